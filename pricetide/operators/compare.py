"""Comparison of the offers for one product code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.scalars import digits, host


def eligible() -> Column:
    return (F.col("status") == "found") & (F.col("in_stock") == True) & F.col("price_cents").isNotNull()  # noqa: E712


def cheapest_by_currency(products: DataFrame) -> DataFrame:
    """The cheapest found offer in stock of each code and currency; null where none is."""
    best = F.min_by(F.struct("id", "price_cents"), F.when(eligible(), F.struct("price_cents", "id")))
    rows = products.where(F.col("currency").isNotNull()).groupBy("ean", "currency").agg(F.count_if(eligible()).alias("n"), best.alias("b"))
    found = F.col("n") > 0
    return rows.select("ean", "currency", F.when(found, F.col("b.id")).alias("id"), F.when(found, F.col("b.price_cents")).alias("price_cents"))


def cheapest(products: DataFrame) -> DataFrame:
    """The overall cheapest offer of codes whose offers, eligible or not, have one currency."""
    each = cheapest_by_currency(products)
    return each.groupBy("ean").agg(F.count("*").alias("currencies"), F.first("id").alias("one_id"), F.first("price_cents").alias("one_price")).select(
        "ean", "currencies", F.when(F.col("currencies") == 1, F.col("one_id")).alias("id"), F.when(F.col("currencies") == 1, F.col("one_price")).alias("price_cents")
    )


def groups(products: DataFrame) -> DataFrame:
    """Offers of codes that more than one offer bears."""
    return products.join(products.groupBy("ean").count().where("count > 1").select("ean"), "ean", "left_semi")


def gap(products: DataFrame) -> DataFrame:
    """Cents above the cheapest eligible offer of the same code and currency."""
    least = F.min(F.when(eligible(), F.col("price_cents"))).over(Window.partitionBy("ean", "currency"))
    return products.where(F.col("price_cents").isNotNull()).select("id", "ean", "currency", "price_cents", (F.col("price_cents") - least).alias("gap_cents"))


def group_key() -> Column:
    d = digits(F.coalesce("ean", F.lit("")))
    return F.when(d != "", d).otherwise(F.lower(F.trim("name")))


def group_status(products: DataFrame) -> DataFrame:
    """Found on n sites, k of n found, Searching or Queued where all wait, else the first status by id that isn't waiting."""
    rows = products.withColumn("group_key", group_key()).groupBy("group_key")
    waits = F.col("status").isin("queued", "searching")
    n, found, waiting = F.count("*"), F.count_if(F.col("status") == "found"), F.count_if(waits)
    other = F.min_by("status", F.when(~waits, F.col("id")))
    label = (
        F.when(found == n, F.concat(F.lit("Found on "), n.cast("string"), F.when(found == 1, " site").otherwise(" sites")))
        .when(found > 0, F.concat(found.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" found")))
        .when(waiting == n, F.when(F.count_if(F.col("status") == "searching") > 0, "Searching").otherwise("Queued"))
        .otherwise(F.when(other == "not_found", "Not found").otherwise(F.replace(other, F.lit("_"), F.lit(" "))))
    )
    return rows.agg(label.alias("label"), F.max("last_checked_at").alias("last_checked_at"))


def group_stock(products: DataFrame) -> DataFrame:
    known = F.count("in_stock")
    label = F.when(known == 0, "—").when(F.bool_and("in_stock"), "In stock").when(~F.bool_or("in_stock"), "Out of stock").otherwise("Mixed")
    return products.withColumn("group_key", group_key()).groupBy("group_key").agg(label.alias("stock"))


def kpis(products: DataFrame) -> DataFrame:
    return products.withColumn("group_key", group_key()).agg(
        F.count_distinct("group_key").alias("products"),
        F.count_if(F.col("status") == "found").alias("found"),
        F.count_if(F.col("status").isin("queued", "searching")).alias("waiting"),
        F.count("price_cents").alias("priced"),
    )


def reasons(products: DataFrame, within: str = "owner", most: int = 6) -> DataFrame:
    """The first distinct reasons, by the smallest id that bears them, of the products of each `within` that weren't found."""
    failing = products.where(F.col("reason_code") != "found").groupBy(within, "reason_code").agg(F.min("id").alias("first"))
    ranked = F.array_sort(F.collect_list(F.struct("first", "reason_code")))
    return failing.groupBy(within).agg(F.array_join(F.transform(F.slice(ranked, 1, most), lambda r: r["reason_code"]), ",").alias("reasons"))


def price_dropped(products: DataFrame, summaries: DataFrame) -> DataFrame:
    """Products below their own price, or with a currency in which the price fell since the first observation.

    summaries has product_id and change_cents, a row for each product and currency.
    """
    fell = summaries.where("change_cents < 0").select("product_id").distinct().withColumn("_fell", F.lit(True))
    rows = products.join(fell, "product_id", "left")
    return rows.where((F.col("price_cents") < F.col("own_price_cents")) | F.col("_fell")).select("id", "ean", "price_cents", "own_price_cents")


def rank_offers(products: DataFrame) -> DataFrame:
    """In stock before unknown before the rest, then the lower price, then the later check."""
    stock = F.when((F.col("status") == "found") & F.col("in_stock"), 2).when((F.col("status") == "found") & F.col("in_stock").isNull(), 1).otherwise(0)
    w = Window.partitionBy("ean").orderBy(F.desc("stock_rank"), F.asc_nulls_last("price_cents"), F.desc_nulls_first("last_checked_at"), "id")
    return products.withColumn("stock_rank", stock).select("ean", "id", "stock_rank", F.row_number().over(w).alias("place"))


def filter_groups(products: DataFrame, text: str | None = None, in_stock: bool | None = None, status: str | None = None, least: int | None = None, most: int | None = None, drops: bool = False, attention: bool = False, site: str | None = None, stock_unknown: bool = False, summaries: DataFrame | None = None) -> DataFrame:
    """Offers of groups in which, for each condition, some member meets it; different members may meet different ones.

    A text is looked for in name, code, address and sku (which may be absent). A drop is a
    price below the own one, or, with `summaries` (product_id, change_cents; a row
    for each product and currency), one below the first of its currency; it needs attention too.
    """
    tests: list[Column] = []
    dropped = F.coalesce(F.col("price_cents") < F.col("own_price_cents"), F.lit(False))
    if summaries is not None and (drops or attention):
        fell = summaries.where("change_cents < 0").select(F.col("product_id").alias("_product")).distinct().withColumn("_fell", F.lit(True))
        columns = products.columns
        products = products.join(fell, F.col("product_id") == F.col("_product"), "left").select(*columns, "_fell")
        dropped = dropped | F.col("_fell").isNotNull()
    if text and text.strip():
        tests.append(F.lower(F.concat_ws(" ", "name", "ean", "website_url", *(["sku"] if "sku" in products.columns else []))).contains(text.strip().lower()))
    if site:
        tests.append(host(F.col("website_url")) == site.lower().removeprefix("www."))
    if in_stock is not None:
        tests.append(F.col("in_stock") == in_stock)
    if stock_unknown:
        tests.append(F.col("in_stock").isNull())
    if status:
        tests.append(F.col("status") == status)
    if least is not None:
        tests.append(F.col("price_cents") >= least)
    if most is not None:
        tests.append(F.col("price_cents") <= most)
    if drops:
        tests.append(dropped)
    if attention:
        tests.append(F.coalesce(F.col("status").isin("needs_review", "blocked", "unavailable", "error"), F.lit(False)) | dropped)
    keyed = products.withColumn("group_key", group_key())
    if not tests:
        return keyed
    flags = keyed.groupBy("group_key").agg(*(F.bool_or(F.coalesce(t, F.lit(False))).alias(f"t{k}") for k, t in enumerate(tests)))
    met = flags.where(" AND ".join(f"t{k}" for k in range(len(tests)))).select("group_key")
    return keyed.drop("_fell").join(met, "group_key", "left_semi")
