"""Price history: summaries, pages and previous observations of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.scalars import half_up


def summary_by_currency(snaps: DataFrame) -> DataFrame:
    """One aggregate gives extremes, average, count, first and latest price of each product and currency."""
    at = F.struct("captured_at", "id")
    out = snaps.groupBy("product_id", "currency").agg(
        F.min("price_cents").alias("min_price_cents"),
        F.max("price_cents").alias("max_price_cents"),
        half_up(F.avg("price_cents")).cast("long").alias("average_price_cents"),
        F.count("*").alias("observations"),
        F.max_by("price_cents", at).alias("latest_price_cents"),
        F.max("captured_at").alias("latest_captured_at"),
        F.min_by("price_cents", at).alias("first_price_cents"),
    )
    change = F.col("latest_price_cents") - F.col("first_price_cents")
    percent = F.when(F.col("first_price_cents") != 0, half_up(change / F.col("first_price_cents") * 10_000) / 100)
    return out.withColumns({"change_cents": change, "change_percent": percent})


def summary(snaps: DataFrame) -> DataFrame:
    """The one currency's summary of a product, else nulls with all observations."""
    each = summary_by_currency(snaps)
    one = lambda c: F.when(F.count("*") == 1, F.first(c)).alias(c)
    names = ["min_price_cents", "max_price_cents", "average_price_cents", "latest_price_cents", "latest_captured_at", "change_cents", "change_percent"]
    return each.groupBy("product_id").agg(*(one(c) for c in names), F.sum("observations").alias("observations"))


def site_change(snaps: DataFrame) -> DataFrame:
    at = F.struct("captured_at", "id")
    return snaps.groupBy("product_id", "host", "currency").agg((F.max_by("price_cents", at) - F.min_by("price_cents", at)).alias("change_cents"), F.count("*").alias("points"))


def scaled_series(snaps: DataFrame) -> DataFrame:
    """Prices scaled to 0..1 within product and currency; 0.5 where all are equal."""
    w = Window.partitionBy("product_id", "currency")
    low, high = F.min("price_cents").over(w), F.max("price_cents").over(w)
    span = high - low
    scaled = F.when(span == 0, 0.5).otherwise((F.col("price_cents") - low) / span)
    return snaps.select("product_id", "currency", "id", scaled.alias("scaled"), low.alias("low_cents"), high.alias("high_cents"))


def with_previous(snaps: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each snapshot with its product's two before it."""
    w = Window.partitionBy("product_id").orderBy("captured_at", "id")
    out = snaps
    for n, name in ((1, "previous"), (2, "before_previous")):
        for c in keep or ["price_cents", "currency", "in_stock"]:
            out = out.withColumn(f"{name}_{c}", F.lag(c, n).over(w))
    return out


def page(snaps: DataFrame, product_id: int, cursor: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Newest first from behind a cursor (captured_at, id); one row more than the limit tells that a page follows."""
    n = 100 if limit is None else max(1, min(250, limit))
    rows = snaps.where(F.col("product_id") == product_id)
    if cursor:
        t = F.lit(cursor[0]).cast(snaps.schema["captured_at"].dataType)
        rows = rows.where((F.col("captured_at") < t) | ((F.col("captured_at") == t) & (F.col("id") < cursor[1])))
    return rows.orderBy(F.desc("captured_at"), F.desc("id")).limit(n + 1)


def snapshot_view(snaps: DataFrame) -> DataFrame:
    return snaps.select("product_id", "id", "captured_at", "price_cents", "currency", "in_stock", F.when(F.col("exact_ean"), 100).otherwise(0).alias("ean_confidence"), half_up(F.col("name_similarity_bps") / 100).cast("long").alias("name_confidence"))


def to_snapshots(results: DataFrame) -> DataFrame:
    """Results that are worth a snapshot: found, with price, currency and url."""
    return results.where((F.col("status") == "found") & F.col("price_cents").isNotNull() & F.col("currency").isNotNull() & F.col("website_url").isNotNull())


def insert_guarded(new: DataFrame, runs: DataFrame, products: DataFrame) -> DataFrame:
    """New rows whose run and product still exist."""
    return new.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi").join(products.select(F.col("id").alias("product")), "product", "left_semi")


def between(snaps: DataFrame, first: str | None, last: str | None) -> Column:
    """Inclusive bounds; text that is no instant bounds nothing."""
    t, out = F.col("captured_at").cast("timestamp"), F.lit(True)
    if first is not None:
        out = out & F.coalesce(t >= F.try_to_timestamp(F.lit(first)), F.lit(True))
    if last is not None:
        out = out & F.coalesce(t <= F.try_to_timestamp(F.lit(last)), F.lit(True))
    return out
