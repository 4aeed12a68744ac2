"""The catalog of monitored products: expansion, validation, results and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.labels import norm_header
from pricetide.functions.scalars import digits, host, import_price, is_public_host, valid_gtin

# Products a plan may monitor, and headings that a sheet may bear.
PLAN_LIMITS = {"starter": 50, "business": 350, "pro": 1000}
HEADINGS = {
    "name": ("product", "product name", "name", "izdelek", "naziv", "naziv izdelka"), "ean": ("ean", "gtin", "barcode", "ean gtin"), "own_price": ("your price", "own price", "price", "lastna cena", "vasa cena", "cena"),
    "sku": ("sku", "sifra"), "notes": ("notes", "opombe"),
}
EXAMPLE = "(?i)example product"


def unique_products(products: DataFrame) -> DataFrame:
    """One row a code, the first by id, with a right check digit."""
    w = Window.partitionBy("ean").orderBy("id")
    rows = products.withColumn("ean", digits(F.col("ean"))).where(valid_gtin(F.col("ean")))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("ean", "name")


#: Parts over which an owner's codes are dealt where they meet the owner's stores, and the tasks of that join.
PARTS, TASKS = 64, 256


def _codes(products: DataFrame) -> DataFrame:
    return products.select("owner", digits(F.col("ean")).alias("ean")).where(valid_gtin(F.col("ean"))).distinct()


def _stores(websites: DataFrame) -> DataFrame:
    return websites.select("owner", host(F.col("url")).alias("host")).where(is_public_host(F.col("host"))).distinct()


def _meet(codes: DataFrame, stores: DataFrame) -> DataFrame:
    """Each code with each row of its owner's stores, made where it is read: codes are dealt over many tasks, and only rows of stores are copied."""
    dealt = codes.withColumn("_part", F.pmod(F.xxhash64("ean"), F.lit(PARTS))).repartition(TASKS, "owner", "_part")
    copies = stores.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))).repartition(TASKS, "owner", "_part")
    return dealt.join(copies, ["owner", "_part"]).drop("_part")


def expand_searches(products: DataFrame, websites: DataFrame) -> DataFrame:
    """Every product at every store that its owner monitors: an equi-join on the owner, as a catalog has no other pairs."""
    return _meet(_codes(products), _stores(websites)).select("owner", "ean", "host")


#: What rows of one code must agree in.
DETAILS = ("name", "sku", "notes", "own_price_cents", "alert_on_price_drop", "alert_on_restock", "alert_target_price_cents", "alert_drop_percent_bps")


def conflicts(products: DataFrame) -> DataFrame:
    """Codes that rows bear with different details, and the number of their variants; null is a value like any other."""
    details = F.to_json(F.struct(*DETAILS))
    return products.groupBy("ean").agg(F.count_distinct(details).alias("variants")).where("variants > 1")


def new_pairs(products: DataFrame, websites: DataFrame, existing: DataFrame) -> DataFrame:
    """ean, host, owner: the pairs of `expand_searches`, each once, that `existing` (ean, host) doesn't hold.

    Of the pairs none moves: a code brings the hosts at which it is known, and
    meets its owner's stores in blocks from which these are taken.
    """
    known = existing.where("host IS NOT NULL").groupBy("ean").agg(F.collect_set("host").alias("_known"))
    codes = _codes(products).join(known, "ean", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))
    blocks = _stores(websites).groupBy("owner", F.pmod(F.xxhash64("host"), F.lit(PARTS))).agg(F.collect_list("host").alias("_hosts")).select("owner", "_hosts")
    return _meet(codes, blocks).select("ean", F.explode(F.array_except("_hosts", "_known")).alias("host"), "owner")


def backfill_hostname(rows: DataFrame, url: str = "website_url") -> DataFrame:
    """Rows with `hostname` from their address where it is missing or empty."""
    return rows.withColumn("hostname", F.coalesce(F.nullif("hostname", F.lit("")), host(F.col(url))))


def duplicate_profiles(profiles: DataFrame) -> DataFrame:
    """Hosts and signatures, in small letters, that more than one profile bears, with how many and the first id."""
    key = [F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("host", "signature")]
    return profiles.select("id", *key).groupBy("host", "signature").agg(F.count("*").alias("profiles"), F.min("id").alias("first_id")).where("profiles > 1")


def website_usage(websites: DataFrame, products: DataFrame) -> DataFrame:
    used = products.groupBy("owner", "host").agg(F.count("*").alias("products"))
    return websites.withColumn("host", host(F.col("url"))).join(used, ["owner", "host"], "left").select("id", "owner", "host", F.coalesce("products", F.lit(0)).alias("products"), F.col("products").isNull().alias("deletable"))


def inventory(websites: DataFrame, products: DataFrame) -> DataFrame:
    urls = websites.select("url").unionByName(products.select(F.col("website_url").alias("url")))
    return urls.select(host(F.col("url")).alias("host")).where(is_public_host(F.col("host"))).distinct()


# Bounds of a product's fields.
NAME_CHARS, SKU_CHARS, NOTES_CHARS, MOST_CENTS, MOST_BPS = (2, 180), 80, 500, 1_000_000_000, 10_000


def validate(products: DataFrame) -> DataFrame:
    """Each product with its errors, comma-joined; valid ones have none. sku, notes and alert_target_price_cents may be absent.

    A website's address is http or https, without credentials, on a standard
    port, and of a public host.
    """
    has = lambda c: F.col(c) if c in products.columns else F.lit(None)
    wrong = lambda c, fits: F.coalesce(~fits, F.lit(False)) & c.isNotNull()
    amount = lambda c: wrong(has(c), has(c).between(0, MOST_CENTS))
    url = F.trim("website_url")
    open_ = url.rlike(r"(?i)^https?://[^/?#@]+([/?#]|$)") & ~url.rlike(r"^[^/]*//[^/?#]*:(?!(80|443)([/?#]|$))[^/?#]*([/?#]|$)")
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.length(F.trim("name")).between(*NAME_CHARS), F.lit(False)), "name"),
            F.when(~F.coalesce(valid_gtin(digits(F.col("ean"))), F.lit(False)), "ean"),
            F.when(wrong(has("sku"), F.length(F.trim(has("sku"))) <= SKU_CHARS), "sku"),
            F.when(wrong(has("notes"), F.length(F.trim(has("notes"))) <= NOTES_CHARS), "notes"),
            F.when(amount("own_price_cents"), "own_price"),
            F.when(amount("alert_target_price_cents"), "alert_target_price"),
            F.when(~F.coalesce(F.col("alert_drop_percent_bps").between(1, MOST_BPS), F.lit(True)), "alert_drop_percent"),
            F.when(~F.coalesce(open_ & is_public_host(host(url)), F.lit(False)), "website"),
        )
    )
    return products.select("id", F.array_join(errors, ",").alias("errors"))


def apply_results(base: DataFrame, results: DataFrame) -> DataFrame:
    """The latest result of each product: a find replaces the offer, any other result only the status."""
    latest = results.groupBy("product_id").agg(F.max_by(F.struct("status", "price_cents", "currency", "in_stock", "started_at"), F.struct("started_at", "id")).alias("r"))
    found = F.coalesce(F.col("r.status") == "found", F.lit(False))
    pick = lambda c: F.when(found, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
    joined = base.join(latest, "product_id", "left")
    return joined.select("id", F.coalesce("r.status", "status").alias("status"), pick("price_cents"), pick("currency"), pick("in_stock"), F.coalesce("r.started_at", "last_checked_at").alias("last_checked_at"))


def bulk_action(base: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """rescan queues, pause and resume switch monitoring of the named products."""
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    rows = base.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    status = F.when(hit & F.lit(action == "rescan"), "queued").otherwise(F.col("status"))
    on = F.when(hit & F.lit(action in ("pause", "resume")), F.lit(action == "resume")).otherwise(F.col("monitoring_enabled"))
    return rows.select(*(status.alias(c) if c == "status" else on.alias(c) if c == "monitoring_enabled" else F.col(c) for c in base.columns))


def patch_settings(base: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """Only given keys change; a patch names them in `given`, so that null can be given."""
    p = patches.select("id", "given", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(p, "id", "left")
    new = lambda c: F.when(F.coalesce(F.array_contains("given", c), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*(new(c) if c in columns else F.col(c) for c in base.columns))


def seed_websites(products: DataFrame) -> DataFrame:
    return products.groupBy("owner", "website_url").agg(F.min("created_at").alias("created_at")).withColumn("host", host(F.col("website_url")))


def quota(products: DataFrame, plans: DataFrame) -> DataFrame:
    limit = F.lit(None).cast("int")
    for plan, n in PLAN_LIMITS.items():
        limit = F.when(F.col("plan") == plan, n).otherwise(limit)
    used = products.groupBy("owner").agg(F.count("*").alias("used"))
    rows = plans.join(used, "owner", "left").select("owner", "plan", F.coalesce("used", F.lit(0)).alias("used"), limit.alias("most"))
    return rows.withColumn("left", F.greatest(F.lit(0), F.col("most") - F.col("used")))


def mark_superseded(runs: DataFrame) -> DataFrame:
    """Runs that a later run of the same product has overtaken count as stale."""
    w = Window.partitionBy("product_id")
    latest = F.max(F.struct("started_at", "id")).over(w)
    stale = F.struct("started_at", "id") != latest
    return runs.select("product_id", "id", F.when(stale, "needs_review").otherwise(F.col("status")).alias("status"), F.when(stale, "stale_result").otherwise(F.col("reason_code")).alias("reason_code"))


def stuck_claims(products: DataFrame, now: str, minutes: int = 15) -> DataFrame:
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")
    return products.where((F.col("status") == "searching") & (F.coalesce("last_checked_at", "created_at") < limit)).select("id")


def import_sheet(raw: DataFrame) -> DataFrame:
    """Products of a sheet read without a heading: columns row_id and cells (array).

    The first row with headings for name and code is the heading; a heading may
    go on after its name ("EAN koda"), and the first column that fits counts.
    Rows above it, rows without a name or code, and the example's row go. A find
    of the heading row's place is one aggregate.
    """
    rows = raw.withColumn("_norm", F.transform("cells", norm_header))

    def position(names: tuple[str, ...]) -> Column:
        fits = lambda h: F.exists(F.array(*map(F.lit, names)), lambda n: (h == n) | h.startswith(F.concat(n, F.lit(" "))))
        return F.nullif(F.array_position(F.transform("_norm", fits), True), F.lit(0))

    place = {k: position(names) for k, names in HEADINGS.items()}
    heads = rows.where(place["name"].isNotNull() & place["ean"].isNotNull())
    head = heads.agg(F.min_by(F.struct(*(p.alias(k) for k, p in place.items())), "row_id").alias("h"), F.min("row_id").alias("at"))
    body = raw.join(F.broadcast(head), F.col("row_id") > F.col("at"))
    cell = lambda k: F.get("cells", (F.col(f"h.{k}") - 1).cast("int"))
    named = body.select("row_id", F.trim(cell("name")).alias("name"), digits(cell("ean")).alias("ean"), import_price(cell("own_price")).alias("own_price_cents"), F.trim(cell("sku")).alias("sku"), F.trim(cell("notes")).alias("notes"))
    return named.where((F.col("name") != "") & (F.col("ean") != "") & ~F.col("name").rlike(EXAMPLE))
