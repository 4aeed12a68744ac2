"""Customer alerts on price and stock, and alerts on the health of hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions.scalars import half_up
from pricetide.operators.history import with_previous
from pricetide.operators.policy import live_rules, meet_all


def customer(snaps: DataFrame, catalog: DataFrame) -> DataFrame:
    """Alerts of each snapshot: product_id, id, alert_type. Catalog rows are one a product.

    A missing flag counts as on. Drop, target and percentage need the previous
    price in the same currency; below-own and restock take any previous one.
    Target, percentage and below-own fire as the price crosses, not while it stays.
    """
    seen = with_previous(snaps).where(F.col("price_cents").isNotNull() & F.col("currency").isNotNull())
    rows = seen.join(catalog.select("product_id", "own_price_cents", "alert_on_price_drop", "alert_on_restock", "alert_target_price_cents", "alert_drop_percent_bps"), "product_id")
    price, prior = F.col("price_cents"), F.when(F.col("previous_currency") == F.col("currency"), F.col("previous_price_cents"))
    before = F.when(F.col("before_previous_currency") == F.col("currency"), F.col("before_previous_price_cents"))
    drop = lambda a, b: F.when(a.isNotNull() & b.isNotNull() & (a > 0), half_up((a - b) / a * 10_000)).otherwise(0)
    on, target, own = F.coalesce("alert_on_price_drop", F.lit(True)), F.col("alert_target_price_cents"), F.col("own_price_cents")
    limit = F.col("alert_drop_percent_bps")
    tests = {
        "price_drop": on & (price < prior),
        "below_target_price": on & (price <= target) & (prior.isNull() | (prior > target)),
        "percentage_price_drop": on & (drop(prior, price) >= limit) & (drop(before, prior) < limit),
        "below_own_price": on & (price < own) & (F.col("previous_price_cents").isNull() | (F.col("previous_price_cents") >= own)),
        "restock": F.coalesce("alert_on_restock", F.lit(True)) & ~F.col("previous_in_stock") & F.col("in_stock"),
    }
    kinds = F.array_compact(F.array(*(F.when(t, name) for name, t in tests.items())))
    return rows.select("product_id", "id", "captured_at", F.explode(kinds).alias("alert_type"))


def outbox(events: DataFrame) -> DataFrame:
    """Open alerts with a key that a second delivery of the same event repeats."""
    key = F.concat_ws(":", F.col("product_id").cast("string"), "alert_type", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return events.select("product_id", "alert_type", F.lit("open").alias("state"), key.alias("dedupe_key")).dropDuplicates(["dedupe_key"])


def match_rules(hosts: DataFrame, rules: DataFrame, now: str) -> DataFrame:
    """Hosts with the live rules for them or for all."""
    live = live_rules(rules, now).withColumnRenamed("host", "rule_host")
    own = hosts.join(live, F.col("host") == F.col("rule_host"))
    return own.unionByName(meet_all(hosts, "host", live.where("rule_host = '*'")))


def health(state: DataFrame, rules: DataFrame, now: str) -> DataFrame:
    """open or resolved for each host and rule with enough checks; state has host, total, operational and streak."""
    rows = match_rules(state, rules, now)
    bps = F.when(F.col("total_checks") > 0, half_up(F.col("operational") / F.col("total_checks") * 10_000)).otherwise(10_000).cast("long")
    fine = (F.col("success_bps") >= F.col("minimum_success_rate_bps")) & (F.col("consecutive_failures") < F.col("maximum_consecutive_failures"))
    judged = rows.withColumn("success_bps", bps).where(F.col("total_checks") >= F.col("minimum_checks"))
    return judged.select(F.col("id").alias("rule_id"), "host", "success_bps", "consecutive_failures", "cooldown_minutes", F.when(fine, "resolved").otherwise("open").alias("state"))


def dedupe_buckets(events: DataFrame, at: str = "detected_at") -> DataFrame:
    """The first open alert of each rule, host and stretch of the rule's cooldown."""
    bucket = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000 / (F.col("cooldown_minutes") * 60)).cast("long")
    return events.withColumn("bucket", bucket).groupBy("rule_id", "host", "bucket").agg(F.min(at).alias("first_detected_at"), F.count("*").alias("raised"))
