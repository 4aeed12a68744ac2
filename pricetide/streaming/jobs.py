"""Structured Streaming forms of the run and snapshot operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pricetide.functions.scalars import BACKOFF_SECONDS, DAY_CAP, PERMANENT, ratio

FAILED = ("blocked", "unavailable", "needs_review")


def run_metrics(runs: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rates of tumbling windows; rows later than the watermark are dropped and counted by the query's progress."""
    timed = runs.withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", late)
    n = F.count("*")
    out = timed.groupBy(F.window("started_at", width).alias("w")).agg(
        n.alias("runs"), ratio(F.count_if(F.col("status").isin("found", "not_found")), n).alias("operational_success_rate"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.sum("duration_ms").alias("response_ms")
    )
    return out.select(F.col("w.start").alias("window_start"), "runs", "operational_success_rate", "blocked", "response_ms")


def insert_once(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


_STATE = "total long, found long, blocked long, streak long, response_ms long"
_OUT = "host string, id long, total_checks long, successful_checks long, blocked_checks long, consecutive_failures long, total_response_ms long"


def domain_state(runs: DataFrame) -> DataFrame:
    """Counters of a host after each of its runs; the state is five numbers a host. Runs of a batch count by time, then id."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, found, blocked, streak, ms = state.get if state.exists else (0, 0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["started_at", "id"])
        out = []
        for i, status, d in zip(rows["id"], rows["status"], rows["duration_ms"], strict=True):
            total, found, blocked = total + 1, found + (status == "found"), blocked + (status == "blocked")
            streak, ms = streak + 1 if status in FAILED else 0, ms + (0 if pd.isna(d) else int(d))
            out.append((key[0], i, total, found, blocked, streak, ms))
        state.update((total, found, blocked, streak, ms))
        yield pd.DataFrame(out, columns=["host", "id", "total_checks", "successful_checks", "blocked_checks", "consecutive_failures", "total_response_ms"])

    cols = runs.select("host", "id", "status", "duration_ms", F.col("started_at").cast("timestamp").alias("started_at"))
    return cols.groupBy("host").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def health_buckets(events: DataFrame, longest: int = 24 * 60, late: str = "1 hour") -> DataFrame:
    """One alert for each rule, host and stretch of the rule's cooldown, as `alerts.dedupe_buckets` gives it.

    Each rule has its own width, cooldown_minutes, of a static join; none is wider than
    `longest` minutes, so that no stretch is closed before all its events within `late` are in.
    events has rule_id, host, detected_at and cooldown_minutes.
    """
    seconds = F.col("cooldown_minutes").cast("long") * 60
    bucket = F.floor(F.unix_seconds(F.col("detected_at").cast("timestamp")) / seconds).cast("long")
    dealt = events.withColumns({"at": F.col("detected_at").cast("timestamp"), "bucket": bucket, "starts": F.timestamp_seconds(bucket * seconds)})
    timed = dealt.withWatermark("starts", f"{longest * 60 + int(pd.Timedelta(late).total_seconds())} seconds")
    out = timed.groupBy("rule_id", "host", "bucket", "starts").agg(F.min("at").alias("first_detected_at"), F.count("*").alias("raised"))
    return out.select("rule_id", "host", "bucket", "first_detected_at", "raised")


_COOLDOWN_OUT = "host string, id long, reason_code string, failures int, cooldown_until timestamp"
_COOLDOWN_STATE = "reasons array<string>, failures array<int>"


def cooldowns(runs: DataFrame) -> DataFrame:
    """The wait that each temporary failure of a host begins, as `ops.cooldowns` gives it: the base delay, doubled with each failure by reason.

    The state of a host is the number of failures by reason since its last find,
    which clears them. A trigger's runs of one host count by time, then id.
    """
    base = {r: s for s, reasons in BACKOFF_SECONDS.items() for r in reasons}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reasons, failures = state.get if state.exists else ([], [])
        held, out = dict(zip(reasons, failures, strict=True)), []
        rows = pd.concat(list(batches)).sort_values(["started_at", "id"])
        for i, status, reason, at in zip(rows["id"], rows["status"], rows["reason_code"], rows["started_at"], strict=True):
            if status == "found":
                held = {}
            elif reason not in (*PERMANENT, "found"):
                held[reason] = held.get(reason, 0) + 1
                ms = min(base.get(reason, 15) * 1000 * 2 ** min(10, held[reason] - 1), (24 if reason in DAY_CAP else 6) * 3_600_000)
                out.append((key[0], i, reason, held[reason], at + pd.Timedelta(ms, "ms")))
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["host", "id", "reason_code", "failures", "cooldown_until"])

    cols = runs.select("host", "id", "status", "reason_code", F.col("started_at").cast("timestamp").alias("started_at"))
    return cols.groupBy("host").applyInPandasWithState(fold, _COOLDOWN_OUT, _COOLDOWN_STATE, "append", GroupStateTimeout.NoTimeout)


_ALERT_OUT = "product_id long, id long, captured_at timestamp, alert_type string"
_ALERT_STATE = "prices array<double>, currencies array<string>, stocks array<int>"


def customer_alerts(snaps: DataFrame) -> DataFrame:
    """Alerts of each snapshot as `alerts.customer` gives them; the state of a product is its last two snapshots.

    snaps has product_id, id, captured_at, price_cents, currency, in_stock and
    the product's settings (own_price_cents, alert_on_price_drop,
    alert_on_restock, alert_target_price_cents, alert_drop_percent_bps) from a
    static join.
    """
    none = lambda v: None if v is None or pd.isna(v) else v

    def fell(a: float | None, b: float | None) -> int:
        return math.floor((a - b) / a * 10_000 + 0.5) if a and b is not None and a > 0 else 0

    def judge(r, last: tuple, before: tuple) -> list[str]:
        price, own, target, limit = r.price_cents, none(r.own_price_cents), none(r.alert_target_price_cents), none(r.alert_drop_percent_bps)
        on, restock = none(r.alert_on_price_drop) in (None, True), none(r.alert_on_restock) in (None, True)
        prior = last[0] if last[1] == r.currency else None
        earlier = before[0] if before[1] == r.currency else None
        tests = {
            "price_drop": on and prior is not None and price < prior,
            "below_target_price": on and target is not None and price <= target and (prior is None or prior > target),
            "percentage_price_drop": on and limit is not None and fell(prior, price) >= limit and fell(earlier, prior) < limit,
            "below_own_price": on and own is not None and price < own and (last[0] is None or last[0] >= own),
            "restock": restock and last[2] is False and none(r.in_stock) is True,
        }
        return [name for name, met in tests.items() if met]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = [(p, c, None if s < 0 else bool(s)) for p, c, s in zip(*state.get, strict=True)] if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values(["captured_at", "id"]).itertuples():
            last, before = (seen[-1:] or [(None, None, None)])[0], (seen[-2:-1] or [(None, None, None)])[0]
            if none(r.price_cents) is not None and none(r.currency) is not None:
                out += [(key[0], r.id, r.captured_at, kind) for kind in judge(r, last, before)]
            seen = [*seen[-1:], (none(r.price_cents), none(r.currency), none(r.in_stock))]
        state.update(([p for p, _, _ in seen], [c for _, c, _ in seen], [-1 if s is None else int(s) for _, _, s in seen]))
        yield pd.DataFrame(out, columns=["product_id", "id", "captured_at", "alert_type"])

    settings = ("own_price_cents", "alert_on_price_drop", "alert_on_restock", "alert_target_price_cents", "alert_drop_percent_bps")
    cols = snaps.select(F.col("product_id").cast("long").alias("product_id"), F.col("id").cast("long").alias("id"), F.col("captured_at").cast("timestamp").alias("captured_at"), "price_cents", "currency", "in_stock", *settings)
    return cols.groupBy("product_id").applyInPandasWithState(fold, _ALERT_OUT, _ALERT_STATE, "append", GroupStateTimeout.NoTimeout)
