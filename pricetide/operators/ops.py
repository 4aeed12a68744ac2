"""Crawl operations: rates, counters, streaks and back-off from the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pricetide.functions.scalars import backoff_ms, failure_class, half_up, ratio, redact_url

FAILED = ("blocked", "unavailable", "needs_review")
DAYS = 30


def recent(runs: DataFrame, now: str, days: int = DAYS) -> DataFrame:
    return runs.where(F.col("started_at") > F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def _is(*status: str) -> Column:
    return F.col("status").isin(*status)


def summary(runs: DataFrame, now: str, days: int = DAYS) -> DataFrame:
    """One row of rates, throughput and response times over the window.

    Runs are counted by what the figures read before they meet in one row, so
    that the exact percentiles hold a number for each different duration alone.
    """
    like = recent(runs, now, days).groupBy("status", "challenge_type", "reason_code", "duration_ms").agg(F.count("*").alias("n"))
    n, done = F.coalesce(F.sum("n"), F.lit(0)), lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    rate = lambda c, name: ratio(done(c), n).alias(name)
    return like.agg(
        n.alias("runs"),
        rate(_is("found", "not_found"), "operational_success_rate"),
        rate(_is("found"), "match_rate"),
        rate(_is("blocked"), "blocked_rate"),
        rate(_is("unavailable"), "unavailable_rate"),
        rate(F.col("challenge_type").isNotNull(), "challenge_rate"),
        rate(F.col("challenge_type") == "captcha", "captcha_rate"),
        rate(F.col("reason_code") == "rate_limited", "rate_limited_rate"),
        (n / F.lit(days * 24.0)).alias("throughput_per_hour"),
        half_up(F.percentile("duration_ms", 0.5, F.col("n"))).cast("long").alias("median_response_ms"),
        half_up(F.percentile("duration_ms", 0.95, F.col("n"))).cast("long").alias("p95_response_ms"),
    )


def domain_counters(runs: DataFrame) -> DataFrame:
    """Counters and last values of each host, as a fold of its runs would leave them."""
    at, kind = F.struct("started_at", "id"), failure_class(F.col("reason_code"))
    last = lambda c, name: F.max_by(c, at).alias(name)
    last_known = lambda c, name: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(name)
    return runs.groupBy("host").agg(
        F.count("*").alias("total_checks"),
        *(F.count_if(_is(s)).alias(f"{n}_checks") for s, n in (("found", "successful"), ("not_found", "not_found"), ("blocked", "blocked"), ("unavailable", "unavailable"), ("needs_review", "needs_review"))),
        F.count_if(kind == "temporary").alias("temporary_failure_checks"),
        F.count_if(kind == "permanent").alias("permanent_failure_checks"),
        F.count("challenge_type").alias("challenge_checks"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_response_ms"),
        F.count("duration_ms").alias("response_samples"),
        last("status", "last_outcome"),
        last("reason_code", "last_reason_code"),
        last_known("challenge_type", "last_challenge_type"),
        last_known("duration_ms", "last_response_ms"),
        F.max("started_at").alias("last_checked_at"),
        F.max(F.when(_is("found"), F.col("started_at"))).alias("last_success_at"),
    )


def domain_health(runs: DataFrame, now: str, days: int = DAYS) -> DataFrame:
    """Ratios of each host, and its latest failure within the window."""
    c = domain_counters(runs)
    failed = recent(runs, now, days).where(_is("blocked", "unavailable", "needs_review", "error"))
    last = failed.groupBy("host").agg(F.max_by(F.struct("status", "reason_code", "started_at"), F.struct("started_at", "id")).alias("f"))
    total = F.col("total_checks")
    return c.join(last, "host", "left").select(
        "host",
        "total_checks",
        ratio(F.col("successful_checks") + F.col("not_found_checks"), total).alias("success_rate"),
        ratio(F.col("challenge_checks"), total).alias("challenge_rate"),
        ratio(F.col("blocked_checks"), total).alias("blocked_rate"),
        F.when(F.col("response_samples") > 0, half_up(F.col("total_response_ms") / F.col("response_samples")).cast("long")).alias("average_response_ms"),
        F.col("f.status").alias("failure_status"),
        F.col("f.reason_code").alias("failure_reason"),
        F.col("f.started_at").alias("failure_at"),
    )


def _segments(runs: DataFrame) -> DataFrame:
    """Runs with their segment, a day of a host: rows are put in order within segments, so that no task takes a whole host. Null hosts are one host, null times its first day."""
    return runs.withColumn("_seg", F.struct("host", F.coalesce(F.to_date("started_at"), F.lit("0001-01-01").cast("date")).alias("day")))


def _up_to() -> WindowSpec:
    """The rows of a segment up to one's own."""
    return Window.partitionBy("_seg").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, 0)


def _days(last: int | None = None) -> WindowSpec:
    """A host's segments, of which there is one row each; up to one's own (0) or the one before (-1)."""
    w = Window.partitionBy("_seg.host").orderBy("_seg.day")
    return w if last is None else w.rowsBetween(Window.unboundedPreceding, last)


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Failures in a row of each host after each run; found and not_found reset.

    A day's runs count among themselves; those before its first reset add what the days before left open.
    """
    failed = F.when(_is(*FAILED), 1).otherwise(0)
    islands = _segments(runs).withColumn("_island", F.sum(1 - failed).over(_up_to()))
    inside = Window.partitionBy("_seg", "_island").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = islands.withColumn("_own", F.sum(failed).over(inside))
    last = rows.groupBy("_seg").agg(F.max("_island").alias("resets"), F.max_by("_own", F.struct("started_at", "id")).alias("open"))
    chained = last.withColumn("chain", F.sum(F.when(F.col("resets") > 0, 1).otherwise(0)).over(_days(0)))
    left_open = F.sum("open").over(Window.partitionBy("_seg.host", "chain").orderBy("_seg.day").rowsBetween(Window.unboundedPreceding, 0))
    carried = chained.withColumn("left_open", left_open).select("_seg", F.coalesce(F.lag("left_open").over(_days()), F.lit(0)).alias("_carry"))
    total = F.col("_own") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    return rows.join(carried, "_seg").select("host", "id", "started_at", "status", total.alias("consecutive_failures"))


def domain_state_history(runs: DataFrame) -> DataFrame:
    """Counters of a host after each of its runs: those of the day so far, and those of the days before."""
    sums = {
        "total_checks": F.lit(1), "successful_checks": F.when(_is("found"), 1).otherwise(0), "blocked_checks": F.when(_is("blocked"), 1).otherwise(0), "total_response_ms": F.coalesce("duration_ms", F.lit(0)),
    }
    found_at, challenged = F.when(_is("found"), F.col("started_at")), F.col("challenge_type").isNotNull()
    rows = _segments(runs)
    ends = [F.sum(c).alias(n) for n, c in sums.items()] + [F.max_by(F.when(challenged, F.col("challenge_type")), F.when(challenged, F.struct("started_at", "id"))).alias("challenge"), F.max(found_at).alias("found_at")]
    days = rows.groupBy("_seg").agg(*ends)
    before = [F.coalesce(F.sum(n).over(_days(-1)), F.lit(0)).alias(f"_{n}") for n in sums] + [F.last("challenge", True).over(_days(-1)).alias("_challenge"), F.max("found_at").over(_days(-1)).alias("_found_at")]
    own = [F.sum(c).over(_up_to()).alias(n) for n, c in sums.items()] + [F.last("challenge_type", True).over(_up_to()).alias("challenge"), F.max(found_at).over(_up_to()).alias("found_at")]
    both = rows.select("_seg", "host", "id", *own).join(days.select("_seg", *before), "_seg")
    return both.select("host", "id", *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums), F.coalesce("challenge", "_challenge").alias("last_challenge_type"), F.coalesce("found_at", "_found_at").alias("last_success_at"))


def cooldowns(runs: DataFrame) -> DataFrame:
    """Host and reason of each temporary failure run: how many since the host's last find, and the wait that follows.

    A day's failures count among themselves; those before its first find add what
    the days since the last find left open, one count a reason.
    """
    marked = _segments(runs).withColumn("_island", F.sum(F.when(_is("found"), 1).otherwise(0)).over(_up_to()))
    temporary = F.coalesce(failure_class(F.col("reason_code")) == "temporary", F.lit(False))
    ends = marked.groupBy("_seg").agg(F.max("_island").alias("finds"))
    spans = ends.withColumn("chain", F.sum(F.when(F.col("finds") > 0, 1).otherwise(0)).over(_days(0)))
    counts = marked.where(temporary).groupBy("_seg", "reason_code", "_island").agg(F.count("*").alias("n"))
    # what precedes a day's first find goes with the find before, what follows its last find with that one; the rest ends within the day
    edges = counts.join(spans, "_seg").where((F.col("_island") == 0) | (F.col("_island") == F.col("finds")))
    edges = edges.select("_seg", "reason_code", "n", (F.col("chain") - F.when((F.col("_island") == 0) & (F.col("finds") > 0), 1).otherwise(0)).alias("chain"), (F.col("_island") == 0).alias("head"))
    same = Window.partitionBy("_seg.host", "reason_code", "chain").orderBy("_seg.day").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("carry", F.coalesce(F.sum("n").over(same), F.lit(0))).where("head AND carry > 0")
    by_reason = carried.groupBy("_seg").agg(F.collect_list(F.struct("reason_code", "carry")).alias("_carry"))
    own = F.row_number().over(Window.partitionBy("_seg", "reason_code", "_island").orderBy("started_at", "id"))
    rows = marked.where(temporary).withColumn("_own", own).join(by_reason, "_seg", "left")
    open_ = F.coalesce(F.get(F.filter("_carry", lambda c: c["reason_code"].eqNullSafe(F.col("reason_code"))), 0)["carry"], F.lit(0))
    n = (F.col("_own") + F.when(F.col("_island") == 0, open_).otherwise(0)).cast("int")
    return rows.select("host", "reason_code", "id", "started_at", n.alias("failures")).withColumn("backoff_ms", backoff_ms(F.col("failures"), F.col("reason_code"), F.lit(None).cast("long")))


def availability(runs: DataFrame, now: str) -> DataFrame:
    """Whether a host may be asked now: the latest wait of its open reasons is over."""
    open_ = cooldowns(runs)
    found = runs.where(_is("found")).groupBy("host").agg(F.max(F.struct("started_at", "id")).alias("found_at"))
    last = open_.join(found, "host", "left").where(F.col("found_at").isNull() | (F.struct("started_at", "id") > F.col("found_at")))
    until = F.timestamp_add("MILLISECOND", F.col("backoff_ms"), F.col("started_at"))
    tops = last.withColumn("until", until).groupBy("host").agg(F.max(F.struct("until", "reason_code")).alias("t"))
    t = F.lit(now).cast("timestamp_ntz")
    waits = F.coalesce(F.col("t.until") > t, F.lit(False))
    return runs.select("host").distinct().join(tops, "host", "left").select("host", (~waits).alias("allowed"), F.when(waits, F.col("t.until")).alias("retry_at"), F.when(waits, F.col("t.reason_code")).alias("reason_code"))


def audit_view(runs: DataFrame, limit: int = 100) -> DataFrame:
    """Newest runs without owner, product, code and address."""
    return runs.select("id", "host", "status", "reason_code", "challenge_type", "duration_ms", "started_at").orderBy(F.desc("started_at"), F.desc("id")).limit(max(1, min(500, limit)))


def needs_review(runs: DataFrame, limit: int = 100) -> DataFrame:
    return audit_view(runs.where(_is("needs_review")), limit)


def recent_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """The latest runs of any status."""
    return audit_view(runs, limit)


def last_failure(runs: DataFrame) -> DataFrame:
    return audit_view(runs.where(_is(*FAILED)), 1)


def latest_run_attempts(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts, by ordinal, of the latest run of each product; addresses are redacted."""
    latest = runs.groupBy("product_id").agg(F.max_by("id", F.struct("started_at", "id")).alias("run_id"))
    return attempts.join(latest, "run_id").select("product_id", "run_id", "ordinal", redact_url(F.col("url")).alias("url"), "outcome")
