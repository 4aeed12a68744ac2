"""Queries over the reference domain, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import scalars as S
from pricetide.operators import alerts, catalog, compare, exports, history, ops, pages, policy, schedule, tables
from pricetide.plans.adapters import domain, oracle
from pricetide.plans.registry import register
from pricetide.sources import readers

NOW = "2024-01-31 00:00:00"


def query(name: str, needs: str, sql: str | None = None):
    """Registers a function of the named domain tables."""

    def keep(f):
        register(name, None if sql is None else oracle(sql))(lambda spark, sf_dir: f(*(domain(spark, sf_dir, n) for n in needs.split())))
        return f

    return keep


_SUMMARY = """SELECT product_id, currency, min(price_cents) AS min_price_cents, max(price_cents) AS max_price_cents, CAST(floor(avg(price_cents) + 0.5) AS BIGINT) AS average_price_cents,
    count(*) AS observations, arg_max(price_cents, (captured_at, id)) AS latest_price_cents, max(captured_at) AS latest_captured_at, arg_min(price_cents, (captured_at, id)) AS first_price_cents FROM snapshots GROUP BY ALL"""
_CHANGED = f"SELECT *, latest_price_cents - first_price_cents AS change_cents, CASE WHEN first_price_cents <> 0 THEN floor((latest_price_cents - first_price_cents) / first_price_cents * 10000 + 0.5) / 100 END AS change_percent FROM ({_SUMMARY})"


@query("history_summary_by_currency", "snapshots", _CHANGED)
def _(snaps: DataFrame) -> DataFrame:
    return history.summary_by_currency(snaps)


_ONE = ["min_price_cents", "max_price_cents", "average_price_cents", "latest_price_cents", "latest_captured_at", "change_cents", "change_percent"]


@query("history_summary", "snapshots", f"SELECT product_id, {', '.join(f'CASE WHEN count(*) = 1 THEN any_value({c}) END AS {c}' for c in _ONE)}, CAST(sum(observations) AS BIGINT) AS observations FROM ({_CHANGED}) GROUP BY product_id")
def _(snaps: DataFrame) -> DataFrame:
    return history.summary(snaps)


@query("history_site_change", "snapshots", "SELECT product_id, host, currency, arg_max(price_cents, (captured_at, id)) - arg_min(price_cents, (captured_at, id)) AS change_cents, count(*) AS points FROM snapshots GROUP BY ALL")
def _(snaps: DataFrame) -> DataFrame:
    return history.site_change(snaps)


@query(
    "history_scaled_series",
    "snapshots",
    """SELECT product_id, currency, id, CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (price_cents - lo) / (hi - lo) END AS scaled, lo AS low_cents, hi AS high_cents
    FROM (SELECT *, min(price_cents) OVER w AS lo, max(price_cents) OVER w AS hi FROM snapshots WINDOW w AS (PARTITION BY product_id, currency))""",
)
def _(snaps: DataFrame) -> DataFrame:
    return history.scaled_series(snaps)


@query(
    "history_with_previous",
    "snapshots",
    "SELECT product_id, id, lag(price_cents) OVER w AS previous_price_cents, lag(currency) OVER w AS previous_currency, lag(price_cents, 2) OVER w AS before_previous_price_cents FROM snapshots WINDOW w AS (PARTITION BY product_id ORDER BY captured_at, id)",
)
def _(snaps: DataFrame) -> DataFrame:
    return history.with_previous(snaps).select("product_id", "id", "previous_price_cents", "previous_currency", "before_previous_price_cents")


@query("history_page", "snapshots", "SELECT product_id, id, captured_at, price_cents FROM snapshots WHERE product_id = 7 AND (captured_at < '1999-06-01' OR captured_at = '1999-06-01' AND id < 5) ORDER BY captured_at DESC, id DESC LIMIT 11")
def _(snaps: DataFrame) -> DataFrame:
    return history.page(snaps, 7, ("1999-06-01", 5), 10).select("product_id", "id", "captured_at", "price_cents")


@query(
    "history_snapshot_view",
    "snapshots",
    "SELECT product_id, id, captured_at, price_cents, currency, in_stock, CASE WHEN exact_ean THEN 100 ELSE 0 END AS ean_confidence, CAST(floor(name_similarity_bps / 100 + 0.5) AS BIGINT) AS name_confidence FROM snapshots",
)
def _(snaps: DataFrame) -> DataFrame:
    return history.snapshot_view(snaps)


@query("history_to_snapshots", "products", "SELECT id, price_cents, currency FROM products WHERE status = 'found' AND price_cents IS NOT NULL AND currency IS NOT NULL AND website_url IS NOT NULL")
def _(products: DataFrame) -> DataFrame:
    return history.to_snapshots(products).select("id", "price_cents", "currency")


@query("history_insert_guarded", "snapshots runs products", "SELECT id, product_id FROM snapshots WHERE id % 20000 IN (SELECT id FROM runs WHERE status = 'found') AND product_id || '-' || store_id IN (SELECT id FROM products WHERE monitoring_enabled)")
def _(snaps: DataFrame, runs: DataFrame, products: DataFrame) -> DataFrame:
    new = snaps.withColumn("run_id", F.col("id") % 20000).withColumn("product", F.concat_ws("-", "product_id", "store_id"))
    return history.insert_guarded(new, runs.where("status = 'found'"), products.where("monitoring_enabled")).select("id", "product_id")


@query("exports_products", "products", "SELECT id, owner, host, name, ean, status, price_cents / 100 AS price, currency, in_stock, last_checked_at, created_at FROM products WHERE status = 'found' ORDER BY created_at DESC, id DESC LIMIT 10000")
def _(products: DataFrame) -> DataFrame:
    return exports.products(products, matches_only=True)


@query("exports_price_history", "snapshots", "SELECT product_id, id, host, price_cents / 100 AS price, currency, in_stock, captured_at FROM snapshots WHERE captured_at BETWEEN '1997-01-01' AND '1998-12-31' ORDER BY captured_at DESC, id DESC, product_id LIMIT 10000")
def _(snaps: DataFrame) -> DataFrame:
    return exports.price_history(snaps, first="1997-01-01", last="1998-12-31")


@query("exports_workbook", "products", "SELECT name AS product, ean, website_url AS website, own_price_cents / 100 AS own_price, price_cents / 100 AS found_price, currency, CASE WHEN in_stock THEN 'Yes' WHEN NOT in_stock THEN 'No' ELSE '' END AS stock, status, last_checked_at AS last_check FROM products")
def _(products: DataFrame) -> DataFrame:
    return exports.workbook(products)


@query("exports_csv_cell", "products", "SELECT id, CASE WHEN substr(id, 1, 1) IN ('=', '+', '-', '@') THEN '''' || id ELSE id END AS cell, CASE WHEN id LIKE '1%' THEN '''=' || id ELSE coalesce(currency, '') END AS other FROM products")
def _(products: DataFrame) -> DataFrame:
    other = F.when(F.col("id").startswith("1"), F.concat(F.lit("="), "id")).otherwise(F.col("currency"))
    return products.select("id", S.csv_cell(F.col("id")).alias("cell"), S.csv_cell(other).alias("other"))


_OK = "status = 'found' AND in_stock AND price_cents IS NOT NULL"
_CHEAP = f"SELECT ean, currency, arg_min(id, (price_cents, id)) FILTER ({_OK}) AS id, min(price_cents) FILTER ({_OK}) AS price_cents FROM products WHERE currency IS NOT NULL GROUP BY ALL"


@query("compare_cheapest_by_currency", "products", _CHEAP)
def _(products: DataFrame) -> DataFrame:
    return compare.cheapest_by_currency(products)


@query("compare_cheapest", "products", f"SELECT ean, count(*) AS currencies, CASE WHEN count(*) = 1 THEN any_value(id) END AS id, CASE WHEN count(*) = 1 THEN any_value(price_cents) END AS price_cents FROM ({_CHEAP}) GROUP BY ean")
def _(products: DataFrame) -> DataFrame:
    return compare.cheapest(products)


@query("compare_groups", "products", "SELECT id, ean FROM products WHERE ean IN (SELECT ean FROM products GROUP BY ean HAVING count(*) > 1)")
def _(products: DataFrame) -> DataFrame:
    return compare.groups(products).select("id", "ean")


@query("compare_gap", "products", f"SELECT id, ean, currency, price_cents, price_cents - min(price_cents) FILTER ({_OK}) OVER (PARTITION BY ean, currency) AS gap_cents FROM products WHERE price_cents IS NOT NULL")
def _(products: DataFrame) -> DataFrame:
    return compare.gap(products)


@query(
    "compare_group_status",
    "products",
    """SELECT ean AS group_key, CASE WHEN f = n THEN 'Found on ' || n || CASE WHEN f = 1 THEN ' site' ELSE ' sites' END WHEN f > 0 THEN f || ' of ' || n || ' found' WHEN s + q = n THEN CASE WHEN s > 0 THEN 'Searching' ELSE 'Queued' END WHEN other = 'not_found' THEN 'Not found' ELSE replace(other, '_', ' ') END AS label, last_checked_at
    FROM (SELECT ean, count(*) AS n, count(*) FILTER (status = 'found') AS f, count(*) FILTER (status = 'searching') AS s, count(*) FILTER (status = 'queued') AS q, arg_min(status, id) FILTER (status NOT IN ('queued', 'searching')) AS other, max(last_checked_at) AS last_checked_at FROM products GROUP BY ean)""",
)
def _(products: DataFrame) -> DataFrame:
    return compare.group_status(products)


@query("compare_group_stock", "products", "SELECT ean AS group_key, CASE WHEN count(in_stock) = 0 THEN '—' WHEN bool_and(in_stock) THEN 'In stock' WHEN NOT bool_or(in_stock) THEN 'Out of stock' ELSE 'Mixed' END AS stock FROM products GROUP BY ean")
def _(products: DataFrame) -> DataFrame:
    return compare.group_stock(products)


@query("compare_kpis", "products", "SELECT count(DISTINCT ean) AS products, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status IN ('queued', 'searching')) AS waiting, count(price_cents) AS priced FROM products")
def _(products: DataFrame) -> DataFrame:
    return compare.kpis(products)


@query(
    "compare_reasons",
    "products runs",
    """SELECT owner, array_to_string(list(reason_code ORDER BY first)[1:6], ',') AS reasons FROM (SELECT owner, reason_code, min(id) AS first FROM products JOIN
    (SELECT product_id, arg_max(reason_code, (started_at, id)) AS reason_code FROM runs GROUP BY 1) r USING (product_id) WHERE reason_code <> 'found' GROUP BY ALL) GROUP BY owner""",
)
def _(products: DataFrame, runs: DataFrame) -> DataFrame:
    latest = runs.groupBy("product_id").agg(F.max_by("reason_code", F.struct("started_at", "id")).alias("reason_code"))
    return compare.reasons(products.join(latest, "product_id"))


@query(
    "compare_rank_offers",
    "products",
    """SELECT ean, id, r AS stock_rank, row_number() OVER (PARTITION BY ean ORDER BY r DESC, price_cents ASC NULLS LAST, last_checked_at DESC NULLS FIRST, id) AS place
    FROM (SELECT *, CASE WHEN status = 'found' AND in_stock THEN 2 WHEN status = 'found' AND in_stock IS NULL THEN 1 ELSE 0 END AS r FROM products)""",
)
def _(products: DataFrame) -> DataFrame:
    return compare.rank_offers(products)


@query("compare_filter_groups", "products", "SELECT id, ean FROM products WHERE ean IN (SELECT ean FROM products GROUP BY ean HAVING bool_or(name LIKE '%ring%') AND bool_or(coalesce(in_stock, false)) AND bool_or(coalesce(price_cents >= 150000, false)) AND bool_or(coalesce(price_cents <= 120000, false)) AND bool_or(coalesce(price_cents < own_price_cents, false)))")
def _(products: DataFrame) -> DataFrame:
    return compare.filter_groups(products, text="RING", in_stock=True, least=150_000, most=120_000, drops=True).select("id", "ean")


_RATE = "CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER ({}) / count(*) END AS {}"
_RATES = ", ".join(
    _RATE.format(c, n)
    for c, n in (
        ("status IN ('found', 'not_found')", "operational_success_rate"),
        ("status = 'found'", "match_rate"),
        ("status = 'blocked'", "blocked_rate"),
        ("status = 'unavailable'", "unavailable_rate"),
        ("challenge_type IS NOT NULL", "challenge_rate"),
        ("challenge_type = 'captcha'", "captcha_rate"),
        ("reason_code = 'rate_limited'", "rate_limited_rate"),
    )
)


@query(
    "ops_summary",
    "runs",
    f"SELECT count(*) AS runs, {_RATES}, count(*) / 720 AS throughput_per_hour, CAST(floor(quantile_cont(duration_ms, 0.5) + 0.5) AS BIGINT) AS median_response_ms, CAST(floor(quantile_cont(duration_ms, 0.95) + 0.5) AS BIGINT) AS p95_response_ms FROM runs WHERE started_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY",
)
def _(runs: DataFrame) -> DataFrame:
    return ops.summary(runs, NOW)


_PERMANENT = ", ".join(f"'{r}'" for r in S.PERMANENT)
_COUNTERS = f"""SELECT host, count(*) AS total_checks, count(*) FILTER (status = 'found') AS successful_checks, count(*) FILTER (status = 'not_found') AS not_found_checks, count(*) FILTER (status = 'blocked') AS blocked_checks,
    count(*) FILTER (status = 'unavailable') AS unavailable_checks, count(*) FILTER (status = 'needs_review') AS needs_review_checks, count(*) FILTER (reason_code <> 'found' AND reason_code NOT IN ({_PERMANENT})) AS temporary_failure_checks,
    count(*) FILTER (reason_code IN ({_PERMANENT})) AS permanent_failure_checks, count(challenge_type) AS challenge_checks, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_response_ms, count(duration_ms) AS response_samples,
    arg_max(status, (started_at, id)) AS last_outcome, arg_max(reason_code, (started_at, id)) AS last_reason_code, arg_max(challenge_type, (started_at, id)) FILTER (challenge_type IS NOT NULL) AS last_challenge_type,
    arg_max(duration_ms, (started_at, id)) FILTER (duration_ms IS NOT NULL) AS last_response_ms, max(started_at) AS last_checked_at, max(started_at) FILTER (status = 'found') AS last_success_at FROM runs GROUP BY host"""


@query("ops_domain_counters", "runs", _COUNTERS)
def _(runs: DataFrame) -> DataFrame:
    return ops.domain_counters(runs)


@query(
    "ops_domain_health",
    "runs",
    f"""SELECT c.host, total_checks, (successful_checks + not_found_checks) / total_checks AS success_rate, challenge_checks / total_checks AS challenge_rate, blocked_checks / total_checks AS blocked_rate,
    CASE WHEN response_samples > 0 THEN CAST(floor(total_response_ms / response_samples + 0.5) AS BIGINT) END AS average_response_ms, f.status AS failure_status, f.reason_code AS failure_reason, f.started_at AS failure_at
    FROM ({_COUNTERS}) c LEFT JOIN (SELECT * FROM runs WHERE status IN ('blocked', 'unavailable', 'needs_review', 'error') AND started_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY
        QUALIFY row_number() OVER (PARTITION BY host ORDER BY started_at DESC, id DESC) = 1) f ON c.host = f.host""",
)
def _(runs: DataFrame) -> DataFrame:
    return ops.domain_health(runs, NOW)


_STREAKS = """SELECT host, id, started_at, status, CAST(sum(CASE WHEN status IN ('blocked', 'unavailable', 'needs_review') THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY started_at, id) AS BIGINT) AS consecutive_failures
    FROM (SELECT *, sum(CASE WHEN status IN ('blocked', 'unavailable', 'needs_review') THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY started_at, id) AS island FROM runs)"""


@query("ops_failure_streaks", "runs", _STREAKS)
def _(runs: DataFrame) -> DataFrame:
    return ops.failure_streaks(runs)


@query(
    "ops_domain_state_history",
    "runs",
    """SELECT host, id, count(*) OVER w AS total_checks, CAST(sum(CASE WHEN status = 'found' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS successful_checks, CAST(sum(CASE WHEN status = 'blocked' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS blocked_checks,
    CAST(sum(coalesce(duration_ms, 0)) OVER w AS BIGINT) AS total_response_ms, last_value(challenge_type IGNORE NULLS) OVER w AS last_challenge_type, max(CASE WHEN status = 'found' THEN started_at END) OVER w AS last_success_at
    FROM runs WINDOW w AS (PARTITION BY host ORDER BY started_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(runs: DataFrame) -> DataFrame:
    return ops.domain_state_history(runs)


_BASES = "CASE " + " ".join(f"WHEN reason_code IN ({', '.join(repr(r) for r in rs)}) THEN {s}" for s, rs in S.BACKOFF_SECONDS.items()) + " ELSE 15 END"
_COOL = f"""SELECT host, reason_code, id, started_at, failures, CAST(least({_BASES} * 1000 * pow(2, least(10, failures - 1)), CASE WHEN reason_code IN ('captcha', 'login_wall', 'robots_disallowed') THEN 86400000 ELSE 21600000 END) AS BIGINT) AS backoff_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY host, reason_code, island ORDER BY started_at, id) AS failures FROM
    (SELECT *, sum(CASE WHEN status = 'found' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY started_at, id) AS island FROM runs) WHERE reason_code <> 'found' AND reason_code NOT IN ({_PERMANENT}))"""


@query("ops_cooldowns", "runs", _COOL)
def _(runs: DataFrame) -> DataFrame:
    return ops.cooldowns(runs)


_THEN = "2024-01-29 22:30:00"


@query(
    "ops_availability",
    "runs",
    f"""SELECT h.host, NOT coalesce(u > TIMESTAMP '{_THEN}', false) AS allowed, CASE WHEN u > TIMESTAMP '{_THEN}' THEN u END AS retry_at, CASE WHEN u > TIMESTAMP '{_THEN}' THEN r END AS reason_code
    FROM (SELECT DISTINCT host FROM runs) h LEFT JOIN (SELECT host, max((started_at + to_milliseconds(backoff_ms))) AS u, arg_max(reason_code, (started_at + to_milliseconds(backoff_ms), reason_code)) AS r FROM ({_COOL}) c
        WHERE NOT EXISTS (SELECT 1 FROM runs f WHERE f.host = c.host AND f.status = 'found' AND (f.started_at, f.id) > (c.started_at, c.id)) GROUP BY host) t ON h.host = t.host""",
)
def _(runs: DataFrame) -> DataFrame:
    return ops.availability(runs, _THEN)


@query("ops_audit_view", "runs", "SELECT id, host, status, reason_code, challenge_type, duration_ms, started_at FROM runs ORDER BY started_at DESC, id DESC LIMIT 500")
def _(runs: DataFrame) -> DataFrame:
    return ops.audit_view(runs, 9999)


@query("ops_needs_review", "runs", "SELECT id, host, status, reason_code, challenge_type, duration_ms, started_at FROM runs WHERE status = 'needs_review' ORDER BY started_at DESC, id DESC LIMIT 100")
def _(runs: DataFrame) -> DataFrame:
    return ops.needs_review(runs)


@query("ops_last_failure", "runs", "SELECT id, host, status, reason_code, challenge_type, duration_ms, started_at FROM runs WHERE status IN ('blocked', 'unavailable', 'needs_review') ORDER BY started_at DESC, id DESC LIMIT 1")
def _(runs: DataFrame) -> DataFrame:
    return ops.last_failure(runs)


@query(
    "ops_latest_run_attempts",
    "runs",
    "SELECT product_id, id AS run_id, CAST(g AS INT) AS ordinal, 'https://' || host || '/p?q=' || g || '&token=[redacted]' AS url, status AS outcome FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY started_at DESC, id DESC) = 1), generate_series(1, 2) t(g)",
)
def _(runs: DataFrame) -> DataFrame:
    url = F.concat(F.lit("https://me:pw@"), "host", F.lit("/p?q="), F.col("ordinal").cast("string"), F.lit("&token=abc"), "status")
    attempts = runs.select(F.col("id").alias("run_id"), "host", "status", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal")).select("run_id", "ordinal", url.alias("url"), F.col("status").alias("outcome"))
    return ops.latest_run_attempts(runs, attempts)


_LAGS = """SELECT s.*, lag(price_cents) OVER w AS p1, lag(currency) OVER w AS c1, lag(in_stock) OVER w AS s1, lag(price_cents, 2) OVER w AS p2, lag(currency, 2) OVER w AS c2 FROM snapshots s WINDOW w AS (PARTITION BY product_id ORDER BY captured_at, id)"""
_ALERTS = f"""SELECT product_id, id, captured_at, unnest(list_filter([CASE WHEN on_drop AND price_cents < q1 THEN 'price_drop' END,
        CASE WHEN on_drop AND price_cents <= target AND (q1 IS NULL OR q1 > target) THEN 'below_target_price' END,
        CASE WHEN on_drop AND coalesce(CASE WHEN q1 > 0 THEN floor((q1 - price_cents) / q1 * 10000 + 0.5) END, 0) >= bps AND coalesce(CASE WHEN q2 > 0 AND q1 IS NOT NULL THEN floor((q2 - q1) / q2 * 10000 + 0.5) END, 0) < bps THEN 'percentage_price_drop' END,
        CASE WHEN on_drop AND price_cents < own AND (p1 IS NULL OR p1 >= own) THEN 'below_own_price' END, CASE WHEN on_stock AND NOT s1 AND in_stock THEN 'restock' END], lambda x: x IS NOT NULL)) AS alert_type
    FROM (SELECT l.*, CASE WHEN c1 = currency THEN p1 END AS q1, CASE WHEN c2 = currency THEN p2 END AS q2, coalesce(a.d, true) AS on_drop, coalesce(a.r, true) AS on_stock, a.t AS target, a.b AS bps, a.o AS own FROM ({_LAGS}) l JOIN
        (SELECT product_id, arg_min(alert_on_price_drop, store_id) AS d0, any_value(alert_on_price_drop) AS d, any_value(alert_on_restock) AS r, any_value(alert_target_price_cents) AS t, any_value(alert_drop_percent_bps) AS b, any_value(own_price_cents) AS o FROM products GROUP BY product_id) a USING (product_id))"""


def _catalog(products: DataFrame) -> DataFrame:
    """One row a product: the settings that the adapter derives from the product alone."""
    keep = ["own_price_cents", "alert_on_price_drop", "alert_on_restock", "alert_target_price_cents", "alert_drop_percent_bps"]
    return products.groupBy("product_id").agg(*(F.first(c).alias(c) for c in keep))


@query("alerts_customer", "snapshots products", _ALERTS)
def _(snaps: DataFrame, products: DataFrame) -> DataFrame:
    return alerts.customer(snaps, _catalog(products))


@query("alerts_outbox", "snapshots products", f"SELECT DISTINCT product_id, alert_type, 'open' AS state, product_id || ':' || alert_type || ':' || strftime(captured_at, '%Y-%m-%dT%H:%M:%S') AS dedupe_key FROM ({_ALERTS})")
def _(snaps: DataFrame, products: DataFrame) -> DataFrame:
    return alerts.outbox(alerts.customer(snaps, _catalog(products)))


_STATE = f"SELECT host, id, started_at, total_checks, operational, consecutive_failures FROM (SELECT *, count(*) OVER w AS total_checks, sum(CASE WHEN status IN ('found', 'not_found') THEN 1 ELSE 0 END) OVER w AS operational FROM ({_STREAKS}) WINDOW w AS (PARTITION BY host ORDER BY started_at, id))"


def _state(runs: DataFrame) -> DataFrame:
    counts = ops.domain_state_history(runs).select("id", "total_checks")
    done = ops.failure_streaks(runs).join(counts, "id")
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("started_at", "id")
    return done.select("host", F.col("id").alias("run_id"), "started_at", "total_checks", F.sum(F.when(F.col("status").isin("found", "not_found"), 1).otherwise(0)).over(w).alias("operational"), "consecutive_failures")


_HEALTH = f"""SELECT r.id AS rule_id, s.host, s.started_at, success_bps, consecutive_failures, cooldown_minutes, CASE WHEN success_bps >= minimum_success_rate_bps AND consecutive_failures < maximum_consecutive_failures THEN 'resolved' ELSE 'open' END AS state
    FROM (SELECT *, CAST(floor(operational / total_checks * 10000 + 0.5) AS BIGINT) AS success_bps FROM ({_STATE})) s JOIN rules r ON (r.host = s.host OR r.host = '*') AND r.enabled AND (r.expires_at IS NULL OR r.expires_at > TIMESTAMP '{NOW}') AND total_checks >= minimum_checks"""


@query("alerts_health", "runs rules", f"SELECT rule_id, host, success_bps, consecutive_failures, cooldown_minutes, state FROM ({_HEALTH}) QUALIFY row_number() OVER (PARTITION BY rule_id, host ORDER BY started_at DESC) = 1")
def _(runs: DataFrame, rules: DataFrame) -> DataFrame:
    last = _state(runs).groupBy("host").agg(F.max_by(F.struct("total_checks", "operational", "consecutive_failures"), F.struct("started_at", "run_id")).alias("s")).select("host", "s.*")
    return alerts.health(last, rules, NOW)


@query("alerts_dedupe_buckets", "runs rules", f"SELECT rule_id, host, CAST(floor(epoch(started_at) / (cooldown_minutes * 60)) AS BIGINT) AS bucket, min(started_at) AS first_detected_at, count(*) AS raised FROM ({_HEALTH}) WHERE state = 'open' GROUP BY ALL")
def _(runs: DataFrame, rules: DataFrame) -> DataFrame:
    state = _state(runs)
    judged = alerts.match_rules(state, rules, NOW).withColumn("success_bps", S.half_up(F.col("operational") / F.col("total_checks") * 10_000))
    fine = (F.col("success_bps") >= F.col("minimum_success_rate_bps")) & (F.col("consecutive_failures") < F.col("maximum_consecutive_failures"))
    events = judged.where((F.col("total_checks") >= F.col("minimum_checks")) & ~fine).select(F.col("id").alias("rule_id"), "host", "cooldown_minutes", F.col("started_at").alias("detected_at"))
    return alerts.dedupe_buckets(events)


@query("alerts_live_rules", "rules", f"SELECT id, host FROM rules WHERE enabled AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')")
def _(rules: DataFrame) -> DataFrame:
    return policy.live_rules(rules, NOW).select("id", "host")


_VALID = "length(ean) = 13 AND (10 - (" + " + ".join(f"CAST(substr(ean, {i + 1}, 1) AS INT) * {3 if i % 2 else 1}" for i in range(12)) + ") % 10) % 10 = CAST(substr(ean, 13, 1) AS INT)"
_HOST = "regexp_replace(lower(regexp_extract({}, '://([^/:?#]+)', 1)), '^www[.]', '')"


@query("catalog_expand_searches", "products websites", f"SELECT owner, ean, host FROM (SELECT DISTINCT owner, ean FROM products WHERE {_VALID}) JOIN (SELECT DISTINCT owner, {_HOST.format('url')} AS host FROM websites) USING (owner)")
def _(products: DataFrame, websites: DataFrame) -> DataFrame:
    return catalog.expand_searches(products, websites)


@query("catalog_new_pairs", "products websites", f"SELECT DISTINCT ean, w.host, p.owner FROM products p JOIN (SELECT DISTINCT owner, {_HOST.format('url')} AS host FROM websites) w USING (owner) WHERE {_VALID} AND (ean, w.host) NOT IN (SELECT (ean, host) FROM products)")
def _(products: DataFrame, websites: DataFrame) -> DataFrame:
    return catalog.new_pairs(products, websites, products)


_VARIANT = "(name, sku, notes, own_price_cents, alert_on_price_drop, alert_on_restock, alert_target_price_cents, alert_drop_percent_bps)"


@query("catalog_conflicts", "products", f"SELECT ean, count(DISTINCT {_VARIANT}) AS variants FROM (SELECT *, CASE WHEN product_id % 3 = 0 THEN 'S' || store_id END AS sku, CASE WHEN product_id % 4 = 0 AND store_id % 2 = 0 THEN 'note' END AS notes FROM products) GROUP BY ean HAVING count(DISTINCT {_VARIANT}) > 1")
def _(products: DataFrame) -> DataFrame:
    return catalog.conflicts(products.selectExpr("*", "CASE WHEN product_id % 3 = 0 THEN 'S' || store_id END AS sku", "CASE WHEN product_id % 4 = 0 AND store_id % 2 = 0 THEN 'note' END AS notes"))


@query("catalog_website_usage", "websites products", f"SELECT w.id, w.owner, w.host, coalesce(n, 0) AS products, n IS NULL AS deletable FROM (SELECT *, {_HOST.format('url')} AS host FROM websites) w LEFT JOIN (SELECT owner, host, count(*) AS n FROM products GROUP BY ALL) p ON p.owner = w.owner AND p.host = w.host")
def _(websites: DataFrame, products: DataFrame) -> DataFrame:
    return catalog.website_usage(websites, products)


@query("catalog_inventory", "websites products", f"SELECT DISTINCT {_HOST.format('u')} AS host FROM (SELECT url AS u FROM websites UNION ALL SELECT website_url FROM products)")
def _(websites: DataFrame, products: DataFrame) -> DataFrame:
    return catalog.inventory(websites, products)


@query("catalog_validate", "products", f"SELECT id, CASE WHEN {_VALID} THEN '' ELSE 'ean' END AS errors FROM products")
def _(products: DataFrame) -> DataFrame:
    return catalog.validate(products)


_LATEST = "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY started_at DESC, id DESC) = 1"


@query("catalog_apply_results", "products runs", f"SELECT p.id, coalesce(r.status, p.status) AS status, CASE WHEN r.status = 'found' THEN r.duration_ms ELSE price_cents END AS price_cents, CASE WHEN r.status = 'found' THEN 'EUR' ELSE currency END AS currency, CASE WHEN r.status = 'found' THEN true ELSE in_stock END AS in_stock, coalesce(r.started_at, last_checked_at) AS last_checked_at FROM products p LEFT JOIN ({_LATEST}) r ON p.product_id = r.product_id")
def _(products: DataFrame, runs: DataFrame) -> DataFrame:
    results = runs.select("product_id", "id", "status", "started_at", F.col("duration_ms").alias("price_cents"), F.lit("EUR").alias("currency"), F.lit(True).alias("in_stock"))
    return catalog.apply_results(products, results)


@query("catalog_bulk_action", "products schedules", "SELECT id, CASE WHEN id IN (SELECT (id % 200) || '-' || (id % 10) FROM schedules) THEN 'queued' ELSE status END AS status, monitoring_enabled FROM products")
def _(products: DataFrame, schedules: DataFrame) -> DataFrame:
    ids = schedules.select(F.concat((F.col("id") % 200).cast("string"), F.lit("-"), (F.col("id") % 10).cast("string")).alias("id"))
    return catalog.bulk_action(products, ids, "rescan").select("id", "status", "monitoring_enabled")


@query("catalog_patch_settings", "products", "SELECT id, CASE WHEN product_id % 2 = 0 THEN NULL ELSE alert_drop_percent_bps END AS alert_drop_percent_bps, CASE WHEN product_id % 2 = 1 THEN 5 ELSE own_price_cents END AS own_price_cents FROM products")
def _(products: DataFrame) -> DataFrame:
    given = F.when(F.col("product_id") % 2 == 0, F.array(F.lit("alert_drop_percent_bps"))).otherwise(F.array(F.lit("own_price_cents")))
    patches = products.select("id", given.alias("given"), F.lit(None).cast("int").alias("alert_drop_percent_bps"), F.lit(5).cast("long").alias("own_price_cents"))
    return catalog.patch_settings(products, patches, ["alert_drop_percent_bps", "own_price_cents"]).select("id", "alert_drop_percent_bps", "own_price_cents")


@query("catalog_seed_websites", "products", "SELECT owner, website_url, min(created_at) AS created_at, any_value(host) AS host FROM products GROUP BY owner, website_url")
def _(products: DataFrame) -> DataFrame:
    return catalog.seed_websites(products)


@query("catalog_quota", "products websites", "SELECT o.owner, plan, coalesce(n, 0) AS used, m AS most, greatest(0, m - coalesce(n, 0)) AS left FROM (SELECT DISTINCT owner, CASE CAST(substr(owner, 7) AS INT) % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'business' ELSE 'pro' END AS plan, CASE CAST(substr(owner, 7) AS INT) % 3 WHEN 0 THEN 50 WHEN 1 THEN 350 ELSE 1000 END AS m FROM websites) o LEFT JOIN (SELECT owner, count(*) AS n FROM products GROUP BY owner) p ON p.owner = o.owner")
def _(products: DataFrame, websites: DataFrame) -> DataFrame:
    k = F.substring("owner", 7, 9).cast("int") % 3
    plans = websites.select("owner").distinct().withColumn("plan", F.when(k == 0, "starter").when(k == 1, "business").otherwise("pro"))
    return catalog.quota(products, plans)


@query("catalog_mark_superseded", "runs", f"SELECT r.product_id, r.id, CASE WHEN r.id = l.id THEN r.status ELSE 'needs_review' END AS status, CASE WHEN r.id = l.id THEN r.reason_code ELSE 'stale_result' END AS reason_code FROM runs r JOIN ({_LATEST}) l ON l.product_id = r.product_id")
def _(runs: DataFrame) -> DataFrame:
    return catalog.mark_superseded(runs)


@query("catalog_stuck_claims", "products", "SELECT id FROM products WHERE status = 'searching' AND coalesce(last_checked_at, created_at) < TIMESTAMP '1999-01-01' - INTERVAL 15 MINUTE")
def _(products: DataFrame) -> DataFrame:
    return catalog.stuck_claims(products, "1999-01-01 00:00:00")


@query("tables_upsert", "products", "SELECT coalesce(b.id, u.id) AS id, CASE WHEN u.id IS NOT NULL THEN 'queued' ELSE b.status END AS status, coalesce(b.name, u.name) AS name FROM (SELECT * FROM products WHERE product_id % 3 <> 0) b FULL JOIN (SELECT * FROM products WHERE product_id % 2 = 0) u ON b.id = u.id")
def _(products: DataFrame) -> DataFrame:
    base = products.where("product_id % 3 <> 0").select("id", "status", "name")
    new = products.where("product_id % 2 = 0").select("id", F.lit("queued").alias("status"), "name")
    return tables.upsert(base, new, ["id"], ["status"])


@query("tables_insert_ignore", "runs", "SELECT host, min(id) % 2 AS first FROM runs WHERE id % 2 = 0 GROUP BY host UNION ALL SELECT host, 1 FROM runs WHERE id % 2 = 1 AND host NOT IN (SELECT host FROM runs WHERE id % 2 = 0) GROUP BY host")
def _(runs: DataFrame) -> DataFrame:
    base = runs.where("id % 2 = 0").groupBy("host").agg((F.min("id") % 2).alias("first"))
    return tables.insert_ignore(base, runs.where("id % 2 = 1").select("host", F.lit(1).cast("long").alias("first")), ["host"])


@query("tables_apply_if_current", "products", "SELECT id, CASE WHEN product_id % 2 = 0 AND store_id % 5 = 0 THEN 'found' ELSE status END AS status FROM products")
def _(products: DataFrame) -> DataFrame:
    base = products.withColumn("scan", F.col("store_id") % 5)
    results = products.where("product_id % 2 = 0").select("id", F.lit(0).cast("long").alias("scan"), F.lit("found").alias("status"))
    return tables.apply_if_current(base, results, "id", "scan", ["status"]).select("id", "status")


@query("tables_cascade_delete", "products snapshots", "SELECT product_id, id FROM snapshots WHERE product_id || '-' || store_id NOT IN (SELECT id FROM products WHERE status = 'blocked')")
def _(products: DataFrame, snaps: DataFrame) -> DataFrame:
    snaps = snaps.withColumn("product", F.concat_ws("-", "product_id", "store_id"))
    return tables.cascade_delete({"snapshots": (snaps, "product")}, products.where("status = 'blocked'"))["snapshots"].select("product_id", "id")


@query("tables_purge_owner", "products", "SELECT id FROM products WHERE owner <> 'owner-3'")
def _(products: DataFrame) -> DataFrame:
    return tables.purge_owner({"p": products}, "owner-3")["p"].select("id")


@query("tables_dedupe", "snapshots", "SELECT product_id, id, price_cents FROM snapshots QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price_cents DESC, id) = 1")
def _(snaps: DataFrame) -> DataFrame:
    return tables.dedupe(snaps, "product_id", [F.desc("price_cents"), F.asc("id")]).select("product_id", "id", "price_cents")


@query("tables_overlay", "products", "SELECT id, CASE WHEN product_id % 4 = 0 THEN 'fresh' ELSE status END AS status FROM products")
def _(products: DataFrame) -> DataFrame:
    return tables.overlay(products.select("id", "status"), products.where("product_id % 4 = 0").select("id", F.lit("fresh").alias("status")), "id")


@query("tables_newest", "runs", "SELECT id, started_at FROM runs ORDER BY started_at DESC, id DESC LIMIT 25")
def _(runs: DataFrame) -> DataFrame:
    return tables.newest(runs, [F.desc("started_at"), F.desc("id")], 25).select("id", "started_at")


@query("tables_missing_ids", "products schedules", "SELECT DISTINCT (id % 300) || '-' || (id % 10) AS id FROM schedules WHERE (id % 300) || '-' || (id % 10) NOT IN (SELECT id FROM products)")
def _(products: DataFrame, schedules: DataFrame) -> DataFrame:
    ids = schedules.select(F.concat((F.col("id") % 300).cast("string"), F.lit("-"), (F.col("id") % 10).cast("string")).alias("id")).distinct()
    return tables.missing_ids(products, ids)


@query("tables_ttl", "runs", f"SELECT id FROM runs WHERE started_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def _(runs: DataFrame) -> DataFrame:
    return tables.ttl(runs, "started_at", NOW, 7).select("id")


@query("schedule_due", "schedules", f"SELECT id, next_run_at FROM schedules WHERE enabled AND next_run_at <= TIMESTAMP '{NOW}' AND (lease_until IS NULL OR lease_until <= TIMESTAMP '{NOW}') ORDER BY next_run_at, id LIMIT 8")
def _(schedules: DataFrame) -> DataFrame:
    return schedule.due(schedules, NOW)


_LISTED = "SELECT DISTINCT schedule_id, owner, unnest(from_json(j, '[\"VARCHAR\"]')) AS id FROM (SELECT id AS schedule_id, owner, CASE WHEN product_ids_json LIKE '[%' THEN product_ids_json ELSE '[]' END AS j FROM schedules WHERE target_mode = 'selected')"


@query("schedule_explode_targets", "schedules", _LISTED)
def _(schedules: DataFrame) -> DataFrame:
    return schedule.explode_targets(schedules)


@query("schedule_public_view", "schedules", "SELECT id, owner, target_mode, cadence_minutes, enabled, CASE WHEN product_ids_json LIKE '[%' THEN 2 ELSE 0 END AS targets FROM schedules")
def _(schedules: DataFrame) -> DataFrame:
    return schedule.public_view(schedules)


_CYCLE = f"""SELECT schedule_id, p.id, host, last_checked_at, created_at FROM (SELECT s.id AS schedule_id, owner, next_run_at, NULL AS want FROM schedules s WHERE target_mode = 'all'
    UNION ALL SELECT l.schedule_id, l.owner, s.next_run_at, l.id FROM ({_LISTED}) l JOIN schedules s ON s.id = l.schedule_id) c JOIN products p ON p.owner = c.owner AND monitoring_enabled AND (want IS NULL OR want = p.id) AND (last_checked_at IS NULL OR last_checked_at < next_run_at)"""


def _few(schedules: DataFrame) -> DataFrame:
    """The schedules that one tick takes: the first eight that are due, as many as the scheduler allows itself."""
    return schedule.due(schedules, NOW).join(schedules.drop("next_run_at"), "id")


_TICK = f"id IN (SELECT id FROM schedules WHERE enabled AND next_run_at <= TIMESTAMP '{NOW}' AND (lease_until IS NULL OR lease_until <= TIMESTAMP '{NOW}') ORDER BY next_run_at, id LIMIT 8)"
_CYCLE_TICK = _CYCLE.replace("FROM schedules", f"FROM (SELECT * FROM schedules WHERE {_TICK})").replace("JOIN schedules s", f"JOIN (SELECT * FROM schedules WHERE {_TICK}) s")


_PICK = """SELECT schedule_id, id, host, turn FROM (SELECT *, ((pos - cursor_index) % hosts + hosts) % hosts AS turn FROM (SELECT o.*, row_number() OVER (PARTITION BY schedule_id ORDER BY o.host) - 1 AS pos, count(*) OVER (PARTITION BY schedule_id) AS hosts, s.cursor_index
    FROM (SELECT * FROM ({}) QUALIFY row_number() OVER (PARTITION BY schedule_id, host ORDER BY last_checked_at ASC NULLS LAST, created_at, id) = 1) o JOIN schedules s ON s.id = o.schedule_id)) WHERE turn < 4"""


@query("schedule_cycle_products", "products schedules", f"SELECT schedule_id, id, host, last_checked_at FROM ({_CYCLE_TICK})")
def _(products: DataFrame, schedules: DataFrame) -> DataFrame:
    return schedule.cycle_products(products, _few(schedules)).drop("created_at")


@query(
    "schedule_tick_pick",
    "products schedules",
    _PICK.format(_CYCLE_TICK),
)
def _(products: DataFrame, schedules: DataFrame) -> DataFrame:
    return schedule.tick_pick(products, _few(schedules))


@query(
    "schedule_fair_order",
    "products",
    "SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY r, f, id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY owner, host ORDER BY id) AS r, min(id) OVER (PARTITION BY owner, host) AS f FROM products)",
)
def _(products: DataFrame) -> DataFrame:
    return schedule.fair_order(products, ["owner"], "host", "id").select("owner", "id", "place")


@query("schedule_fair_batches", "products")
def _(products: DataFrame) -> DataFrame:
    return schedule.fair_batches(products, ["owner"], "host", "id", 4).select("owner", "id", "host", "batch")


@query("schedule_retest_eligible", "products", "SELECT id, host FROM products WHERE status IN ('blocked', 'needs_review') AND store_id % 4 <> 0 AND host IN ('shop-1.example', 'shop-2.example', 'shop-3.example') AND product_id % 3 = 0")
def _(products: DataFrame) -> DataFrame:
    rows = products.selectExpr("*", "CASE product_id % 3 WHEN 0 THEN 'captcha' WHEN 1 THEN 'timeout' END AS reason_code")
    return schedule.retest_eligible(rows, products.where("store_id % 4 = 0"), ["blocked", "needs_review"], [f"shop-{k}.example" for k in (1, 2, 3)], ["captcha"])


_OUT = "SELECT host, string_agg(status || '=' || n, ',' ORDER BY status || '=' || n) AS outcomes, CAST(sum(n) AS BIGINT) AS runs FROM (SELECT host, status, count(*) AS n FROM runs GROUP BY ALL) GROUP BY host"


@query("schedule_outcomes", "runs", _OUT)
def _(runs: DataFrame) -> DataFrame:
    return schedule.outcomes(runs)


_PENDING = "CASE id % 3 WHEN 0 THEN '{\"found\":2,\"error\":1}' WHEN 1 THEN '{}' END AS pending_outcome_json"


def _ticked(products: DataFrame, schedules: DataFrame) -> DataFrame:
    """Each schedule's picked products, with their own status as the outcome."""
    return schedule.tick_pick(products, schedules).join(products.select("id", "status"), "id").select("schedule_id", "turn", "status")


def _advanced(products: DataFrame, schedules: DataFrame) -> DataFrame:
    made = schedules.selectExpr("*", _PENDING, "next_run_at - INTERVAL '1' DAY AS last_run_at")
    outcomes = _ticked(products, schedules)
    cycle = schedule.cycle_sizes(products, schedules)
    left = cycle.join(outcomes.groupBy("schedule_id").agg(F.count("*").alias("took")), "schedule_id").selectExpr("schedule_id", "n - took AS remaining")
    return schedule.advance(made, outcomes, left, NOW)


def _advance_sql(due: str, cycle: str, pick: str) -> str:
    return f"""SELECT id, CASE WHEN done THEN TIMESTAMP '{NOW}' ELSE next_run_at - INTERVAL 1 DAY END AS last_run_at,
        CASE WHEN NOT done THEN 'Processing ' || (cursor_index + took) || ' of ' || (cursor_index + took + remaining) || ': ' || summary WHEN summary = '' THEN 'No products selected' ELSE summary END AS last_outcome,
        CASE WHEN done THEN TIMESTAMP '{NOW}' + to_minutes(cadence_minutes) ELSE TIMESTAMP '{NOW}' END AS next_run_at, CASE WHEN done THEN 0 ELSE cursor_index + took END AS cursor_index,
        CASE WHEN done THEN '{{}}' ELSE pending END AS pending_outcome_json, remaining
    FROM (WITH picked AS (SELECT schedule_id, status, turn FROM ({pick}) JOIN products USING (id)),
        said AS (SELECT schedule_id, status, count(*) AS n, 10 + min(turn) AS place FROM picked GROUP BY ALL
            UNION ALL SELECT id, unnest(['found', 'error']), unnest([2, 1]), unnest([0, 1]) FROM ({due}) WHERE id % 3 = 0),
        counts AS (SELECT schedule_id, status, sum(n)::BIGINT AS n, min(place) AS place FROM said GROUP BY ALL),
        texts AS (SELECT schedule_id, string_agg(n || ' ' || status, ', ' ORDER BY place) AS summary, '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY place) || '}}' AS pending FROM counts GROUP BY 1),
        sizes AS (SELECT schedule_id, count(*) AS n, any_value(coalesce(took, 0)) AS took FROM ({cycle}) LEFT JOIN (SELECT schedule_id, count(*) AS took FROM picked GROUP BY 1) USING (schedule_id) GROUP BY 1)
        SELECT s.*, coalesce(took, 0) AS took, coalesce(n - took, 0) AS remaining, coalesce(n - took, 0) = 0 AS done, pending,
            CASE WHEN target_mode = 'selected' AND product_ids_json NOT LIKE '[%' THEN '' ELSE coalesce(summary, '') END AS summary
        FROM ({due}) s LEFT JOIN texts x ON x.schedule_id = s.id LEFT JOIN sizes z ON z.schedule_id = s.id)"""


@query("schedule_advance", "products schedules", _advance_sql(f"SELECT * FROM schedules WHERE {_TICK}", _CYCLE_TICK, _PICK.format(_CYCLE_TICK)))
def _(products: DataFrame, schedules: DataFrame) -> DataFrame:
    return _advanced(products, _few(schedules))


def _all_due(schedules: DataFrame) -> DataFrame:
    """Every schedule that is due, as many as there are."""
    t = F.lit(NOW).cast("timestamp_ntz")
    return schedules.where(F.col("enabled") & (F.col("next_run_at") <= t) & (F.col("lease_until").isNull() | (F.col("lease_until") <= t)))


_DUE = f"SELECT * FROM schedules WHERE enabled AND next_run_at <= TIMESTAMP '{NOW}' AND (lease_until IS NULL OR lease_until <= TIMESTAMP '{NOW}')"
_CYCLE_DUE = _CYCLE.replace("FROM schedules", f"FROM ({_DUE})").replace("JOIN schedules s", f"JOIN ({_DUE}) s")


@query("schedule_all_cycle_products", "products schedules", f"SELECT schedule_id, id, host, last_checked_at FROM ({_CYCLE_DUE})")
def _(products: DataFrame, schedules: DataFrame) -> DataFrame:
    return schedule.cycle_products(products, _all_due(schedules)).drop("created_at")


@query(
    "schedule_all_tick_pick",
    "products schedules",
    _PICK.format(_CYCLE_DUE),
)
def _(products: DataFrame, schedules: DataFrame) -> DataFrame:
    return schedule.tick_pick(products, _all_due(schedules))


@query("schedule_all_advance", "products schedules", _advance_sql(_DUE, _CYCLE_DUE, _PICK.format(_CYCLE_DUE)))
def _(products: DataFrame, schedules: DataFrame) -> DataFrame:
    return _advanced(products, _all_due(schedules))


@query("schedule_outcome_counts", "products schedules", f"SELECT schedule_id, '{{' || string_agg('\"' || status || '\":' || n, ',' ORDER BY status) || '}}' AS counts FROM (SELECT schedule_id, status, count(*) AS n FROM ({_PICK.format(_CYCLE_DUE)}) JOIN products USING (id) GROUP BY ALL) GROUP BY 1")
def _(products: DataFrame, schedules: DataFrame) -> DataFrame:
    return schedule.outcome_counts(_ticked(products, _all_due(schedules))).select("schedule_id", F.to_json("counts").alias("counts"))


@query(
    "schedule_ensure_default",
    "websites schedules",
    f"""SELECT DISTINCT owner, 'all' AS target_mode, c AS cadence_minutes, TIMESTAMP '{NOW}' + to_minutes(c) AS next_run_at FROM (SELECT owner, CASE id % 20 % 4 WHEN 0 THEN 1440 WHEN 1 THEN 60 ELSE 360 END AS c FROM websites)
    WHERE owner NOT IN (SELECT owner FROM schedules WHERE target_mode = 'all' AND id % 20 < 12)""",
)
def _(websites: DataFrame, schedules: DataFrame) -> DataFrame:
    owners = websites.selectExpr("owner", "CASE id % 20 % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'pro' WHEN 2 THEN 'business' END AS plan").distinct()
    return schedule.ensure_default(owners, schedules.where("id % 20 < 12"), NOW)


@query(
    "scalars_offer",
    "products",
    f"""SELECT id, {_VALID} AS gtin_ok, own_price_cents AS parsed, own_price_cents AS imported, 'EUR' AS money, CASE WHEN currency IS NULL THEN NULL ELSE currency END AS code, {_HOST.format('website_url')} AS host,
    CASE WHEN status = 'found' THEN 'none' WHEN status = 'not_found' THEN 'permanent' ELSE 'temporary' END AS class FROM products""",
)
def _(products: DataFrame) -> DataFrame:
    price = F.expr("format_number(own_price_cents / 100, '#,##0.00')")
    local = F.translate(price, ".,", ",.")
    text = F.concat(F.lit("Now "), F.when(F.col("product_id") % 2 == 0, local).otherwise(price), F.lit(" EUR"))
    return products.select(
        "id", S.valid_gtin(F.col("ean")).alias("gtin_ok"), S.price_cents(text).alias("parsed"), S.import_price(text).alias("imported"), S.detect_currency(text).alias("money"), S.normalize_currency(F.lower("currency")).alias("code"),
        S.host(F.col("website_url")).alias("host"), S.failure_class(F.col("status")).alias("class"),
    )


@query("scalars_profile_health", "products", "SELECT id, least(100, greatest(0, 50 + CASE WHEN in_stock THEN 15 WHEN NOT in_stock THEN -25 ELSE 0 END + CASE WHEN monitoring_enabled THEN 20 ELSE 0 END + CASE WHEN price_cents IS NOT NULL THEN 15 WHEN store_id % 2 > 0 THEN -5 ELSE 0 END - CASE WHEN status = 'blocked' THEN 20 ELSE 0 END)) AS score FROM products")
def _(products: DataFrame) -> DataFrame:
    return products.select("id", S.profile_health(F.col("in_stock"), F.col("monitoring_enabled"), F.col("price_cents").isNotNull(), F.col("status") == "blocked", F.col("store_id") % 2).alias("score"))


_SCORES = """SELECT product_id, id, CASE WHEN in_stock THEN 100 WHEN exact_ean THEN 88 ELSE 0 END AS ean, CAST(floor(greatest(0, least(1, name_similarity_bps / 10000)) * 100 + 0.5) AS INT) AS name,
    greatest(35, least(100, CAST(floor((id % 300 - 45) / 2 + 0.5) AS INT))) AS price, CASE WHEN in_stock THEN 98 ELSE 82 END AS source FROM snapshots"""


@query(
    "scalars_confidence",
    "snapshots",
    f"""SELECT *, CASE WHEN overall >= 86 AND ean >= 88 AND price >= 70 AND source >= 95 THEN 'high' WHEN overall >= 68 AND price >= 45 THEN 'medium' ELSE 'low' END AS label
    FROM (SELECT *, CAST(floor(ean * 0.42::DOUBLE + name * 0.22::DOUBLE + price * 0.22::DOUBLE + source * 0.14::DOUBLE + 0.5) AS INT) AS overall FROM ({_SCORES}))""",
)
def _(snaps: DataFrame) -> DataFrame:
    scores = S.confidence(F.coalesce("in_stock", F.lit(False)), F.col("exact_ean"), F.col("name_similarity_bps") / 10_000, F.col("id") % 300, F.when(F.col("in_stock"), "structured").otherwise("product-meta"), F.lit(False), F.lit(False))
    return snaps.select("product_id", "id", scores.alias("s")).select("product_id", "id", "s.*", S.confidence_label(F.col("s")).alias("label"))


_URL_HOST = "regexp_replace(lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www[.]', '')"


def pages_query(name: str, sql: str | None = None):
    """Registers a function of the pages table."""

    def keep(f):
        register(name, sql)(lambda spark, sf_dir: f(readers.pages(spark, sf_dir)))
        return f

    return keep


_SILENT = "regexp_replace(regexp_replace({}, '(?s)<script\\b.*?</script>', ' ', 'g'), '(?s)<style\\b.*?</style>', ' ', 'g')"
#: The rules of walls, over `page` (the first characters in small letters) and `seen` (its text).
WALLS = r"""CASE WHEN regexp_matches(seen, '(complete|solve|enter)\s+(the\s+)?captcha|captcha\s+(is\s+)?required|verify\s+(that\s+)?you(''re| are)\s+human')
        OR (regexp_matches(page, 'g-recaptcha|hcaptcha|turnstile-wrapper|captcha-container') AND length(seen) < 1500 AND regexp_matches(seen, 'captcha|human|verification')) THEN 'captcha'
    WHEN regexp_matches(page, 'verify you are human|are you a robot|unusual traffic|automated access|attention required|potrebno je varnostno preverjanje') THEN 'bot_wall'
    WHEN regexp_matches(seen, '(sign in|log in)\s+(to|before you can)\s+(continue|view|see)') OR contains(seen, 'authentication required') OR (length(seen) < 2500 AND regexp_matches(page, '<title>\s*(sign in|log in|authentication required)')) THEN 'login_wall'
    WHEN regexp_matches(page, 'enable javascript and cookies to continue|javascript is required to continue|checking your browser before accessing|<title>just a moment|js challenge') THEN 'js_challenge' END"""
_SEEN = f"""SELECT *, trim(regexp_replace(regexp_replace({_SILENT.format('page')}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS seen FROM (SELECT *, lower(substr(html, 1, 180000)) AS page FROM ({{}}))"""
_BARE = "html"
for _tag in ("script", "style", "noscript"):
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"
_BARE = f"regexp_replace({_BARE}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
for _name, _char in (("nbsp", " "), ("quot", '"'), ("apos", "''"), ("#39", "''"), ("lt", "<"), ("gt", ">"), ("euro", "€"), ("amp", "&")):
    _BARE = f"replace({_BARE}, '&{_name};', '{_char}')"
_TEXT = f"trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))"
_STOCK = r"CASE WHEN regexp_matches(text, '(?i)\b(out of stock|sold out|not available|unavailable|ni na zalogi|razprodano)\b') THEN false WHEN regexp_matches(text, '(?i)\b(in stock|available|na zalogi|dobavljivo)\b') THEN true END"


@pages_query(
    "pages_signals",
    f"""SELECT page_id, {_URL_HOST.format('url')} AS host, regexp_replace(url, '#.*$', '') AS canonical_url, coalesce(nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)), '')) AS title,
    length(html) AS chars, length(text) AS visible_chars, strlen(html) AS bytes, {WALLS} AS challenge, {_STOCK} AS in_stock, CAST(NULL AS VARCHAR) AS platform, md5(html) AS fingerprint FROM ({_SEEN.format(f'SELECT *, {_TEXT} AS text FROM pages')})""",
)
def _(pages_: DataFrame) -> DataFrame:
    return pages.signals(pages_)


@pages_query("pages_links", "SELECT page_id, generate_subscripts(a, 1) - 1 AS place, regexp_extract(unnest(a), '(?is)href=[\"'']([^\"''#]+)', 1) AS href, trim(regexp_extract(unnest(a), '(?is)>([^<]*)</a>', 1)) AS label FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href=[\"'']([^\"''#]+)[\"''][^>]*>([^<]*)</a>') AS a FROM pages)")
def _(pages_: DataFrame) -> DataFrame:
    return pages.links(pages_)


@query("pages_best_price", "products", "SELECT id AS page_id, own_price_cents AS price_cents, 'EUR' AS currency, 100 AS score, 'product-element' AS source FROM products")
def _(products: DataFrame) -> DataFrame:
    price = F.expr("format_number(own_price_cents / 100, '#,##0.00')")
    parts = [F.lit('<div class="shipping price">4.99 EUR</div><span class="old-price">99,999.00 EUR</span><span class="price price-current">'), price, F.lit(" EUR</span><del class='price'>77,777.00 EUR</del>")]
    return pages.best_price(products.select(F.col("id").alias("page_id"), F.concat(*parts).alias("html")))


@query("policy_suffix_join", "websites products", "SELECT DISTINCT p.host, w.host AS store FROM products p JOIN (SELECT DISTINCT CASE id % 3 WHEN 0 THEN 'm.shop-' || id || '.example' ELSE 'shop-' || id || '.example' END AS host FROM websites) w ON p.host = w.host OR w.host LIKE '%.' || p.host")
def _(websites: DataFrame, products: DataFrame) -> DataFrame:
    name = F.concat(F.lit("shop-"), F.col("id").cast("string"), F.lit(".example"))
    stores = websites.select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("m."), name)).otherwise(name).alias("store")).distinct()
    return policy.suffix_join(products.select("host").distinct(), stores, "host", "store").select("host", "store")


def _robots(websites: DataFrame) -> DataFrame:
    text = F.concat(F.lit("User-agent: *\nDisallow: /private\n\nUser-agent: pricebot\nUser-agent: other\nDisallow: /p"), (F.col("id") % 5).cast("string"), F.lit("\nAllow: /p1/open # yes\nDisallow: /*.pdf$\nSitemap: https://x.example/"), F.col("id").cast("string"), F.lit(".xml\n"))
    return websites.select(F.concat(F.lit("shop-"), F.col("id").cast("string"), F.lit(".example")).alias("host"), text.alias("text"))


_SHOP = "SELECT 'shop-' || id || '.example' AS host, id FROM websites"


@query("policy_robots_rules", "websites", f"SELECT host, false AS allow, '/p' || (id % 5) AS path FROM ({_SHOP}) UNION ALL SELECT host, true, '/p1/open' FROM ({_SHOP}) UNION ALL SELECT host, false, '/*.pdf$' FROM ({_SHOP})")
def _(websites: DataFrame) -> DataFrame:
    return policy.robots_rules(_robots(websites), "PriceBot/1.0")


@query("policy_robots_allows", "websites products", "SELECT host, 'https://' || host || '/p' || (product_id % 5) || CASE product_id % 3 WHEN 0 THEN '/open/a' WHEN 1 THEN '/x.pdf' ELSE '/x.pdf?a' END AS url, (product_id % 5 <> store_id % 5 AND product_id % 3 <> 1) OR (product_id % 5 = 1 AND product_id % 3 = 0) AS allowed FROM (SELECT DISTINCT host, store_id, product_id % 15 AS product_id FROM products)")
def _(websites: DataFrame, products: DataFrame) -> DataFrame:
    k = (F.col("product_id") % 15).alias("k")
    rows = products.select("host", k).distinct()
    tail = F.when(F.col("k") % 3 == 0, "/open/a").when(F.col("k") % 3 == 1, "/x.pdf").otherwise("/x.pdf?a")
    urls = rows.select("host", F.concat(F.lit("https://"), "host", F.lit("/p"), (F.col("k") % 5).cast("string"), tail).alias("url"))
    return policy.robots_allows(urls, policy.robots_rules(_robots(websites), "PriceBot/1.0"))


@query("policy_robots_sitemaps", "websites", f"SELECT host, 'https://x.example/' || id || '.xml' AS sitemap FROM ({_SHOP})")
def _(websites: DataFrame) -> DataFrame:
    return policy.robots_sitemaps(_robots(websites))


@query("policy_sitemap_locations", "products", "SELECT host, 'https://' || host || '/p/' || product_id AS url, min(CASE WHEN product_id % 2 = 0 THEN '2024-01-01' END) AS lastmod FROM products WHERE product_id % 3 <> 1 GROUP BY ALL")
def _(products: DataFrame) -> DataFrame:
    k = F.col("product_id").cast("string")
    loc = F.concat(F.lit("<url> <loc>https://"), F.when(F.col("product_id") % 3 == 1, "other.example").otherwise(F.col("host")), F.lit("/p/"), k, F.lit("</loc>"), F.when(F.col("product_id") % 2 == 0, "<lastmod>2024-01-01</lastmod>").otherwise(""), F.lit("</url>"))
    return policy.sitemap_locations(products.select("host", loc.alias("loc")).groupBy("host").agg(F.concat_ws("\n", F.collect_list("loc")).alias("xml")))


@query("policy_access", "products websites", "SELECT DISTINCT host, CASE WHEN store_id % 7 = 0 OR store_id % 5 = 0 THEN 'blocked' ELSE 'allowed' END AS access FROM products")
def _(products: DataFrame, websites: DataFrame) -> DataFrame:
    name = F.concat(F.lit("shop-"), F.col("id").cast("string"), F.lit(".example"))
    policies = websites.select(name.alias("host"), F.when(F.col("id") % 7 == 0, "block").otherwise("allow").alias("mode"))
    blocked = websites.where("id % 5 = 0").select(name.alias("host"))
    return policy.access(products.select("host").distinct(), policies, blocked, websites.select(name.alias("host")))


@query("policy_drop_non_store", "products", "SELECT DISTINCT host FROM products WHERE store_id % 4 <> 0")
def _(products: DataFrame) -> DataFrame:
    rows = products.select(F.when(F.col("store_id") % 4 == 0, F.concat(F.lit("s"), F.col("store_id").cast("string"), F.lit(".google.com"))).otherwise(F.col("host")).alias("host")).distinct()
    return policy.drop_non_store(rows)


@query("policy_known_bad", "products", "SELECT id AS page_id, CASE WHEN product_id % 2 = 0 THEN 'a' ELSE 'b' END AS rule_id FROM products WHERE product_id % 2 = 0 OR (store_id = 3 AND status = 'blocked')")
def _(products: DataFrame) -> DataFrame:
    url = F.concat(F.col("website_url"), F.when(F.col("product_id") % 2 == 0, "old/item").otherwise("item"))
    seen = products.select(F.col("id").alias("page_id"), "host", url.alias("url"), F.col("status").alias("html"))
    rules = products.sparkSession.createDataFrame([("a", "*", "*/OLD/*", None), ("b", "shop-3.example", None, "block*d")], "id string, host string, url_pattern string, content_pattern string")
    return policy.known_bad(seen, rules)


@query("policy_same_store_urls", "products", "SELECT host AS site, 'https://m.' || host || '/' || product_id AS url FROM (SELECT DISTINCT host, product_id FROM products) QUALIFY row_number() OVER (PARTITION BY host ORDER BY product_id) <= 3")
def _(products: DataFrame) -> DataFrame:
    rows = products.select(F.col("host").alias("site"), F.col("product_id").alias("place"), F.concat(F.lit("https://m."), "host", F.lit("/"), F.col("product_id").cast("string"), F.lit("#x")).alias("url"))
    return policy.same_store_urls(rows.unionByName(rows.withColumn("url", F.lit("https://elsewhere.example/1"))), 3)
