"""Domain operators against DuckDB on the smallest tables, pinned cases, and streams against their batch twins."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricetide.functions import labels
from pricetide.functions import scalars as S
from pricetide.operators import alerts, catalog, compare, crawl, history, ops, pages, policy, results, schedule, tables
from pricetide.plans import registry
from pricetide.plans.adapters import domain
from pricetide.plans.reference_queries import NOW
from pricetide.sources import readers, sinks
from pricetide.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shaped(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        known = df[c].dropna()
        if len(known) and known.map(lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)).all():
            df[c] = df[c].astype(float).round(6)
        df[c] = df[c].astype(str).replace({"NaT": "None", "nan": "None", "<NA>": "None"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_as_in_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = shaped(registry.queries()[name](spark, sf_dir).toPandas()), shaped(con.sql(registry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def values(spark, rows, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}").orderBy("i").select(make(F.col("v"))).collect()]


def test_prices(spark):
    texts = ["€1.299,99", "$1,299.99", "1 299,95 EUR", "1.299", "12.5", "0", "no", None, "1,234,567.89 USD", "99,9", "1.234.567"]
    assert values(spark, texts, S.price_cents) == [129999, 129999, 129995, 129900, 1250, None, None, None, 123456789, 9990, 123456700]
    assert values(spark, ["1.299", "1.299,5", "12", "-3", "", None, "x"], S.import_price) == [130, 129950, 1200, None, None, None, None]
    assert values(spark, ["5 €", "kr 5", "5 zł", "usd 4", "5 XYZ", "five"], S.normalize_currency) == ["EUR", "SEK", "PLN", "USD", "XYZ", None]


def test_gtin(spark):
    rng, codes = random.Random(1), []
    for n in (8, 12, 13, 14):
        body = [rng.randrange(10) for _ in range(n - 1)]
        check = -sum(d * (3 if i % 2 == 0 else 1) for i, d in enumerate(reversed(body))) % 10
        codes += ["".join(map(str, [*body, check])), "".join(map(str, [*body, (check + 1) % 10]))]
    assert values(spark, [*codes, "", None, "12a45678"], S.valid_gtin) == [True, False] * 4 + [False, False, False]


def test_hosts(spark):
    hosts = ["shop.example", "localhost", "a.local", "10.1.2.3", "172.20.1.1", "8.8.8.8", "192.168.0.1", "x", "", None, "internal.shop.si"]
    assert values(spark, hosts, S.is_public_host) == [True, False, False, False, False, True, False, False, False, False, True] or values(spark, hosts, S.is_public_host)[9] in (False, None)
    assert values(spark, ["https://me@WWW.Shop.Example:8443/a?b", "junk", "http://a.b."], S.host) == ["shop.example", "", "a.b"]
    assert values(spark, ["https://u:p@a.b/c?api_key=1&q=2#x", "https://a.b/?Token=zz"], S.redact_url) == ["https://a.b/c?api_key=[redacted]&q=2#x", "https://a.b/?Token=[redacted]"]


def test_backoff(spark):
    rows = [(1, "timeout", None, 30_000), (3, "timeout", None, 120_000), (1, "timeout", 300_000, 300_000), (40, "captcha", None, 86_400_000), (40, "timeout", None, 21_600_000), (0, "odd", None, 15_000)]
    df = spark.createDataFrame(rows, "n int, r string, a long, want long")
    assert all(r[0] == r[1] for r in df.select(S.backoff_ms(F.col("n"), F.col("r"), F.col("a")), "want").collect())


def test_fingerprint(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return f"fnv1a-{h:08x}-{len(s)}"

    texts = ["", "a", "hello wörld", "žaba €"]
    assert values(spark, texts, S.fnv1a) == [fnv(t) for t in texts]


def test_barcode(spark):
    df = spark.createDataFrame([("code 12345-670 here", "12345670", True), ("9912345670", "12345670", False), ("", "12345670", False)], "t string, e string, want boolean")
    assert all(r[0] == r[1] for r in df.select(S.contains_barcode(F.col("t"), F.col("e")), "want").collect())


def test_fair_order_and_batches(spark):
    df = spark.createDataFrame([("o", 1, "a"), ("o", 2, "a"), ("o", 3, "b"), ("o", 4, "c")], "owner string, id int, host string")
    assert [r["id"] for r in schedule.fair_order(df, ["owner"], "host", "id").orderBy("place").collect()] == [1, 3, 4, 2]
    rng = random.Random(3)
    items = [(i, rng.choice("abcdefg"), rng.choice("xy")) for i in range(120)]
    want = {}
    for owner in "xy":
        left, n = {}, 0
        for i, h, o in items:
            if o == owner:
                left.setdefault(h, []).append(i)
        while any(left.values()):
            for h in [h for h in left if left[h]][:3]:
                want[left[h].pop(0)] = n
            n += 1
    got = schedule.fair_batches(spark.createDataFrame(items, "id int, host string, owner string"), ["owner"], "host", "id", 3)
    assert {r["id"]: r["batch"] for r in got.collect()} == want


def test_alert_crossings(spark):
    snaps = spark.createDataFrame([(1, i, p, "EUR", s, t) for i, (p, s, t) in enumerate([(1000, False, 1), (900, True, 2), (890, True, 3), (None, True, 4), (1200, None, 5)])], "product_id int, id int, price_cents long, currency string, in_stock boolean, captured_at int")
    rules = spark.createDataFrame([(1, 950, None, None, 900, 500)], "product_id int, own_price_cents long, alert_on_price_drop boolean, alert_on_restock boolean, alert_target_price_cents long, alert_drop_percent_bps int")
    got = {(r["id"], r["alert_type"]) for r in alerts.customer(snaps, rules).collect()}
    assert got == {(1, "price_drop"), (1, "below_target_price"), (1, "percentage_price_drop"), (1, "below_own_price"), (1, "restock"), (2, "price_drop")}


def test_empty_tables(spark, sf_dir):
    snaps, products, runs = (domain(spark, sf_dir, n).limit(0) for n in ("snapshots", "products", "runs"))
    assert history.summary_by_currency(snaps).count() == 0 and catalog.validate(products).count() == 0
    row = ops.summary(runs, "2024-01-31 00:00:00").first()
    assert row["runs"] == 0 and row["match_rate"] == 0 and row["p95_response_ms"] is None


def test_sheet_and_sinks(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Report,,,\nIzdelek,EAN koda,Cena,SKU\n"Big ring",1234 5670,"1.299,50",=x\n,,,\n')
    got = catalog.import_sheet(readers.sheet(spark, f"{tmp_path}/s.csv", 4)).collect()
    assert [(r["name"], r["ean"], r["own_price_cents"], r["sku"]) for r in got] == [("Big ring", "12345670", 129950, "=x")]
    sinks.export_csv(spark.createDataFrame([("=1", None, 'a"b')], "x string, y string, z string").coalesce(1), f"{tmp_path}/out")
    text = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert text == '﻿"x","y","z"\r\n"\'=1","","a""b"\r\n'.replace('﻿"x"', '"﻿x"')
    sinks.export_json(spark.range(3), "products", f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j/manifest").first()["resource"] == "products"


def test_page_rules(spark):
    html = "<html><head><title>t</title><meta property='og:title' content='Ring'></head><script>sold out</script><p>Na zalogi &amp; more</p></html>"
    r = pages.signals(spark.createDataFrame([(1, "https://www.a.b/x#y", html), (2, "https://a.b/", "Checking your browser before accessing a.b"), (3, None, None)], "page_id int, url string, html string")).orderBy("page_id").collect()
    assert (r[0]["title"], r[0]["in_stock"], r[0]["host"], r[0]["canonical_url"]) == ("Ring", True, "a.b", "https://www.a.b/x") and r[1]["challenge"] == "js_challenge" and r[2]["title"] is None
    bad = policy.validate_rules(spark.createDataFrame([("a", "*" * 9, None), ("b", None, None), ("c", "x", None)], "id string, url_pattern string, content_pattern string"))
    assert {x["id"]: x["errors"] for x in bad.collect()} == {"a": "stars", "b": "pattern", "c": ""}


def test_upsert_nulls(spark):
    base, new = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string"), spark.createDataFrame([(1, None), (None, "z"), (3, "n")], "k int, v string")
    assert {(r["k"], r["v"]) for r in tables.upsert(base, new, ["k"], ["v"]).collect()} == {(1, None), (None, "z"), (3, "n")}


def streamed(spark, df, make, tmp_path, mode="append"):
    """All rows through a stream of files."""
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = make(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    name = "t" + tmp_path.name.replace("-", "_")
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_state_as_batch(spark, sf_dir, tmp_path):
    runs = domain(spark, sf_dir, "runs")
    got = streamed(spark, runs, jobs.domain_state, tmp_path).toPandas().set_index("id").sort_index()
    want = ops.domain_state_history(runs).join(ops.failure_streaks(runs).select("id", "consecutive_failures"), "id").toPandas().set_index("id").sort_index()
    for c in ("total_checks", "successful_checks", "blocked_checks", "consecutive_failures", "total_response_ms"):
        assert got[c].tolist() == want[c].tolist(), c


def test_stream_metrics_as_batch(spark, sf_dir, tmp_path):
    runs = domain(spark, sf_dir, "runs")
    got = streamed(spark, runs, jobs.run_metrics, tmp_path, "complete").toPandas().set_index("window_start").sort_index()
    want = runs.groupBy(F.date_trunc("hour", "started_at").alias("h")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "blocked").alias("blocked")).toPandas().set_index("h").sort_index()
    assert got["runs"].tolist() == want["runs"].tolist() and got["blocked"].tolist() == want["blocked"].tolist()


def test_stream_cooldowns_as_batch(spark, sf_dir, tmp_path):
    runs = domain(spark, sf_dir, "runs")
    got = streamed(spark, runs, jobs.cooldowns, tmp_path).toPandas().set_index("id").sort_index()
    want = ops.cooldowns(runs).withColumn("until", F.timestamp_add("MILLISECOND", "backoff_ms", "started_at")).toPandas().set_index("id").sort_index()
    assert got.index.tolist() == want.index.tolist() and got["failures"].tolist() == want["failures"].tolist() and got["reason_code"].tolist() == want["reason_code"].tolist()
    assert got["cooldown_until"].tolist() == want["until"].tolist()


def test_stream_customer_alerts_as_batch(spark, sf_dir, tmp_path):
    settings = domain(spark, sf_dir, "products").dropDuplicates(["product_id"]).select("product_id", "own_price_cents", "alert_on_price_drop", "alert_on_restock", "alert_target_price_cents", "alert_drop_percent_bps")
    snaps = domain(spark, sf_dir, "snapshots")
    got = streamed(spark, snaps.join(settings, "product_id"), jobs.customer_alerts, tmp_path)
    want = alerts.customer(snaps, settings)
    shape = lambda df: sorted(map(tuple, df.select(F.col("product_id").cast("long"), F.col("id").cast("long"), "alert_type").collect()))
    assert shape(got) == shape(want) and want.count() > 100


def test_stream_once(spark, sf_dir, tmp_path):
    runs = domain(spark, sf_dir, "runs").select("host", "started_at")
    assert streamed(spark, runs, lambda s: jobs.insert_once(s, "host", "started_at"), tmp_path).count() == runs.select("host").distinct().count()


def test_schema_drift(spark, sf_dir):
    tables_ = {"region": spark.read.parquet(f"{sf_dir}/region.parquet")}
    required = spark.createDataFrame([("region", "R_NAME"), ("region", "r_area"), ("moon", "m_id"), ("moon", "m_id")], "table string, column string")
    assert sorted(map(tuple, tables.schema_drift(tables_, required).collect())) == [("moon", "m_id"), ("region", "r_area")]


def test_all_due_schedules(spark, sf_dir):
    """The whole-table queries hold every due schedule, not the first few of a tick."""
    s = domain(spark, sf_dir, "schedules")
    due = {r["id"] for r in s.where(F.expr(f"enabled AND next_run_at <= TIMESTAMP_NTZ '{NOW}' AND (lease_until IS NULL OR lease_until <= TIMESTAMP_NTZ '{NOW}')")).select("id").collect()}
    assert len(due) > 40 and {r["id"] for r in registry.queries()["schedule_all_advance"](spark, sf_dir).select("id").collect()} == due


def test_advance_cases(spark):
    """Open, complete, empty and aimless cycles, and pending texts that are no map of numbers."""
    made = "id int, target_mode string, product_ids_json string, cadence_minutes int, cursor_index int, pending_outcome_json string, last_run_at timestamp_ntz"
    rows = [(1, "all", "[]", 60, 3, '{"found":2,"error":1}'), (2, "all", "[]", 60, 3, '{"found":2}'), (3, "all", "[]", 60, 3, None), (4, "selected", "junk", 60, 3, '{"found":2}'), (5, "all", "[]", 60, 0, '{"found":"x","error":-1}'), (6, "all", "[]", 60, 0, "[1]")]
    s = spark.createDataFrame([(*r, None) for r in rows], made)
    outcomes = spark.createDataFrame([(1, 1, "blocked"), (1, 0, "found"), (2, 0, "error"), (5, 0, "found"), (6, 0, "found")], "schedule_id int, turn int, status string")
    left = spark.createDataFrame([(1, 7), (2, 0), (5, 1), (6, 1)], "schedule_id int, remaining long")
    got = {r["id"]: r for r in schedule.advance(s, outcomes, left, NOW).collect()}
    assert {k: (r["last_outcome"], r["cursor_index"], r["pending_outcome_json"]) for k, r in got.items()} == {
        1: ("Processing 5 of 12: 3 found, 1 error, 1 blocked", 5, '{"found":3,"error":1,"blocked":1}'),
        2: ("2 found, 1 error", 0, "{}"),
        3: ("No products selected", 0, "{}"),
        4: ("No products selected", 0, "{}"),
        5: ("Processing 1 of 2: 1 found", 1, '{"found":1}'),
        6: ("Processing 1 of 2: 1 found", 1, '{"found":1}'),
    }
    assert [str(got[k]["next_run_at"]) for k in (1, 2)] == [NOW, "2024-01-31 01:00:00"] and got[1]["last_run_at"] is None


def test_form_candidates(spark):
    """Hidden values are encoded, commas in them stay, and hosts with a route of their own get no guessed one."""
    sites = spark.createDataFrame([(1, "trgovinejager.com", "https://trgovinejager.com/", None, None)], "site int, host string, root string, template string, platform string")
    forms = spark.createDataFrame([(1, 0, "https://trgovinejager.com/f#x", "q", "a=1,2 3,b=é,empty=")], "site int, place int, action string, field string, hidden string")
    got = crawl.search_candidates(sites, spark.createDataFrame([(1, "č d")], "site int, query string"), forms).collect()
    assert {r["url"]: r["profile"] for r in got} == {"https://trgovinejager.com/iskalnik/?isci=%C4%8D%20d": "host", "https://trgovinejager.com/f?a=1%2C2+3&b=%C3%A9&q=%C4%8D+d": "form-1"}


def test_json_nodes_odd(spark):
    ld = '<script type="application/ld+json">{}</script>'
    rows = [(1, None), (2, ""), (3, ld.format("{bad")), (4, ld.format('[{"a":{"b":[{"c":null}]}},3]')), (5, ld.format('"text"'))]
    got = pages.json_nodes(spark.createDataFrame(rows, "page_id int, html string")).select("page_id", "path").collect()
    assert sorted(map(tuple, got)) == [(4, "0/0"), (4, "0/0/a"), (4, "0/0/a/b/0")]


def test_offer_needs_identity(spark):
    made = "page_id int, path string, price_cents long, currency string, exact_ean boolean, name_score double, score double"
    structured = spark.createDataFrame([(1, "a", 100, "EUR", False, 0.5, 77.0), (2, "a", None, "EUR", False, 0.7, 71.0), (3, "a", 100, "EUR", False, 0.7, 87.0), (4, "a", 100, "EUR", True, 0.7, 87.0)], made)
    prices = spark.createDataFrame([(i, 200, "EUR", 170.0, "ean-context") for i in (1, 2, 3, 4)], "page_id int, price_cents long, currency string, score double, source string")
    got = {r["page_id"]: (r["price_cents"], r["source"]) for r in pages.select_offer(structured, prices).collect()}
    assert got == {2: (200, "ean-context"), 3: (100, "structured"), 4: (200, "ean-context")}


def test_group_status(spark):
    rows = [("a", 1, "searching"), ("a", 2, "not_found"), ("b", 3, "searching"), ("b", 4, "queued"), ("c", 5, "found"), ("d", 6, "found"), ("d", 7, "blocked"), ("e", 8, "queued"), ("e", 9, "needs_review"), ("f", 10, "found"), ("f", 11, "found")]
    df = spark.createDataFrame(rows, "name string, id int, status string").withColumns({"ean": F.lit(None).cast("string"), "last_checked_at": F.lit(None).cast("timestamp_ntz")})
    got = {r["group_key"]: r["label"] for r in compare.group_status(df).collect()}
    assert got == {"a": "Not found", "b": "Searching", "c": "Found on 1 site", "d": "1 of 2 found", "e": "needs review", "f": "Found on 2 sites"}


def test_verdicts(spark):
    """A price alone is no find; a sitemap's page needs the code."""
    kind = "id string, place int, score double, ean_match boolean, structured_ean boolean, structured boolean, name_score double, price_cents long, profile_id string, overall_confidence int, source_confidence int"
    rows = [
        ("found", 1, 9.0, True, True, True, 1.0, 100, None, 90, 98), ("named", 1, 9.0, False, False, True, 0.95, 100, None, 55, 72), ("wrong", 1, 9.0, False, False, True, 0.8, 100, None, 55, 72),
        ("weak", 1, 9.0, True, False, False, 0.2, 100, None, 60, 62), ("bare", 1, 9.0, True, True, True, 1.0, None, None, 70, 40), ("map", 1, 9.0, True, False, False, 0.5, 100, "sitemap", 80, 72), ("far", 1, 9.0, False, False, False, 0.1, 100, None, 30, 48),
        ("tie", 1, 9.0, True, True, True, 1.0, 100, None, 90, 98), ("tie", 2, 9.0, False, False, False, 0.0, 100, None, 90, 98),
    ]
    seen = [("gone", "unavailable"), ("wall", "blocked"), ("drift", "profile_drift"), ("wrong", "profile_drift"), ("robots", "robots_disallowed"), ("bad", "known_bad_pattern"), ("big", "response_too_large"), ("read", "read"), ("read", "blocked")]
    names = sorted({r[0] for r in rows} | {s[0] for s in seen} | {"none"})
    got = results.classify_results(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(rows, kind), spark.createDataFrame(seen, "id string, outcome string"))
    want = {
        "found": "found", "named": "found", "tie": "found", "wrong": "profile_drift", "weak": "low_confidence", "bare": "price_missing", "map": "low_confidence", "far": "not_found", "gone": "network_error", "wall": "blocked",
        "drift": "profile_drift", "robots": "robots_disallowed", "bad": "known_bad_pattern", "big": "response_too_large", "read": "blocked", "none": "not_found",
    }
    assert {r["id"]: r["reason_code"] for r in got.collect()} == want


def test_labels(spark):
    assert values(spark, [123456, -50, 0], lambda v: labels.money_text(v, F.lit("eur")), "long") == ["€1,234.56", "-€0.50", "€0.00"]
    assert values(spark, ["120", "1e9", "-3", "", None, "Wed, 31 Jan 2024 00:01:00 GMT", "Wed, 31 Jan 2024 09:00:00 GMT", "Tue, 30 Jan 2024 09:00:00 GMT"], lambda v: labels.retry_after_ms(v, F.lit(NOW).cast("timestamp_ntz")).cast("string")) == ["120000", None, None, None, None, "60000", "21600000", "0"]
    assert values(spark, [0.1234, 0.5, 1.0, -0.02], labels.percent_text, "double") == ["12.3%", "50%", "100%", "-2%"]
    assert values(spark, ["Lastna cena (€)", "EAN_koda", " Šifra / Naziv "], labels.norm_header) == ["lastna cena €", "ean koda", "sifra naziv"]
    assert len(labels.country_codes(spark)) > 240
    assert values(spark, ["Kavč Čuk", "kavc uk", None], lambda v: S.name_score(F.lit("Kavč m²"), v), "string") == [0.5, 0.5, 0.0]
