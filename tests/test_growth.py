"""Steps whose work is to grow with the input: what moves, and results against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pricetide.operators import catalog, crawl, offers, schedule
from pricetide.plans.adapters import domain


@pytest.fixture()
def moved(spark):
    """How many rows a run writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        every = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(every.apply, range(every.size()))}

    def run(df):
        before = stages()
        rows = df.collect()
        return rows, sum(n for k, n in stages().items() if k not in before)

    return run


def _lists(spark, owners, products, schedules, seed, hosts=6):
    """Products and schedules whose dates lie in one another's midst, with equal and missing ones."""
    rng, day = random.Random(seed), lambda k: None if k is None else f"2024-01-{k + 1:02d} 00:00:00"
    made = [(f"p{i}", f"o{rng.randrange(owners)}", f"h{rng.randrange(hosts)}", day(rng.choice([None, *range(20)])), day(rng.randrange(20)), rng.random() < 0.9) for i in range(products)]
    due = [(i, f"o{rng.randrange(owners)}", rng.choice(["all", "all", "selected"]), '["p1","p2","p3","p4","p5"]', rng.randrange(-3, 9), day(rng.choice([None, *range(20)]))) for i in range(schedules)]
    when = lambda df, *names: df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})
    p = when(spark.createDataFrame(made, "id string, owner string, host string, last_checked_at string, created_at string, monitoring_enabled boolean"), "last_checked_at", "created_at")
    s = when(spark.createDataFrame(due, "id int, owner string, target_mode string, product_ids_json string, cursor_index int, next_run_at string"), "next_run_at")
    return made, due, p, s


def test_schedules_by_hand(spark):
    made, due, p, s = _lists(spark, 3, 60, 60, 1)
    cycle, picks = {}, set()
    for sid, owner, mode, _, cursor, at in due:
        mine = [r for r in made if r[1] == owner and r[5] and (mode == "all" or r[0] in ("p1", "p2", "p3", "p4", "p5")) and (r[3] is None or (at is not None and r[3] < at))]
        if mine:
            cycle[sid] = sorted(r[0] for r in mine)
        hosts = sorted({r[2] for r in mine})
        for place, host in enumerate(hosts):
            if (turn := (place - cursor) % len(hosts)) < 4:
                best = min((r for r in mine if r[2] == host), key=lambda r: (r[3] is None, r[3] or "", r[4], r[0]))
                picks.add((sid, best[0], host, turn))
    assert {tuple(r) for r in schedule.tick_pick(p, s).collect()} == picks and len(picks) > 80
    got = {}
    for r in schedule.cycle_products(p, s).collect():
        got.setdefault(r["schedule_id"], []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == cycle
    assert dict(map(tuple, schedule.cycle_sizes(p, s).collect())) == {k: len(v) for k, v in cycle.items()}


def test_schedules_move_no_pairs(spark, moved):
    """An owner's 600 products and 600 schedules make 360,000 pairs, none of which moves."""
    _, _, p, s = _lists(spark, 1, 600, 600, 2, 600)
    for rows, n in (moved(schedule.tick_pick(p, s)), moved(schedule.cycle_sizes(p, s))):
        assert rows and n < 20_000


def test_new_pairs_move_no_pairs(spark, moved):
    """One owner's 400 codes at 400 stores, but for the pairs that are known: 160,000 pairs, none of which moves."""
    code = "lpad('' || id, 12, '0')"
    check = "(" + " + ".join(f"int(substr(c, {i + 1}, 1)) * {3 if i % 2 else 1}" for i in range(12)) + ")"
    products = spark.range(400).selectExpr(f"{code} AS c", "id").selectExpr("'o' AS owner", f"c || ((10 - {check} % 10) % 10) AS ean", "'s' || (id % 7) || '.example' AS host")
    websites = spark.range(400).selectExpr("'o' AS owner", "'https://www.s' || id || '.example/' AS url")
    rows, n = moved(catalog.new_pairs(products, websites, products))
    known = {(r["ean"], r["host"]) for r in products.collect()}
    got = [(r["ean"], r["host"]) for r in rows]
    assert len(got) == len(set(got)) == 400 * 400 - 400 and not known & set(got)
    assert n < 60_000


def test_products_are_sorted_by_parts(spark, sf_dir):
    """Rows of a product meet before they are aggregated, so that no task sorts a whole split of the file."""
    plan = domain(spark, sf_dir, "products")._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_COL" in plan or "hashpartitioning(product_id" in plan


def test_node_facts_are_made_before_the_filter(spark):
    """The fields of a page's nodes are made once: no filter holds them anew."""
    pairs = spark.createDataFrame([("a", "<p>x</p>", "4006381333931", "x")], "page_id string, html string, ean string, name string")
    plan = offers.structured_candidates(pairs, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("map_entries" in line or "try_variant_get" in line.lower() and "offers" in line for line in plan.splitlines() if "Filter (" in line.split("higherorder")[0][:60])


def test_sitemaps_move_what_can_be_met(spark, moved):
    """2,000 addresses with a code of 13 digits hold nine stretches as long as some code; only those as long as a wanted one move."""
    spelled = spark.range(2000).selectExpr("id", "'h' || id % 3 AS host", "lpad(id * 7919 + 1000000, 13, '0') AS ean", "'Big ab' || lpad(id, 6, '0') AS name")
    places = spelled.selectExpr("host", "'https://' || host || '/p/' || CASE WHEN id % 2 = 0 THEN ean ELSE 'ab' || lpad(id, 6, '0') || '-x' END AS url", "CAST(NULL AS STRING) AS lastmod")
    rows, n = moved(crawl.sitemap_match(places, spelled))
    assert {(r["id"], r["score"]) for r in rows} == {(i, 1000 if i % 2 == 0 else 901) for i in range(2000)}
    assert n < 10_000


def test_sitemap_ties_and_lengths(spark):
    """Codes of two lengths in one run, a code and words of the same address, equal addresses, later dates, and rows without a host or id."""
    targets = [(1, "h", "12345678", None), (2, "h", "1234567890123", "x Ab1234 cd5678"), (3, "h", "40063813", ""), (4, "h", "123", "ab1234"), (None, "h", "12345678", None), (5, None, "12345678", None)]
    places = [("h", "https://h/a/1234567890123", None), ("h", "https://h/a/1234567890123", "2024-01-01"), ("h", "https://h/ab1234/CD5678/x", "bad"), ("h", "https://h/40063813", "2024-01-01"), ("h", "https://h/b/40063813", "2024-02-01"), (None, "https://h/12345678", None), ("h", None, None), ("h", "https://h/ab1234", None)]
    got = crawl.sitemap_match(spark.createDataFrame(places, "host string, url string, lastmod string"), spark.createDataFrame(targets, "id int, host string, ean string, name string"))
    assert {tuple(r) for r in got.collect()} == {(1, "https://h/a/1234567890123", 1000), (2, "https://h/a/1234567890123", 1000), (3, "https://h/b/40063813", 1000)}


def test_products_alone_sort_no_snapshots(spark, sf_dir):
    """What a store's number tells needs no latest snapshot."""
    plan = domain(spark, sf_dir, "products").select("id", "host")._jdf.queryExecution().sparkPlan().toString()
    assert "max_by" not in plan
