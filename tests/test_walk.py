"""Walks over the links of made sites, against a queue kept by hand."""

import random

from pyspark.sql import functions as F

from pricetide.operators import links

MOST_PAGES, MOST_QUEUED = 8, 24
TARGETS = "id string, url string, ean string, name string"


def page(rng, root, size):
    """Up to ten links of a page, in order, and its html; every link speaks of the product."""
    out = [f"{root}n{k}" for k in rng.sample(range(size + 3), rng.randint(0, min(10, size)))]
    data = [f"{root}n{rng.randrange(size)}"] if rng.random() < 0.3 else []
    html = "".join(f'<a href="{u}">zyx</a>' for u in out) + "".join(f'<div data-product-api="{u}"></div>' for u in data)
    return data, list(dict.fromkeys(out))[:8], html


def by_hand(start, others, web):
    queue, seen, read = [start, *others], set(), []
    for at in queue:  # the queue grows while it is read
        if at in seen or len(read) == MOST_PAGES:
            continue
        seen.add(at)
        if at not in web:
            continue
        read.append(at)
        data, found, _ = web[at]
        for link in [*data, *found]:
            if link not in seen and len(queue) < MOST_QUEUED:
                queue.append(link)
    return read


def test_walk_against_a_queue_by_hand(spark):
    rng = random.Random(5)
    webs, targets, starts, want = {}, [], [], {}
    for t in range(24):
        root, size = f"https://s{t}.example/", rng.randint(1, 30)
        pages_ = {u: page(rng, root, size) for u in [root, *(f"{root}n{k}" for k in range(size))] if u == root or rng.random() < 0.8}
        if t % 8 == 7:
            del pages_[root]
        more = [f"{root}n{rng.randrange(size)}" for _ in range(rng.choice([0, 0, 3]))]
        targets.append((f"t{t}", root, "4006381333931", "zyx"))
        starts += [(f"t{t}", k, u) for k, u in enumerate(more)]
        webs |= pages_
        want |= {(f"t{t}", u): n for n, u in enumerate(by_hand(root, more, pages_), 1)}
    table = spark.createDataFrame([(u, html) for u, (_, _, html) in webs.items()], "url string, html string")
    got = links.walk(spark.createDataFrame(targets, TARGETS), table, spark.createDataFrame(starts, "id string, place int, url string"))
    assert {(r["id"], r["url"]): r["turn"] for r in got.collect()} == want and len(want) > 100


def test_shared_pages_nulls_and_empty_tables(spark):
    table = spark.createDataFrame([("https://a.example/", '<a href="/p/1">x</a>'), ("https://a.example/p/1", None), (None, "x")], "url string, html string")
    targets = spark.createDataFrame([("1", "https://A.example", "9", "Zz"), ("2", "https://a.example/#x", None, None), ("3", None, "9", "Zz"), ("4", "https://b.example/", "9", "Zz")], TARGETS)
    got = {tuple(r) for r in links.walk(targets.withColumn("html", F.lit("own")), table).collect()}
    assert got == {("1", "https://a.example/", 1), ("1", "https://a.example/p/1", 2), ("2", "https://a.example/", 1)}
    assert links.walk(targets.where("false"), table).count() == 0 and links.walk(targets, table.where("false")).count() == 0


def made(spark, sites, linked):
    """Sites whose first page links `linked` others, each without links; targets and pages, in one part each."""
    root = "'https://s' || id || '.example/'"
    anchors = "array_join(transform(sequence(1, %d), k -> '<a href=\"/p/' || k || '\">zyx</a>'), '')" % linked
    table = spark.range(0, sites, 1, 1).selectExpr(f"inline(array_union(array(struct({root} AS url, {anchors} AS html)), transform(sequence(1, {linked}), k -> struct({root} || 'p/' || k AS url, '<p>x</p>' AS html))))")
    return spark.range(0, sites, 1, 1).selectExpr("'t' || id AS id", f"{root} AS url", "'9' AS ean", "'zyx' AS name"), table


def test_read_pages_are_dealt_over_all_cores(spark):
    """Pages of one part, few bytes and much work, are read in two parts a core; none of them is broadcast by the size of the table that they are made of."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: (lambda found: {found.apply(k).stageId(): found.apply(k).numTasks() for k in range(found.size())})(store.stageList(None, False, False, none, None))
    before = stages()
    targets, table = made(spark, 40, 2)
    assert {tuple(r) for r in links.walk(targets, table).collect()} == {(f"t{i}", f"https://s{i}.example/" + (f"p/{k}" if k else ""), k + 1) for i in range(40) for k in range(3)}
    assert sum(n == 2 * spark.sparkContext.defaultParallelism for at, n in stages().items() if at not in before) >= 2


def test_pages_after_the_last_turn_are_not_looked_into(spark, monkeypatch):
    """The eighth page read ends a walk: no links of it are looked for; nor are they where the queue is full."""
    looked, likely = [], links._likely
    monkeypatch.setattr(links, "_likely", lambda page, most: looked.append(1) or likely(page, most))
    targets, table = made(spark, 2, 7)
    assert links.walk(targets, table).count() == 16 and len(looked) == 1
    targets, table = made(spark, 2, 3)
    assert links.walk(targets, table, most_queued=4).count() == 8 and len(looked) == 2
