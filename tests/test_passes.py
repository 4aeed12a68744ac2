"""Page jobs read a page's text in one pass, by rules on Python texts that give what their Column forms give."""

import random

import pytest
from pyspark.sql import functions as F

from pricetide.functions import plain as P
from pricetide.functions import scalars as S
from pricetide.operators import elements, links, offers, pages

BITS = ["<script>", "</script>", "<STYLE a>", "</style>", "<noscript>", "</noscript>", "<p class='x'>", "</p>", "<!--", "-->", "&amp;", "&AMP;lt;", "&nbsp;", "&#160;", "&#x41;", "&#38;", "#65;", "&euro;", "&#39;", "&quot;", "&#xFEFF;", "&#xD800;", "&#9999999;", "&#x20AC;",
        " ", "\n", " ", "\x1c", "1", "23", "456", ".", ",", "’", "€", "EUR", "eur", "kr", "ſek", "zł", "ZŁ", "USD5", "é", "Ø", "İ", "ß", "½", "price", "now", "-", "<", ">", "4006381333931", "4006381 333931", "4-0-0 6381333931", "9", "XYZ", "$", "nok", "x"]
CODE = "4006381333931"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame([("a", "https://s.example/", "<p>x</p>", CODE, "x")], "page_id string, url string, html string, ean string, name string")


def test_plain_rules_are_the_columns(spark):
    r, t = random.Random(3), F.col("t")
    texts = ["".join(r.choice(BITS) for _ in range(r.randrange(0, 12))) for _ in range(1500)] + [None, ""]
    columns = {
        "decoded": (elements.decoded(t), P.decoded), "visible": (pages.visible(t), P.visible), "price_values": (S.price_values(t), P.price_values), "detect": (S.detect_currency(t), P.detect_currency), "normalize": (S.normalize_currency(t), P.normalize_currency),
        "words": (S.plain_words(t), P.plain_words), "score": (S.name_score(F.lit("Xyz Now Éx price"), t), lambda x: P.name_score("Xyz Now Éx price", x)), "code": (S.contains_barcode(t, F.lit(CODE)), lambda x: P.contains_barcode(x, CODE)), "short": (S.contains_barcode(t, F.lit("23")), lambda x: P.contains_barcode(x, "23")),
        "text": (elements.text_of(t), lambda x: None if x is None else P.text_of(x)), "digits": (S.digits(t), P.digits),
    }
    for row in spark.createDataFrame([(x,) for x in texts], "t string").select("t", *(c.alias(n) for n, (c, _) in columns.items())).collect():
        assert {n: row[n] for n in columns} == {n: rule(row["t"]) for n, (_, rule) in columns.items()}, row["t"]


def test_passes_keep_rows_and_types(spark):
    rows = spark.createDataFrame([((k, "x"), None if k % 3 else "ab" * (k % 4)) for k in range(200)], "page_id struct<a:int,b:string>, html string").repartition(1)
    found = elements.passed(rows, ["page_id"], ["html"], lambda html: list(enumerate(html or "")), "place int, char string")
    assert found.dtypes == [("page_id", "struct<a:int,b:string>"), ("place", "int"), ("char", "string")]
    assert sorted((r[0]["a"], r["place"], r["char"]) for r in found.collect()) == [(k, i, c) for k in range(0, 200, 3) for i, c in enumerate("ab" * (k % 4))]


def test_prices_are_read_in_one_pass(pairs):
    """No step of a price is a lambda over arrays of elements, and the best price moves rows once."""
    plan = plan_of(pages.html_prices(pairs))
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan
    assert pages.best_price(pairs)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_currencies_of_prices():
    html = "<b class='price'>5 eur</b><b class='price' id='usd'>6</b><p>7 ₹</p><b class='cost'>8</b><b class='cost'>½EUR 9</b><b class='cost'>x9EUR</b>"
    assert [(c, k) for _, c, k, _, _ in pages.prices_of(html)] == [(500, "EUR"), (600, "USD"), (800, "EUR"), (900, "EUR"), (900, "EUR")]


@pytest.mark.parametrize(("make", "moves"), [(pages.ranked_data_urls, 1), (pages.search_forms, 1), (links.likely_links, 1)])
def test_references_are_read_in_one_pass(pairs, make, moves):
    """What a page refers to comes of one pass over its text, and its rows move once."""
    df = make(pairs)
    assert plan_of(df).count("MapInArrow") == 1 and "ArrowEvalPython" not in plan_of(df)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == moves


def test_forms_within_forms():
    page = "<form action=/a><form action=/b><input name=q></form></form><form method=POST><input name=q></form><form class=search><input name=isci><input type=hidden name=a value=1><input type=hidden name=token value=2><input name=s><input name=q></form><form><input name=q>"
    assert pages.forms_of(page) == [(0, "/a", "q", "", 14), (2, "", "s", "a=1", 22)] and pages.forms_of(None) == []


def test_references_of_odd_pages():
    assert pages.data_references("<link rel='x alternate' type=text/json href=><i data-api-url='a&amp;b' data-product-api=c></i><link rel=alternate type='application/a+json' href=d>") == [(0, "d", 12), (1, "c", 11), (2, "a&b", 8)]
    assert links.shown_anchors("<a href='/a'>A <b>b</b></a><link rel=canonical><link rel='x canonical' href='/c'><div hidden><a href=\"/h\">h</a></div><a href=/n>n</a>") == [(0, "/c", True, ""), (1, "/a", False, "a b")]
    assert pages.data_references(None) == links.anchors_of(None) == links.shown_anchors(None) == []


def test_candidates_are_judged_in_one_pass(spark, pairs):
    """Documents are parsed once, no node moves, and what Spark's variants make of numbers and bad documents stays."""
    df = offers.structured_candidates(pairs)
    assert plan_of(df).count("MapInArrow") == 1 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    data = ['{"@type":"Product","name":"x","gtin13":4006381333931,"offers":{"price":100.0}} tail', '{"@type":"Product","name":"x","offers":[]}', '{"@type":"Product","name":"x","name":"x"}', '{"@type":"Product","name":"x\\ud800","offers":{"price":1e2}}', '{"@type":"Product","name":NaN}', '[[{"@type":["Product"],"gtin":"1","sku":5.50}]]']
    html = "".join(f"<script type=application/json>{d}</script>" for d in data)
    got = offers.structured_candidates(spark.createDataFrame([(1, html, CODE, "xy")], "page_id int, html string, ean string, name string")).orderBy("path").collect()
    assert [(r["path"], r["title"], r["price_cents"], r["exact_ean"]) for r in got] == [("0", "x", 10000, True), ("1", "x", None, False), ("3", "x?", 10000, False), ("5/0/0", None, None, False)]


def test_labelled_prices_are_read_in_one_pass(pairs):
    df = pages.context_prices(pairs)
    assert plan_of(df).count("MapInArrow") == 1 and "lambda" not in plan_of(df)
    text = f"<p>now 1.00 EUR</p>{'x ' * 1000}<p>EAN {CODE[:3]} {CODE[3:]}</p><p>Price: 2.00 EUR</p><p>{'y' * 60} price 3.00 EUR and shipping</p><p>{'z' * 60} €4 NOW</p>"
    assert sorted(pages.labelled_prices(text, CODE, None)) == [(200, "EUR", 54, True), (400, "EUR", 72, True)]
    assert pages.labelled_prices(None, CODE, "x") == pages.labelled_prices(text, None, None) == pages.labelled_prices(text, "", "") == []


def test_evidence_is_read_in_one_pass(pairs, spark):
    html = f"<title> t </title><h1> </h1><p>{CODE} Stabil</p>"
    assert offers.evidence_of(html, CODE, "T Stabil point") == [(True, 0.5)] and offers.evidence_of(None, CODE, None) == [(False, 0.0)]
    rules = spark.createDataFrame([], "host string, price_selector string")
    assert "(?is)<(script|style|noscript)" in plan_of(pages.signals(pairs)) and plan_of(offers.match_pages(pairs, rules)).count("(?is)<(script|style|noscript)") <= 2
