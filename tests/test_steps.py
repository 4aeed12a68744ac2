"""Costly steps of page jobs are in a plan once, whatever filters read them; and what they give stays the same."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricetide.functions import scalars as S
from pricetide.operators import links, pages, results

FRAGMENT = "#.*$"


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame([("a", "https://s.example/", "<p>x</p>", "4006381333931", "x")], "page_id string, url string, html string, ean string, name string")


@pytest.mark.parametrize("make", [pages.ranked_data_urls, pages.search_forms, links.likely_links])
def test_addresses_are_resolved_once(pairs, make):
    """An address loses its fragment twice, as a reference and when it is whole."""
    plan = make(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(FRAGMENT) == 2


def test_amounts_and_texts_are_read_once(spark, pairs):
    """A profile's price: the texts of a selector and its amounts are in the plan once."""
    rules = spark.createDataFrame([("s.example", "b")], "host string, price_selector string")
    made = pages.profile_prices(pairs.selectExpr("page_id", "url", "html", "true AS exact_ean", "0.5D AS name_score"), rules)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]{1,8}") == 1
    assert plan.count("(?is)<(script|style)") == 1


def test_page_currency_where_a_price_names_none(spark):
    html = [("a", '<p>£</p><b class="price">5.00 £</b><b class="price">6.00</b>'), ("b", '<p>£</p><b class="price">5.00 EUR</b>'), ("c", '<meta property="og:price:currency" content="chf"><b class="price">7.00</b>'), ("d", "<p>€ 5</p>")]
    rows = pages.html_prices(spark.createDataFrame(html, "page_id string, html string")).select("page_id", "price_cents", "currency").collect()
    assert {tuple(r) for r in rows} == {("a", 500, "GBP"), ("a", 600, "GBP"), ("b", 500, "EUR"), ("c", 700, "CHF")}


def test_odd_addresses(spark):
    given = {"a/.b": "http://h/x/a/.b", "a?b/./c": "http://h/x/a?b/./c", "a\n": "http://h/x/a\n", "HTTP://H:80/#": "http://h/", "https://h:443": "https://h/", "http://h:443/a": "http://h:443/a", "http://:80": None, "//.h/a": "http://.h/a", "http://İ.example/A": "http://i̇.example/A"}
    rows = spark.createDataFrame(list(given.items()), "r string, want string").select("want", S.resolve_url(F.col("r"), F.lit("http://h/x/y#z")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hidden_links_read_anchors_once(pairs):
    """A page's anchors, and those of what is shown of it, are in the plan once."""
    assert plan_of(links.hidden_links(pairs)).count("data-product-url") == 2


def test_shown_in_parts():
    """A batch of any size is never whole as texts of Python; what is made of it keeps its order and nulls."""
    pages_ = [None if k % 7 == 0 else f"<p>{k}</p><b hidden>x</b>" for k in range(300)]
    parts = list(links.shown_parts(iter([pa.array(pages_), pa.array([], pa.string()), pa.array(["a"])])))
    assert max(map(len, parts)) <= links.AT_A_TIME
    assert [t for part in parts for t in part.to_pylist()] == [None if p is None else p.replace("<b hidden>x</b>", "") for p in pages_] + ["a"]


def test_suggestions_read_attributes_once(spark, pairs):
    assert plan_of(pairs.select(S.selector_suggestions(F.col("html")).alias("s"))).count(r"\bitemprop=") == 1
    html = '<b class="price x">1</b><b class="price x">1</b><i itemprop="Price" id="a">2</i><u itemprop="no" data-testid="a b" id="sku-1">3</u><em data-testid="ean.1">4</em><s class="- gtin!">5</s>'
    assert spark.createDataFrame([(html,)], "html string").select(S.selector_suggestions(F.col("html"))).first()[0] == [".price", "i[itemprop=Price]", "#sku-1", "em[data-testid=ean.1]"]


def test_paths_and_nodes_open_levels_in_place(spark, pairs):
    """However many levels a document has, its rows pass one step that opens arrays; odd documents give what they gave."""
    given = ['{"a":[{"b":[1,[2],null,{"c":3}]},{"b":[]},{"b":"x"},null,4]}', '{"a":{"b":true}}', "[]", '{"a":[]}', '[{"a":{"b":1.50}}]', "7"]
    rows = spark.createDataFrame(list(enumerate(given)), "id int, text string").select("id", F.parse_json("text").alias("node"))
    found = pages.json_path_values(rows, "a.b")
    assert plan_of(found).count("Generate") == 1
    assert sorted(map(tuple, found.collect())) == [(0, "1"), (0, "x"), (1, "true"), (4, "1.5")]
    assert pages.json_path_values(rows, "a.b.c.d.e.f").count() == pages.json_path_values(rows, " . ").count() == 0
    nodes = pages.json_nodes(pairs)
    assert plan_of(nodes).count("Generate") == 2
    html = [(0, '<SCRIPT type="application/json">{"a":[null,{},[[{"b":1}]],"x"],"c/d":{"e":null}}</SCRIPT><script>{"no":1}</script><script id=__NEXT_DATA__>[1,{"f":2}]</script><script type="application/ld+json">{bad</script>'), (1, ' [{"g":[]}] '), (2, "5"), (3, None)]
    got = pages.json_nodes(spark.createDataFrame(html, "page_id int, html string")).select("page_id", "path").collect()
    assert sorted(map(tuple, got)) == sorted([(0, "0"), (0, "0/a/1"), (0, "0/a/2/0/0"), (0, "0/c/d"), (0, "1/1"), (1, "0/0")])


def test_attempts_meet_once(spark):
    """Verdicts need no join of attempts with what was found of them: one for what is met, one for the state."""
    attempts = spark.createDataFrame([(1, 0, None, "read", None)], "id int, place int, profile_id string, kind string, reason_code string")
    facts = "id int, place int, score double, ean_match boolean, structured_ean boolean, structured boolean, name_score double, price_cents long, profile_id string, overall_confidence int, source_confidence int"
    made = results.classify_attempts(attempts.select("id"), attempts, spark.createDataFrame([], facts))
    assert plan_of(made.select("id", "status")).count("Join") <= 2
    assert [tuple(r) for r in made.collect()] == [(1, "not_found", "not_found")]
