"""Links that pages hide, structured offers and matches of pages, on pinned cases."""

import pytest
from pyspark.sql import functions as F

from pricetide.operators import links, offers, pages

EAN, NAME = "4006381333931", "Stabil Point 88 Blue"


def ld(data, kind='type="application/ld+json"'):
    return f"<script {kind}>{data}</script>"


def pairs_of(spark, htmls):
    rows = [(i, "https://www.shop.example/a/b?x=1", h, EAN, NAME) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id int, url string, html string, ean string, name string")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a</p>", "<p>a</p>"),
        ("<div hidden><div>x</div><a href='/t'>t</a></div>b", "b"),
        ("<style>.trap, #gone { display : none }</style><i class='big trap'>x</i><b id=gone>y</b>z", " z"),
        ("<div style='position:absolute; left:-9999px'>x<br>y</div>k<img hidden>l", "kl"),
        ("<ul><li aria-hidden='true'>x</ul>y", "<ul>y"),
        ("<p style='width:0;height:0px'>x</p><p style='width:0'>y</p>", "<p style='width:0'>y</p>"),
        ("<p style='max-width:0;height:0'>y</p>", "<p style='max-width:0;height:0'>y</p>"),
        ("a<script>if (a < b) {}</script>b", "a b"),
        ("</div>a<div class='sr-only'>b", "</div>a"),
        ("", ""),
    ],
)
def test_shown(html, want):
    assert links.shown_html(html) == want


def test_hidden_links(spark):
    html = "<a href='/open'>o</a><div class='honeypot'><p><a href='/trap'>t</a></p><a href='/open'>o</a></div>"
    got = links.hidden_links(pairs_of(spark, [html, None, ""])).collect()
    assert [tuple(r) for r in got] == [(0, "/trap")]


def test_likely_links(spark):
    html = f"""<link rel="canonical" href="/c"><a href="/p/{EAN}">x</a><a href="item?v=1&amp;w=2">Stabil <b>point</b></a><a href="/plain">no</a><a href="https://else.example/p/1">e</a>
        <a href="/sale">s</a><a href="mailto:a@b">m</a><div hidden><a href="/p/{EAN}9">h</a></div>"""
    got = links.likely_links(pairs_of(spark, [html, None])).orderBy("n").collect()
    root = "https://www.shop.example"
    assert [(r["link"], r["score"]) for r in got] == [(f"{root}/c", 30), (f"{root}/p/{EAN}", 24), (f"{root}/a/item?v=1&w=2", 2), (f"{root}/sale", 2)]


def deep(inner, levels):
    """`inner` below so many levels, every other one an array."""
    for i in range(levels):
        inner = f"[{inner}]" if i % 2 else f'{{"k{i}":{inner}}}'
    return inner


def test_deep_nodes(spark):
    """Products 10 and 14 levels deep count in nodes, candidates, offers and matches; one at 15 doesn't, as in the reference."""
    product = f'{{"@type":"Product","name":"{NAME}","gtin13":"{EAN}","price":"8.50","offers":{{"price":"8.50","priceCurrency":"EUR"}}}}'
    pairs = pairs_of(spark, [ld(deep(product, n)) for n in (6, 10, 14, 15)])
    nodes = pages.json_nodes(pairs).groupBy("page_id").agg(F.max(F.size(F.split("path", "/"))).alias("n"))
    assert {r["page_id"]: r["n"] - 1 for r in nodes.collect()} == {0: 7, 1: 11, 2: 14, 3: 14}
    found = offers.structured_candidates(pairs).select("page_id", "price_cents").cache()
    assert sorted(map(tuple, found.collect())) == [(0, 850), (1, 850), (2, 850)]
    chosen = pages.select_offer(offers.structured_candidates(pairs), pages.context_prices(pairs)).collect()
    assert sorted((r["page_id"], r["price_cents"]) for r in chosen) == [(0, 850), (1, 850), (2, 850)]
    rules = spark.createDataFrame([], "host string, price_selector string")
    match = {r["page_id"]: (r["structured"], r["price_cents"]) for r in offers.match_pages(pairs, rules).collect()}
    assert match == {0: (True, 850), 1: (True, 850), 2: (True, 850), 3: (False, None)}


def test_structured_candidates(spark):
    cases = [
        ld(f'{{"@type":"product","name":"{NAME}","gtin13":["1","{EAN}"],"offers":[{{"price":"9"}},{{"price":"8.50","salePrice":"7,50","priceCurrency":"eur","availability":"InStock"}}]}}'),
        ld(f'{{"@graph":[{{"@type":"Product","name":"{NAME}","sku":"{EAN}","offers":{{"@id":"#o"}}}},{{"@id":"#o","price":5,"priceCurrency":"EUR"}}]}}'),
        ld(f'{{"props":{{"product":{{"displayName":"{NAME}","EAN":"{EAN}","oldPrice":"20","price":{{"amount":12.5,"currency":"EUR"}},"shipping":{{"price":1}},"inStock":true}}}}}}', 'id="__NEXT_DATA__" type="x"'),
        f'{{"item":1,"title":"{NAME}","priceCents":1234,"list_price":"99"}}',
        ld(f'{{"item":1,"title":"Another thing","price":"3"}}') + ld('{"@type":"Production","name":"x","price":"4"}'),
        None,
        "",
    ]
    got = {r["page_id"]: r for r in offers.structured_candidates(pairs_of(spark, cases)).collect()}
    assert set(got) == {0, 1, 2, 3}
    told = {i: (r["price_cents"], r["currency"], r["in_stock"], r["exact_ean"], r["score"]) for i, r in got.items()}
    assert told == {0: (750, "EUR", True, True, 374.0), 1: (500, "EUR", None, True, 374.0), 2: (1250, "EUR", True, True, 358.0), 3: (1234, None, None, False, 108.0)}


def test_context_prices_near_name(spark):
    far = "<p>" + "filler " * 10 + "</p>"
    html = f"<p>{NAME}: now 5.00 EUR</p>{far}<p>old price 9.00 EUR</p><p>now 8.00 EUR</p>{far}<p>now 7.00 EUR or €4.00 today</p>{far}<p>now 3.00 EUR per month</p>"
    got = {tuple(r) for r in pages.context_prices(pairs_of(spark, [html, None])).collect()}
    assert got == {(0, 500, "EUR", 53, "name-context"), (0, 700, "EUR", 53, "name-context"), (0, 400, "EUR", 35, "name-context")}


def test_json_alternates(spark):
    html = '<link rel="alternate" type="application/ld+json" href="/x/1"><b data-json-url="/a.json"></b><link rel="alternate" type="text/html" href="/y">'
    got = pages.public_data_urls(pairs_of(spark, [html, None])).orderBy("link").collect()
    assert [(r["link"], r["score"]) for r in got] == [("https://www.shop.example/a.json", 12), ("https://www.shop.example/x/1", 12)]


def test_match_pages(spark):
    product = f'{{"@type":"Product","name":"{NAME}","gtin":"{EAN}","offers":{{"price":"10.00","priceCurrency":"EUR","availability":"OutOfStock"}}}}'
    cases = [ld(product), f"<h1>{NAME}</h1><p>EAN {EAN}</p><span class='price-now'>8.00 EUR</span> in stock", "<h1>Other</h1><span class='price'>3.00 EUR</span>", None, f"<h1>{NAME}</h1><em id='cost'>6.00 EUR</em>"]
    rules = spark.createDataFrame([("shop.example", "#cost")], "host string, price_selector string")
    got = {r["page_id"]: r for r in offers.match_pages(pairs_of(spark, cases), rules).collect()}
    told = {i: (r["price_cents"], r["price_source"], r["ean_match"], r["in_stock"], r["structured"]) for i, r in got.items()}
    assert told == {0: (1000, "structured", True, False, True), 1: (800, "product-element", True, True, False), 2: (None, None, False, None, False), 3: (None, None, False, None, False), 4: (600, "profile-selector", False, None, False)}
    assert got[0]["title"] == NAME and got[0]["confidence"] == "high"
