"""Elements, selectors, entities, addresses and forms of pages, on markups as shops write them."""

import pytest
from pyspark.sql import functions as F

from pricetide.functions import scalars as S
from pricetide.operators import elements, pages


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("a&nbsp;b&amp;c", "a b&c"), ("&#8364;9 &#x20AC;9", "€9 €9"), ("&#x1F600;&lt;", "😀<"), ("&amp;#65;", "A"), ("&#0;&#xD800;&#9999999;", "\0&#xD800;&#9999999;"), ("&apos;&QUOT;", "'\""), ("no &entity", "no &entity"), ("", ""), (None, None)],
)
def test_decoded(spark, text, want):
    assert one(spark, text, elements.decoded) == want


@pytest.mark.parametrize(
    "reference, want",
    [
        # RFC 3986, 5.4.1 and 5.4.2, without fragments
        ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g/"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q"),
        (";x", "http://a/b/c/;x"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"),
        ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"), ("g..", "http://a/b/c/g.."), ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"),
        ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("g;x=1/./y", "http://a/b/c/g;x=1/y"), ("g?y/./x", "http://a/b/c/g?y/./x"), ("g?y/../x", "http://a/b/c/g?y/../x"),
        ("ftp://g", None), ("javascript:x()", None), (" HTTP://G:80 ", "http://g/"), ("https://g:444/A", "https://g:444/A"), (None, None),
    ],
)
def test_resolve_url(spark, reference, want):
    assert one(spark, reference, lambda c: S.resolve_url(c, F.lit("http://a/b/c/d;p?q"))) == want


@pytest.mark.parametrize("a, b, want", [("shop.example", "shop.example", True), ("m.shop.example", "shop.example", True), ("shop.example", "m.shop.example", True), ("myshop.example", "shop.example", False), ("a.shop.example", "b.shop.example", False)])
def test_same_store(spark, a, b, want):
    assert spark.range(1).select(S.same_store(F.lit(a), F.lit(b)).alias("x")).first()["x"] is want


PAGE = """<!doctype html><html><body class="p"><div id="box"><p class="a price-now">Now <b>12,<i>50</i></b>&nbsp;€</p><br><p>second</div>
<meta itemprop="price" content="9.99 EUR"><input type=text name=q value="typed"><span data-testid='buy-price'>7 EUR<span>x</span></span><em id=never>open"""


@pytest.mark.parametrize(
    "selector, want",
    [
        (".price-now", "Now 12, 50 €"), ("p.price-now", "Now 12, 50 €"), ("b.price-now", None), ("#box", "Now 12, 50 € second"), ("div#box", "Now 12, 50 € second"), ("[itemprop=price]", "9.99 EUR"), ('meta[itemprop="price"]', "9.99 EUR"),
        ("input", "typed"), ("span[data-testid=buy-price]", "7 EUR x"), ("[data-testid]", "7 EUR x"), ("#never", ""), ("p p", None), ("a[href=x]", None), ("", None), (None, None), ("P.PRICE-NOW", None), ("  p.a  ", "Now 12, 50 €"),
    ],
)
def test_selected_text(spark, selector, want):
    row = spark.createDataFrame([(PAGE, selector)], "html string, s string")
    assert row.select(elements.selected_text(F.col("html"), F.col("s")).alias("x")).first()["x"] == want


def test_spans():
    found = elements.spans_of(PAGE, None)
    names = [e[0] for e in found]
    assert names[:6] == ["html", "body", "div", "p", "b", "i"] and "!doctype" not in names
    by = {e[0]: e for e in found}
    name, head, attributes, start, inner, close, end, parent = by["div"]
    assert attributes == {"id": "box"} and PAGE[start:inner] == '<div id="box">' and PAGE[close:end] == "</div>"
    assert found[found.index(by["b"])][7] == names.index("p") and by["em"][5] == -1
    assert elements.spans_of("", None) == [] and elements.spans_of("a < b > c <1>", None) == []


def test_suggestions_name_what_prices_read(spark):
    """What the library proposes as selectors its own profile prices read."""
    html = '<span itemprop="price">4.50 EUR</span><div data-testid="buy-price">4.50 EUR</div><b class="now-price">4.50 EUR</b>'
    page = spark.createDataFrame([(1, "https://s.example/", html)], "page_id int, url string, html string")
    proposed = page.select(F.explode(S.selector_suggestions(F.col("html"))).alias("s")).collect()
    assert proposed
    for r in proposed:
        rules = spark.createDataFrame([("s.example", r["s"])], "host string, price_selector string")
        got = pages.profile_prices(page.withColumns({"exact_ean": F.lit(True), "name_score": F.lit(0.0)}), rules).collect()
        assert [g["price_cents"] for g in got] == [450], r["s"]


def test_prices_of_odd_pages(spark):
    """Null, empty and cut pages, long contents, and prices in the page's currency."""
    htmls = [None, "", '<b class="price">', '<b class="price">5</b', f'<b class="price">5 EUR{"x" * 900}</b>', '<b class="price">5 EUR</b>' * 2, '<b class="price">5</b> SEK', "<p>5 EUR</p>"]
    rows = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    got = {r["page_id"]: (r["price_cents"], r["currency"]) for r in pages.best_price(rows).collect()}
    assert got == {5: (500, "EUR"), 6: (500, "SEK")}
    assert pages.html_prices(rows).where("page_id = 5").count() == 2 and pages.html_prices(rows.where("false")).count() == 0
