"""Rules for search profiles, and the fields that a valid one keeps."""

from pricetide.operators import profiles

SCHEMA = "id int, label string, hostname string, html_signature string, search_url_template string, product_selector string, ean_selector string, price_selector string, cookie_consent_selector string, json_ld_ean_fields string, json_ld_price_fields string, json_ld_currency_fields string, block_patterns string, allow_rendered_fallback string, enabled string, site_type string, timeout_ms double, max_page_bytes double, retry_budget double"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")][1:]
GOOD = dict.fromkeys(NAMES) | {"label": "Store", "hostname": "store.example", "search_url_template": "/search?q={query}"}

CASES = [
    ({}, ""), ({"label": " x "}, "label"), ({"label": "x" * 81}, "label"), ({"label": None}, "label"),
    ({"hostname": "https://www.trgovinejager.com/", "search_url_template": "/iskalnik/?isci={query}"}, ""), ({"hostname": "https://store.example/shop"}, "hostname"), ({"hostname": "localhost"}, "hostname"), ({"hostname": "10.0.0.1"}, "hostname"), ({"hostname": "u:p@store.example"}, "hostname"),
    ({"hostname": "store.example:8080"}, "hostname"), ({"hostname": "STORE.example:443"}, ""), ({"hostname": "ftp://store.example"}, "hostname"), ({"hostname": "store.example?x=1"}, "hostname"), ({"hostname": "my store.example"}, "hostname"), ({"hostname": "[::1]"}, "hostname"),
    ({"hostname": None}, "html_signature"), ({"hostname": None, "html_signature": "shop-platform", "search_url_template": "/find/{query}"}, ""), ({"hostname": "", "html_signature": "abc", "search_url_template": "https://store.example/find?q={query}"}, "search_url_relative_only"), ({"html_signature": "s" * 501}, "html_signature"),
    ({"search_url_template": "/search"}, "search_url_placeholder"), ({"search_url_template": None}, "search_url_placeholder"), ({"search_url_template": "/{query}/search?q={query}"}, "search_url_placeholder"), ({"search_url_template": "https://evil.example/search?q={query}"}, "search_url_other_site"),
    ({"search_url_template": "https://{query}.store.example/search"}, "search_url_query_in_host"), ({"search_url_template": "/search#{query}"}, "search_url_query_in_fragment"), ({"search_url_template": "//store.example/{query}"}, "search_url_address"), ({"search_url_template": "javascript:{query}"}, "search_url_address"),
    ({"search_url_template": "https://u:p@store.example/{query}"}, "search_url_credentials"), ({"search_url_template": "https://store.example:8443/{query}"}, "search_url_port"), ({"search_url_template": "https://store.example:443/{query}"}, ""), ({"search_url_template": "http://m.store.example/s?q={query}&l=1"}, ""), ({"search_url_template": "/" + "x" * 500 + "{query}"}, "search_url_length"), ({"search_url_template": "find/{query}"}, ""),
    ({"product_selector": ".product-card", "ean_selector": "[data-ean]", "price_selector": "[itemprop=price]"}, ""), ({"price_selector": ".card .price"}, "price_selector"), ({"price_selector": "span.a"}, ""), ({"price_selector": "#a.b"}, "price_selector"), ({"ean_selector": "[href=x]"}, "ean_selector"), ({"product_selector": "x" * 181}, "product_selector"), ({"price_selector": "div[data-testid='a b']"}, ""),
    ({"json_ld_ean_fields": "barcode, product.gtin13", "json_ld_price_fields": "offers.price"}, ""), ({"json_ld_ean_fields": "a.b.c.d.e.f"}, "json_ld_ean_fields"), ({"json_ld_price_fields": ",".join("abcdefghi")}, "json_ld_price_fields"), ({"json_ld_currency_fields": "a[0]"}, "json_ld_currency_fields"), ({"json_ld_currency_fields": "x" * 81}, "json_ld_currency_fields"),
    ({"block_patterns": "verify you are human\nchallenge page"}, ""), ({"block_patterns": "\n".join("abcdefghi")}, "block_patterns"), ({"block_patterns": "b" * 121}, "block_patterns"), ({"block_patterns": "a\x01b"}, "block_patterns"),
    ({"allow_rendered_fallback": "yes"}, "allow_rendered_fallback"), ({"cookie_consent_selector": ".accept-all"}, "renderer_needed"), ({"cookie_consent_selector": ".accept-all", "allow_rendered_fallback": "true"}, ""), ({"enabled": "yes"}, "enabled"), ({"enabled": "false"}, ""),
    ({"site_type": "slow"}, ""), ({"site_type": "fast"}, "site_type"), ({"timeout_ms": 2999.0}, "timeout_ms"), ({"timeout_ms": 3000.0, "max_page_bytes": 8e6, "retry_budget": 4.0}, ""), ({"retry_budget": 1.5}, "retry_budget"), ({"max_page_bytes": 8e6 + 1}, "max_page_bytes"), ({"label": "", "enabled": "no", "retry_budget": -1.0}, "label,enabled,retry_budget"),
]


def table(spark, changes):
    return spark.createDataFrame([(k, *(GOOD | changed).values()) for k, changed in enumerate(changes)], SCHEMA)


def test_validate(spark):
    got = {r["id"]: r["errors"] for r in profiles.validate(table(spark, [c for c, _ in CASES])).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


def test_stored(spark):
    changed = {"label": " Example Store ", "hostname": "https://www.Store.Example/", "html_signature": " data-shop ", "enabled": "false", "json_ld_ean_fields": "barcode, product.gtin13\nbarcode", "block_patterns": " a \nb\na", "timeout_ms": 3000.0}
    rows = profiles.stored(table(spark, [changed, {"label": "x"}])).collect()
    assert len(rows) == 1
    row = rows[0].asDict()
    assert [row[c] for c in ("label", "hostname", "html_signature", "enabled", "allow_rendered_fallback", "json_ld_ean_fields", "block_patterns", "timeout_ms", "retry_budget", "identity")] == ["Example Store", "store.example", "data-shop", False, False, "barcode,product.gtin13", "a\nb", 3000, None, "store.example\0data-shop"]


def test_few_columns_and_empty_table(spark):
    rows = table(spark, [{}]).select("id", "label", "hostname", "search_url_template")
    assert profiles.validate(rows).first()["errors"] == "" and profiles.stored(rows.where("false")).count() == 0
