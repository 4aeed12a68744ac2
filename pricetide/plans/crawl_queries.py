"""Queries of the crawl operators and of the page-to-offer jobs, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import scalars as S
from pricetide.operators import crawl, links, offers, pages, policy, schedule
from pricetide.plans.reference_queries import _URL_HOST, NOW, _robots, pages_query, query

_KIND_HOST = "CASE {0} % 5 WHEN 0 THEN 'amazon.s' || {0} || '.example' WHEN 1 THEN 'temu.s' || {0} || '.example' ELSE 'shop-' || {0} || '.example' END"


@query(
    "crawl_budgets",
    "products websites",
    f"""SELECT host, t AS site_type, CASE WHEN s % 2 = 0 THEN greatest(3000, least(30000, s * 1000)) ELSE CASE t WHEN 'standard' THEN 8000 WHEN 'slow' THEN 16000 WHEN 'large' THEN 12000 WHEN 'javascript' THEN 10000 ELSE 14000 END END AS timeout_ms,
    CASE t WHEN 'standard' THEN 2 WHEN 'slow' THEN 3 WHEN 'large' THEN 5 WHEN 'javascript' THEN 3 ELSE 4 END * 1048576 AS max_page_bytes, CASE WHEN t IN ('standard', 'slow') THEN 2 ELSE 1 END AS retry_budget
    FROM (SELECT DISTINCT store_id AS s, {_KIND_HOST.format('store_id')} AS host, CASE WHEN store_id % 3 = 1 THEN 'marketplace' WHEN store_id % 7 = 0 THEN 'javascript' WHEN store_id % 5 = 0 THEN 'large' WHEN store_id % 5 = 1 THEN 'slow' ELSE 'standard' END AS t FROM products)""",
)
def _(products: DataFrame, websites: DataFrame) -> DataFrame:
    settings = websites.selectExpr(
        f"{_KIND_HOST.format('id')} AS host", "CASE id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'marketplace' END AS site_type", "id % 7 = 0 AS rendered",
        "CASE WHEN id % 2 = 0 THEN id * 1000 END AS timeout_ms", "CAST(NULL AS BIGINT) AS max_page_bytes", "CAST(NULL AS INT) AS retry_budget",
    )
    return crawl.budgets(products.selectExpr(f"{_KIND_HOST.format('store_id')} AS host").distinct(), settings)


_ASK = "replace(name, ' ', '%20')"


@query(
    "crawl_search_candidates",
    "websites products",
    f"""SELECT id AS site, 'https://shop-' || id || '.example' || path || q AS url, profile FROM (SELECT DISTINCT store_id, {_ASK} AS q FROM products) JOIN (
        SELECT id, '/find?x=' AS path, 'custom' AS profile FROM websites WHERE id % 4 = 0 UNION ALL SELECT id, '/catalogsearch/result/?q=', 'magento' FROM websites WHERE id % 4 = 1
        UNION ALL SELECT id, unnest(['/search?q=', '/search?query=', '/search?search=', '/?s=']), 'generic' FROM websites WHERE id % 4 <> 0) ON id = store_id""",
)
def _(websites: DataFrame, products: DataFrame) -> DataFrame:
    name = "'shop-' || id || '.example'"
    sites = websites.selectExpr("id AS site", f"{name} AS host", f"'https://' || {name} || '/' AS root", "CASE WHEN id % 4 = 0 THEN '/find?x={query}' END AS template", "CASE WHEN id % 4 = 1 THEN 'magento' END AS platform")
    return crawl.search_candidates(sites, products.selectExpr("store_id AS site", "name AS query").distinct())


@query(
    "crawl_form_candidates",
    "websites products",
    f"""SELECT id AS site, 'https://shop-' || id || '.example' || path || CASE WHEN profile = 'generic' THEN q ELSE replace(q, '%20', '+') END AS url, profile FROM (SELECT DISTINCT store_id, {_ASK} AS q FROM products) JOIN (
        SELECT id, '/find?shop=x&lang=en&term=' AS path, 'form-1' AS profile FROM websites WHERE id % 2 = 0
        UNION ALL SELECT id, unnest(['/search?q=', '/search?query=', '/search?search=', '/?s=']), 'generic' FROM websites) ON id = store_id""",
)
def _(websites: DataFrame, products: DataFrame) -> DataFrame:
    sites = websites.selectExpr("id AS site", "'shop-' || id || '.example' AS host").selectExpr("*", "'https://' || host || '/' AS root", "CAST(NULL AS STRING) AS template", "CAST(NULL AS STRING) AS platform")
    form = '<form action="/find?shop=x&term=old"><input type="hidden" name="lang" value="en"><input type="hidden" name="csrf" value="1"><input type="hidden" name="shop" value="y"><input type="search" name="term"></form>'
    forms = pages.search_forms(sites.selectExpr("site AS page_id", "root AS url", f"CASE WHEN site % 2 = 0 THEN '{form}' ELSE '' END AS html")).withColumnRenamed("page_id", "site")
    return crawl.search_candidates(sites, products.selectExpr("store_id AS site", "name AS query").distinct(), forms)


@query(
    "crawl_plan",
    "products websites",
    """SELECT host, 'https://' || host || '/p' || k || '/x' AS url, CASE WHEN store_id % 7 = 0 THEN 'blocked' WHEN store_id % 3 = 2 THEN 'cooldown' WHEN k = 3 THEN 'known_bad_pattern' WHEN k = store_id % 5 THEN 'robots_disallowed' END AS reason
    FROM (SELECT DISTINCT host, store_id, product_id % 5 AS k FROM products)""",
)
def _(products: DataFrame, websites: DataFrame) -> DataFrame:
    urls = products.selectExpr("host", "'https://' || host || '/p' || (product_id % 5) || '/x' AS url").distinct()
    shop = "'shop-' || id || '.example' AS host"
    access = policy.access(urls.select("host").distinct(), websites.selectExpr(shop, "CASE WHEN id % 7 = 0 THEN 'block' ELSE 'allow' END AS mode"), websites.limit(0).selectExpr(shop), websites.limit(0).selectExpr(shop))
    waits = websites.selectExpr(shop, f"timestampadd(DAY, CAST(id % 3 - 1 AS INT), TIMESTAMP_NTZ '{NOW}') AS until")
    bad = policy.known_bad(urls.selectExpr("url AS page_id", "host", "url", "'' AS html"), websites.agg(F.min("id")).selectExpr("'a' AS id", "'*' AS host", "'*/p3/*' AS url_pattern", "CAST(NULL AS STRING) AS content_pattern"))
    return crawl.plan(urls, policy.robots_allows(urls, policy.robots_rules(_robots(websites), "PriceBot/1.0")), bad.select(F.col("page_id").alias("url")), access, waits, NOW)


@query(
    "crawl_sitemap_match",
    "products",
    """SELECT id, 'https://' || host || CASE product_id % 4 WHEN 0 THEN '/p/' || ean WHEN 1 THEN '/item/mx' || lpad('' || product_id, 8, '0') || '-new' ELSE '/b/' || ean END AS url, CASE WHEN product_id % 4 = 1 THEN 901 ELSE 1000 END AS score
    FROM products WHERE product_id % 4 <> 2""",
)
def _(products: DataFrame) -> DataFrame:
    targets = products.selectExpr("id", "host", "ean", "name || ' MX' || lpad('' || product_id, 8, '0') AS name", "product_id % 4 AS k")
    one = targets.where("k < 2").selectExpr("host", "'https://' || host || CASE k WHEN 0 THEN '/p/' || ean ELSE '/item/' || lower(substring_index(name, ' ', -1)) || '-new' END AS url", "CAST(NULL AS STRING) AS lastmod")
    two = targets.where("k > 1").selectExpr("host", "ean", "k", "explode(array('a', 'b')) AS x").selectExpr("host", "'https://' || host || '/' || x || '/' || ean AS url", "CASE WHEN k = 3 THEN CASE x WHEN 'a' THEN '2024-01-01' ELSE '2024-02-01' END END AS lastmod")
    return crawl.sitemap_match(one.unionByName(two), targets)


_ROOT = "lower(regexp_extract(url, '^(https?://[^/?#]+)', 1))"


@pages_query("crawl_discovered_stores", f"SELECT {_URL_HOST.format('url')} AS host, arg_min({_ROOT}, page_id) || '/' AS url, arg_min(regexp_replace(url, '#.*$', ''), page_id) AS product_url FROM pages GROUP BY 1")
def _(pages_: DataFrame) -> DataFrame:
    return crawl.discovered_stores(pages_.select(F.col("page_id").alias("place"), "url"))


_LAST = "SELECT store_id, arg_max(struct_pack(status, product_id, last_checked_at), (last_checked_at, id)) AS r FROM products WHERE last_checked_at IS NOT NULL GROUP BY store_id"


@query(
    "crawl_profile_health",
    "websites products",
    f"""SELECT id, CASE WHEN r IS NULL THEN 70 ELSE score END AS health_score, CASE WHEN r IS NULL THEN 'healthy' ELSE drift END AS drift_status, CASE WHEN r.status = 'found' THEN r.last_checked_at END AS last_working_at, id % 6 <> 0 AND NOT (r IS NOT NULL AND (score <= 20 OR drift = 'drifted')) AS enabled
    FROM (SELECT id, r, CASE WHEN r.product_id % 4 = 0 THEN r.product_id % 100 WHEN r.status = 'found' THEN 100 ELSE 40 END AS score, CASE WHEN r.product_id % 10 = 0 THEN 'drifted' WHEN r.status = 'found' THEN 'healthy' ELSE 'degraded' END AS drift FROM websites LEFT JOIN ({_LAST}) ON store_id = id)""",
)
def _(websites: DataFrame, products: DataFrame) -> DataFrame:
    profiles = websites.selectExpr("id", "70 AS health_score", "'healthy' AS drift_status", "CAST(NULL AS TIMESTAMP_NTZ) AS last_working_at", "id % 6 <> 0 AS enabled")
    results = products.where("last_checked_at IS NOT NULL").selectExpr("store_id AS profile_id", "id", "last_checked_at AS at", "status", "CASE WHEN product_id % 4 = 0 THEN product_id % 100 END AS score", "CASE WHEN product_id % 10 = 0 THEN 'drifted' END AS drift_status")
    return crawl.profile_health_update(profiles, results)


def _profiles(pages_: DataFrame) -> DataFrame:
    hosts = pages_.select(S.host(F.col("url")).alias("host")).distinct()
    return hosts.selectExpr("'p-' || host AS id", "host", "CASE WHEN length(host) % 2 = 0 THEN '<ARTICLE>' ELSE 'zzz' END AS signature")


_HOSTED = f"SELECT page_id, {_URL_HOST.format('url')} AS host, contains(lower(html), '<article>') AS has FROM pages"


@pages_query(
    "crawl_resolve_profile",
    f"""SELECT page_id, CASE WHEN own THEN 'custom-p-' || host WHEN any_ THEN 'custom-z-any' ELSE 'b-html' END AS profile_id, CASE WHEN own THEN '#own' WHEN any_ THEN '#any' ELSE '.built' END AS price_selector,
        concat_ws(',', CASE WHEN lists THEN 'wall' END, CASE WHEN own THEN 'gate' WHEN any_ THEN 'stop' END) AS block_patterns
    FROM (SELECT *, length(host) % 2 = 0 AND has AS own, contains(lower(html), '<b>') AS any_, regexp_matches(html, '<(ul|li)>') AS lists FROM ({_HOSTED.replace('SELECT page_id', 'SELECT html, page_id')})) WHERE own OR any_ OR lists""",
)
def _(pages_: DataFrame) -> DataFrame:
    own = _profiles(pages_).selectExpr("id", "1 AS place", "host", "signature", "'#own' AS price_selector", "array('gate') AS block_patterns")
    any_ = pages_.agg(F.count("*")).selectExpr("'z-any' AS id", "2 AS place", "CAST(NULL AS STRING) AS host", "'<B>' AS signature", "'#any' AS price_selector", "array('stop') AS block_patterns")
    built_in = pages_.agg(F.count("*")).selectExpr("'b-html' AS id", "1 AS place", "'^never$' AS host_pattern", "'<(ul|li)>' AS html_pattern", "'.built' AS price_selector", "array('wall') AS block_patterns")
    return crawl.resolve_profile(pages_, own.unionByName(any_), built_in)


@pages_query("crawl_profile_drift", f"SELECT page_id, 'p-' || host AS profile_id, length(host) % 2 <> 0 OR NOT has AS drifted FROM ({_HOSTED})")
def _(pages_: DataFrame) -> DataFrame:
    return crawl.profile_drift(pages_, _profiles(pages_)).select("page_id", "profile_id", "drifted")


@query(
    "schedule_apply_edit",
    "schedules",
    f"""SELECT id, c AS cadence_minutes, e AS enabled, m AS target_mode, CASE WHEN c <> cadence_minutes OR (NOT enabled AND e) OR m <> target_mode THEN TIMESTAMP '{NOW}' + to_minutes(CAST(c AS INT)) ELSE next_run_at END AS next_run_at, CASE WHEN m <> target_mode THEN 0 ELSE cursor_index END AS cursor_index
    FROM (SELECT *, CASE WHEN ok AND id % 2 = 0 THEN (id % 50) * 10 ELSE cadence_minutes END AS c, CASE WHEN ok AND id % 4 = 0 THEN true ELSE enabled END AS e, CASE WHEN ok AND id % 5 = 0 THEN 'all' ELSE target_mode END AS m FROM (SELECT *, id % 2 = 1 OR (id % 50) * 10 >= 15 AS ok FROM schedules))""",
)
def _(schedules: DataFrame) -> DataFrame:
    return schedule.apply_edit(schedules, schedules.selectExpr("id", "CASE WHEN id % 2 = 0 THEN (id % 50) * 10 END AS cadence_minutes", "CASE WHEN id % 4 = 0 THEN true END AS enabled", "CASE WHEN id % 5 = 0 THEN 'all' END AS target_mode"), NOW)


def _spread(products: DataFrame) -> DataFrame:
    """The rows over all cores: small as they are, the pages made from them take long to read."""
    return products.repartition(products.sparkSession.sparkContext.defaultParallelism)


def _shop_pages(products: DataFrame) -> DataFrame:
    """A page of each product: linked data, without a price in a third of them and with another code in half, and a labelled price."""
    offer = "CASE WHEN product_id % 3 = 0 THEN '' ELSE '\"price\":\"' || format_string('%.2f', own_price_cents / 100) || '\",' END"
    data = f"""'{{"@graph":[{{"@type":"WebSite","name":"shop"}},{{"@type":["Product"],"name":"' || name || '","gtin13":"' || CASE WHEN product_id % 2 = 0 THEN ean ELSE '0000000000000' END
        || '","offers":[{{' || {offer} || '"priceCurrency":"EUR","availability":"https://schema.org/InStock"}}]}}]}}'"""
    text = "'<p>EAN ' || ean || '</p><p>Our price: 9.99 EUR</p><p>Sold by the shop itself, with a two-year warranty.</p><p>Shipping price 4.90 EUR</p>'"
    api = """'<div data-product-api="/api/item/' || ean || '"></div><i data-json-url="/x.json?token=1"></i><i data-api-url="https://' || host || '/login/x"></i>'"""
    return _spread(products).selectExpr("id AS page_id", "ean", "name", "website_url AS url", f"'<script type=\"application/ld+json\">' || {data} || '</script>' || {text} || {api} AS html")


@query("pages_json_nodes", "products", "SELECT id AS page_id, unnest(['0', '0/@graph/0', '0/@graph/1', '0/@graph/1/offers/0']) AS path FROM products")
def _(products: DataFrame) -> DataFrame:
    return pages.json_nodes(_shop_pages(products)).select("page_id", "path")


@query(
    "pages_structured_candidates",
    "products",
    "SELECT id AS page_id, ean, CASE WHEN product_id % 3 <> 0 THEN own_price_cents END AS price_cents, 'EUR' AS currency, true AS in_stock, product_id % 2 = 0 AS exact_ean, CASE WHEN product_id % 2 = 0 THEN 260 ELSE 0 END + 98.0 + CASE WHEN product_id % 3 <> 0 THEN 24 ELSE 0 END AS score FROM products",
)
def _(products: DataFrame) -> DataFrame:
    return offers.structured_candidates(_shop_pages(products)).select("page_id", "ean", "price_cents", "currency", "in_stock", "exact_ean", "score")


def _deep_pages(products: DataFrame) -> DataFrame:
    """A page of each product whose framework state holds it ten levels deep, and its offer twelve."""
    outer = ("props", "pageProps", "state", "initial", "cache", "catalog", "data", "list")
    head, tail = "".join(f'{{"{k}":' for k in outer), "}" * len(outer)
    data = f"""'{head}{{"products":[{{"@type":"Product","name":"' || name || '","gtin13":"' || ean || '","offers":[{{"price":"' || format_string('%.2f', own_price_cents / 100) || '","priceCurrency":"EUR","availability":"InStock"}}]}}]}}{tail}'"""
    return _spread(products).selectExpr("id AS page_id", "ean", "name", "website_url AS url", f"'<script id=\"__NEXT_DATA__\" type=\"application/json\">' || {data} || '</script>' AS html")


@query("pages_deep_candidates", "products", "SELECT id AS page_id, '0/props/pageProps/state/initial/cache/catalog/data/list/products/0' AS path, ean, own_price_cents AS price_cents, 'EUR' AS currency, true AS in_stock, true AS exact_ean FROM products")
def _(products: DataFrame) -> DataFrame:
    return offers.structured_candidates(_deep_pages(products)).select("page_id", "path", "ean", "price_cents", "currency", "in_stock", "exact_ean")


@query("pages_context_prices", "products", "SELECT id AS page_id, 999 AS price_cents, 'EUR' AS currency, 72 AS score FROM products")
def _(products: DataFrame) -> DataFrame:
    return pages.context_prices(_shop_pages(products)).drop("source")


@query("pages_select_offer", "products", "SELECT id AS page_id, CASE WHEN product_id % 3 = 0 THEN 999 ELSE own_price_cents END AS price_cents, 'EUR' AS currency, CASE WHEN product_id % 3 = 0 THEN 'ean-context' ELSE 'structured' END AS source FROM products")
def _(products: DataFrame) -> DataFrame:
    made = _shop_pages(products)
    return pages.select_offer(offers.structured_candidates(made), pages.context_prices(made))


@query("pages_public_data_urls", "products", "SELECT id AS page_id, 'https://www.' || host || '/api/item/' || ean AS link, 22 AS score FROM products")
def _(products: DataFrame) -> DataFrame:
    return pages.public_data_urls(_shop_pages(products))


@query("pages_search_forms", "products", "SELECT id AS page_id, 0 AS place, website_url || 'search' AS action, CASE WHEN product_id % 2 = 0 THEN 'q' ELSE 'find' END AS field, 'lang=' || store_id AS hidden FROM products")
def _(products: DataFrame) -> DataFrame:
    field = "CASE WHEN product_id % 2 = 0 THEN '<input name=\"q\">' ELSE '<input type=\"search\" name=\"find\">' END"
    form = f"""'<form action="/search"><input type="hidden" name="csrf_token" value="x"><input type="hidden" name="lang" value="' || store_id || '">' || {field} || '</form>'"""
    other = """'<form method="post" action="/search"><input name="q"></form><form action="https://elsewhere.example/"><input name="q"></form><form action="/mail"><input name="mail"></form>'"""
    return pages.search_forms(products.selectExpr("id AS page_id", "website_url AS url", f"{form} || {other} AS html"))


@query("pages_profile_prices", "products websites", "SELECT id AS page_id, own_price_cents AS price_cents, 'EUR' AS currency, CASE WHEN product_id % 2 = 0 THEN 290.0 ELSE 230.0 END AS score, 'profile-selector' AS source FROM products")
def _(products: DataFrame, websites: DataFrame) -> DataFrame:
    price = "format_string('%.2f EUR', own_price_cents / 100)"
    html = f"""'<div class="price old">1.00 EUR</div><span id="now" class="price main" data-testid="cost">' || {price} || '</span><strong>' || {price} || '</strong>'"""
    pairs = products.selectExpr("id AS page_id", "website_url AS url", f"{html} AS html", "product_id % 2 = 0 AS exact_ean", "0.5D AS name_score")
    rules = websites.selectExpr("'shop-' || id || '.example' AS host", "CASE id % 4 WHEN 0 THEN '#now' WHEN 1 THEN '.main' WHEN 2 THEN '[data-testid=\"cost\"]' ELSE 'strong' END AS price_selector")
    return pages.profile_prices(pairs, rules)


def _match_pages(products: DataFrame) -> DataFrame:
    """Pages of products in four kinds: linked data, a price element beside the code, a bare element that a selector names, and neither."""
    data = """'<script type="application/ld+json">{"@type":"Product","name":"' || name || '","gtin13":"' || ean || '","offers":{"price":"' || price || '","priceCurrency":"EUR","availability":"OutOfStock"}}</script>'"""
    made = _spread(products).withColumn("price", F.expr("format_string('%.2f', own_price_cents / 100)"))
    html = f"""CASE product_id % 4 WHEN 0 THEN {data} WHEN 1 THEN '<h1>' || name || '</h1><p>EAN ' || ean || '</p><span class="price-now">' || price || ' EUR</span><p>in stock</p>' WHEN 2 THEN '<h1>' || name || '</h1><em id="cost">' || price || ' EUR</em>' ELSE '<p>-</p>' END"""
    return made.selectExpr("id AS page_id", "website_url AS url", f"{html} AS html", "ean", "name")


@query(
    "pages_match",
    "products",
    """SELECT id AS page_id, product_id % 4 < 2 AS ean_match, CASE WHEN product_id % 4 < 3 THEN own_price_cents END AS price_cents, CASE WHEN product_id % 4 < 3 THEN 'EUR' END AS currency, CASE product_id % 4 WHEN 0 THEN false WHEN 1 THEN true END AS in_stock,
    CASE product_id % 4 WHEN 0 THEN 'structured' WHEN 1 THEN 'product-element' WHEN 2 THEN 'profile-selector' END AS price_source, product_id % 4 = 0 AS structured FROM products""",
)
def _(products: DataFrame) -> DataFrame:
    rules = products.select(S.host(F.col("website_url")).alias("host")).distinct().withColumn("price_selector", F.lit("#cost"))
    return offers.match_pages(_match_pages(products), rules).select("page_id", "ean_match", "price_cents", "currency", "in_stock", "price_source", "structured")


_NESTED = """'<style>.trap-' || {0} || ' {{ display: none }}</style><a href="/open">o</a><div class="x trap-' || {0} || '"><p><a href="/trap/' || {0} || '">t</a></p><a href="/open">o</a></div><span hidden><a href="/gone">g</a></span>'"""


@query("pages_hidden_links", "products", "SELECT id AS page_id, unnest(['/trap/' || product_id, '/gone']) AS link FROM products")
def _(products: DataFrame) -> DataFrame:
    return links.hidden_links(products.selectExpr("id AS page_id", f"{_NESTED.format('product_id')} AS html"))


@query("pages_likely_links", "products", "SELECT id AS page_id, website_url || unnest(['canonical', 'p/' || ean]) AS link, unnest([30, 24]) AS score FROM products")
def _(products: DataFrame) -> DataFrame:
    html = f"""'<link rel="canonical" href="/canonical"><a href="/p/' || ean || '">buy</a><a href="/about">us</a>' || {_NESTED.format('ean')}"""
    return links.likely_links(products.selectExpr("id AS page_id", "website_url AS url", f"{html} AS html", "ean", "'Zz' AS name")).drop("n")


# One price in twelve markups: (html, cents or none for the product's own price, currency, base score, source). P is the price.
_MARKUPS = (
    ('<span class="wasabi-price">P EUR</span>', None, "EUR", 62, "product-element"),
    ('<meta property="product:price:currency" content="EUR"><p itemprop="price">P</p>', None, "EUR", 104, "product-element"),
    ('<li class="product-price">P EUR</li>', None, "EUR", 62, "product-element"),
    ('<span class="price"><b>9</b>.99 €</span>', 900, "EUR", 62, "product-element"),
    ('<meta property="product:price:amount" content="P"><meta property="og:price:currency" content="chf">', None, "CHF", 115, "product-meta"),
    ('<meta content="P" name="sale_price"><b class="cost">1.00 EUR</b>', None, "EUR", 142, "product-meta"),
    ('<meta name="twitter:data1" content="P EUR"><div class="was-price">3.00 EUR</div>', None, "EUR", 82, "product-meta"),
    ('<input data-product-price="P" name="x"> EUR', None, "EUR", 100, "product-meta"),
    ("<link value='P' itemprop='price'> £", None, "GBP", 110, "product-meta"),
    ('<div class="old price">1.00 EUR</div><td id="total-cost">P EUR</td><b class="price">2.00 EUR <del>x</del></b>', None, "EUR", 62, "product-element"),
    ('<div class="price-box"><i></i><span class="price-now">P EUR</span></div>', None, "EUR", 62, "product-element"),
    ('<strong data-testid="price_current">&#80;rice: P&nbsp;&#8364;</strong>', None, "EUR", 100, "product-element"),
)


def _by_kind(values, key: str = "product_id") -> str:
    said = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {said(v)}" for k, v in enumerate(values)) + " END"


def _with_price(htmls) -> Column:
    kind = F.get(F.array(*map(F.lit, htmls)), (F.col("product_id") % len(htmls)).cast("int"))
    return F.replace(kind, F.lit("P"), F.expr("format_string('%.2f', own_price_cents / 100)"))


@query(
    "pages_price_markups",
    "products",
    f"SELECT id AS page_id, coalesce({_by_kind([m[1] for m in _MARKUPS])}, own_price_cents) AS price_cents, {_by_kind([m[2] for m in _MARKUPS])} AS currency, {_by_kind([m[3] for m in _MARKUPS])} AS score, {_by_kind([m[4] for m in _MARKUPS])} AS source FROM products",
)
def _(products: DataFrame) -> DataFrame:
    return pages.best_price(_spread(products).select(F.col("id").alias("page_id"), _with_price([m[0] for m in _MARKUPS]).alias("html")))


# (selector of a host's profile, html, whether it names a price)
_SELECTED = (
    ("b.now-price", '<i class="now-price">1.00</i><b class="x now-price">P EUR</b>', True),
    ("span[itemprop=price]", '<span itemprop="name">2</span><span itemprop="price"><b>P</b> <i>EUR</i></span>', True),
    ("div[data-testid=buy-price]", "<div data-testid='old'>3 EUR</div><div data-testid='buy-price'>P EUR</div>", True),
    ('meta[itemprop="price"]', '<meta itemprop="price" content="P EUR">', True),
    ("#deal", '<u id=deal>P EUR</u><u id="deal">4 EUR</u>', True),
    ("[data-price]", "<td data-price>P&nbsp;EUR</td>", True),
    ("p > b", "<p><b>5.00 EUR</b></p>", False),
    ("[href=x]", '<a href="x">6.00 EUR</a>', False),
)


@query("pages_selector_markups", "products", f"SELECT id AS page_id, own_price_cents AS price_cents, 'EUR' AS currency, 230.0 AS score, 'profile-selector' AS source FROM products WHERE {_by_kind([int(s[2]) for s in _SELECTED])} = 1")
def _(products: DataFrame) -> DataFrame:
    url = F.concat(F.lit("https://kind-"), (F.col("product_id") % len(_SELECTED)).cast("string"), F.lit(".example/"))
    made = _spread(products).select(F.col("id").alias("page_id"), url.alias("url"), _with_price([s[1] for s in _SELECTED]).alias("html"), F.lit(False).alias("exact_ean"), F.lit(0.5).alias("name_score"))
    rules = F.get(F.array(*(F.lit(s[0]) for s in _SELECTED)), F.col("kind"))
    profiles = products.select((F.col("product_id") % len(_SELECTED)).cast("int").alias("kind")).distinct().select(F.expr("'kind-' || kind || '.example'").alias("host"), rules.alias("price_selector"))
    return pages.profile_prices(made, profiles)


# (html of a page in the folder /shop/, place, action behind the host's name, field, hidden); a null place: no search form.
_FORMS = (
    ("<form action=/find><input type=text name=search_query></form>", 0, "/find", "search_query", ""),
    ('<form><input name=k placeholder="Search products"></form>', 0, "/shop/", "k", ""),
    ('<form action="?x=1"><input type=tel name=q><input type=hidden name=a value=b><input type="hidden" name="nonce" value="c"></form>', 0, "/shop/?x=1", "q", "a=b"),
    ('<form action="//search.HOST/go/./to"><input type="search" name="find"></form>', 0, None, "find", ""),
    ('<form action="/a"><input name="isci"></form><form method=POST><input name=q></form>', None, None, None, None),
    ('<form action="/news"><input name="text"></form><form class="site-search" action="../s"><input name=term></form>', 1, "/s", "term", ""),
    ('<form action="https://other.example/"><input name=q></form><form action="mailto:x@HOST"><input name=q></form>', None, None, None, None),
)


@query(
    "pages_form_markups",
    "products",
    f"""SELECT id AS page_id, {_by_kind([f[1] for f in _FORMS])} AS place, CASE WHEN product_id % 7 = 3 THEN 'https://search.' || host || '/go/to' ELSE 'https://' || host || {_by_kind([f[2] for f in _FORMS])} END AS action, {_by_kind([f[3] for f in _FORMS])} AS field, {_by_kind([f[4] for f in _FORMS])} AS hidden
    FROM products WHERE {_by_kind([f[1] for f in _FORMS])} IS NOT NULL""",
)
def _(products: DataFrame) -> DataFrame:
    kind = F.get(F.array(*(F.lit(f[0]) for f in _FORMS)), (F.col("product_id") % len(_FORMS)).cast("int"))
    made = _spread(products).select(F.col("id").alias("page_id"), F.expr("'https://' || host || '/shop/#top'").alias("url"), F.replace(kind, F.lit("HOST"), F.col("host")).alias("html"))
    return pages.search_forms(made, 1)


# (reference, address behind the host's name) on a page https://HOST/a/b/?q=1; null: no address of the web.
_REFERENCES = (("c", "/a/b/c"), ("../c", "/a/c"), ("./../../../c/.", "/c/"), ("/d?e#f", "/d?e"), ("?e", "/a/b/?e"), ("", "/a/b/?q=1"), ("#f", "/a/b/?q=1"), ("c d", "/a/b/c%20d"), ("mailto:x", None), ("//:0", None), ("HTTPS://HOST:443", "/"), ("..", "/a/"), ("/g/./h/../i", "/g/i"))


@query("pages_url_resolution", "products", f"SELECT id, 'https://' || host || {_by_kind([r[1] for r in _REFERENCES])} AS link FROM products")
def _(products: DataFrame) -> DataFrame:
    kind = F.get(F.array(*(F.lit(r[0]) for r in _REFERENCES)), (F.col("product_id") % len(_REFERENCES)).cast("int"))
    return products.select("id", S.resolve_url(F.replace(kind, F.lit("HOST"), F.col("host")), F.expr("'https://' || host || '/a/b/?q=1'")).alias("link"))


# Addresses of data and links: in the family of the store's hosts, relative, with credentials, tokens or account paths. The page is https://HOST/a/b.
_FAMILY_HTML = """'<link rel="canonical" href="https://m.' || host || '/item/' || ean || '"><link rel=alternate type="application/ld+json" href="item.json"><div data-product-api="https://api.' || host || '/v1/' || ean || '?x=1&amp;y=2#z" data-json-url="/account/data.json"></div>
    <b data-api-url=list data-product-json="https://u:p@' || host || '/x"></b><i data-api-url="/q?access_token=1"></i><a href="c/' || ean || '">buy</a><a href="https://www.' || host || '/p/' || ean || '">buy</a><a href="https://other.example/' || ean || '">x</a><a href="mailto:' || ean || '">m</a>'"""


def _family(products: DataFrame) -> DataFrame:
    return _spread(products).selectExpr("id AS page_id", "'https://' || host || '/a/b' AS url", f"{_FAMILY_HTML} AS html", "ean", "'Zz' AS name")


@query("pages_family_data_urls", "products", "SELECT id AS page_id, unnest(['https://' || host || '/a/item.json', 'https://api.' || host || '/v1/' || ean || '?x=1&y=2', 'https://' || host || '/a/list']) AS link, unnest([15, 19, 8]) AS score FROM products")
def _(products: DataFrame) -> DataFrame:
    return pages.public_data_urls(_family(products))


@query("pages_family_links", "products", "SELECT id AS page_id, unnest(['https://m.' || host || '/item/' || ean, 'https://www.' || host || '/p/' || ean, 'https://' || host || '/a/c/' || ean]) AS link, unnest([30, 24, 20]) AS score, unnest([1, 2, 3]) AS n FROM products")
def _(products: DataFrame) -> DataFrame:
    return links.likely_links(_family(products))


# Entries of a sitemap document or index of HOST: (entry, address behind the host's name, lastmod); a null address: none.
_ENTRIES = (
    ("<sitemap>\n<loc> https://HOST/products-1.xml </loc><lastmod>2024-02-03</lastmod></sitemap>", "/products-1.xml", "2024-02-03"),
    ('<url xmlns="x"><loc type="a">/p/a&amp;b</loc></url>', "/p/a&b", None),
    ("<url><loc><![CDATA[https://www.HOST/p/1]]></loc></url>", "/p/1", None),
    ("<url><loc>https://m.HOST/p/1</loc></url>", None, None),
    ("<url><loc>https://HOST/p?q=1</loc></url><url><loc>https://HOST:8080/p</loc></url><url><loc>https://u@HOST/p</loc></url><url><loc>https://HOST/p#x</loc></url><url><loc>ftp://HOST/p</loc></url>", None, None),
    ("<URL><LOC>HTTPS://HOST:443/a/../b</LOC><lastmod></lastmod></URL><url><loc>https://HOST/b</loc><lastmod>x</lastmod></url>", "/b", None),
)


@query(
    "policy_sitemap_entries",
    "products",
    f"""SELECT host, 'https://' || CASE WHEN k = 2 THEN 'www.' ELSE '' END || host || {_by_kind([e[1] for e in _ENTRIES], 'k')} AS url, {_by_kind([e[2] for e in _ENTRIES], 'k')} AS lastmod
    FROM (SELECT host, min(product_id) % {len(_ENTRIES)} AS k FROM products GROUP BY host) WHERE {_by_kind([e[1] for e in _ENTRIES], 'k')} IS NOT NULL""",
)
def _(products: DataFrame) -> DataFrame:
    docs = products.groupBy("host").agg(F.min("product_id").alias("k"))
    xml = F.replace(F.get(F.array(*(F.lit(e[0]) for e in _ENTRIES)), (F.col("k") % len(_ENTRIES)).cast("int")), F.lit("HOST"), F.col("host"))
    return policy.sitemap_locations(docs.select("host", F.concat(F.lit("<urlset><urlx><loc>/no</loc></urlx>"), xml, F.lit("</urlset>")).alias("xml")))
