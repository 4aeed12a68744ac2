"""Queries of results, labels and page rules; the SQL states the rules anew over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import labels as L
from pricetide.functions import scalars as S
from pricetide.operators import catalog, compare, crawl, history, links, offers, ops, pages, results, schedule
from pricetide.plans.reference_queries import _SEEN, _SUMMARY, _URL_HOST, NOW, WALLS, pages_query, query

_MONEY = """CASE WHEN length(c) <> 3 THEN format('{:.2f}', x / 100) || ' ' || c ELSE CASE WHEN x < 0 THEN '-' ELSE '' END || CASE c WHEN 'EUR' THEN '€' WHEN 'USD' THEN '$' WHEN 'GBP' THEN '£' WHEN 'JPY' THEN '¥' ELSE c || chr(160) END
    || CASE WHEN c = 'JPY' THEN format('{:,}', CAST(floor(abs(x) / 100 + 0.5) AS BIGINT)) ELSE format('{:,.2f}', abs(x) / 100) END END"""
_COINS = "CASE product_id % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' WHEN 4 THEN 'CHF' ELSE 'POINTS' END"


@query("labels_money", "products", f"SELECT id, {_MONEY} AS money FROM (SELECT id, own_price_cents * (store_id % 3 - 1) * 11 AS x, {_COINS} AS c FROM products)")
def _(products: DataFrame) -> DataFrame:
    return products.selectExpr("id", "own_price_cents * (store_id % 3 - 1) * 11 AS x", f"{_COINS} AS c").select("id", L.money_text(F.col("x"), F.col("c")).alias("money"))


_SUNDAY = "(make_timestamp(year(t), {0}, 31, 1, 0, 0) - to_days(CAST(dayofweek(make_date(year(t), {0}, 31)) AS INT)))"


@query(
    "labels_local_time",
    "runs",
    f"""SELECT id, replace(strftime(t + to_hours(CASE WHEN t >= {_SUNDAY.format(3)} AND t < {_SUNDAY.format(10)} THEN 2 ELSE 1 END), '%-d %b %Y, %H:%M'), ' Sep ', ' Sept ') AS local FROM (SELECT id, started_at + to_days(CAST(id % 366 AS INT)) AS t FROM runs)""",
)
def _(runs: DataFrame) -> DataFrame:
    return runs.select("id", L.local_time(F.timestamp_add("DAY", (F.col("id") % 366).cast("int"), F.col("started_at"))).alias("local"))


@query(
    "labels_waits",
    "runs",
    f"""SELECT id, CASE id % 4 WHEN 0 THEN least(id % 40000 * 1000, 21600000) WHEN 1 THEN greatest(0, least(21600000, (epoch_ms(TIMESTAMP '{NOW}' + to_minutes(CAST(id % 900 - 100 AS INT))) - epoch_ms(TIMESTAMP '{NOW}')))) END AS retry_ms,
    CASE id % 4 WHEN 0 THEN least(id % 40000 * 1000, 21600000) WHEN 2 THEN greatest(0, least(21600000, (id % 900 - 100) * 1000)) WHEN 3 THEN greatest(0, least(21600000, id % 900 - 100)) END AS reset_ms FROM runs""",
)
def _(runs: DataFrame) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    at = F.timestamp_add("MINUTE", (F.col("id") % 900 - 100).cast("int"), now)
    epoch = F.unix_millis(now.cast("timestamp"))
    k, seconds = F.col("id") % 4, (F.col("id") % 40000).cast("string")
    header = F.when(k == 0, seconds).when(k == 1, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    reset = F.when(k == 0, seconds).when(k == 2, (epoch / 1000 + F.col("id") % 900 - 100).cast("long").cast("string")).when(k == 3, (epoch + F.col("id") % 900 - 100).cast("string")).otherwise("-1")
    return runs.select("id", L.retry_after_ms(header, now).alias("retry_ms"), L.rate_limit_reset_ms(reset, now).alias("reset_ms"))


@query("labels_sitemap_key", "products", """SELECT id, CASE WHEN store_id % 5 <> 0 THEN '["' || host || '","' || ean || '"]' END AS key FROM products""")
def _(products: DataFrame) -> DataFrame:
    return products.select("id", L.sitemap_key(F.expr("CASE WHEN store_id % 5 = 0 THEN '192.168.0.7' ELSE 'WWW.' || upper(host) || '.' END"), F.expr("'GTIN ' || ean")).alias("key"))


_CASES = {**L.STATUSES, **L.REASONS}
_LABEL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CASES.items()) + " ELSE replace({0}, '_', ' ') END"


@query(
    "labels_results",
    "runs",
    f"""SELECT id, {_LABEL.format('status')} AS status_label, {_LABEL.format('reason_code')} AS reason_label, CASE WHEN floor((id % 2001 - 1000) / 1000 * 1000 + 0.5) % 10 = 0 THEN CAST(CAST(floor((id % 2001 - 1000) + 0.5) / 10 AS BIGINT) AS VARCHAR) ELSE format('{{:.1f}}', (id % 2001 - 1000) / 10) END || '%' AS percent FROM runs""",
)
def _(runs: DataFrame) -> DataFrame:
    return runs.select("id", L.status_label(F.col("status")).alias("status_label"), L.reason_label(F.col("reason_code")).alias("reason_label"), L.percent_text((F.col("id") % 2001 - 1000) / 1000).alias("percent"))


@query("labels_country_code", "websites", "SELECT id, CASE id % 4 WHEN 0 THEN 'SI' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' END AS country FROM websites")
def _(websites: DataFrame) -> DataFrame:
    name = F.expr("CASE id % 4 WHEN 0 THEN ' si ' WHEN 1 THEN 'uk' WHEN 2 THEN 'De' ELSE 'Narnia' END")
    return websites.select("id", L.country_code(name, L.country_codes(websites.sparkSession)).alias("country"))


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)"


@pages_query("labels_norm_header", f"SELECT page_id, trim(regexp_replace(strip_accents(lower(trim({_TITLE}))), '[/_()\\-\\s]+', ' ', 'g')) AS header FROM pages")
def _(pages_: DataFrame) -> DataFrame:
    return pages_.select("page_id", L.norm_header(F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)", 1)).alias("header"))


@query("scalars_min_cadence", "websites", "SELECT id, CAST(ceil(1440 / (id % 24 + 1)) AS INT) AS minutes FROM websites")
def _(websites: DataFrame) -> DataFrame:
    return websites.select("id", S.min_cadence_minutes(F.col("id") % 24 + 1).alias("minutes"))


@pages_query("scalars_norm_url", "SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END AS norm FROM (SELECT *, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '#.*$', '') AS rest FROM pages)")
def _(pages_: DataFrame) -> DataFrame:
    odd = F.regexp_replace(F.regexp_replace("url", "^(http)://([^/?#]+)", "HTTP://$2:80"), "^(https)://([^/?#]+)", "https://$2:443")
    return pages_.select("page_id", S.norm_url(F.when(F.col("page_id") % 2 == 0, odd).otherwise(F.col("url"))).alias("norm"))


_OCTETS = "product_id % 256 AS a, (product_id * 7 + store_id) % 256 AS b, store_id % 4 AS c"


@query(
    "scalars_public_host",
    "products",
    f"""SELECT id, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)))) OR (a = 198 AND b IN (18, 19))) AS public4,
    NOT (a // 2 = 126 OR a = 255 OR (a = 254 AND b >= 128)) AS public6 FROM (SELECT id, {_OCTETS} FROM products)""",
)
def _(products: DataFrame) -> DataFrame:
    rows = products.selectExpr("id", _OCTETS.split(", ")[0], "(product_id * 7 + store_id) % 256 AS b", "store_id % 4 AS c")
    four, six = F.expr("a || '.' || b || '.' || c || '.9'"), F.expr("lower(hex(a)) || lower(lpad(hex(b), 2, '0')) || '::7'")
    return rows.select("id", S.is_public_host(four).alias("public4"), S.is_public_host(six).alias("public6"))


_SHOPS = ("cdn.shopify.com/x", "/wp-content/plugins/woocommerce/a", "Magento_Ui", "PrestaShop", "stencilUtils", "data-shopware", "vtexassets", "static.wixstatic.com", "plain")


@query("scalars_platform", "products", "SELECT id, CASE product_id % 9 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(("shopify", "woocommerce", "magento", "prestashop", "bigcommerce", "shopware", "vtex", "wix-stores"))) + " END AS platform FROM products")
def _(products: DataFrame) -> DataFrame:
    html = F.concat(F.lit("<p>"), F.get(F.array(*map(F.lit, _SHOPS)), (F.col("product_id") % 9).cast("int")), F.lit("</p>"))
    return products.select("id", S.commerce_platform(html).alias("platform"))


@query(
    "scalars_reasons",
    "runs",
    """SELECT id, CASE WHEN status IN ('found', 'not_found', 'blocked') THEN status WHEN status = 'unavailable' THEN CASE WHEN id % 3 = 0 THEN 'http_server_error' ELSE 'network_error' END WHEN id % 2 > 0 THEN 'wrong_product' WHEN id % 5 = 0 THEN 'price_missing' ELSE 'low_confidence' END AS result_reason,
    CASE WHEN status IN ('found', 'not_found', 'blocked') THEN status WHEN status = 'unavailable' THEN 'network_error' ELSE 'low_confidence' END AS status_reason,
    CASE id % 9 WHEN 0 THEN 'timeout' WHEN 1 THEN 'blocked' WHEN 2 THEN 'bot_wall' WHEN 3 THEN 'rate_limited' WHEN 4 THEN 'request_queue_busy' WHEN 5 THEN 'response_too_large' WHEN 6 THEN 'http_client_error' ELSE 'http_server_error' END AS fetch_reason,
    reason_code IN ('captcha', 'rate_limited', 'timeout', 'http_server_error', 'blocked', 'bot_wall', 'js_challenge', 'response_too_large', 'network_error') AS cools FROM runs""",
)
def _(runs: DataFrame) -> DataFrame:
    kinds = ("timeout", "blocked", "challenge", "rate_limited", "queue_busy", "response_too_large", "http_client_error", "http_server_error", "unavailable")
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("id") % 9).cast("int"))
    http, exact, price = F.when(F.col("id") % 3 == 0, 503), F.when(F.col("id") % 2 == 0, True), F.when(F.col("id") % 5 != 0, 100)
    return runs.select("id", S.reason_for_result(F.col("status"), http, exact, price).alias("result_reason"), S.reason_for_status(F.col("status")).alias("status_reason"), S.reason_for_fetch(kind).alias("fetch_reason"), S.is_cooldown_reason(F.col("reason_code")).alias("cools"))


@query("scalars_selector_suggestions", "products", "SELECT id, 'div[itemprop=price],span[data-testid=product-cost],#ean-' || store_id || ',.now-price,.gtin' AS suggestions FROM products")
def _(products: DataFrame) -> DataFrame:
    html = F.expr("""'<div class="x" itemprop="price">1</div><span data-testid="product-cost" id="a">2</span><b id="ean-' || store_id || '">3</b><i class="big now-price">4</i><i class="big now-price">4</i><em class="gtin">5</em><p class="plain">6</p>'""")
    return products.select("id", F.array_join(S.selector_suggestions(html), ",").alias("suggestions"))


# Walls and pages that only look like them, and what each is.
_PAGES = (
    ("<script src=\"https://www.example.com/recaptcha/api.js\"></script><h1>Product</h1><p>In stock</p>", None),
    ("<title>Verify</title><div class=\"g-recaptcha\"></div><p>Complete the captcha to continue</p>", "captcha"),
    ("<title>Sign in</title><p>Sign in to continue</p>", "login_wall"),
    ("<div class=\"hcaptcha\"></div><p>human?</p>", "captcha"),
    ("<textarea name=\"g-recaptcha-response\"></textarea><p>Our ring</p>", None),
    ("<p>Access denied to nobody</p>", None),
    ("<p>Are you a robot</p>", "bot_wall"),
    ("<h1>Attention Required</h1>", "bot_wall"),
    ("<title>Just a moment</title>", "js_challenge"),
    ("<title>Log in</title><p>short</p>", "login_wall"),
    ("<p>Checking your browser before accessing the shop</p>", "js_challenge"),
    ("<p>Gate 7 of the shop</p>", "bot_wall"),
)
_KIND = "CASE product_id % 12 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(_PAGES) if kind) + " END"


@query("pages_challenge", "products", f"SELECT id, {_KIND} AS challenge FROM products")
def _(products: DataFrame) -> DataFrame:
    html = F.get(F.array(*(F.lit(h) for h, _ in _PAGES)), (F.col("product_id") % 12).cast("int"))
    return products.select("id", pages.challenge(html, F.array(F.lit(""), F.lit("GATE 7"))).alias("challenge"))


_EAN = "lpad('' || page_id, 12, '0')"
_CODE = f"({_EAN} || ((10 - (" + " + ".join(f"CAST(substr({_EAN}, {i + 1}, 1) AS INT) * {3 if i % 2 else 1}" for i in range(12)) + ") % 10) % 10))"


def _planted(pages_: DataFrame) -> DataFrame:
    """The pages themselves, each with an offer planted at its end: linked data in every second, a price element, a form, an address of data, links and a hidden link."""
    data = f"""CASE WHEN page_id % 2 = 0 THEN '<script type="application/ld+json">{{"@type":"Product","name":"Zyxring Model ' || page_id || '","gtin13":"' || {_CODE} || '","offers":{{"price":"' || page_id || '.50","priceCurrency":"EUR","availability":"InStock"}}}}</script>' ELSE '' END"""
    form = """'<form action="/find"><input type="hidden" name="lang" value="en"><input type="search" name="q"></form>'"""
    rest = f"""'<p>Here ends the text of the page, and what follows is a planted offer.</p><p>EAN ' || {_CODE} || '</p><p>Our price: ' || (page_id + 3) || ',75 EUR</p><span class="price-now">' || (page_id + 1) || '.25 EUR</span><i id="cost">' || (page_id + 2) || '.00 EUR</i><div data-product-api="/api/' || page_id || '"></div><a href="/p/' || {_CODE} || '">buy</a><div style="opacity:0"><a href="/trap/' || page_id || '">x</a></div>'"""
    html = f"CASE WHEN html LIKE '%</body>%' THEN replace(html, '</body>', {data} || {form} || {rest} || '</body>') ELSE html || {data} || {form} || {rest} END"
    return pages_.selectExpr("page_id", "url", f"{html} AS html", f"{_CODE} AS ean", "'Zyxring Model ' || page_id AS name")


_WHOLE = "FROM pages WHERE page_id IS NOT NULL"
_ROOT = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@pages_query("real_json_nodes", f"SELECT page_id, unnest(['0', '0/offers']) AS path {_WHOLE} AND page_id % 2 = 0")
def _(pages_: DataFrame) -> DataFrame:
    return pages.json_nodes(_planted(pages_)).select("page_id", "path")


@pages_query("real_structured_candidates", f"SELECT page_id, {_CODE} AS ean, page_id * 100 + 50 AS price_cents, 'EUR' AS currency, true AS in_stock, true AS exact_ean, 1.0::DOUBLE AS name_score, 382.0::DOUBLE AS score {_WHOLE} AND page_id % 2 = 0 AND page_id > 0")
def _(pages_: DataFrame) -> DataFrame:
    return offers.structured_candidates(_planted(pages_).where("page_id > 0")).select("page_id", "ean", "price_cents", "currency", "in_stock", "exact_ean", "name_score", "score")


@pages_query("real_best_price", f"SELECT page_id, (page_id + 1) * 100 + 25 AS price_cents, 'EUR' AS currency, 100 AS score, 'product-element' AS source {_WHOLE}")
def _(pages_: DataFrame) -> DataFrame:
    return pages.best_price(_planted(pages_))


@pages_query("real_context_prices", f"SELECT page_id, (page_id + 3) * 100 + 75 AS price_cents, 'EUR' AS currency, 72 AS score, 'ean-context' AS source {_WHOLE}")
def _(pages_: DataFrame) -> DataFrame:
    return pages.context_prices(_planted(pages_).drop("name"))


@pages_query("real_profile_prices", f"SELECT page_id, (page_id + 2) * 100 AS price_cents, 'EUR' AS currency, 290.0::DOUBLE AS score, 'profile-selector' AS source {_WHOLE}")
def _(pages_: DataFrame) -> DataFrame:
    rules = pages_.select(S.host(F.col("url")).alias("host")).distinct().withColumn("price_selector", F.lit("#cost"))
    return pages.profile_prices(_planted(pages_).selectExpr("page_id", "url", "html", "true AS exact_ean", "0.0D AS name_score"), rules)


@pages_query("real_profile_fields", f"SELECT page_id, 'bu y' AS product_text, true AS ean_match {_WHOLE}")
def _(pages_: DataFrame) -> DataFrame:
    rules = pages_.select(S.host(F.col("url")).alias("host")).distinct().selectExpr("host", "'a[data-testid=buy]' AS product_selector", "'[data-code=\"x\"]' AS ean_selector")
    made = _planted(pages_).selectExpr("page_id", "url", f"html || '<a data-testid=\"buy\"><i>bu</i>y</a><b data-code=\"x\">GTIN ' || {_CODE} || '</b>' AS html", "ean")
    return pages.profile_fields(made, rules)


@pages_query("real_search_forms", f"SELECT page_id, 0 AS place, {_ROOT} || '/find' AS action, 'q' AS field, 'lang=en' AS hidden {_WHOLE}")
def _(pages_: DataFrame) -> DataFrame:
    return pages.search_forms(_planted(pages_))


@pages_query("real_public_data_urls", f"SELECT page_id, {_ROOT} || '/api/' || page_id AS link, 14 AS score {_WHOLE}")
def _(pages_: DataFrame) -> DataFrame:
    return pages.public_data_urls(_planted(pages_))


@pages_query("real_hidden_links", f"SELECT page_id, '/trap/' || page_id AS link {_WHOLE}")
def _(pages_: DataFrame) -> DataFrame:
    return links.hidden_links(_planted(pages_))


@pages_query("real_likely_links", f"SELECT page_id, {_ROOT} || '/p/' || {_CODE} AS link, 24 AS score {_WHOLE}")
def _(pages_: DataFrame) -> DataFrame:
    return links.likely_links(_planted(pages_).withColumn("name", F.lit("Zy"))).drop("n")


@pages_query("pages_link_frontier", f"SELECT id, link, 24 AS score, turn FROM (SELECT page_id % 9 AS id, {_ROOT} || '/p/' || {_CODE} AS link, row_number() OVER (PARTITION BY page_id % 9 ORDER BY page_id) AS turn {_WHOLE}) WHERE turn <= 24")
def _(pages_: DataFrame) -> DataFrame:
    return links.link_frontier(_planted(pages_).withColumn("name", F.lit("Zy")).withColumn("id", F.col("page_id") % 9))


@pages_query("real_select_offer", f"SELECT page_id, page_id * 100 + 50 AS price_cents, 'EUR' AS currency, 'structured' AS source {_WHOLE} AND page_id % 2 = 0 AND page_id > 0")
def _(pages_: DataFrame) -> DataFrame:
    made = _planted(pages_).where("page_id > 0")
    return pages.select_offer(offers.structured_candidates(made), pages.context_prices(made))


@pages_query(
    "real_match",
    f"""SELECT page_id, true AS ean_match, CASE WHEN page_id % 2 = 0 THEN page_id * 100 + 50 ELSE (page_id + 2) * 100 END AS price_cents, 'EUR' AS currency, CASE WHEN page_id % 2 = 0 THEN 'structured' ELSE 'profile-selector' END AS price_source,
    page_id % 2 = 0 AS structured, page_id % 2 = 0 AS structured_ean, 'found' AS verdict {_WHOLE} AND page_id > 0""",
)
def _(pages_: DataFrame) -> DataFrame:
    made = _planted(pages_).where("page_id > 0")
    rules = pages_.select(S.host(F.col("url")).alias("host")).distinct().withColumn("price_selector", F.lit("#cost"))
    found = offers.match_pages(made, rules).withColumn("profile_id", F.lit(None).cast("string"))
    return found.select("page_id", "ean_match", "price_cents", "currency", "price_source", "structured", "structured_ean", F.when(S.is_verified(F.struct("*")), "found").otherwise("open").alias("verdict"))


_JSON = """'{"offers":[{"price":{"amount":["' || product_id || '.5",' || store_id || ',null]}},{"price":{"amount":true}}]}'"""


@query("pages_json_path_values", "products", "SELECT id, unnest([product_id || '.5', '' || store_id, 'true']) AS value FROM products")
def _(products: DataFrame) -> DataFrame:
    return pages.json_path_values(products.select("id", F.parse_json(F.expr(_JSON)).alias("node")), "offers.price.amount")


_FAMILY = "(page_host = store OR page_host LIKE '%.' || store OR store LIKE '%.' || page_host)"


def _targets(pages_: DataFrame) -> DataFrame:
    """Two wanted products of each store that has pages, every third under a parent or child of its host."""
    hosts = pages_.select(S.host(F.col("url")).alias("h")).distinct().selectExpr("h", "explode(array(1, 2)) AS k")
    return hosts.selectExpr("h || '-' || k AS id", "'ean' || k AS ean", "'name' AS name", "'https://' || CASE length(h) % 3 WHEN 0 THEN 'shop.' || h WHEN 1 THEN h ELSE regexp_replace(h, '^[^.]+[.]', '') END || '/' AS website_url")


@pages_query(
    "results_pair_targets",
    f"""SELECT page_id, id, ean, name FROM (SELECT page_id, {_URL_HOST.format('url')} AS page_host FROM pages) JOIN (SELECT h || '-' || k AS id, 'ean' || k AS ean, 'name' AS name, CASE length(h) % 3 WHEN 0 THEN 'shop.' || h WHEN 1 THEN h ELSE regexp_replace(h, '^[^.]+[.]', '') END AS store
    FROM (SELECT DISTINCT {_URL_HOST.format('url')} AS h, unnest([1, 2]) AS k FROM pages)) ON {_FAMILY}""",
)
def _(pages_: DataFrame) -> DataFrame:
    return results.pair_targets(pages_, _targets(pages_))


# Matches of products with what decides their verdict: three a product, of which the second and third score alike.
_MATCHES = """SELECT id, k AS place, CASE WHEN k = 1 THEN 10.0 ELSE 50.0 END AS score, k = 2 AND product_id % 2 = 0 AS ean_match, k = 2 AND product_id % 4 = 0 AS structured_ean, k = 2 AND product_id % 3 = 0 AS structured,
    CAST((product_id % 21) * 0.05 AS DOUBLE) AS name_score, CASE WHEN product_id % 5 <> 0 THEN own_price_cents END AS price_cents, CASE WHEN product_id % 7 = 0 THEN 'sitemap' END AS profile_id, CAST(40 + product_id % 60 AS INT) AS overall_confidence, CAST(60 + product_id % 40 AS INT) AS source_confidence
    FROM products, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) t WHERE product_id % 11 <> 0"""
_BEST = f"SELECT * FROM ({_MATCHES}) WHERE place = 2"
_OK = """price_cents IS NOT NULL AND CASE WHEN profile_id = 'sitemap' THEN (structured_ean OR (ean_match AND name_score >= 0.85)) AND overall_confidence >= 68 WHEN ean_match THEN overall_confidence >= 68
    ELSE name_score >= 0.93 AND overall_confidence >= 52 AND source_confidence >= 70 END"""


def _matches(products: DataFrame) -> DataFrame:
    return products.selectExpr("*", "explode(array(1, 2, 3)) AS k").selectExpr(
        "id", "k AS place", "CASE WHEN k = 1 THEN 10.0D ELSE 50.0D END AS score", "k = 2 AND product_id % 2 = 0 AS ean_match", "k = 2 AND product_id % 4 = 0 AS structured_ean", "k = 2 AND product_id % 3 = 0 AS structured",
        "CAST((product_id % 21) * 0.05 AS DOUBLE) AS name_score", "CASE WHEN product_id % 5 <> 0 THEN own_price_cents END AS price_cents", "CASE WHEN product_id % 7 = 0 THEN 'sitemap' END AS profile_id",
        "CAST(40 + product_id % 60 AS INT) AS overall_confidence", "CAST(60 + product_id % 40 AS INT) AS source_confidence", "product_id",
    ).where("product_id % 11 <> 0").drop("product_id")


@query("results_best_match", "products", f"SELECT id, place, ean_match, price_cents, {_OK} AS verified FROM ({_BEST})")
def _(products: DataFrame) -> DataFrame:
    return results.best_match(_matches(products)).select("id", "place", "ean_match", "price_cents", S.is_verified(F.struct("*")).alias("verified"))


_OUTCOMES = ("read", "unavailable", "blocked", "profile_drift", "robots_disallowed", "known_bad_pattern", "response_too_large")
_SAW = "CASE store_id % 8 " + " ".join(f"WHEN {k} THEN '{o}'" for k, o in enumerate(_OUTCOMES)) + " END"


@query(
    "pages_classify_results",
    "products",
    f"""SELECT id, split_part(v, ':', 1) AS status, split_part(v, ':', 2) AS reason_code FROM (SELECT p.id, CASE WHEN {_OK.replace('price_cents', 'm.price_cents')} THEN 'found:found' WHEN saw = 'blocked' THEN 'blocked:blocked' WHEN saw = 'known_bad_pattern' AND NOT read THEN 'needs_review:known_bad_pattern' WHEN saw = 'unavailable' AND NOT read THEN 'unavailable:network_error'
        WHEN ean_match OR name_score >= 0.65 OR structured THEN 'needs_review:' || CASE WHEN saw = 'profile_drift' THEN 'profile_drift' WHEN NOT ean_match THEN 'wrong_product' WHEN m.price_cents IS NULL THEN 'price_missing' ELSE 'low_confidence' END
        WHEN saw = 'profile_drift' THEN 'needs_review:profile_drift' WHEN saw = 'robots_disallowed' THEN 'blocked:robots_disallowed' WHEN saw IN ('known_bad_pattern', 'response_too_large') THEN 'needs_review:' || saw ELSE 'not_found:not_found' END AS v
    FROM (SELECT id, {_SAW} AS saw, product_id % 2 = 0 OR store_id % 8 = 0 AS read FROM products) p LEFT JOIN ({_BEST}) m ON m.id = p.id)""",
)
def _(products: DataFrame) -> DataFrame:
    seen = products.selectExpr("id", f"explode(array_compact(array({_SAW}, CASE WHEN product_id % 2 = 0 THEN 'read' END))) AS outcome")
    return results.classify_results(products, _matches(products), seen)


def _pairs(pages_: DataFrame) -> DataFrame:
    return pages_.selectExpr("page_id", "'t' || page_id AS id", "url", "'GTIN 0' || page_id AS ean", "md5(html) AS fingerprint", "CASE WHEN page_id % 2 = 0 THEN 'profile' END AS profile_fingerprint")


def _cache(pages_: DataFrame) -> DataFrame:
    """Entries of a half: a third live, a third run out, a third of another version of the page, two of each address."""
    rows = _pairs(pages_).where("page_id % 2 = 0").withColumn("fingerprint", F.when(F.col("page_id") % 3 == 2, F.lit("old")).otherwise(F.col("fingerprint")))
    at = F.lit(NOW).cast("timestamp_ntz")
    return results.cache_keys(rows).select("norm_url", "ean_digits", "content_hash", F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("match_json"), F.timestamp_add("DAY", F.when(F.col("page_id") % 3 == 1, -1).otherwise(1), at).alias("expires_at"))


@pages_query("pages_incremental", "SELECT page_id, id FROM (SELECT page_id, 't' || page_id AS id FROM pages) WHERE NOT (page_id % 2 = 0 AND page_id % 3 = 0)")
def _(pages_: DataFrame) -> DataFrame:
    return results.incremental(_pairs(pages_), _cache(pages_), NOW).select("page_id", "id")


@pages_query("results_cached_matches", "SELECT page_id, 't' || page_id AS id, 'm' || page_id AS match_json FROM pages WHERE page_id % 6 = 0")
def _(pages_: DataFrame) -> DataFrame:
    return results.cached_matches(_pairs(pages_), _cache(pages_), NOW)


@pages_query("results_refresh_cache", f"SELECT CASE WHEN page_id % 4 = 0 THEN 'new' ELSE 'm' || page_id END AS match_json, TIMESTAMP '{NOW}' + to_days(CASE WHEN page_id % 4 = 0 THEN 7 WHEN page_id % 3 = 1 THEN -1 ELSE 1 END) AS expires_at FROM pages WHERE page_id % 2 = 0")
def _(pages_: DataFrame) -> DataFrame:
    fresh = results.cache_keys(_pairs(pages_).where("page_id % 4 = 0")).withColumn("match_json", F.lit("new"))
    return results.refresh_cache(_cache(pages_), fresh, NOW).select("match_json", "expires_at")


@pages_query("pages_carry_forward", "SELECT 't' || page_id AS id, page_id, page_id * 100 AS price_cents, 'EUR' AS currency, CASE WHEN page_id % 5 = 0 THEN 'ean' ELSE 'name' END AS match_type, CASE WHEN page_id % 7 = 0 THEN 'high' ELSE 'medium' END AS confidence, 304 AS http_status FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0")
def _(pages_: DataFrame) -> DataFrame:
    was = _pairs(pages_).selectExpr(
        "id", "CASE WHEN page_id % 3 = 0 THEN 'needs_review' ELSE 'found' END AS status", "url || '#top' AS matched_url", "fingerprint", "page_id % 2 = 0 AS exact_ean", "page_id * 100 AS price_cents", "'EUR' AS currency", "true AS in_stock",
        "CASE WHEN page_id % 5 = 0 THEN 'ean' END AS match_type", "CASE WHEN page_id % 7 = 0 THEN 'high' ELSE 'sure' END AS confidence",
    )
    return results.carry_forward(_pairs(pages_), was).select("id", "page_id", "price_cents", "currency", "match_type", "confidence", "http_status")


@query("results_product_fingerprint", "websites", """SELECT id, md5('["h' || id || '","","","","","' || CASE WHEN id % 2 = 0 THEN '#p' ELSE '' END || '","gtin","",""]') AS fingerprint FROM websites""")
def _(websites: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    fields = dict.fromkeys(results.PROFILE_FIELDS, none) | {"host": F.concat(F.lit("h"), F.col("id").cast("string")), "price_selector": F.when(F.col("id") % 2 == 0, "#p"), "ean_fields": F.lit("gtin")}
    return websites.select("id", results.product_fingerprint(fields).alias("fingerprint"))


_FIRSTS = "SELECT host, min(id) AS id FROM products WHERE status = 'blocked' GROUP BY host"


@query("schedule_retest_next", "products", f"SELECT id, host FROM ({_FIRSTS}) ORDER BY coalesce(id <= (SELECT id FROM ({_FIRSTS}) WHERE host = 'shop-3.example'), false), id LIMIT 1")
def _(products: DataFrame) -> DataFrame:
    return schedule.retest_next(products.where("status = 'blocked'"), "shop-3.example")


@query("catalog_backfill_hostname", "products", "SELECT id, CASE WHEN product_id % 3 = 0 THEN 'kept' ELSE host END AS hostname FROM products")
def _(products: DataFrame) -> DataFrame:
    return catalog.backfill_hostname(products.selectExpr("id", "website_url", "CASE product_id % 3 WHEN 0 THEN 'kept' WHEN 1 THEN '' END AS hostname")).select("id", "hostname")


@query("catalog_duplicate_profiles", "websites", "SELECT 'h' || (id % 40) AS host, CASE WHEN id % 2 = 0 THEN 'sig' ELSE '' END AS signature, count(*) AS profiles, min(id) AS first_id FROM websites GROUP BY ALL HAVING count(*) > 1")
def _(websites: DataFrame) -> DataFrame:
    return catalog.duplicate_profiles(websites.selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'H' ELSE 'h' END || (id % 40) AS host", "CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 = 0 THEN 'Sig' ELSE 'sig' END END AS signature"))


@query("ops_recent_runs", "runs", "SELECT id, host, status, reason_code, challenge_type, duration_ms, started_at FROM runs ORDER BY started_at DESC, id DESC LIMIT 100")
def _(runs: DataFrame) -> DataFrame:
    return ops.recent_runs(runs)


_MAPS = ("/sitemap.xml", "/products-index.xml", "/product/map.xml", "/index.xml", "/news.xml")


@query("crawl_sitemap_documents", "websites", "SELECT 'h' || id AS host, unnest(['https://h' || id || '/products-index.xml', 'https://h' || id || '/product/map.xml', 'https://h' || id || '/index.xml']) AS sitemap, unnest([125, 20, 5]) AS priority, unnest([1, 2, 3]) AS turn FROM websites")
def _(websites: DataFrame) -> DataFrame:
    maps = F.posexplode(F.array(*map(F.lit, _MAPS))).alias("place", "path")
    return crawl.sitemap_documents(websites.select(F.expr("'h' || id").alias("host"), maps).selectExpr("host", "place", "'https://' || host || path AS sitemap"))


@pages_query("crawl_first_stores", f"SELECT host, url, product_url FROM (SELECT {_URL_HOST.format('url')} AS host, arg_min(lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)), page_id) || '/' AS url, arg_min(regexp_replace(url, '#.*$', ''), page_id) AS product_url, min(page_id) AS place FROM pages GROUP BY 1) ORDER BY place LIMIT 12")
def _(pages_: DataFrame) -> DataFrame:
    return crawl.discovered_stores(pages_.select(F.col("page_id").alias("place"), "url"), 12)


@pages_query("crawl_profile_repairs", f"SELECT page_id, NOT contains(lower(html), '<article>') AS drifted, 'shopware' AS platform, '#price-' || page_id || ',.ean' AS suggestions {_WHOLE}")
def _(pages_: DataFrame) -> DataFrame:
    made = pages_.selectExpr("page_id", "url", """html || '<b id="price-' || page_id || '">1</b><b class="ean">2</b><b class="old-price">3</b><i data-shopware="1"></i>' AS html""")
    rules = pages_.select(S.host(F.col("url")).alias("host")).distinct().selectExpr("'p-' || host AS id", "host", "'<ARTICLE>' AS signature", "CAST(NULL AS STRING) AS product_selector", "CAST(NULL AS STRING) AS ean_selector", "'.old-price' AS price_selector")
    return crawl.profile_drift(made, rules).drop("profile_id")


@query(
    "compare_price_dropped",
    "products snapshots",
    f"""SELECT id, ean, price_cents, own_price_cents FROM products WHERE price_cents < own_price_cents OR product_id IN (SELECT product_id FROM ({_SUMMARY}) WHERE latest_price_cents < first_price_cents)""",
)
def _(products: DataFrame, snaps: DataFrame) -> DataFrame:
    return compare.price_dropped(products, history.summary_by_currency(snaps))


# Scans of products: (attempts in order as profile/kind/reason, what the best match is, status, reason); one for each way out.
_SCANS = (
    (("generic/read/", "generic/challenge/captcha", "generic/read/"), "verified", "found", "found"),
    (("generic/read/", "generic/challenge/captcha", "generic/response_too_large/x"), "likely", "blocked", "captcha"),
    (("generic/rate_limited/rate_limited", "generic/read/"), "none", "unavailable", "rate_limited"),
    (("generic/known_bad_pattern/x", "custom-1/timeout/timeout"), "none", "needs_review", "known_bad_pattern"),
    (("generic/read/", "sitemap/challenge/bot_wall"), "likely", "blocked", "bot_wall"),
    (("generic/read/", "sitemap/timeout/timeout"), "none", "unavailable", "timeout"),
    (("generic/refused/x", "generic/read/"), "likely", "blocked", "blocked"),
    (("custom-1/timeout/timeout", "custom-1/read/", "generic/read/"), "likely", "unavailable", "timeout"),
    (("custom-1/read/", "custom-2/unavailable/http_server_error"), "likely", "needs_review", "wrong_product"),
    (("custom-1/unavailable/http_server_error", "generic/read/"), "none", "unavailable", "http_server_error"),
    (("custom-1/response_too_large/y", "generic/read/"), "none", "needs_review", "response_too_large"),
    (("custom-1/http_client_error/http_client_error", "generic/read/"), "none", "not_found", "not_found"),
    (("generic/unavailable/network_error",), "none", "unavailable", "network_error"),
    (("generic/read/", "generic/profile_drift/x"), "likely", "needs_review", "profile_drift"),
    (("generic/profile_drift/x", "generic/robots_disallowed/x"), "none", "needs_review", "profile_drift"),
    (("generic/robots_disallowed/x", "generic/read/", "generic/known_bad_pattern/x"), "none", "blocked", "robots_disallowed"),
    (("generic/read/", "generic/known_bad_pattern/x", "generic/response_too_large/x"), "none", "needs_review", "known_bad_pattern"),
    (("generic/read/", "generic/response_too_large/x"), "none", "needs_review", "response_too_large"),
    (("generic/response_too_large/x", "generic/timeout/timeout"), "none", "not_found", "not_found"),
    ((), "none", "not_found", "not_found"),
)
_EXIT = "CASE product_id % {n} {whens} END"


@query("results_classify_attempts", "products", f"SELECT id, split_part(v, ':', 1) AS status, split_part(v, ':', 2) AS reason_code FROM (SELECT id, {_EXIT.format(n=len(_SCANS), whens=' '.join(f"WHEN {k} THEN '{s[2]}:{s[3]}'" for k, s in enumerate(_SCANS)))} AS v FROM products)")
def _(products: DataFrame) -> DataFrame:
    kind = (F.col("product_id") % len(_SCANS)).cast("int")
    scan = F.get(F.array(*(F.array(*map(F.lit, s[0])).cast("array<string>") for s in _SCANS)), kind)
    attempts = products.select("id", F.posexplode(scan).alias("place", "a")).select("id", "place", *(F.split("a", "/")[k].alias(c) for k, c in enumerate(("profile_id", "kind", "reason_code"))))
    found = products.select("id", F.get(F.array(*(F.lit(s[1]) for s in _SCANS)), kind).alias("m")).where("m <> 'none'")
    facts = "id, 1 AS place, 5.0D AS score, m = 'verified' AS ean_match, m = 'verified' AS structured_ean, true AS structured, 0.7D AS name_score, 100L AS price_cents, CAST(NULL AS STRING) AS profile_id, 80 AS overall_confidence, 80 AS source_confidence"
    return results.classify_attempts(products, attempts, found.selectExpr(*[f.strip() for f in facts.split(",")]))
