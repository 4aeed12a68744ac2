"""Pages: signals, links, price candidates, and pages that need no new extraction."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import plain as P
from pricetide.functions.scalars import CURRENCIES, commerce_platform, detect_currency, digits, host, narrowed, normalize_currency, once, price_cents, price_values, resolve_url, same_store, without_fragment
from pricetide.operators.elements import KEPT_CHARS, KEPT_TAGS, STATING, VALUES, decoded, passed, selected_text, spans_of

# Texts of walls before a page, and characters of a page that are read for them.
CAPTCHA_TEXT = r"(?:complete|solve|enter)\s+(?:the\s+)?captcha|captcha\s+(?:is\s+)?required|verify\s+(?:that\s+)?you(?:'re| are)\s+human"
CAPTCHA_WIDGET, CAPTCHA_WORDS, CAPTCHA_CHARS = r"g-recaptcha|hcaptcha|turnstile-wrapper|captcha-container", r"captcha|human|verification", 1_500
BOT_MARKS = ("verify you are human", "are you a robot", "unusual traffic", "automated access", "attention required", "potrebno je varnostno preverjanje")
LOGIN_TEXT, LOGIN_TITLE, LOGIN_CHARS = r"(?:sign in|log in)\s+(?:to|before you can)\s+(?:continue|view|see)|authentication required", r"<title>\s*(?:sign in|log in|authentication required)", 2_500
SCRIPT_MARKS = ("enable javascript and cookies to continue", "javascript is required to continue", "checking your browser before accessing", "<title>just a moment", "js challenge")
OUT_OF_STOCK = r"(?i)\b(out of stock|sold out|not available|unavailable|ni na zalogi|razprodano)\b"
IN_STOCK = r"(?i)\b(in stock|available|na zalogi|dobavljivo)\b"
PREFIX = 180_000


def visible(html: Column) -> Column:
    """Text without scripts, styles and tags, named and numbered entities decoded, white space folded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    plain = once(bare, lambda text: decoded(F.replace(text, F.lit("&euro;"), F.lit("€"))))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def challenge(html: Column, patterns: Column | None = None) -> Column:
    """The wall that a page is, or null: captcha, bot_wall, login_wall, js_challenge, in that order; a profile's own marks (an array) mean bot_wall.

    Only the first characters are read. A captcha or a login box on an ordinary page is no wall.
    """

    def rule(page: Column) -> Column:
        silent = F.regexp_replace(F.regexp_replace(page, r"(?s)<script\b.*?</script>", " "), r"(?s)<style\b.*?</style>", " ")
        return once(F.trim(F.regexp_replace(F.regexp_replace(silent, "<[^>]+>", " "), r"\s+", " ")), lambda text: kind(page, text))

    def kind(page: Column, text: Column) -> Column:
        any_of = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(page, m))
        widget = page.rlike(CAPTCHA_WIDGET) & (F.length(text) < CAPTCHA_CHARS) & text.rlike(CAPTCHA_WORDS)
        login = text.rlike(LOGIN_TEXT) | ((F.length(text) < LOGIN_CHARS) & page.rlike(LOGIN_TITLE))
        own = F.lit(False) if patterns is None else F.coalesce(F.exists(patterns, lambda p: (p != "") & F.contains(page, F.lower(p))), F.lit(False))
        return F.when(text.rlike(CAPTCHA_TEXT) | widget, "captcha").when(any_of(BOT_MARKS), "bot_wall").when(login, "login_wall").when(any_of(SCRIPT_MARKS), "js_challenge").when(own, "bot_wall")

    return once(F.lower(F.substring(html, 1, PREFIX)), rule)


def stock(text: Column) -> Column:
    """False before true, null where a text says nothing."""
    return F.when(text.rlike(OUT_OF_STOCK), False).when(text.rlike(IN_STOCK), True)


#: What names a page, in the order in which it is tried.
TITLES = (r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)""", r"(?is)<h1[^>]*>([^<]*)", r"(?is)<title[^>]*>([^<]*)")


def title(html: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit("")) for p in TITLES))


def signals(pages: DataFrame) -> DataFrame:
    """What later jobs need of a page; the html itself goes no further."""
    html = F.col("html")
    canonical = F.nullif(F.regexp_extract(html, r"""(?is)<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']+)""", 1), F.lit(""))
    text = visible(html)
    return pages.select(
        "page_id", host(F.col("url")).alias("host"), F.coalesce(canonical, without_fragment(F.col("url"))).alias("canonical_url"), title(html).alias("title"), F.length(html).alias("chars"),
        F.length(text).alias("visible_chars"), F.octet_length(html).alias("bytes"), challenge(html).alias("challenge"), stock(text).alias("in_stock"), commerce_platform(html).alias("platform"), F.md5(html).alias("fingerprint"),
    )


def links(pages: DataFrame) -> DataFrame:
    """page_id, place, href, label of plain anchors."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href=["']([^"'#]+)["'][^>]*>([^<]*)</a>"""), 0)).alias("place", "a"))
    return found.select("page_id", "place", F.regexp_extract("a", r"""(?is)href=["']([^"'#]+)""", 1).alias("href"), F.trim(F.regexp_extract("a", r"(?is)>([^<]*)</a>", 1)).alias("label"))


# Meta elements that state a price or the page's currency, with the price's base score, and the words that mark price elements.
META_PRICES = (("product:price:amount", 115), ("og:price:amount", 115), ("twitter:data1", 82), ("price", 82), ("sale_price", 142), ("product:sale_price:amount", 142))
META_CURRENCIES = ("product:price:currency", "og:price:currency")
PRICE_TAG = r"""(?i)itemprop=["']price["']|data-(?:product-)?price\b|property=["'](?:product|og):price:amount["']"""
PRICE_ELEMENT = r"""(?is)(?:class|id|itemprop|data-testid)=["'][^"']*(?:price|cost)[^"']*["']"""
NOW, FORMER = "current|sale|special|final|now|our", "old|was|original|regular|compare|strike|list|rrp|msrp"
#: Most characters of a price element's content.
PRICE_CONTENT = 900


def _beside_price(words: str) -> str:
    return rf"(?i)(?:{words})[-_\s]*(?:price|cost)|(?:price|cost)[-_\s]*(?:{words})"


_WORDS = re.compile(r"^(?:meta|link|input)\b|price|cost", re.IGNORECASE)
_ELEMENT, _TAGGED, _ITEMPROP = P.pattern(PRICE_ELEMENT), P.pattern(PRICE_TAG), P.pattern("(?i)itemprop")
_STATED, _NOW, _FORMER, _STRUCK = P.pattern("""(?i)itemprop=["']price["']"""), P.pattern(_beside_price(NOW)), P.pattern(_beside_price(FORMER)), P.pattern(r"(?i)<(?:s|del)\b")


@lru_cache(maxsize=KEPT_TAGS)
def _facts(head: str) -> tuple[int | None, int | None, int]:
    """Of a tag's attributes: the score of a stated price and of a price element's content, if they speak of one, and the rank of the currency that they name."""
    stated = (110 if _ITEMPROP.search(head) else 100) if _TAGGED.search(head) else None
    element = 62 + 42 * bool(_STATED.search(head)) + 38 * bool(_NOW.search(head)) - 85 * bool(_FORMER.search(head)) if _ELEMENT.search(head) else None
    return stated, element, P.currency_rank(head)


def prices_of(html: str | None) -> list[tuple]:
    """`html_prices` of one page: place, price_cents, currency, score, source."""
    if html is None:
        return []
    found = spans_of(html, _WORDS)
    metas = [((a.get("property") or "").lower(), (a.get("name") or "").lower(), P.decoded(a["content"]).strip(" ")) for name, _, a, *_ in found if name == "meta" and a.get("content")]
    content = lambda wanted: next((said for property_, name, said in metas if wanted in (property_, name)), None)
    every = [(content(name), score, P.currency_rank(name), "product-meta") for name, score in META_PRICES] if metas else []
    elements, last = [], -1
    for name, head, a, start, inner, close, end, _ in found:
        stated, element, rank = (_facts if len(head) <= KEPT_CHARS else _facts.__wrapped__)(head)
        if stated and name in STATING:
            raw = P.decoded(next((a[v] for v in VALUES if a.get(v)), None))
            raw = next((said for k in ("data-product-price", "data-price") if (said := (P.decoded(a.get(k)) or "").strip(" "))), None) if raw is None else raw
            every.append((raw, stated, rank, "product-meta"))
        if element is not None and close >= 0 and close - inner <= PRICE_CONTENT and start >= last:
            last = end
            if element > 20 and (score := element - 65 * bool("<" in (inside := html[inner:close]) and _STRUCK.search(inside))) > 20:
                elements.append((P.text_of(inside), score, rank, "product-element"))
    # a blank parts what is said from the tag's attributes, so that no currency's name lies in both
    every = [(raw, score, min(rank, P.currency_rank(raw)), source) for raw, score, rank, source in every + elements if raw]
    own = None
    if any(rank == len(CURRENCIES) for _, _, rank, _ in every):  # the page's own currency is looked for only where a candidate names none
        own = P.normalize_currency(next((said for name in META_CURRENCIES if (said := content(name))), None) or P.detect_currency(P.text_of(html)))
    currency = lambda rank: own if rank == len(CURRENCIES) else CURRENCIES[rank][0]
    return [(place, cents, P.normalize_currency(currency(rank)), score, source) for place, (raw, score, rank, source) in enumerate(every) for cents in P.price_values(raw)]


def html_prices(pages: DataFrame) -> DataFrame:
    """page_id, place, price_cents, currency, score, source: all amounts that a page's meta and price elements state, with a base score.

    Meta elements are looked up by name. Elements of any kind count whose class, id,
    itemprop or test id speaks of a price or cost, with all that they hold up to the first
    end tag of their kind; one inside another is part of it. A current or sale price
    scores more, a former or struck one less, from 20 down none. The currency is
    that of the element, else that of the page.
    """
    return passed(pages, ["page_id"], ["html"], prices_of, "place int, price_cents bigint, currency string, score int, source string")


def meta_prices(pages: DataFrame) -> DataFrame:
    """The prices of `html_prices` that meta, link and input elements state."""
    return html_prices(pages).where("source = 'product-meta'").drop("source")


def element_prices(pages: DataFrame) -> DataFrame:
    """The prices of `html_prices` of elements that speak of a price."""
    return html_prices(pages).where("source = 'product-element'").drop("source")


def best_price(pages: DataFrame) -> DataFrame:
    """The highest-scoring candidate of each page, the first of equals."""
    rank = F.struct("score", -F.col("place"), -F.col("price_cents"))
    top = html_prices(pages).groupBy("page_id").agg(F.max_by(F.struct("price_cents", "currency", "score", "source"), rank).alias("t"))
    return top.select("page_id", "t.price_cents", "t.currency", "t.score", "t.source")


#: A price with a label before or behind it, and words near a price that make it another price.
LABELLED = (
    r"(?:current\s+price|sale\s+price|our\s+price|now|price)\s*[:\-]?\s*(?:€|EUR|\$|USD|£|GBP|CHF|PLN|SEK)?\s*\d{1,8}(?:(?:[ .,'’]\d{3})+)?(?:[.,]\d{1,2})?\s*(?:€|EUR|USD|GBP|CHF|PLN|SEK)?",
    r"(?:€|EUR|\$|USD|£|GBP|CHF|PLN|SEK)\s*\d{1,8}(?:(?:[ .,'’]\d{3})+)?(?:[.,]\d{1,2})?\s*(?:current|today|now)",
)
OTHER_PRICE = r"(?i)shipping|delivery|postage|per\s+month|monthly|save\s+|discount|was\s+|old\s+price"


# Characters around the wanted code, its name and a price that are read.
AROUND, AROUND_NAME, BESIDE = 1_800, 1_400, 45
_LABELLED, _OTHER_PRICE, _SALE = tuple(P.pattern(f"(?is){p}") for p in LABELLED), P.pattern(OTHER_PRICE), P.pattern(r"(?i)current|sale|our\s+price|now")
#: A word of each form of a labelled price: a text without any holds none.
_LABELS = (("price", "now"), ("current", "today", "now"))
_BLANKS = P.pattern(r"\s+")


def _near(text: str, at: int, what: str, around: int) -> str:
    """What stands at a place (from 1) of a text, and up to `around` characters on each side."""
    start = max(1, at - around) - 1
    return text[start : start + min(at - 1, around) + len(what) + around]


def _spaced_at(text: str, code: str) -> int:
    """The place (from 1) of a code of digits with blanks or dashes between them, 0 where it is none."""
    return next((a + 1 for a, _ in P.spaced(text, code)), 0) if P.DIGITS.match(code) else 0


def labelled_prices(html: str | None, ean: str | None, name: str | None, around: int = AROUND, around_name: int = AROUND_NAME) -> list[tuple]:
    """`context_prices` of one page: price_cents, currency, score, by_code."""
    if html is None:
        return []
    text, best = P.visible(html), {}
    low = text.lower()
    name = None if name is None else _BLANKS.sub(" ", name.lower()).strip(" ")
    at = low.find(ean) + 1 or _spaced_at(text, ean) if ean else 0
    named_at = low.find(name) + 1 if name else 0
    for base, by_code, window in ((54, True, _near(text, at, ean, around) if at else ""), (35, False, _near(text, named_at, name, around_name) if named_at else "")):
        said = window.lower()
        for price, labels in zip(_LABELLED, _LABELS, strict=True):
            for m in price.finditer(window) if any(label in said for label in labels) else ():
                if _OTHER_PRICE.search(window[max(0, m.start() - BESIDE) : m.end() + BESIDE]):
                    continue
                for cents in P.price_values(m[0])[:1]:
                    key, score = (cents, P.detect_currency(m[0])), (base + 18 * bool(_SALE.search(m[0])), by_code)
                    best[key] = max(score, best.get(key, score))
    return [(*key, *score) for key, score in best.items()]


def context_prices(pairs: DataFrame, around: int = AROUND, around_name: int = AROUND_NAME) -> DataFrame:
    """page_id, price_cents, currency, score, source: labelled prices near the wanted code (54) or, if pairs has a name, near that (35).

    A code may have blanks or dashes between its digits where it stands nowhere without. A current or sale label adds 18; a price with shipping, instalments or former
    prices within 45 characters of it doesn't count. Of equal prices the best score
    stays, the code's before the name's. pairs has page_id, html, ean.
    """
    named = F.col("name") if "name" in pairs.columns else F.lit(None).cast("string")
    rule = lambda html, ean, name: labelled_prices(html, ean, name, around, around_name)
    priced = passed(pairs.select("page_id", "html", "ean", named.alias("name")), ["page_id"], ["html", "ean", "name"], rule, "price_cents bigint, currency string, score int, by_code boolean")
    best = priced.groupBy("page_id", "price_cents", "currency").agg(F.max(F.struct("score", "by_code")).alias("b"))
    return best.select("page_id", "price_cents", "currency", F.col("b.score").alias("score"), F.when(F.col("b.by_code"), "ean-context").otherwise("name-context").alias("source"))


#: Levels of a JSON document, arrays included, below its top.
JSON_DEPTH = 14


def json_documents(html: Column) -> Column:
    """Texts of a page's JSON scripts (linked data, plain JSON and the state of two known frameworks), or the page itself if it is JSON."""
    head = lambda s: F.regexp_extract(s, r"(?i)^<script\b([^>]*)>", 1)
    kind = r"""(?i)\stype=["']?application/(ld\+)?json(;|["'\s]|$)|\sid=["']?__(next|nuxt)_data__(["'\s]|$)"""
    data = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>.*?</script>"), 0), lambda s: head(s).rlike(kind))
    body = lambda s: once(F.length(head(s)) + len("<script>"), lambda n: F.substr(s, n + 1, F.length(s) - n - len("</script>")))
    return F.when(html.rlike(r"(?s)^\s*(\{.*\}|\[.*\])\s*$"), F.array(html)).otherwise(F.transform(data, body))


def json_nodes(pages: DataFrame, depth: int = JSON_DEPTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, the columns to keep, path, node: every JSON object down to `depth` levels in a page's JSON documents; bad JSON has none."""
    # outer, as Spark would put a filter before an inner explode that makes the array once more
    texts = pages.select("page_id", *keep, F.posexplode_outer(json_documents(F.col("html"))).alias("place", "text"))
    get = lambda node, kind: F.try_variant_get(node, "$", kind)
    made = lambda path, node: F.struct(path.alias("path"), node.alias("node"), get(node, "map<string,variant>").alias("fields"), get(node, "array<variant>").alias("items"))
    nests = lambda n: n["fields"].isNotNull() | n["items"].isNotNull()
    below = lambda o, step: F.concat(o["path"], F.lit("/"), step)
    fields = lambda o: F.transform(F.map_entries(o["fields"]), lambda e: made(below(o, e["key"]), e["value"]))
    items = lambda o: F.transform(o["items"], lambda v, k: made(below(o, k.cast("string")), v))
    objects = lambda level: F.transform(F.filter(level, lambda n: n["fields"].isNotNull()), lambda n: F.struct(n["path"].alias("path"), n["node"].alias("node")))
    top = F.filter(F.array(made(F.col("place").cast("string"), F.try_parse_json("text"))), nests)
    start = once(top, lambda level: F.struct(objects(level).alias("found"), level.alias("open")))

    def step(so_far: Column, _: Column) -> Column:
        """What a level holds is opened once; a document without further levels passes on what it has."""
        level = F.filter(F.flatten(F.transform(so_far["open"], lambda o: F.when(o["fields"].isNotNull(), fields(o)).otherwise(items(o)))), nests)
        return F.when(F.size(so_far["open"]) == 0, so_far).otherwise(once(level, lambda new: F.struct(F.concat(so_far["found"], objects(new)).alias("found"), new.alias("open"))))

    found = F.aggregate(F.array_repeat(F.lit(0), depth), start, step, lambda all_: all_["found"])
    return texts.select("page_id", *keep, F.explode_outer(found).alias("n")).where("n IS NOT NULL").select("page_id", *keep, "n.path", "n.node")


def select_offer(structured: DataFrame, candidates: DataFrame) -> DataFrame:
    """page_id, price_cents, currency, source: a page's structured offer, if its identity holds, unless a page price scores higher and the code is met.

    Identity is the code, or 0.65 of the name. Structured scores count 80 more.
    candidates has page_id, price_cents, currency, score, source.
    """
    best = structured.groupBy("page_id").agg(F.max_by(F.struct("price_cents", "currency", "exact_ean", "name_score", "score"), F.struct("score", "path")).alias("s"))
    top = candidates.groupBy("page_id").agg(F.max_by(F.struct("price_cents", "currency", "score", "source"), F.struct("score", -F.col("price_cents"))).alias("h"))
    rows = best.join(top, "page_id", "left")
    identity = F.col("s.exact_ean") | (F.col("s.name_score") >= 0.65)
    own = identity & F.col("s.price_cents").isNotNull()
    html = identity & F.col("h").isNotNull() & (~own | (F.col("s.exact_ean") & (F.col("h.score") > F.col("s.score") + 80)))
    pick = lambda c: F.when(html, F.col(f"h.{c}")).when(own, F.col(f"s.{c}")).alias(c)
    return rows.select("page_id", pick("price_cents"), pick("currency"), F.when(html, F.col("h.source")).when(own, "structured").alias("source")).where("source IS NOT NULL")


# Attributes that name a page's data, with their scores, and query keys that keep an address from use.
DATA_ATTRIBUTES = {"data-product-api": 11, "data-product-json": 11, "data-json-url": 9, "data-api-url": 8}
DATA_ALTERNATE = 12
PRIVATE_PATH, PRIVATE_KEY = r"(?i)^https?://[^/]*/(?:.*/)?(account|admin|auth|checkout|login|oauth|session)(/|$|\?)", r"(?i)[?&][^=&]*(token|secret|auth|signature|session|password|passcode|api[_-]?key|access[_-]?key|jwt)[^=&]*(=|&|$)"


_DATA = re.compile(r"^link\b|\sdata-(?:product-api|product-json|json-url|api-url)\b", re.IGNORECASE)
_ALTERNATE, _JSON = P.pattern(r"(?i)(^|\s)alternate(\s|$)"), P.pattern(r"(?i)(?:application|text)/(?:[a-z0-9.+-]*\+)?json")


def data_references(html: str | None) -> list[tuple]:
    """place, href, base: what a page names as its data, JSON alternates first, and the scores of where it is named."""
    found = [] if html is None else spans_of(html, _DATA)
    named = [(a.get("href"), DATA_ALTERNATE) for name, _, a, *_ in found if name == "link" and _ALTERNATE.search(a.get("rel", "")) and _JSON.search(a.get("type", ""))]
    named += [(a.get(name), score) for _, _, a, *_ in found for name, score in DATA_ATTRIBUTES.items()]
    return [(place, P.decoded(href), base) for place, (href, base) in enumerate(x for x in named if x[0])]


def public_data_urls(pages: DataFrame, most: int = 3) -> DataFrame:
    """`ranked_data_urls` without the rank."""
    return ranked_data_urls(pages, most).drop("n")


def ranked_data_urls(pages: DataFrame, most: int = 3) -> DataFrame:
    """page_id, link, score, n: the likeliest data addresses of a page in its own store's family of hosts, JSON alternates first; account paths, credentials and token-bearing addresses don't count.

    Of equal scores the first on the page stays. pages has ean; give it shown
    html (`links.shown`) to leave out hidden elements.
    """
    rows = passed(pages, ["page_id", "url", "ean"], ["html"], data_references, "place int, href string, base int")
    rows = narrowed(rows, F.struct(resolve_url(F.col("href"), F.col("url")).alias("link")), lambda x: x["link"].isNotNull())
    open_ = ~F.col("link").rlike("^https?://[^/?#]*@") & ~F.col("link").rlike(PRIVATE_PATH) & ~F.col("link").rlike(PRIVATE_KEY)
    after = F.regexp_extract("link", r"^https?://[^/?#]*(.*)$", 1)
    score = F.col("base") + F.when(after.rlike(r"(?i)/api/|\.json(/|$)|product|catalog|item|search"), 3).otherwise(0) + F.when(F.contains(after, "ean"), 8).otherwise(0)
    # dealt by page, rows move once for both what follows
    ok = rows.where(same_store(host(F.col("link")), host(F.col("url"))) & open_).select("page_id", "link", score.alias("score"), "place").repartition("page_id")
    ok = ok.groupBy("page_id", "link").agg(F.max("score").alias("score"), F.min("place").alias("place"))
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "place", "link")
    return ok.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("page_id", "link", "score", "n")


# Controls that take no query, names of controls that do, and words that speak of searching.
NO_QUERY = ("hidden", "submit", "button", "checkbox", "radio")
QUERY_NAMES, QUERY_WORDS, SEARCH_FORM, TOKENS = "^(q|s|query|search|search_query|searchquery|keyword|keywords|term|text)$", "search|find|keyword|product", "(?i)search|find", "(?i)csrf|token|nonce|session"
FORM_LEAST = 8


_FORMS, _TOKENS = re.compile(r"^(?:form|input)\b", re.IGNORECASE), P.pattern(TOKENS)
_QUERY_NAMES, _QUERY_WORDS, _SEARCHING = P.pattern(QUERY_NAMES), P.pattern(QUERY_WORDS), P.pattern(SEARCH_FORM)


def _control(a: dict[str, str]) -> tuple[int, str] | None:
    """The score and name of a control that takes a query."""
    kind, name = a.get("type", "").lower(), a.get("name", "").lower()
    if not name or kind in NO_QUERY:
        return None
    says = " ".join(a.get(k, "") for k in ("name", "id", "placeholder", "aria-label")).lower()
    return 20 * (kind == "search") + 14 * bool(_QUERY_NAMES.search(name)) + 8 * bool(_QUERY_WORDS.search(says)), P.decoded(a["name"])


def forms_of(html: str | None) -> list[tuple]:
    """place, said, field, hidden, score: a page's forms that search and aren't sent by another method than GET, wherever they are sent to."""
    found = [] if html is None else spans_of(html, _FORMS)
    inputs = [(start, a) for name, _, a, start, *_ in found if name == "input"]
    out, place, last = [], -1, -1
    for name, _, a, start, inner, close, end, _ in found:
        if name != "form" or close < 0:
            continue
        inside, last = start < last, max(last, end)
        if inside:
            continue
        place += 1
        if a.get("method", "").lower() not in ("", "get"):
            continue
        own = [has for at, has in inputs if inner <= at < close]
        best = max((c for has in own if (c := _control(has))), key=lambda c: c[0], default=None)
        if best is None or best[0] < FORM_LEAST:
            continue
        kept = [has for has in own if has.get("type", "").lower() == "hidden" and has.get("name") and has.get("value") and not _TOKENS.search(has["name"])]
        hidden = ",".join(f"{P.decoded(has['name'])}={P.decoded(has['value'])}" for has in kept)
        bonus = 8 * bool(_SEARCHING.search(" ".join(a.get(k, "") for k in ("role", "class", "id"))))
        out.append((place, P.decoded(a.get("action", "")), best[1], hidden, best[0] + bonus))
    return out


def search_forms(pages: DataFrame, most: int = 2) -> DataFrame:
    """page_id, place, action, field, hidden: the likeliest search forms of each page.

    A form is sent by GET to the page's own store's family of hosts. A control scores
    20 for the type search, 14 for a name such as q, query or search, and 8 if its name, id,
    placeholder or label speaks of searching; the first of the best is taken, and under 8 it is
    no search form. A form's own role, class or id that speaks of searching adds
    8 to its place among the page's forms. Hidden fields come as name=value, comma-joined, but for tokens.
    """
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = passed(pages, ["page_id", "url"], ["html"], forms_of, "place int, said string, field string, hidden string, score int")
    action = resolve_url(F.coalesce(F.nullif("said", F.lit("")), F.nullif(path, F.lit("")), F.lit("/")), F.col("url"))
    rows = narrowed(rows, F.struct(action.alias("action")), lambda x: x["action"].isNotNull())
    rows = rows.where(same_store(host(F.col("action")), host(F.col("url"))))
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "place")
    return rows.select("page_id", "place", "action", "field", "hidden", "score").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("page_id", "place", "action", "field", "hidden")


def profile_fields(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """page_id, product_text, ean_match: what a host's selectors for the product and its code name, and whether the code is the wanted one.

    pairs has page_id, url, html, ean; profiles host, product_selector and ean_selector (nullable), one row a host.
    """
    rows = pairs.withColumn("host", host(F.col("url"))).join(profiles.select("host", "product_selector", "ean_selector"), "host")
    take = lambda c: F.when(F.col(c).isNotNull(), F.nullif(F.trim(selected_text(F.col("html"), F.col(c))), F.lit("")))
    code = F.regexp_replace(take("ean_selector"), "[^0-9]", "")
    return rows.select("page_id", take("product_selector").alias("product_text"), F.coalesce(code == digits(F.col("ean")), F.lit(False)).alias("ean_match"))


def profile_prices(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """page_id, price_cents, currency, score, source: the price in the first element that a host's selector names.

    Scores are 210 and 80 for a met code, else 40 times the name's score. pairs
    has page_id, url, html, exact_ean, name_score; profiles host and
    price_selector, one row a host.
    """
    rules = profiles.where("price_selector IS NOT NULL").select("host", "price_selector")
    rows = pairs.withColumn("host", host(F.col("url"))).join(rules, "host")
    rows = rows.withColumn("said", selected_text(F.col("html"), F.col("price_selector"))).select("page_id", "exact_ean", "name_score", "said")
    rows = narrowed(rows, F.struct(F.col("said").alias("text")), lambda x: x["text"].isNotNull())
    text = F.col("text")
    score = 210 + F.when(F.col("exact_ean"), F.lit(80.0)).otherwise(F.col("name_score") * 40)
    return rows.select("page_id", F.explode(F.slice(price_values(text), 1, 1)).alias("price_cents"), once(text, lambda t: normalize_currency(detect_currency(t))).alias("currency"), score.alias("score"), F.lit("profile-selector").alias("source"))


def json_path_values(rows: DataFrame, path: str, node: str = "node") -> DataFrame:
    """The columns of `rows` but for the node, and value: the plain values at a dotted path of at most five parts, lists opened on the way and at the end."""
    parts = [p.strip() for p in path.split(".") if p.strip()]
    keep = [c for c in rows.columns if c != node]
    if not parts or len(parts) > 5:
        return rows.select(*keep, F.lit(None).cast("string").alias("value")).limit(0)
    opened = lambda values: F.flatten(F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    values = F.array(F.col(node))
    for part in parts:
        field = "$['" + part.replace("'", "\\'") + "']"
        values = F.filter(F.transform(opened(values), lambda v: F.try_variant_get(v, field, "variant")), lambda v: v.isNotNull())  # noqa: B023  made at once
    # outer, as Spark would put a filter before an inner explode that walks the path once more
    found = rows.select(*keep, F.explode_outer(opened(values)).alias("_v"))
    return found.where(~F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY|VOID)")).select(*keep, F.try_variant_get("_v", "$", "string").alias("value"))
