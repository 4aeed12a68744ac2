"""Offers of pages: structured product nodes, price candidates of all kinds, and the match of a page with a wanted product."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import documents as J
from pricetide.functions import plain as P
from pricetide.functions.scalars import confidence, confidence_label, host
from pricetide.operators.elements import passed
from pricetide.operators.pages import JSON_DEPTH, TITLES, context_prices, html_prices, profile_prices, signals
from pricetide.operators.profiles import PATHS, paths

# Keys (in lower case, without marks) that hold identifiers, names and addresses; containers of prices.
CODES = ("gtin", "gtin8", "gtin12", "gtin13", "gtin14", "ean", "ean8", "ean13", "ean14", "barcode", "productid", "sku", "mpn")
NAMES = ("name", "productname", "displayname", "title")
ADDRESSES = ("url", "canonicalurl", "producturl", "link")
CURRENCIES = ("pricecurrency", "currency", "currencycode")
STOCKS = ("availability", "stockstatus", "inventorystatus")
CONTAINERS = "(?i)^(offer|offers|price|prices|pricing|variant|variants|sale|current)$"
PRICE_KEYS = "^(price|currentprice|saleprice|finalprice|sellingprice|unitprice|amount|value)$"
OTHER_PRICES = "old|original|regular|list|rrp|msrp|shipping|delivery|discount|saving"
CURRENT = "current|sale|final|selling"
#: The last price that counts as one, in cents; entries of an array that are looked at.
MOST_CENTS, ENTRIES = 100_000_000, 50

#: Parts of a path that a profile names.
MOST_PARTS = 5

_CODES, _SHAPES = frozenset(CODES), frozenset(("product", "productdata", "item", "variant"))
_PRODUCT, _CONTAINER, _NESTED = P.pattern(r'(?i)(^|")(product|productgroup)("|$)'), P.pattern(CONTAINERS), P.pattern(r"^\s*[\[{]")
_PRICE_KEY, _OTHER, _CURRENT, _CENTS, _PRICED = P.pattern(PRICE_KEYS), P.pattern(OTHER_PRICES), P.pattern(CURRENT), P.pattern("pricecents$"), P.pattern("price|pricing|offer|sale|current")
_READY = P.pattern("(?i)instock|preorder|limitedavailability")
_GONE, _THERE = P.pattern(r"(?i)out\s*of\s*stock|sold\s*out|not\s+available|unavailable|discontinued|ni\s+na\s+zalogi|razprodano"), P.pattern(r"(?i)in\s*stock|available|preorder|limitedavailability|na\s+zalogi|dobavljivo")
#: Characters of a node without a name that are read for the product's.
NODE_CHARS = 10_000


def _text(v: J.Value) -> str | None:
    """A scalar as text; null for objects, arrays and texts that look like them."""
    if type(v) is str:
        return v if v[:1].isalnum() or not _NESTED.match(v) else None
    return None if v is None else J.text_of(v)


def _at(v: J.Value, *path: str) -> str | None:
    """The scalar below so many objects as text."""
    for key in path:
        v = v.get(key) if type(v) is dict else None
    return _text(v)


def _many(v: J.Value) -> list:
    """The entries of an array, or the value itself as one."""
    return v if type(v) is list else [v]


@lru_cache(maxsize=4096)
def _parts(path: str) -> tuple[str, ...]:
    return tuple(p for x in path.split(".") if (p := x.strip(" ")))


def values_at(node: J.Value, path: str) -> list[str]:
    """The plain values at a dotted path in a document, in order, lists opened on the way and at the end; a path of no part or more than `MOST_PARTS` has none."""
    parts = _parts(path)
    if not 1 <= len(parts) <= MOST_PARTS:
        return []
    found = [node]
    for part in parts:
        found = [y for v in found for x in _many(v) if type(x) is dict and part in x for y in _many(x[part])]
    return [t for v in found for x in _many(v) if (t := _text(x)) is not None]


def _said(node: J.Value, named: list[str] | None) -> list[list[str]] | None:
    """The values at each of some paths, a list a path; without paths null."""
    return None if named is None else [values_at(node, p) for p in named]


def _first(own: list[list[str]] | None, offers: list[list[str]] | None, rule: Callable):
    """The first value, by path and then the product's before its offer's, of which a rule makes something."""
    every = (v for k, values in enumerate(own or ()) for v in (*values, *(offers[k] if offers and k < len(offers) else ())))
    return next((x for v in every if (x := rule(v)) is not None), None)


def _cents(text: str | None) -> int | None:
    return next(iter(P.price_values(text)), None)


class _Offer(NamedTuple):
    """A node's offer; offers that bear one id are ranked by these fields in order, null before all else."""

    score: int
    price_cents: int | None
    currency: str | None
    availability: str | None
    url: str | None
    id: str | None
    said_prices: list[list[str]] | None
    said_currencies: list[list[str]] | None

    def rank(self) -> tuple:
        return tuple((x is not None, x if x is not None else 0) for x in self)


def _offer(o: J.Value, prices: list[str] | None = None, currencies: list[str] | None = None) -> _Offer:
    """A node's offer fields; a sale or current price counts before the price. Besides, what stands at a profile's paths."""
    said = _said(o, prices), _said(o, currencies)
    if type(o) is not dict:
        return _Offer(0, None, None, None, None, None, *said)
    plain, stock, currency = _at(o, "price"), _at(o, "availability"), _at(o, "priceCurrency")
    raws = (_at(o, "salePrice"), _at(o, "currentPrice"), plain, _at(o, "priceSpecification", "price"), _at(o, "lowPrice"))
    cents = _cents(next((t for t in raws if t is not None), None))
    score = 20 * (cents is not None) + 6 * bool(stock and _READY.search(stock)) + 4 * (plain is not None)
    return _Offer(score, cents, _at(o, "priceSpecification", "priceCurrency") if currency is None else currency, stock, _at(o, "url"), _at(o, "@id"), *said)


@lru_cache(maxsize=4096)
def _key(key: str) -> tuple[str, str]:
    """A key in small letters without marks, and without digits."""
    plain = "".join(c for c in key if c.isascii() and c.isalnum()).lower()
    return plain, "".join(c for c in plain if not c.isdigit())


def _fields(level: list[tuple]) -> list[tuple]:
    """Parent path, key (plain), key (letters only) and text of all entries of a level's nodes."""
    return [(path, *_key(k), _text(v)) for path, node in level if type(node) is dict for k, v in node.items()]


def _deeper(level: list[tuple]) -> list[tuple]:
    """The nodes in the price containers of a level's nodes, with their paths."""
    return [(f"{path}.{''.join(c for c in k if c.isascii() and c.isalpha()).lower()}", c) for path, node in level if type(node) is dict for k, v in node.items() if _CONTAINER.search(k) for c in _many(v)[:ENTRIES]]


def _named(keys: tuple[str, ...], fields: list[tuple]) -> str | None:
    return next((raw for k in keys for _, key, _, raw in fields if key == k and raw is not None), None)


def _rounded(text: str | None) -> int | None:
    value = J.number(text)
    return None if value is None or not abs(value) < 2**63 else int(math.copysign(math.floor(abs(value) + 0.5), value))


def _generic_price(fields: list[tuple]) -> int | None:
    """The price of a node without a type: current and sale fields before others, the shallowest of equals; other prices never."""
    best = None
    for place, (parent, _, letters, raw) in enumerate(fields):
        whole, in_cents = f"{parent}.{letters}", bool(_CENTS.search(letters))
        if _OTHER.search(whole) or not (in_cents or (_PRICE_KEY.search(letters) and (parent == "" or _PRICED.search(parent)))):
            continue
        cents = _rounded(raw) if in_cents else _cents(raw)
        if cents is not None and 0 < cents < MOST_CENTS:
            made = (30 if _CURRENT.search(whole) else 10, -place, cents)
            best = made if best is None or made > best else best
    return best and best[2]


def candidates_of(html: str | None, ean: str | None, name: str | None, named: tuple | None, depth: int = JSON_DEPTH) -> list[tuple]:
    """`structured_candidates` of one page; `named` has a profile's paths of codes, prices and currencies."""
    said_ean, said_price, said_currency = named or (None, None, None)
    found, owns = [], []
    for path, node in J.nodes(html, depth):
        kind = J.json_text(node["@type"]) if "@type" in node else None
        typed = kind is not None and bool(_PRODUCT.search(kind))
        id_, f0 = _at(node, "@id") if "@id" in node else None, _fields([("", node)])
        if id_ is not None and (own := _offer(node, said_price, said_currency)).score > 0:
            owns.append(own)
        title = _named(NAMES, f0)
        if not typed and title is None:
            continue
        codes = (P.digits(_text(v)) for k, e in node.items() if _key(k)[0] in _CODES for v in _many(e))
        exact = ean is not None and (ean in codes or (typed and said_ean is not None and any(P.digits(v) == ean for values in _said(node, said_ean) for v in values)))
        loose = not typed and (exact or (any(f[1] in _SHAPES for f in f0) and P.name_score(name, title) >= 0.65))
        if typed:
            called = J.json_text(node)[:NODE_CHARS] if title is None else title
            offers_ = [_offer(o, said_price, said_currency) for o in _many(node.get("offers"))]
            found.append((path, True, exact, P.name_score(name, called), title, _named(ADDRESSES, f0), offers_, _said(node, said_price), _said(node, said_currency)))
        elif loose:
            level, fields = [("", node)], f0
            for _ in range(3):
                level = _deeper(level)
                fields = fields + _fields(level)
            flag = (_named(("instock", "isinstock"), f0) or "").lower()
            stock = _named(STOCKS, fields)
            stock = {"true": "InStock", "false": "OutOfStock"}.get(flag) if stock is None else stock
            bare = _Offer(0, _generic_price(fields), _named(CURRENCIES, fields), stock, _named(ADDRESSES, f0), None, None, None)
            found.append((path, False, exact, P.name_score(name, title), title, _named(ADDRESSES, f0), [bare], None, None))
    if not found:
        return []
    page_ean, out = any(typed for _, typed, *_ in found) and P.contains_barcode(P.visible(html), ean), []
    for path, typed, exact, score, title, link, offers_, prices, currencies in found:
        best = None
        for o in offers_:
            if o.price_cents is None and o.id is not None:
                o = max((n for n in owns if n.id == o.id), key=_Offer.rank, default=o)
            best = o if best is None or o.score > best.score else best
        b = best or _Offer(0, *[None] * 7)
        cents, currency = _first(prices, b.said_prices, _cents), _first(currencies, b.said_currencies, P.normalize_currency)
        cents, currency = b.price_cents if cents is None else cents, P.normalize_currency(b.currency) if currency is None else currency
        in_stock = None if b.availability is None else False if _GONE.search(b.availability) else True if _THERE.search(b.availability) else None
        total = (260 if typed else 250) * exact + score * (90 if typed else 86) + (24 if typed else 22) * (cents is not None) + 8 * (typed and page_ean)
        out.append((J.whole(path), J.whole(title), J.whole(link if b.url is None else b.url), cents, currency, in_stock, exact, score, float(total)))
    return out


def structured_candidates(pairs: DataFrame, depth: int = JSON_DEPTH, profiles: DataFrame | None = None) -> DataFrame:
    """page_id, path, ean, title, link, price_cents, currency, in_stock, exact_ean, name_score, score: a page's product nodes.

    Nodes of a product's type score 260 for the wanted code, 90 times the share
    of the name, 24 for a price and 8 for the code in the page's visible text.
    Their best offer is the one with a price, stock and a plain price; an offer
    that only names an @id takes the fields of the node that bears it. Other
    nodes count if they hold the code, or are shaped like a product, and bear
    0.65 of the name: 250, 86 and 22, with the price found down to three
    containers. pairs has one row a page_id: page_id, html, ean, name.

    profiles name fields of typed nodes by host (json_ld_ean_fields,
    json_ld_price_fields, json_ld_currency_fields: paths by commas or lines, one
    row a host); pairs then has url. Codes there count besides the ones by known
    keys; the first value that is a price, of the product or its best offer, or a
    currency, goes before the offer's own.

    A page's documents are parsed, walked and judged in one pass (`json_nodes` gives the same nodes).
    """
    met = pairs.select("page_id", *(["url"] if profiles is not None else []), "ean", "name", "html")
    if profiles is not None:
        named_paths = profiles.select("host", *(F.nullif(paths(F.col(c)), F.array().cast("array<string>")).alias(c) for c in PATHS)).where(F.coalesce(*PATHS).isNotNull())
        none = F.array().cast("array<string>")
        met = met.withColumn("host", host(F.col("url"))).join(named_paths, "host", "left").withColumns({c: F.coalesce(c, none) for c in PATHS}).drop("host", "url")
    fields = "path string, title string, link string, price_cents bigint, currency string, in_stock boolean, exact_ean boolean, name_score double, score double"
    rule = lambda html, ean, name, *named: candidates_of(html, ean, name, named or None, depth)
    found = passed(met, ["page_id", "ean"], ["html", "ean", "name", *(PATHS if profiles is not None else ())], rule, fields)
    return found.select("page_id", "path", "ean", "title", "link", "price_cents", "currency", "in_stock", "exact_ean", "name_score", "score")


def price_candidates(pairs: DataFrame) -> DataFrame:
    """page_id, price_cents, currency, score, source: prices of meta, elements and labels near the product, the best of each amount and currency."""
    kinds = [html_prices(pairs), context_prices(pairs)]
    columns = ["page_id", "price_cents", "currency", F.col("score").cast("double").alias("score"), "source"]
    every = kinds[0].select(columns).unionByName(kinds[1].select(columns))
    best = every.groupBy("page_id", "price_cents", "currency").agg(F.max(F.struct("score", "source")).alias("b"))
    return best.select("page_id", "price_cents", "currency", "b.score", "b.source")


_TITLES = tuple(P.pattern(p) for p in TITLES)


def evidence_of(html: str | None, ean: str | None, name: str | None) -> list[tuple]:
    """page_ean, page_name: whether a page's text shows the wanted code, and the share of the name that its title and text bear."""
    text = P.visible(html)
    heads = (m[1].strip(" ") for p in _TITLES if html is not None and (m := p.search(html)))
    return [(P.contains_barcode(text, ean), P.name_score(name, " ".join(x for x in (next((h for h in heads if h), None), text) if x is not None)))]


def match_pages(pairs: DataFrame, profiles: DataFrame, depth: int = JSON_DEPTH) -> DataFrame:
    """One row for each page paired with a wanted product: identity, offer, stock and confidence.

    Identity is the code (in a product node or the visible text), or a share of
    the name. A product node's price counts 80 above its score and needs the
    code or 0.65 of the name; a profile's price takes over if it scores higher;
    a price of the page if there is none, or if it scores higher and the code is
    met. Prices of the page gain 70 by the code, else 35 times the name's share.
    pairs has page_id (one row each), url, html, ean, name; profiles host and
    price_selector, and the fields of linked data if it names any. Pages without any evidence keep a row without a price.
    """
    page = signals(pairs).select("page_id", "canonical_url", F.col("title").alias("page_title"), F.col("in_stock").alias("page_stock"))
    seen = passed(pairs, ["page_id"], ["html", "ean", "name"], evidence_of, "page_ean boolean, page_name double")
    nodes = structured_candidates(pairs, depth, profiles if set(PATHS) <= set(profiles.columns) else None).groupBy("page_id").agg(F.max_by(F.struct("title", "price_cents", "currency", "in_stock", "exact_ean", "name_score", "score"), F.struct("score", "path")).alias("s"), F.max("exact_ean").alias("structured_ean"))
    base = page.join(seen, "page_id").join(nodes, "page_id", "left")
    base = base.withColumn("ean_match", F.coalesce("s.exact_ean", F.lit(False)) | F.col("page_ean")).withColumn("name_score", F.greatest("page_name", F.coalesce("s.name_score", F.lit(0.0))))
    top = price_candidates(pairs).groupBy("page_id").agg(F.max_by(F.struct("price_cents", "currency", "score", "source"), F.struct("score", -F.col("price_cents"))).alias("h"))
    known = pairs.select("page_id", "url", "html").join(base.select("page_id", F.col("ean_match").alias("exact_ean"), "name_score"), "page_id")
    chosen = profile_prices(known, profiles).groupBy("page_id").agg(F.max_by(F.struct("price_cents", "currency", "score", "source"), "score").alias("p"))
    rows = base.join(top, "page_id", "left").join(chosen, "page_id", "left")
    kind = "struct<price_cents:bigint,currency:string,score:double,source:string>"
    pick = lambda a, score, source: F.struct(F.col(f"{a}.price_cents"), F.col(f"{a}.currency"), score.alias("score"), source.alias("source")).cast(kind)
    own = F.when(F.col("s.price_cents").isNotNull() & (F.col("s.exact_ean") | (F.col("s.name_score") >= 0.65)), pick("s", F.col("s.score") + 80, F.lit("structured")))
    rows = rows.withColumn("best", own)
    rows = rows.withColumn("best", F.when(F.col("p").isNotNull() & (F.col("best").isNull() | (F.col("p.score") > F.col("best.score"))), pick("p", F.col("p.score"), F.col("p.source"))).otherwise(F.col("best")))
    shown = F.col("h.score") + F.when(F.col("ean_match"), F.lit(70.0)).otherwise(F.col("name_score") * 35)
    named = F.col("h").isNotNull() & (F.col("ean_match") | (F.col("name_score") >= 0.65))
    rows = rows.withColumn("best", F.when(named & (F.col("best").isNull() | (F.col("ean_match") & (shown > F.col("best.score")))), pick("h", shown, F.col("h.source"))).otherwise(F.col("best")))
    structured = F.col("s").isNotNull()
    scores = confidence(F.coalesce("structured_ean", F.lit(False)), F.col("ean_match"), F.col("name_score"), F.col("best.score"), F.col("best.source"), structured, F.coalesce(F.col("best.source") == "profile-selector", F.lit(False)))
    rows = rows.withColumn("c", scores)
    return rows.select(
        "page_id", "canonical_url", F.coalesce("s.title", "page_title").alias("title"), "ean_match", "name_score", "best.price_cents", "best.currency", F.coalesce("s.in_stock", "page_stock").alias("in_stock"),
        F.col("best.source").alias("price_source"), structured.alias("structured"), F.coalesce("structured_ean", F.lit(False)).alias("structured_ean"), confidence_label(F.col("c")).alias("confidence"),
        F.col("c.overall").alias("overall_confidence"), F.col("c.source").alias("source_confidence"), (F.col("c.overall") * 3 + F.when(structured, 12).otherwise(0)).alias("score"),
    )
