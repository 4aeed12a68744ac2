"""Scalar rules as Column functions; none is a UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies and base delays of the crawl log.
PERMANENT = ("not_found", "wrong_product", "robots_disallowed", "known_bad_pattern", "http_client_error", "login_wall", "stale_result")
BACKOFF_SECONDS = {
    120: ("captcha", "bot_wall", "login_wall", "js_challenge", "blocked"),
    60: ("rate_limited",),
    30: ("timeout", "http_server_error", "network_error"),
    300: ("profile_drift", "low_confidence", "price_missing"),
    3600: ("robots_disallowed", "known_bad_pattern"),
}
DAY_CAP = ("captcha", "login_wall", "robots_disallowed")
SOURCE_CONFIDENCE = {"structured": 98, "profile-selector": 90, "product-meta": 82, "product-element": 72, "ean-context": 62, "name-context": 48}
# In the order in which they are tried.
CURRENCIES = (("EUR", r"€|\bEUR\b"), ("GBP", r"£|\bGBP\b"), ("NOK", r"\bNOK\b"), ("DKK", r"\bDKK\b"), ("JPY", r"¥|\bJPY\b"), ("INR", r"₹|\bINR\b"), ("PLN", r"zł|\bPLN\b"), ("CHF", r"\bCHF\b"), ("SEK", r"\bSEK\b|\bkr\b"), ("USD", r"\$|\bUSD\b"))
SECRET_KEYS = "token|secret|password|passwd|apikey|api_key|key|auth|signature|session"


def once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(value) with the value computed once, however often the rule reads it."""
    return F.get(F.transform(F.array(value), rule), 0)


def narrowed(rows: DataFrame, made: Column, fits: Callable[[Column], Column]) -> DataFrame:
    """rows with the fields of the struct `made`, where `fits` holds of it; a row's struct is computed once, while a filter would be pushed below it and compute its columns anew for each use."""
    return rows.select("*", F.inline(F.filter(F.array(made), fits)))


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def host(url: Column) -> Column:
    """Lower-case host without one leading www. and a trailing dot; null for junk."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"\.$", ""), r"^www\.", "")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def norm_url(url: Column) -> Column:
    """Without the fragment and a default port, scheme and host in small letters, and with at least / as the path."""

    def rule(s: Column) -> Column:
        bare, head = s["bare"], F.lower(s["head"])
        root = F.when(head.rlike(":(80|443)$"), F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")).otherwise(head)
        rest = F.substr(bare, F.length(s["head"]) + 1)
        return F.when(s["head"] == "", bare).otherwise(F.concat(root, F.when(rest.startswith("/"), "").otherwise("/"), rest))

    split = lambda bare: F.struct(bare.alias("bare"), F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("head"))
    return F.get(F.transform(F.transform(F.array(without_fragment(url)), split), rule), 0)


def same_store(a: Column, b: Column) -> Column:
    """Whether two hosts (of `host`) are equal, or as whole labels one the end of the other."""
    return once(F.struct(a.alias("a"), b.alias("b")), lambda s: (s["a"] == s["b"]) | s["a"].endswith(F.concat(F.lit("."), s["b"])) | s["b"].endswith(F.concat(F.lit("."), s["a"])))


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.array_append(out, p))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.get(parts, 0)), step)
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def resolve_url(reference: Column, base: Column) -> Column:
    """The address that a page at `base` means by a reference, without the fragment; null for other schemes than http and https.

    Scheme and host come in small letters, without a default port; . and ..
    segments are gone, blanks are %20, and a missing path is /.
    """

    def rule(ref: Column) -> Column:
        scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        path = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^$", "/")
        query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
        full = (
            F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme, ref))
            .when(ref == "", F.concat(root, path, query))
            .when(ref.startswith("?"), F.concat(root, path, ref))
            .when(ref.startswith("/"), F.concat(root, ref))
            .otherwise(F.concat(root, F.regexp_extract(path, "^(.*/)", 1), ref))
        )
        return once(norm_url(F.replace(full, F.lit(" "), F.lit("%20"))), tidy)

    def tidy(url: Column) -> Column:
        part = lambda k: F.regexp_extract(url, r"^(https?://[^/?#]+)([^?]*)(\?.*)?$", k)
        plain = ~url.contains("/.") & url.rlike(r"^https?://[^/?#:][^/?#]*[^?]*(?:\?.*)?\z")
        return F.when(plain, url).when(url.rlike("^https?://[^/?#:]"), F.concat(part(1), _without_dots(part(2)), part(3)))

    return once(F.trim(without_fragment(reference)), rule)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def valid_gtin(code: Column) -> Column:
    """8, 12, 13 or 14 digits with a right check digit: weights 3, 1 from the right."""

    def rule(s: Column) -> Column:
        chars = F.filter(F.split(F.reverse(s), ""), lambda c: c != "")
        weighed = F.transform(chars, lambda c, i: c.try_cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
        shaped = F.coalesce(s.rlike("^(?:[0-9]{8}|[0-9]{12,14})$"), F.lit(False))
        return F.when(shaped, F.aggregate(weighed, F.lit(0), lambda x, v: x + v) % 10 == 0).otherwise(False)

    return once(code, rule)


def price_values(s: Column) -> Column:
    """Distinct amounts in cents in the order of the text; null gives an empty array.

    With both separators the last one is the decimal one; one separator with
    three digits behind it, or several of a kind, separate thousands.
    """
    found = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"([0-9]{1,3}(?:(?:[ .,'’][0-9]{3})+)(?:[.,][0-9]{1,2})?|[0-9]{1,8}(?:[.,][0-9]{1,2})?)"), 1)

    def facts(token: Column) -> Column:
        tail = F.regexp_extract(token, r"[.,]([0-9]+)$", 1)
        return F.struct(token.alias("token"), F.length(tail).alias("tail"), F.length(F.regexp_replace(token, "[0-9]", "")).alias("marks"), F.regexp_replace(token, "[.,]", "").cast("decimal(20,0)").cast("double").alias("whole"))

    def cents(f: Column) -> Column:
        both = f["token"].contains(".") & f["token"].contains(",")
        decimal = (both & (f["tail"] < 3)) | (~both & (f["marks"] == 1) & (f["tail"] < 3))
        decimal = decimal | (both & (f["tail"] == 3) & (f["marks"] == 2))
        scale = F.when(~decimal, F.lit(100.0)).otherwise(F.pow(F.lit(10.0), 2 - f["tail"]))
        return F.when(f["whole"].isNotNull(), half_up(f["whole"] * scale).cast("long"))

    # one step after the other over the same array: a step's outcome is computed once, however often the next one reads it
    tokens = F.transform(F.transform(found, lambda raw: F.regexp_replace(raw, r"[\s'’]", "")), facts)
    return F.array_distinct(F.filter(F.transform(tokens, cents), lambda c: c.isNotNull() & (c > 0) & (c < 10_000_000_000)))


def price_cents(s: Column) -> Column:
    return F.get(price_values(s), 0)


def import_price(s: Column) -> Column:
    """An own price from a sheet in cents: the last separator is the decimal one; null below 0 or for junk."""
    token = F.regexp_replace(s, r"[^0-9.,-]", "")
    whole = F.regexp_replace(F.regexp_replace(token, "[.,][0-9]*$", ""), "[.,]", "")
    value = F.concat(whole, F.lit("."), F.regexp_extract(token, "[.,]([0-9]*)$", 1), F.lit("0")).try_cast("double")
    return F.when((value >= 0) & token.rlike("[0-9]"), half_up(value * 100).cast("long"))


def detect_currency(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, pattern in reversed(CURRENCIES):
        out = F.when(s.rlike(f"(?i){pattern}"), code).otherwise(out)
    return out


def normalize_currency(s: Column) -> Column:
    """A detected currency, else the first three-letter word, else null."""
    code = F.regexp_extract(F.upper(F.trim(s)), r"\b([A-Z]{3})\b", 1)
    return F.coalesce(detect_currency(s), F.when(code != "", code))


def _plain_letters() -> tuple[str, str, str]:
    """Characters whose compatibility form is one plain letter or digit, their forms, and those of them that leave a mark behind."""
    forms, marked = {}, []
    for c in map(chr, (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2150), *range(0xFF10, 0xFF5B))):
        form = unicodedata.normalize("NFKD", c)
        if form != c and form[0].isascii() and form[0].isalnum() and not any(x.isascii() and x.isalnum() for x in form[1:]):
            forms[c] = form[0].lower()
            if len(form) > 1:
                marked.append(c)
    return "".join(forms), "".join(forms.values()), "".join(marked)


_LETTERS, _FORMS, _MARKED = _plain_letters()


def plain_words(text: Column) -> Column:
    """Runs of a-z and 0-9 of a text in small letters and decomposed, one space between; a letter's mark ends a run."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.translate(F.regexp_replace(low, f"([{_MARKED}])", "$1 "), _LETTERS, _FORMS), "[^a-z0-9]+", " ")


def name_score(expected: Column, candidate: Column) -> Column:
    """Share of the longer-than-one tokens of a name that a candidate contains; 0 without tokens."""
    tokens = F.filter(F.split(plain_words(expected), " "), lambda t: F.length(t) > 1)
    hits = F.filter(tokens, lambda t: plain_words(candidate).contains(t))
    return ratio(F.size(hits), F.size(tokens))


def confidence(structured_ean: Column, exact_ean: Column, name: Column, price_score: Column, source: Column, structured: Column, profile: Column) -> Column:
    """Scores of 0 to 100: ean, name, price, source and their weighted overall."""
    ean = F.when(structured_ean, 100).when(exact_ean, 88).otherwise(0)
    named = half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), name)) * 100).cast("int")
    price = F.when(price_score.isNull(), 0).otherwise(F.greatest(F.lit(35), F.least(F.lit(100), half_up((price_score - 45) / 2).cast("int"))))
    known = F.when(source == "structured", 98).when(profile, 90)
    for key, value in list(SOURCE_CONFIDENCE.items())[1:]:
        known = known.when(source == key, value)
    from_ = known.otherwise(F.when(structured, 40).otherwise(20))
    overall = half_up(ean * 0.42 + named * 0.22 + price * 0.22 + from_ * 0.14).cast("int")
    return F.struct(ean.alias("ean"), named.alias("name"), price.alias("price"), from_.alias("source"), overall.alias("overall"))


def confidence_label(scores: Column) -> Column:
    high = (scores["overall"] >= 86) & (scores["ean"] >= 88) & (scores["price"] >= 70) & (scores["source"] >= 95)
    return F.when(high, "high").when((scores["overall"] >= 68) & (scores["price"] >= 45), "medium").otherwise("low")


def failure_class(reason: Column) -> Column:
    return F.when(reason == "found", "none").when(reason.isin(*PERMANENT), "permanent").otherwise("temporary")


def backoff_ms(failures: Column, reason: Column, retry_after_ms: Column, jitter: float = 0.0) -> Column:
    """Base delay doubled with each failure up to ten times, capped at 6 or 24 hours; a longer retry-after wins."""
    base = F.lit(15)
    for seconds, reasons in BACKOFF_SECONDS.items():
        base = F.when(reason.isin(*reasons), seconds).otherwise(base)
    cap = F.when(reason.isin(*DAY_CAP), 24 * 3_600_000).otherwise(6 * 3_600_000)
    grown = base * 1000 * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(F.lit(10), failures - 1)))
    wait = F.greatest(F.least(cap.cast("double"), grown), F.coalesce(retry_after_ms, F.lit(0)).cast("double"), F.lit(0.0))
    return F.ceil(wait * (1 + max(0.0, min(0.25, jitter)))).cast("long")


def redact_url(url: Column) -> Column:
    """Without credentials, and with the values of secret-looking query keys masked."""
    bare = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@?#]*@", "$1")
    return F.regexp_replace(bare, rf"(?i)([?&][^=&#]*(?:{SECRET_KEYS})[^=&#]*=)[^&#]*", "$1[redacted]")


def csv_cell(s: Column) -> Column:
    """Cells that a sheet would read as a formula start with an apostrophe."""
    return F.when(s.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), s)).otherwise(F.coalesce(s, F.lit("")))


def _private_address(p: Column) -> Column:
    """Private and reserved ranges of IPv4, and what is no address."""
    a, b, c = (F.get(p, k).try_cast("int") for k in range(3))
    ranges = (
        a.isin(0, 10, 127), a >= 224, (a == 100) & b.between(64, 127), (a == 169) & (b == 254), (a == 172) & b.between(16, 31), (a == 192) & (b == 168), (a == 192) & (b == 0) & c.isin(0, 2),
        (a == 198) & b.isin(18, 19), (a == 198) & (b == 51) & (c == 100), (a == 203) & (b == 0) & (c == 113),
    )
    out = F.exists(p, lambda v: v.try_cast("int") > 255)
    for r in ranges:
        out = out | r
    return F.coalesce(out, F.lit(False))


def is_public_host(name: Column) -> Column:
    """Neither local names nor private or reserved ranges of IPv4 and IPv6 (without brackets)."""
    half = lambda h, k: F.conv(F.regexp_extract(h, "^::(?:ffff:)?([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 16, 10).try_cast("int")
    inside = lambda h: F.array(*(F.floor(half(h, k) / d).cast("int") % 256 for k in (1, 2) for d in (256, 1)))

    def rule(h: Column) -> Column:
        wide = h.contains(":")
        local = (h == "") | (~wide & ~h.contains(".")) | h.rlike(r"(^|\.)(localhost|local|internal)$")
        mapped = half(h, 1).isNotNull() & once(inside(h), _private_address)
        wide_private = h.rlike("^(::1?$|f[cd][0-9a-f]{2}:|fe[89a-f][0-9a-f]:|ff[0-9a-f]{2}:|2001:db8:)") | mapped
        private = F.when(wide, wide_private).when(h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), once(F.split(h, r"\."), _private_address)).otherwise(False)
        return F.coalesce(~local & ~private, F.lit(False))

    return once(F.lower(name), rule)


def profile_health(signature: Column, ean: Column, price: Column, challenge: Column, suggestions: Column) -> Column:
    points = (
        F.lit(50)
        + F.when(signature, 15).when(~signature, -25).otherwise(0)
        + F.when(ean, 20).otherwise(0)
        + F.when(price, 15).when(suggestions > 0, -5).otherwise(0)
        - F.when(challenge, 20).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def contains_barcode(text: Column, ean: Column) -> Column:
    """The code in a text, with blanks or dashes between digits, and not inside a longer number."""
    pattern = F.concat(F.lit("(?<![0-9])"), F.array_join(F.filter(F.split(ean, ""), lambda c: c != ""), r"[\s-]*"), F.lit("(?![0-9])"))
    return F.coalesce(F.regexp_like(text, pattern), F.lit(False))


def fnv1a(s: Column) -> Column:
    """fnv1a-<hex>-<length> over the characters of a text."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    value = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.concat(F.lit("fnv1a-"), F.lower(F.lpad(F.hex(value), 8, "0")), F.lit("-"), F.length(s).cast("string"))


def min_cadence_minutes(checks: Column) -> Column:
    return F.ceil(F.lit(1440.0) / checks).cast("int")


# Marks of a shop's software, in the order in which they are tried.
PLATFORMS = (
    ("shopify", r"cdn\.shopify\.com|Shopify\.(?:theme|routes)|myshopify\.com"),
    ("woocommerce", r"woocommerce|wp-content/plugins/woocommerce"),
    ("magento", r"Magento_[A-Za-z]+|mage/cookies|/static/version\d+"),
    ("prestashop", r"prestashop"),
    ("bigcommerce", r"bigcommerce\.com|stencilUtils"),
    ("shopware", r"shopware|data-shopware"),
    ("vtex", r"vtexassets|__RUNTIME__"),
    ("wix-stores", r"wixstores|static\.wixstatic\.com"),
)


def commerce_platform(html: Column) -> Column:
    """The software that a shop's page names, null where none is known."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PLATFORMS):
        out = F.when(html.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


# Characters of a page that suggestions read, most suggestions, and what an attribute must speak of.
SUGGESTED_FROM, MOST_SUGGESTIONS = 250_000, 6


def selector_suggestions(html: Column) -> Column:
    """The first six different selectors of elements that speak of prices, products or codes: by itemprop, test id, id or class, in that order."""
    tags = F.regexp_extract_all(F.substring(html, 1, SUGGESTED_FROM), F.lit(r"(?is)<[a-z][\w:-]*\b[^>]*(?:price|product|gtin|ean|sku)[^>]*>"), 0)
    value = lambda t, name, of: F.regexp_extract(t, rf"""(?is)<[a-z][\w:-]*\b.*?\b{name}=["']({of})["']""", 1)

    def suggest(t: Column) -> Column:
        """Each attribute is looked for once, and only where those before it say nothing."""
        name = F.lower(F.regexp_extract(t, r"(?i)^<([a-z][\w:-]*)", 1))
        word = F.get(F.filter(F.split(value(t, "class", "[^\"']+"), r"\s+"), lambda w: w.rlike("(?i)price|product|ean|gtin")), 0)
        by_class = once(word, lambda w: F.when(w.rlike(r"^[\w-]+$"), F.concat(F.lit("."), w)))
        by_id = once(value(t, "id", r"[\w-]+"), lambda own: F.when(own != "", F.concat(F.lit("#"), own)).otherwise(by_class))
        by_test = once(value(t, "data-testid", "[^\"']+"), lambda test: F.when(test.rlike(r"^[\w.-]+$"), F.concat(name, F.lit("[data-testid="), test, F.lit("]"))).otherwise(by_id))
        return once(value(t, "itemprop", "[^\"']+"), lambda prop: F.when(prop.rlike(r"(?i)^(?:price|gtin\d*|sku)$"), F.concat(name, F.lit("[itemprop="), prop, F.lit("]"))).otherwise(by_test))

    return F.slice(F.array_distinct(F.array_compact(F.transform(F.array_distinct(tags), suggest))), 1, MOST_SUGGESTIONS)


def reason_for_status(status: Column) -> Column:
    """The reason that a status alone stands for."""
    return F.when(status.isin("found", "not_found", "blocked"), status).when(status == "unavailable", "network_error").otherwise("low_confidence")


def reason_for_fetch(kind: Column) -> Column:
    """The reason of a failed fetch by its kind."""
    return F.when(kind == "challenge", "bot_wall").when(kind == "queue_busy", "request_queue_busy").when(kind.isin("timeout", "blocked", "rate_limited", "response_too_large", "http_client_error"), kind).otherwise("http_server_error")


def reason_for_result(status: Column, http_status: Column, exact_ean: Column, price_cents: Column) -> Column:
    """The reason of a result without one: by status and answer, else by what its evidence lacks."""
    lost = F.when(http_status >= 500, "http_server_error").otherwise("network_error")
    unsure = F.when(~F.coalesce(exact_ean, F.lit(False)), "wrong_product").when(F.coalesce(price_cents, F.lit(0)) == 0, "price_missing").otherwise("low_confidence")
    return F.when(status.isin("found", "not_found", "blocked"), status).when(status == "unavailable", lost).otherwise(unsure)


def is_cooldown_reason(reason: Column) -> Column:
    """Reasons that make a whole host wait."""
    return F.coalesce(reason.isin("blocked", "captcha", "bot_wall", "js_challenge", "rate_limited", "timeout", "response_too_large", "http_server_error", "network_error"), F.lit(False))


def is_verified(match: Column) -> Column:
    """Whether a match (struct) is a find: it has a price, and its evidence is strong enough for where it came from.

    A sitemap's address is a hint only, and needs the code; by code the overall
    confidence must be 68, by name 52 with 0.93 of the name and a source of 70.
    """
    overall = match["overall_confidence"]
    coded = match["structured_ean"] | (match["ean_match"] & (match["name_score"] >= 0.85))
    named = (match["name_score"] >= 0.93) & (overall >= 52) & (match["source_confidence"] >= 70)
    by_page = F.when(match["ean_match"], overall >= 68).otherwise(named)
    return F.coalesce(match["price_cents"].isNotNull() & F.when(match["profile_id"] == "sitemap", coded & (overall >= 68)).otherwise(by_page), F.lit(False))
