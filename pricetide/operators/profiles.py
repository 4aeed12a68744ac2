"""Search profiles: rules for their fields, and the fields as they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.scalars import host, is_public_host, once, resolve_url, same_store

# Bounds of a profile's texts, lists and numbers, kinds of sites, and the forms of selectors and field paths.
LABEL_CHARS, SIGNATURE_CHARS, TEMPLATE_CHARS, SELECTOR_CHARS, PATH_CHARS, MARK_CHARS = (2, 80), (3, 500), 500, 180, 80, 120
MOST_PATHS, MOST_MARKS = 8, 8
NUMBERS = {"timeout_ms": (3_000, 30_000), "max_page_bytes": (256_000, 8_000_000), "retry_budget": (0, 4)}
SITE_TYPES = ("auto", "standard", "slow", "large", "javascript", "marketplace")
SELECTOR = r"""(?i)^(?:[a-z][\w-]*)?(?:#[\w-]+|\.[\w-]+|\[(?:data-[\w-]+|itemprop|data-testid|id|class)(?:=(?:"[^"]*"|'[^']*'|[\w.-]+))?\])?$"""
FIELD_PATH = r"^[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*){0,4}$"
SELECTORS = ("product_selector", "ean_selector", "price_selector", "cookie_consent_selector")
PATHS = ("json_ld_ean_fields", "json_ld_price_fields", "json_ld_currency_fields")
QUERY = "{query}"

#: An address of the web without credentials and path, on a standard port; and what stands in a template for the query while it is looked at.
PLAIN_SITE, MARK = r"(?i)^https?://(\[[0-9a-f:.]+\]|[^\s/?#@:\[\]<>^|%\\]+)(:(80|443)?)?/?$", "the-query-goes-here"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")


def entries(text: Column, split: str) -> Column:
    """The trimmed entries of a list in one text; empty ones don't count, and null is an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), split), trimmed), lambda x: x != "")


def paths(text: Column) -> Column:
    """Field paths of a profile, by commas or lines, in order and each once."""
    return F.array_distinct(entries(text, "[\n,]"))


def site(hostname: Column) -> Column:
    """The host that a hostname or a bare address names, without one leading www.; empty for none, null for one that isn't bare, on the web or public."""

    def rule(name: Column) -> Column:
        url = F.when(name.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), name).otherwise(F.concat(F.lit("https://"), name))
        named = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, PLAIN_SITE, 1)), r"^www\.", ""), r"\.$", "")
        return F.when(name == "", "").when(url.rlike(PLAIN_SITE), once(named, lambda h: F.when(is_public_host(F.regexp_replace(h, r"[\[\]]", "")), h)))

    return once(trimmed(F.coalesce(hostname, F.lit(""))), rule)


def _template_error(template: Column, name: Column) -> Column:
    """What is wrong with a template for the addresses of searches of a host (of `site`), or null; of an unknown host (null) only what holds for any."""
    filled = F.replace(template, F.lit(QUERY), F.lit(MARK))
    url = resolve_url(filled, F.concat(F.lit("https://"), F.coalesce(F.nullif(name, F.lit("")), F.lit("store.example")), F.lit("/")))

    def rule(u: Column) -> Column:
        authority = F.regexp_extract(u, "^https?://([^/?#]*)", 1)
        return (
            F.when(u.isNull(), "address")
            .when(F.contains(authority, F.lit("@")), "credentials")
            .when(F.regexp_replace(authority, r"^\[[^\]]*\]", "").rlike(":(?!(80|443)$)"), "port")
            .when(F.contains(authority, F.lit(MARK)), "query_in_host")
            .when(~F.contains(u, F.lit(MARK)), "query_in_fragment")
            .when((name != "") & ~same_store(host(u), name), "other_site")
        )

    marks = F.size(F.split(template, r"\{query\}")) - 1
    return (
        F.when(F.length(template) > TEMPLATE_CHARS, "length").when(marks != 1, "placeholder").when(template.startswith("//"), "address")
        .when((name == "") & template.rlike("(?i)^[a-z][a-z0-9+.-]*:"), "relative_only").otherwise(once(url, rule))
    )


FIELDS = ("label", "hostname", "html_signature", "search_url_template", *SELECTORS, *PATHS, "block_patterns", "allow_rendered_fallback", "enabled", "site_type", *NUMBERS)


def _texts(profiles: DataFrame) -> DataFrame:
    """id, every field of a profile as trimmed text, and `site`; columns that are absent, and nulls, are empty."""
    text = lambda n: trimmed(F.coalesce(F.col(n).cast("string"), F.lit(""))) if n in profiles.columns else F.lit("")
    return profiles.select("id", *(text(n).alias(n) for n in FIELDS)).withColumn("site", site(F.col("hostname")))


def validate(profiles: DataFrame) -> DataFrame:
    """id and the errors of each profile, comma-joined and in a fixed order; a valid one has none.

    A profile has a label, a host or a mark in the html, and a template with one
    {query} in the path or query of an address on its own site; without a host
    the template is relative. Selectors, field paths and walls are plain, a
    cookie selector needs the renderer, and flags are true or false. A flag or
    number that is null or empty is as if not given.
    """
    rows = _texts(profiles)
    f, name = {n: F.col(n) for n in FIELDS}, F.col("site")
    flag = lambda n: ~f[n].isin("", "true", "false")

    def number(n: str) -> Column:
        value = f[n].try_cast("double")
        return (f[n] != "") & ~F.coalesce(value.between(*NUMBERS[n]) & (value == F.floor(value)), F.lit(False))

    def bad_list(items: Column, most: int, chars: int, ok) -> Column:
        return (F.size(items) > most) | F.exists(items, lambda x: (F.length(x) > chars) | ~ok(x))

    template = F.when(f["search_url_template"] == "", "placeholder").otherwise(_template_error(f["search_url_template"], name))
    tests = [
        F.when(~F.length(f["label"]).between(*LABEL_CHARS), "label"),
        F.when(name.isNull(), "hostname"),
        F.when((F.length(f["html_signature"]) > SIGNATURE_CHARS[1]) | ((f["hostname"] == "") & (F.length(f["html_signature"]) < SIGNATURE_CHARS[0])), "html_signature"),
        F.concat(F.lit("search_url_"), template),
        *(F.when((f[n] != "") & ((F.length(f[n]) > SELECTOR_CHARS) | ~f[n].rlike(SELECTOR)), n) for n in SELECTORS),
        *(F.when(bad_list(entries(f[n], "[\n,]"), MOST_PATHS, PATH_CHARS, lambda x: x.rlike(FIELD_PATH)), n) for n in PATHS),
        F.when(bad_list(entries(f["block_patterns"], "\n"), MOST_MARKS, MARK_CHARS, lambda x: ~x.rlike(r"[\x00-\x1f]")), "block_patterns"),
        F.when(flag("allow_rendered_fallback"), "allow_rendered_fallback"),
        F.when((f["cookie_consent_selector"] != "") & (f["allow_rendered_fallback"] != "true"), "renderer_needed"),
        F.when(flag("enabled"), "enabled"),
        F.when(~f["site_type"].isin("", *SITE_TYPES), "site_type"),
        *(F.when(number(n), n) for n in NUMBERS),
    ]
    return rows.select("id", F.array_join(F.array_compact(F.array(*tests)), ",").alias("errors"))


def stored(profiles: DataFrame) -> DataFrame:
    """The fields of valid profiles as they are kept: trimmed, hosts bare, lists without repeats, and the identity that two profiles may not share."""
    f, name = {n: F.col(n) for n in FIELDS}, F.col("site")
    flag = lambda n, default: F.when(f[n] == "", default).otherwise(f[n] == "true")
    made = {
        "label": f["label"], "hostname": name, "html_signature": f["html_signature"], "search_url_template": f["search_url_template"], **{n: f[n] for n in SELECTORS},
        **{n: F.array_join(paths(f[n]), ",") for n in PATHS}, "block_patterns": F.array_join(F.array_distinct(entries(f["block_patterns"], "\n")), "\n"),
        "allow_rendered_fallback": flag("allow_rendered_fallback", False), "enabled": flag("enabled", True), "site_type": F.nullif(f["site_type"], F.lit("")), **{n: f[n].try_cast("double").cast("long") for n in NUMBERS},
        "identity": F.concat_ws("\0", F.lower(name), F.lower(f["html_signature"])),
    }
    good = validate(profiles).where("errors = ''").select("id")
    return _texts(profiles).select("id", *(c.alias(n) for n, c in made.items())).join(good, "id", "left_semi")
