"""Results of reading pages for wanted products: pairs, the match cache, carried offers, the best match and its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.scalars import digits, host, is_verified, norm_url
from pricetide.operators.policy import suffix_join

#: How long a match of a page is kept.
CACHE_DAYS = 7
#: What a profile's fingerprint covers, in order.
PROFILE_FIELDS = ("host", "signature", "search_template", "product_selector", "ean_selector", "price_selector", "ean_fields", "price_fields", "currency_fields")


def pair_targets(pages: DataFrame, products: DataFrame) -> DataFrame:
    """page_id, id, ean, name: pages beside the wanted products of their store's family.

    Hosts are equal, or one is the other's end in whole labels. The join works
    on hosts alone, so that neither html nor products move for hosts that don't
    meet; a store's pages and products then meet by host.
    """
    own = pages.select("page_id", host(F.col("url")).alias("page_host"))
    wanted = products.select("id", "ean", "name", host(F.col("website_url")).alias("store"))
    met = suffix_join(own.select("page_host").distinct(), wanted.select("store").distinct(), "page_host", "store")
    return own.join(met, "page_host").join(wanted, "store").select("page_id", "id", "ean", "name")


def product_fingerprint(profile: dict[str, Column] | None = None) -> Column:
    """Hash of the nine fields of a profile that change what is read from a page; nulls keep their places."""
    fields = profile or {}
    parts = [fields.get(c, F.col(c)) for c in PROFILE_FIELDS]
    return F.md5(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))))


def cache_keys(pairs: DataFrame) -> DataFrame:
    """pairs with the key of the match cache: norm_url, the code's digits, and a hash of the page and of what it is read with.

    pairs has url, ean, fingerprint (of the page) and profile_fingerprint, nullable.
    """
    content = F.md5(F.to_json(F.array(F.lit("extractor-1"), F.col("fingerprint"), F.coalesce("profile_fingerprint", F.lit("")))))
    return pairs.withColumn("norm_url", norm_url(F.col("url"))).withColumn("ean_digits", digits(F.col("ean"))).withColumn("content_hash", content)


_KEY = ["norm_url", "ean_digits", "content_hash"]


def _live(cache: DataFrame, now: str) -> DataFrame:
    return cache.where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))


def cached_matches(pairs: DataFrame, cache: DataFrame, now: str) -> DataFrame:
    """page_id, id, match_json of pairs whose match is in the cache and hasn't run out."""
    live = _live(cache, now).select(*_KEY, "match_json")
    return cache_keys(pairs).join(live, _KEY).select("page_id", "id", "match_json")


def incremental(pairs: DataFrame, cache: DataFrame, now: str) -> DataFrame:
    """The pairs that must be read anew: page, code or profile are new to the cache, or their entry has run out."""
    return cache_keys(pairs).join(_live(cache, now).select(_KEY), _KEY, "left_anti")


def refresh_cache(cache: DataFrame, fresh: DataFrame, now: str) -> DataFrame:
    """The cache after new matches (norm_url, ean_digits, content_hash, match_json): they replace all entries of their page and code."""
    at = F.lit(now).cast("timestamp_ntz")
    new = fresh.select(*_KEY, "match_json").withColumn("expires_at", F.timestamp_add("DAY", F.lit(CACHE_DAYS), at))
    kept = cache.select(*_KEY, "match_json", "expires_at").join(fresh.select("norm_url", "ean_digits").distinct(), ["norm_url", "ean_digits"], "left_anti")
    return kept.unionByName(new)


def carry_forward(pages: DataFrame, previous: DataFrame) -> DataFrame:
    """Found offers of unchanged pages, repeated as new observations of their own products.

    The last result must be a find with a price and exact evidence of the code,
    and its address the page's. pages has id, page_id, url, fingerprint; previous
    id, status, matched_url, fingerprint, exact_ean, price_cents, currency,
    in_stock, match_type, confidence.
    """
    was = previous.where((F.col("status") == "found") & F.col("price_cents").isNotNull() & F.col("matched_url").isNotNull() & F.coalesce("exact_ean", F.lit(False)))
    was = was.select("id", norm_url(F.col("matched_url")).alias("norm_url"), "fingerprint", "price_cents", "currency", "in_stock", "match_type", "confidence")
    rows = pages.withColumn("norm_url", norm_url(F.col("url"))).join(was, ["id", "norm_url", "fingerprint"])
    return rows.select(
        "id", "page_id", "norm_url", "price_cents", "currency", "in_stock", F.when(F.col("match_type") == "ean", "ean").otherwise("name").alias("match_type"),
        F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("medium").alias("confidence"), F.lit(304).alias("http_status"),
    )


def best_match(matches: DataFrame) -> DataFrame:
    """The match with the highest score of each product, the first by place of equals."""
    rest = [c for c in matches.columns if c != "id"]
    best = matches.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("place"))).alias("m"))
    return best.select("id", "m.*")


def classify_results(targets: DataFrame, matches: DataFrame, seen: DataFrame) -> DataFrame:
    """id, status, reason_code of each wanted product after its pages were read.

    found by the best match if that is verified. Else, in this order: blocked
    where any page was; under review where nothing was read for known bad pages;
    unavailable where nothing was read and something was out of reach; under review where the best match bears the code, 0.65 of the name or a product
    node (drift, then what the evidence lacks); under review for a drifted
    profile; blocked by robots rules; under review for known bad pages or ones
    that were too large; not found. matches has id, place, score, ean_match,
    structured_ean, structured, name_score, price_cents, profile_id,
    overall_confidence, source_confidence; seen id and outcome: read,
    unavailable, blocked, profile_drift, robots_disallowed, known_bad_pattern or
    response_too_large.
    """
    best = best_match(matches).withColumn("verified", is_verified(F.struct("*")))
    flags = ("read", "unavailable", "blocked", "profile_drift", "robots_disallowed", "known_bad_pattern", "response_too_large")
    was = seen.groupBy("id").agg(*(F.bool_or(F.col("outcome") == f).alias(f"_{f}") for f in flags))
    rows = targets.select("id").join(best, "id", "left").join(was, "id", "left")
    had = {f: F.coalesce(f"_{f}", F.lit(False)) for f in flags}
    likely = F.coalesce(F.col("ean_match") | (F.col("name_score") >= 0.65) | F.col("structured"), F.lit(False))
    lacks = F.when(had["profile_drift"], "profile_drift").when(~F.col("ean_match"), "wrong_product").when(F.col("price_cents").isNull(), "price_missing").otherwise("low_confidence")
    verdict = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason_code"))
    said = (
        F.when(F.coalesce("verified", F.lit(False)), verdict("found", "found"))
        .when(had["blocked"], verdict("blocked", "blocked"))
        .when(had["known_bad_pattern"] & ~had["read"], verdict("needs_review", "known_bad_pattern"))
        .when(had["unavailable"] & ~had["read"], verdict("unavailable", "network_error"))
        .when(likely, verdict("needs_review", lacks))
        .when(had["profile_drift"], verdict("needs_review", "profile_drift"))
        .when(had["robots_disallowed"], verdict("blocked", "robots_disallowed"))
        .when(had["known_bad_pattern"], verdict("needs_review", "known_bad_pattern"))
        .when(had["response_too_large"], verdict("needs_review", "response_too_large"))
        .otherwise(verdict("not_found", "not_found"))
    )
    return rows.select("id", said.alias("v")).select("id", "v.*")


# Kinds of failures that end a scan of a host, that mean an access challenge, and that put a host out of reach.
TERMINAL, CHALLENGED, OUT_OF_REACH = ("blocked", "challenge", "rate_limited", "queue_busy"), ("blocked", "challenge"), ("unavailable", "rate_limited")
#: Kinds of attempts that are no failures of a request.
NO_FAILURE = ("read", "known_bad_pattern", "robots_disallowed", "profile_drift")


def classify_attempts(targets: DataFrame, attempts: DataFrame, matches: DataFrame) -> DataFrame:
    """id, status, reason_code of each wanted product by its attempts in order and what they found.

    attempts has id, place, profile_id (custom-... for a configured route,
    sitemap), kind and reason_code. Kinds are read, the skips known_bad_pattern and robots_disallowed, profile_drift, and failures:
    blocked, challenge, rate_limited, queue_busy, unavailable, timeout,
    http_client_error, response_too_large, refused (an answer that isn't told apart).
    A configured route that failed isn't tried again, and a host's
    terminal failure ends the scan: what comes after them doesn't count.

    The first that holds: a find that is verified; the terminal failure; known
    bad pages and nothing read; a sitemap's page that failed; an answer that
    refuses; a configured route that failed and never loaded; a host out of reach
    and nothing read; a likely page under review; a drifted profile; robots rules; known bad pages; a last
    failure that was too large; not found. matches are those of `classify_results`.
    """
    tried = attempts.withColumn("profile_id", F.coalesce("profile_id", F.lit(""))).withColumn("configured", F.col("profile_id").startswith("custom-")).withColumn("failure", ~F.col("kind").isin(*NO_FAILURE))
    # attempts meet once, by product; all that follows reads them in that place
    route, own = Window.partitionBy("id", "profile_id"), Window.partitionBy("id")
    fails = F.col("configured") & F.col("failure") & (F.col("kind") != "http_client_error")
    tried = tried.repartition("id").withColumn("lost", F.min(F.when(fails, F.col("place"))).over(route)).where(F.col("lost").isNull() | (F.col("place") <= F.col("lost")))
    ends = (F.col("profile_id") != "sitemap") & F.col("kind").isin(*TERMINAL)
    tried = tried.withColumn("stop", F.min(F.when(ends, F.col("place"))).over(own)).where(F.col("stop").isNull() | (F.col("place") <= F.col("stop")))
    told = F.struct("kind", "reason_code")
    first = lambda which: F.min_by(F.when(which, told), F.when(which, F.col("place")))
    any_ = lambda which: F.coalesce(F.bool_or(which), F.lit(False))
    kind = F.col("kind")
    state = tried.groupBy("id").agg(
        any_(kind == "read").alias("read"), any_((kind == "known_bad_pattern")).alias("bad"), any_(kind == "robots_disallowed").alias("robots"), any_(kind == "profile_drift").alias("drift"), any_(kind == "refused").alias("refused"),
        any_(kind.isin(*OUT_OF_REACH)).alias("away"), any_(F.col("configured") & (kind == "read")).alias("loaded"), first(F.col("place") == F.col("stop")).alias("terminal"), first(F.col("failure") & (F.col("profile_id") == "sitemap")).alias("map"),
        first(F.col("configured") & F.col("failure") & (kind != "http_client_error")).alias("route"), F.max_by(F.when(F.col("failure"), kind), F.when(F.col("failure"), F.col("place"))).alias("last"),
    )
    best = best_match(matches).withColumn("verified", is_verified(F.struct("*")))
    rows = targets.select("id").join(best.drop("profile_id"), "id", "left").join(state, "id", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    verdict = lambda status, reason: F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason_code"))
    by_access = lambda c: verdict(F.when(F.col(f"{c}.kind").isin(*CHALLENGED), "blocked").otherwise("unavailable"), F.col(f"{c}.reason_code"))
    route = F.col("route.kind")
    likely = F.coalesce(F.col("ean_match") | (F.col("name_score") >= 0.65) | F.col("structured"), F.lit(False))
    lacks = F.when(is_("drift"), "profile_drift").when(~F.col("ean_match"), "wrong_product").when(F.col("price_cents").isNull(), "price_missing").otherwise("low_confidence")
    said = (
        F.when(is_("verified"), verdict("found", "found"))
        .when(F.col("terminal").isNotNull(), by_access("terminal"))
        .when(is_("bad") & ~is_("read"), verdict("needs_review", "known_bad_pattern"))
        .when(F.col("map").isNotNull(), by_access("map"))
        .when(is_("refused"), verdict("blocked", "blocked"))
        .when(F.col("route").isNotNull() & ~is_("loaded"), verdict(F.when(route.isin("timeout", *OUT_OF_REACH), "unavailable").when(route == "response_too_large", "needs_review").otherwise("blocked"), F.when(route.isin("timeout", "response_too_large"), route).otherwise(F.col("route.reason_code"))))
        .when(is_("away") & ~is_("read"), verdict("unavailable", "network_error"))
        .when(likely, verdict("needs_review", lacks))
        .when(is_("drift"), verdict("needs_review", "profile_drift"))
        .when(is_("robots"), verdict("blocked", "robots_disallowed"))
        .when(is_("bad"), verdict("needs_review", "known_bad_pattern"))
        .when(F.col("last") == "response_too_large", verdict("needs_review", "response_too_large"))
        .otherwise(verdict("not_found", "not_found"))
    )
    return rows.select("id", said.alias("v")).select("id", "v.*")
