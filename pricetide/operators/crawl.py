"""What to crawl and how: search addresses, budgets, sitemap finds, discovered stores, the plan, and profile health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.scalars import commerce_platform, digits, host, is_public_host, selector_suggestions, without_fragment
from pricetide.operators.policy import drop_non_store, meet_all, suffix_join

# Budgets by type of site (timeout in ms, bytes of a page, retries), their clamps, and hosts of a known type.
BUDGETS = {"standard": (8_000, 2_097_152, 2), "slow": (16_000, 3_145_728, 2), "large": (12_000, 5_242_880, 1), "javascript": (10_000, 3_145_728, 1), "marketplace": (14_000, 4_194_304, 1)}
CLAMPS = {"timeout_ms": (3_000, 30_000), "max_page_bytes": (256_000, 8_388_608), "retry_budget": (0, 4)}
LARGE = r"(?i)(^|\.)(amazon\.|ebay\.|walmart\.|aliexpress\.)"
SLOW = r"(?i)(^|\.)(amazon\.|ebay\.|etsy\.com$|aliexpress\.|temu\.)"
# Search routes of known hosts and platforms, and those that are tried where nothing is known.
HOST_ROUTES = ((r"(?i)(^|\.)trgovinejager\.com$", "/iskalnik/?isci={query}"), (r"(?i)(^|\.)amazon\.[a-z.]+$", "/s?k={query}"), (r"(?i)(^|\.)ebay\.[a-z.]+$", "/sch/i.html?_nkw={query}"), (r"(?i)(^|\.)etsy\.com$", "/search?q={query}"))
PLATFORM_ROUTES = (
    ("shopify", "/search?type=product&q={query}"),
    ("shopify", "/search?q={query}"),
    ("magento", "/catalogsearch/result/?q={query}"),
    ("woocommerce", "/?s={query}&post_type=product"),
    ("prestashop", "/search?controller=search&s={query}"),
    ("bigcommerce", "/search.php?search_query={query}"),
    ("shopware", "/search?search={query}"),
    ("opencart", "/index.php?route=product/search&search={query}"),
    ("vtex", "/{query}?_q={query}&map=ft"),
    ("vtex", "/busca?ft={query}"),
    ("wix-stores", "/search-results?q={query}"),
    ("squarespace-commerce", "/search?query={query}"),
)
#: Hosts whose own route leaves none to be guessed.
OWN_ROUTE_ONLY = r"(?i)(^|\.)trgovinejager\.com$"
#: Lengths of the codes that a sitemap's addresses are searched for.
CODE_LENGTHS = (8, 12, 13, 14)
GENERIC_ROUTES = ("/search?q={query}", "/search?query={query}", "/search?search={query}", "/?s={query}")


def budgets(hosts: DataFrame, settings: DataFrame) -> DataFrame:
    """host, site_type, timeout_ms, max_page_bytes, retry_budget: a host's own settings within their clamps, else those of its type.

    settings has host, site_type ("auto" or null: inferred), rendered and the three figures, all nullable, one row a host.
    """
    rows = hosts.select("host").join(settings, "host", "left")
    inferred = F.when(F.coalesce("rendered", F.lit(False)), "javascript").when(F.col("host").rlike(LARGE), "large").when(F.col("host").rlike(SLOW), "slow").otherwise("standard")
    rows = rows.withColumn("site_type", F.coalesce(F.nullif("site_type", F.lit("auto")), inferred))

    def figure(place: int, name: str) -> Column:
        base = F.lit(None).cast("long")
        for kind, values in BUDGETS.items():
            base = F.when(F.col("site_type") == kind, values[place]).otherwise(base)
        low, high = CLAMPS[name]
        own = F.when(F.col(name).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col(name))))
        return F.coalesce(own, base).cast("long").alias(name)

    return rows.select("host", "site_type", *(figure(k, name) for k, name in enumerate(CLAMPS)))


def _form_urls(forms: DataFrame, queries: DataFrame) -> DataFrame:
    """site, url, order, profile of forms sent with each query of their site.

    The action's own parameters come first, then hidden fields that it doesn't
    name, then the query, in whose place the action's own value goes.
    """
    name = lambda pair: F.regexp_extract(pair, "^([^=]*)", 1)
    own = F.filter(F.split(F.regexp_extract("action", r"\?([^#]*)", 1), "&"), lambda p: (p != "") & (name(p) != F.col("field")))
    fixed = F.filter(F.split("hidden", ",(?=[^,=]+=)"), lambda p: p.rlike("^[^=]+=."))
    encoded = lambda p: F.concat(F.url_encode(name(p)), F.lit("="), F.url_encode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)))
    more = lambda p: ~F.exists(own, lambda o: name(o) == name(p))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("place"))
    rows = forms.select("site", F.regexp_extract("action", "^([^?#]*)", 1).alias("base"), "field", F.concat(own, F.transform(F.filter(fixed, more), encoded)).alias("params"), rank.alias("rank"))
    asked = F.concat(F.url_encode("field"), F.lit("="), F.url_encode("query"))
    url = F.concat("base", F.lit("?"), F.array_join(F.concat("params", F.array(asked)), "&"))
    return rows.join(queries.select("site", "query"), "site").select("site", url.alias("url"), (F.col("rank") + 50).alias("order"), F.concat(F.lit("form-"), F.col("rank").cast("string")).alias("profile"))


def search_candidates(sites: DataFrame, queries: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """site, url, profile: search addresses of every site for its own queries, each once, under the first profile that gives it.

    sites has site, host, root and, nullable, template (its owner's own route,
    tried first, in whose place none is guessed) and platform; queries has site
    and query. Routes are an array beside the row, so the only join is on site.
    forms, if given, has site and what `pages.search_forms` finds on the site's
    page; their addresses come before guessed ones.
    """

    def route(order: int, profile: str, template, when: Column) -> Column:
        made = F.struct(F.lit(order).alias("order"), F.lit(profile).alias("profile"), (template if isinstance(template, Column) else F.lit(template)).alias("template"))
        return F.when(when, made)

    routes = [route(0, "custom", F.col("template"), F.col("template").isNotNull())]
    routes += [route(1 + k, "host", t, F.col("host").rlike(p)) for k, (p, t) in enumerate(HOST_ROUTES)]
    routes += [route(10 + k, p, t, F.coalesce(F.col("platform") == p, F.lit(False))) for k, (p, t) in enumerate(PLATFORM_ROUTES)]
    routes += [route(100 + k, "generic", t, F.col("template").isNull() & ~F.col("host").rlike(OWN_ROUTE_ONLY)) for k, t in enumerate(GENERIC_ROUTES)]
    rows = sites.select("site", "root", F.explode(F.array_compact(F.array(*routes))).alias("r")).join(queries.select("site", "query"), "site")
    text = F.replace(F.url_encode("query"), F.lit("+"), F.lit("%20"))
    rows = rows.select("site", F.concat(F.regexp_replace("root", "/$", ""), F.replace("r.template", F.lit("{query}"), text)).alias("url"), "r.order", "r.profile")
    if forms is not None:
        rows = rows.unionByName(_form_urls(forms, queries))
    return rows.groupBy("site", "url").agg(F.min_by("profile", "order").alias("profile"))


def plan(candidates: DataFrame, allowed: DataFrame, known_bad: DataFrame, access: DataFrame, cooldowns: DataFrame, now: str) -> DataFrame:
    """host, url, reason: null where a candidate may be fetched, else the first reason against it.

    allowed is the outcome of robots rules by host and url, known_bad the urls
    that an exclusion rule meets, access by host, cooldowns host and until.
    """
    until = cooldowns.groupBy("host").agg(F.max("until").alias("_until"))
    rows = (
        candidates.select("host", "url")
        .join(access.select("host", F.col("access").alias("_access")), "host", "left")
        .join(until, "host", "left")
        .join(known_bad.select("url").distinct().withColumn("_bad", F.lit(True)), "url", "left")
        .join(allowed.select("host", "url", F.col("allowed").alias("_allowed")), ["host", "url"], "left")
    )
    reason = (
        F.when(F.col("_access") == "blocked", "blocked")
        .when(F.col("_until") > F.lit(now).cast("timestamp_ntz"), "cooldown")
        .when(F.col("_bad"), "known_bad_pattern")
        .when(~F.col("_allowed"), "robots_disallowed")
    )
    return rows.select("host", "url", reason.alias("reason"))


def sitemap_match(locations: DataFrame, targets: DataFrame) -> DataFrame:
    """id, url, score: the one best sitemap location of each wanted product; none where two are equally good.

    A location whose path holds the product's code scores 1000; one that holds
    all model words of its name (letters and digits, six or more characters)
    900 and one for each. Equal scores go to the later lastmod. Codes meet the
    digit windows of a path, model words the words of a path, both as tokens of
    one equi-join with the host, so that a host's products never meet all its
    locations. Only what can be met is a token: windows as long as some product's
    code, words with letters and digits. What was met moves once, by product.
    locations has host, url, lastmod; targets id, host, ean, name.
    """
    path = F.lower(F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1))
    model = lambda words: F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 6) & w.rlike("[a-z]") & w.rlike("[0-9]")))
    words = lambda text: model(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "))
    code = digits(F.col("ean"))
    lengths = targets.select(F.length(code).alias("n")).agg(F.collect_set(F.when(F.col("n").isin(*CODE_LENGTHS), F.col("n"))).alias("lengths"))

    places = locations.select("host", "url", F.coalesce(F.unix_seconds(F.try_to_timestamp("lastmod")), F.lit(0)).alias("at")).crossJoin(F.broadcast(lengths))
    runs = F.regexp_extract_all(F.regexp_replace(path, "[^a-z0-9]+", ""), F.lit("[0-9]{8,}"), 0)
    fits = lambda run: F.filter("lengths", lambda n: n <= F.length(run))
    windows = F.flatten(F.transform(runs, lambda run: F.flatten(F.transform(fits(run), lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda k: F.substr(run, k, n))))))
    # outer, as an inner explode would compute the tokens once more for the filter that Spark infers; null meets nothing
    offered = places.select("host", "url", "at", F.explode_outer(F.array_distinct(F.concat(windows, words(path)))).alias("token"))
    wanted = targets.where("id IS NOT NULL").select("id", "host", words(F.lower("name")).alias("model"), F.array_compact(F.array(F.when(F.length(code).isin(*CODE_LENGTHS), code))).alias("code"))
    wanted = wanted.select("id", "host", F.greatest(F.size("model"), F.lit(0)).alias("n"), F.explode_outer(F.concat(F.coalesce("code", F.array().cast("array<string>")), F.coalesce("model", F.array().cast("array<string>")))).alias("token"))

    met = offered.join(wanted, ["host", "token"]).select("id", "url", "at", "n", "token").repartition("id").distinct()
    worded = F.count_if(F.col("token").rlike("[a-z]"))
    score = F.greatest(F.when(F.count("*") > worded, 1000).otherwise(0), F.when(worded == F.col("n"), 900 + F.col("n")).otherwise(0))
    one = met.groupBy("id", "url", "at", "n").agg(score.alias("score")).where("score > 0").select("id", "url", "score", "at").distinct()
    equal = one.groupBy("id", "score", "at").agg(F.count("*").alias("equal"), F.min("url").alias("url"))
    best = equal.groupBy("id").agg(F.max(F.struct("score", "at", "equal", "url")).alias("b"))
    return best.where("b.equal = 1").select("id", "b.url", "b.score")


def sitemap_documents(docs: DataFrame, most: int = 3) -> DataFrame:
    """host, sitemap, priority, turn: the `most` sitemap documents of each host to read first.

    An address whose path speaks of products counts 100, of a product 20, of an
    index 5; of equals the first stays. docs has host, place and sitemap.
    """
    path = F.lower(F.regexp_extract("sitemap", r"^[^:]+://[^/?#]*([^?#]*)", 1))
    score = sum((F.when(F.contains(path, F.lit(word)), n).otherwise(0) for word, n in (("products", 100), ("product", 20), ("index", 5))), F.lit(0))
    one = docs.groupBy("host", "sitemap").agg(F.min("place").alias("place")).withColumn("priority", score)
    w = Window.partitionBy("host").orderBy(F.desc("priority"), "place", "sitemap")
    return one.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most).select("host", "sitemap", "priority", "turn")


def discovered_stores(urls: DataFrame, most: int | None = None) -> DataFrame:
    """host, url (the store's root), product_url: the first address of each public store, of the first `most` stores if given; urls has place and url."""
    named = urls.where(F.col("url").rlike("(?i)^https?://[^/@?#]+([/?#]|$)")).withColumn("host", host(F.col("url")))
    ok = drop_non_store(named.where(is_public_host(F.col("host"))))
    first = ok.groupBy("host").agg(F.min_by("url", F.struct("place", "url")).alias("u"), F.min("place").alias("place"))
    if most is not None:
        first = first.orderBy("place", "host").limit(most)
    return first.select("host", F.concat(F.lower(F.regexp_extract("u", "(?i)^(https?://[^/?#]+)", 1)), F.lit("/")).alias("url"), without_fragment(F.col("u")).alias("product_url"))


def profile_health_update(profiles: DataFrame, results: DataFrame) -> DataFrame:
    """Profiles after the latest result of each: score, status, last found, and off at 20 or less or when drifted.

    results has profile_id, id, at, status, and, nullable, score and drift_status.
    """
    latest = results.groupBy("profile_id").agg(F.max_by(F.struct("at", "status", "score", "drift_status"), F.struct("at", "id")).alias("r"))
    rows = profiles.join(latest, profiles["id"] == latest["profile_id"], "left")
    found, met = F.col("r.status") == "found", F.col("r").isNotNull()
    score = F.coalesce("r.score", F.when(found, 100).otherwise(40))
    status = F.coalesce("r.drift_status", F.when(found, "healthy").otherwise("degraded"))
    off = (score <= 20) | (status == "drifted")
    return rows.select(
        "id",
        F.when(met, score).otherwise(F.col("health_score")).alias("health_score"),
        F.when(met, status).otherwise(F.col("drift_status")).alias("drift_status"),
        F.when(met & found, F.col("r.at")).otherwise(F.col("last_working_at")).alias("last_working_at"),
        (F.col("enabled") & ~F.coalesce(met & off, F.lit(False))).alias("enabled"),
    )


def profile_drift(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """page_id, profile_id, drifted, platform, suggestions of pages of a profile's host.

    A page drifted if it lacks the signature that the profile expects, in either
    case of letters. Suggestions are selectors of the page that the profile lacks.
    profiles has id, host, signature and, nullable, the three selectors.
    """
    own = [F.col(c) if c in profiles.columns else F.lit(None).cast("string").alias(c) for c in ("product_selector", "ean_selector", "price_selector")]
    rules = profiles.select(F.col("id").alias("profile_id"), "host", "signature", F.array(*own).alias("_own"))
    rows = pages.withColumn("host", host(F.col("url"))).join(rules, "host")
    lacks = ~F.coalesce(F.contains(F.lower("html"), F.lower("signature")), F.lit(True))
    return rows.select("page_id", "profile_id", lacks.alias("drifted"), commerce_platform(F.col("html")).alias("platform"), F.array_join(F.array_except(selector_suggestions(F.col("html")), "_own"), ",").alias("suggestions"))


def resolve_profile(pages: DataFrame, profiles: DataFrame, built_in: DataFrame) -> DataFrame:
    """page_id, profile_id, price_selector, block_patterns: what a page is read with; pages that nothing fits are left out.

    A custom profile fits by host (its store family) and signature, where it
    names them; the first by place counts. A built-in one fits by its host
    pattern or its html pattern. The custom one's fields come before the
    built-in's, and both lists of block patterns are joined. profiles has id,
    place, host, signature, price_selector, block_patterns (array); built_in id,
    place, host_pattern, html_pattern, price_selector, block_patterns. Profiles
    without a host and built-in ones are few, and meet every page (`meet_all`).
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), F.lower("html").alias("low"), "html")
    fields = lambda: F.struct("place", F.col("rule.id").alias("id"), F.col("rule.price_selector").alias("price_selector"), F.col("rule.block_patterns").alias("block_patterns"))
    rule = lambda df: df.withColumn("rule", F.struct("id", "price_selector", "block_patterns"))
    custom = rule(profiles).select("place", F.col("host").alias("_host"), F.lower("signature").alias("_signature"), "rule")
    met = suffix_join(rows.select("page_id", "host"), custom.where("_host IS NOT NULL").select("_host").distinct(), "host", "_host").select("page_id", "_host")
    hosted = rows.join(met.join(custom, "_host"), "page_id").select("page_id", "low", "place", "_signature", "rule")
    anywhere = meet_all(rows.select("page_id", "low"), "page_id", custom.where("_host IS NULL").select("place", "_signature", "rule")).select("page_id", "low", "place", "_signature", "rule")
    fits = hosted.unionByName(anywhere).where(F.coalesce(F.contains("low", "_signature"), F.lit(True)))
    own = fits.groupBy("page_id").agg(F.min_by(fields(), "place").alias("c"))
    known = meet_all(rows.select("page_id", "host", "html"), "page_id", rule(built_in).select("place", "host_pattern", "html_pattern", "rule"))
    known = known.where(F.coalesce(F.regexp_like("host", "host_pattern"), F.lit(False)) | F.coalesce(F.regexp_like("html", "html_pattern"), F.lit(False)))
    base = known.groupBy("page_id").agg(F.min_by(fields(), "place").alias("b"))
    none = F.array().cast("array<string>")
    blocks = F.array_union(F.coalesce("b.block_patterns", none), F.coalesce("c.block_patterns", none))
    both = own.join(base, "page_id", "full")
    return both.select("page_id", F.coalesce(F.concat(F.lit("custom-"), "c.id"), "b.id").alias("profile_id"), F.coalesce("c.price_selector", "b.price_selector").alias("price_selector"), F.array_join(blocks, ",").alias("block_patterns"))
