"""Crawl policy: hosts, robots rules, sitemaps, exclusion rules and the plan of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.scalars import host, narrowed, resolve_url, without_fragment
from pricetide.operators.elements import decoded

# Sites that sell nothing themselves.
NON_STORES = r"(^|\.)(google|bing|yahoo|duckduckgo|facebook|instagram|youtube|tiktok|pinterest|twitter|x|linkedin|reddit|wikipedia|wikidata)\.[a-z.]+$"
MOST_PATTERN, MOST_STARS = 300, 8


def suffixes(h: Column) -> Column:
    """A host and every parent of it with at least two labels."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))


def suffix_join(left: DataFrame, right: DataFrame, left_host: str, right_host: str, both_ways: bool = True) -> DataFrame:
    """Rows whose hosts are equal or, as whole labels, one the end of the other; an equi-join on exploded suffixes."""
    up = left.withColumn("_s", F.explode(suffixes(F.col(left_host)))).join(right, F.col("_s") == F.col(right_host)).drop("_s")
    if not both_ways:
        return up
    down = right.withColumn("_s", F.explode(suffixes(F.col(right_host)))).where(F.col("_s") != F.col(right_host)).join(left, F.col("_s") == F.col(left_host)).drop("_s")
    return up.unionByName(down)


def robots_rules(docs: DataFrame, agent: str) -> DataFrame:
    """host, allow, path: the rules of the most specific group that speaks to the agent; docs has host and text.

    Lines that name agents open a group together; a group of none but agents has
    no rules. Among groups the longest agent that the given one contains wins, * last.
    """
    lines = docs.select("host", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    clean = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    pairs = clean.select("host", "at", F.lower(F.trim(F.regexp_extract("line", "^([^:]+):", 1))).alias("k"), F.trim(F.regexp_extract("line", "^[^:]+:(.*)$", 1)).alias("v")).where(F.col("k").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("at")
    opens = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    grouped = pairs.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(w))
    name = F.lower(F.col("v"))
    fit = F.when(name == "*", 0).when((name != "") & F.lit(agent.lower()).contains(name), F.length(name))
    agents = grouped.where("k = 'user-agent'").groupBy("host", "group").agg(F.max(fit).alias("fit")).where("fit IS NOT NULL")
    best = agents.withColumn("top", F.max("fit").over(Window.partitionBy("host"))).where("fit = top").select("host", "group")
    return grouped.where("k != 'user-agent'").join(best, ["host", "group"]).where("v != ''").select("host", (F.col("k") == "allow").alias("allow"), F.col("v").alias("path")).distinct()


def path_pattern(path: Column) -> Column:
    """The regular expression of a robots path: * for anything, a final $ for the end."""
    quoted = F.regexp_replace(path, r"([.+?^{}()|\[\]\\])", r"\\$1")
    ended = F.regexp_replace(quoted, r"\$$", "<end>")
    starred = F.regexp_replace(F.regexp_replace(ended, r"\$", r"\\\$"), r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(starred, "<end>$", r"\$"))


def robots_allows(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, allowed: the longest matching path decides, allow on ties; no match allows. urls has url and host."""
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[^:]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    met = urls.withColumn("_path", path).join(rules.withColumnRenamed("path", "_rule"), "host").where(F.regexp_like("_path", path_pattern(F.col("_rule"))))
    verdict = met.groupBy("host", "url").agg(F.max_by("allow", F.struct(F.length("_rule"), "allow")).alias("allowed"))
    return urls.join(verdict, ["host", "url"], "left").select("host", "url", F.coalesce("allowed", F.lit(True)).alias("allowed"))


def robots_sitemaps(docs: DataFrame) -> DataFrame:
    named = F.regexp_extract_all("text", F.lit(r"(?im)^\s*sitemap:\s*(\S+)\s*$"), 1)
    fallback = F.array(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")), F.concat(F.lit("https://"), "host", F.lit("/sitemap_index.xml")))
    return docs.select("host", F.explode(F.when(F.size(named) > 0, named).otherwise(fallback)).alias("sitemap")).distinct()


def sitemap_locations(docs: DataFrame) -> DataFrame:
    """host, url, lastmod of sitemap documents and indexes, the first of equals. docs has host and xml.

    Entries are url or sitemap tags, with attributes or not. Addresses are decoded and
    resolved against the host; they stay on it (www. aside), without credentials, port, query and fragment.
    """
    blocks = docs.select("host", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<(?:url|sitemap)\b[^>]*>(.*?)</(?:url|sitemap)>"), 1)).alias("at", "b"))
    inside = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("b", rf"(?is)<{tag}\b[^>]*>\s*(.*?)\s*</{tag}>", 1), r"(?s)^<!\[CDATA\[\s*(.*?)\s*\]\]>$", "$1")), F.lit(""))
    rows = blocks.select("host", "at", decoded(inside("loc")).alias("loc"), inside("lastmod").alias("lastmod"))
    rows = narrowed(rows, F.struct(resolve_url(F.col("loc"), F.concat(F.lit("https://"), "host", F.lit("/"))).alias("url")), lambda x: x["url"].isNotNull())
    fit = (host(F.col("url")) == F.col("host")) & ~F.col("loc").rlike("[?#]") & ~F.col("url").rlike(r"^[a-z]+://([^/]*@|[^/]*:[0-9])")
    return rows.where(fit).groupBy("host", "url").agg(F.min_by("lastmod", "at").alias("lastmod"))


def access(hosts: DataFrame, policies: DataFrame, blocked: DataFrame, allowed: DataFrame) -> DataFrame:
    """host, access: blocked by its stored policy or by a list, or, if an allow list has rows, for not being on it. Lists hold parents too."""
    on = lambda rows, name: suffix_join(hosts, rows.select(F.col("host").alias("_l")), "host", "_l", False).select("host").distinct().withColumn(name, F.lit(True))
    joined = hosts.join(on(blocked, "_b"), "host", "left").join(on(allowed, "_a"), "host", "left").join(policies.select("host", "mode"), "host", "left")
    some = allowed.agg((F.count("*") > 0).alias("_some"))
    rows = joined.join(F.broadcast(some))
    bad = F.coalesce(F.col("mode") == "block", F.lit(False)) | F.col("_b").isNotNull() | (F.col("_some") & F.col("_a").isNull())
    return rows.select("host", F.when(bad, "blocked").otherwise("allowed").alias("access"))


def wildcard(pattern: Column) -> Column:
    """The regular expression of a pattern in which * stands for anything, in either case."""
    return F.concat(F.lit("(?is)"), F.regexp_replace(F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"))


def live_rules(rules: DataFrame, now: str) -> DataFrame:
    """Rules that are on and haven't run out."""
    return rules.where(F.col("enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))))


#: Parts that rows are dealt over where they all meet the same few rules.
PARTS = 64


def meet_all(rows: DataFrame, by: str, rules: DataFrame, parts: int = PARTS) -> DataFrame:
    """Every row beside every rule that holds for all hosts; such rules are few.

    Spark broadcasts the rules if their size is under its limit; else rows are
    dealt over `parts` by a hash of `by`, and each part gets a copy of the rules.
    """
    copies = rules.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).join(copies, "_part").drop("_part")


def known_bad(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, rule_id: the first rule by id whose host, address and content patterns a page meets; missing ones meet all. Give it `live_rules`."""
    own = suffix_join(pages, rules.withColumnRenamed("host", "rule_host"), "host", "rule_host", False)
    star = meet_all(pages, "page_id", rules.where("host = '*'").withColumnRenamed("host", "rule_host"))
    meets = lambda text, pattern: F.col(pattern).isNull() | F.regexp_like(F.col(text), wildcard(F.col(pattern)))
    both = own.unionByName(star).where(meets("url", "url_pattern") & meets("html", "content_pattern"))
    return both.groupBy("page_id").agg(F.min("id").alias("rule_id"))


def validate_rules(rules: DataFrame) -> DataFrame:
    """Errors of exclusion rules: a rule needs a pattern, at most 300 characters and eight stars long."""
    pattern = F.concat_ws("", "url_pattern", "content_pattern")
    stars = F.length(pattern) - F.length(F.replace(pattern, F.lit("*"), F.lit("")))
    errors = F.array_compact(F.array(F.when(pattern == "", "pattern"), F.when(F.length(pattern) > MOST_PATTERN, "length"), F.when(stars > MOST_STARS, "stars")))
    return rules.select("id", F.array_join(errors, ",").alias("errors"))


def drop_non_store(df: DataFrame, column: str = "host") -> DataFrame:
    return df.where(~F.col(column).rlike(NON_STORES))


def same_store_urls(urls: DataFrame, n: int) -> DataFrame:
    """site, url: the first n distinct addresses of a site's own store family; urls has site, place and url."""
    h = host(F.col("url"))
    same = (h == F.col("site")) | h.endswith(F.concat(F.lit("."), F.col("site"))) | F.col("site").endswith(F.concat(F.lit("."), h))
    ok = urls.where(F.col("url").rlike("(?i)^https?://") & same).withColumn("url", without_fragment(F.col("url")))
    first = ok.groupBy("site", "url").agg(F.min("place").alias("place"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("place", "url"))).where(F.col("n") <= n).select("site", "url")
