"""Links of pages: what a reader sees of a page, links kept from readers, and the links that likely lead to a product."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import plain as P
from pricetide.functions.scalars import host, narrowed, norm_url, resolve_url, same_store
from pricetide.operators.elements import passed
from pricetide.operators.pages import ranked_data_urls
from pricetide.sources.sinks import cut

# Elements without an end tag, and class names that hide.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDING = frozenset("hidden d-none is-hidden visually-hidden sr-only offscreen honeypot bot-trap".split())
#: How far off the page, in any unit, an element is out of sight; how much of each side an inset must cut to leave nothing.
FAR, HALF = -100, 50
TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-z][\w:-]*)\b(?P<rest>[^>]*)>", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Names of the attributes that can hide an element.
TELLING = re.compile(r"(?<![\w:-])(?:hidden|inert|aria-hidden|style|class|id)(?![\w:-])", re.IGNORECASE)
SILENT = re.compile(r"<(script|style)\b[^>]*>.*?</\1>", re.IGNORECASE | re.DOTALL)
SHEET = re.compile(r"<style\b[^>]*>(.*?)</style>", re.IGNORECASE | re.DOTALL)
NUMBER = re.compile(r"-?\d*\.?\d+")


def numbers(value: str) -> list[float]:
    return [float(n) for n in NUMBER.findall(value)]


@lru_cache(maxsize=4096)
def unseen(style: str) -> bool:
    """Whether declarations keep an element out of sight; each property is judged by its own value."""
    said = {name.strip(): value.replace("!important", "").strip() for name, _, value in (d.partition(":") for d in style.lower().split(";"))}
    zero = lambda name: bool(n := numbers(said.get(name, ""))) and not any(n)
    away = any(min(numbers(said.get(side, "")), default=0) <= FAR for side in ("left", "top"))
    cut = any("inset" in (v := said.get(name, "")) and "%" in v and min(numbers(v), default=0) >= HALF for name in ("clip", "clip-path"))
    gone = said.get("display") == "none" or said.get("visibility") in ("hidden", "collapse")
    return gone or zero("opacity") or (zero("width") and zero("height")) or away or cut or ("rect" in said.get("clip", "") and zero("clip"))


def elements(page: str) -> list[list]:
    """[name, attributes as text, start, end] of every element by its start.

    An element that is never closed ends where the one around it does.
    """
    found: list[list] = []
    open_: list[int] = []
    for tag in TAG.finditer(page):
        closing, name, rest = tag.groups()
        name = name.lower()
        if closing:
            depth = len(open_) - 1
            while depth >= 0 and found[open_[depth]][0] != name:
                depth -= 1
            if depth >= 0:
                for k in open_[depth:]:
                    found[k][3] = tag.end()
                del open_[depth:]
            continue
        found.append([name, rest, tag.start(), len(page)])
        if name in VOID or rest.rstrip().endswith("/"):
            found[-1][3] = tag.end()
        else:
            open_.append(len(found) - 1)
    return found


def shown_html(html: str) -> str:
    """A page without scripts, styles and all elements that are hidden themselves or lie in a hidden one.

    Hidden are elements by attribute, by a class name that says so, by their own
    style, or by a style sheet's rule for their class or id.
    """
    rules = (rule for sheet in SHEET.findall(html) for rule in re.findall(r"([^{}]+)\{([^{}]+)\}", sheet))
    named = {n for names, body in rules if unseen(body) for n in re.findall(r"[.#][\w-]+", names)}

    def hidden(rest: str) -> bool:
        if not TELLING.search(rest):
            return False
        have = {a.lower(): v.strip("\"'") for a, v in ATTRIBUTE.findall(rest)}
        classes = have.get("class", "").split()
        marks = {"#" + have.get("id", ""), *("." + c for c in classes)}
        return bool({"hidden", "inert"} & have.keys() or marks & named or HIDING & {c.lower() for c in classes}) or have.get("aria-hidden", "").lower() == "true" or "style" in have and unseen(have["style"])

    page = SILENT.sub(" ", html)
    parts, at = [], 0
    for _, rest, start, end in elements(page):
        if start >= at and hidden(rest):
            parts.append(page[at:start])
            at = end
    return "".join(parts) + page[at:]


#: Pages that are Python objects at a time; the rest of a batch stays in Arrow's memory.
AT_A_TIME = 64


def shown_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """`shown_html` of batches of pages, in parts: only a few pages of a batch are texts of Python at a time, and what is made of them goes on at once."""
    for pages in batches:
        for k in range(0, len(pages), AT_A_TIME):
            yield pa.array([None if p is None else shown_html(p) for p in pages.slice(k, AT_A_TIME).to_pylist()], pa.string())


def shown(html: Column) -> Column:
    """`shown_html` of a column; null stays null."""
    return F.arrow_udf(shown_parts, "string")(html)


def anchors(html: Column) -> Column:
    """Addresses of anchors and articles, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<(?:a|article)\b[^>]*?(?:href|data-product-url)=["']([^"']+)["'][^>]*>"""), 1)


def hidden_links(pages: DataFrame) -> DataFrame:
    """page_id, link: addresses that a page links only where readers don't see them, each once."""
    both = pages.select("page_id", anchors(F.col("html")).alias("all"), shown(F.col("html")).alias("seen"))
    # outer, as Spark would put a filter before an inner explode that reads the anchors once more; addresses are never null
    return both.select("page_id", F.explode_outer(F.array_except("all", anchors(F.col("seen")))).alias("link")).where("link IS NOT NULL")


_BLOCK = P.pattern(r"""(?is)<(a|article)\b[^>]*?(?:href|data-product-url)=["'][^"']+["'][^>]*>.*?</\1>""")
_LINK, _CANONICAL, _HREF = P.pattern(r"(?is)<link\b[^>]*>"), P.pattern(r"""(?is)\srel=["'][^"']*canonical"""), P.pattern(r"""(?is)(?:href|data-product-url)=["']([^"']+)""")


def anchors_of(html: str | None) -> list[tuple]:
    """place, href, canonical, says: a page's first canonical address, then its anchors and articles, with their texts in small letters."""
    if html is None:
        return []
    first = next((m[0] for m in _LINK.finditer(html) if _CANONICAL.search(m[0])), None)
    tags = ([] if first is None else [(first, True)]) + [(m[0], False) for m in _BLOCK.finditer(html)]
    return [(place, P.decoded(m[1]) if (m := _HREF.search(tag)) else "", canonical, P.visible(tag).lower()) for place, (tag, canonical) in enumerate(tags)]


def shown_anchors(html: str | None) -> list[tuple]:
    """`anchors_of` what readers see of a page."""
    return anchors_of(None if html is None else shown_html(html))


def likely_links(pairs: DataFrame, most: int = 8) -> DataFrame:
    """page_id, link, score, n: the shown links of a page's store, its family of hosts, that likely lead to the wanted product.

    A canonical address scores 30. An anchor scores 20 for the product's code in
    its path or label, one for each word of the name of three or more letters,
    and 4 for a product's route or 2 for an offer's; those without a score go.
    Of equal addresses the best score stays. pairs has page_id, url, html, ean, name.
    """
    return _likely(pairs, most, shown_anchors)


def _likely(page: DataFrame, most: int, read: Callable[[str | None], list[tuple]] = anchors_of) -> DataFrame:
    """`likely_links` of pages whose html is what readers see, or of which `read` looks at that alone."""
    tags = passed(page, ["page_id", "ean", "name", "url"], ["html"], read, "place int, href string, canonical boolean, says string")
    rows = narrowed(tags, F.struct(resolve_url(F.col("href"), F.col("url")).alias("link")), lambda x: x["link"].isNotNull())
    rows = rows.where(same_store(host(F.col("link")), host(F.col("url"))))
    path = F.lower(F.regexp_extract("link", r"^https?://[^/?#]+([^?#]*)", 1))
    text = F.concat(path, F.lit(" "), F.col("says"))
    said = F.col("text")
    words = F.filter(F.split(F.lower("name"), r"\s+"), lambda w: F.length(w) > 2)
    hits = F.size(F.filter(words, lambda w: said.contains(w)))
    route = F.when(F.col("path").rlike("/(products?|items?|p|dp|catalog)/"), 4).when(F.lower(F.regexp_extract("link", r"^https?://[^/?#]+([^#]*)", 1)).rlike("variant|offer|discount|sale"), 2).otherwise(0)
    score = F.when(F.col("canonical"), 30).otherwise(F.when(said.contains(F.col("ean")), 20).otherwise(0) + hits + route)
    rows = narrowed(rows, F.struct(path.alias("path"), text.alias("text")), lambda x: F.lit(True))
    scored = narrowed(rows.select("page_id", "place", "canonical", "link", "ean", "name", "path", "text"), F.struct(score.alias("score")), lambda x: x["score"] > 0)
    # dealt by page, rows move once for both what follows
    best = scored.select("page_id", "link", "score", "place").repartition("page_id").groupBy("page_id", "link").agg(F.max("score").alias("score"), F.min("place").alias("place"))
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "place", "link")
    return best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("page_id", "link", "score", "n")


def link_frontier(pairs: DataFrame, per_page: int = 8, per_target: int = 24) -> DataFrame:
    """id, link, score, turn: the pages to read next for each wanted product, the first `per_target` of its pages' likely links.

    Pages go by page_id, a page's links by their rank; of equal addresses the
    first counts. pairs has id besides what `likely_links` needs, and one id a page.
    """
    found = likely_links(pairs, per_page).join(pairs.select("page_id", "id"), "page_id")
    first = found.groupBy("id", "link").agg(F.min(F.struct("page_id", "n", "score")).alias("f")).select("id", "link", "f.*")
    order = Window.partitionBy("id").orderBy("page_id", "n", "link")
    return first.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= per_target).select("id", "link", "score", "turn")


# Pages that a scan reads of a store, addresses that its queue takes, and links and data addresses of one page.
MOST_PAGES, MOST_QUEUED, PER_PAGE, DATA_PER_PAGE = 8, 24, 8, 3
#: Pages and products of one part of a walk; few of them come in two parts a core.
PER_PART = 20_000


def walk(targets: DataFrame, pages: DataFrame, starts: DataFrame | None = None, most_pages: int = MOST_PAGES, most_queued: int = MOST_QUEUED) -> DataFrame:
    """id, url, turn: the pages that each wanted product's scan reads of its store, in order, until its queue ends or `most_pages` are read.

    The queue begins with the product's own address, then its `starts` (id,
    place, url). A page that is read adds its data addresses, then its likely
    links, unless they were visited before or the queue is full; an address
    without a page is visited and adds nothing. An address that waits already
    may be added again and takes its place in the queue, but is read once.

    A round takes all that waits since the one before, for all products at
    once: a queue's order is that of its levels, so there are at most
    `most_pages` rounds. Pages are dealt by address once, for all rounds, and
    what is read of them moves to even parts, as reading takes longer than its
    bytes tell; pages of which nothing more can come are not looked into.
    targets has id (one row each), url, ean, name; pages url and html, one row
    an address. Null addresses are no pages; empty tables give none.
    """
    parts = max(2 * targets.sparkSession.sparkContext.defaultParallelism, (pages.count() + targets.count()) // PER_PART)
    dealt = pages.where("url IS NOT NULL").select(norm_url(F.col("url")).alias("url"), "html").repartition(parts, "url").sortWithinPartitions("url").persist()
    # Spark would judge pages that are made of a small table by that table's size, and send all of them everywhere
    page = dealt.hint("merge")
    wanted = targets.select("id", "ean", "name")
    first = targets.select("id", F.lit(0).alias("place"), F.lit(0).alias("later"), norm_url(F.col("url")).alias("url"))
    if starts is not None:
        first = first.unionByName(starts.select("id", "place", F.lit(1).alias("later"), norm_url(F.col("url")).alias("url")))
    own = Window.partitionBy("id")
    queue = first.withColumn("pos", F.row_number().over(own.orderBy("later", "place", "url")) - 1).withColumn("queued", F.count("*").over(own))
    queue = cut(queue.select("id", "url", "pos", "queued", F.lit(0).alias("done")))
    visited, out = None, []
    for _ in range(most_pages):
        level = queue.where("url IS NOT NULL").groupBy("id", "url").agg(F.min("pos").alias("pos"), F.max("queued").alias("queued"), F.max("done").alias("done"))
        level = cut(level if visited is None else level.join(visited, ["id", "url"], "left_anti"))
        readable = level.join(page.select("url"), "url", "left_semi")
        turns = readable.withColumn("turn", F.col("done") + F.row_number().over(own.orderBy("pos"))).withColumn("last", F.col("done") + F.count("*").over(own))
        read = cut(turns.where(F.col("turn") <= most_pages))
        out.append(read.select("id", "url", "turn"))
        read = read.where((F.col("last") < most_pages) & (F.col("queued") < most_queued))
        if read.isEmpty():
            break
        now = level.select("id", "url", "pos")
        visited = now if visited is None else visited.unionByName(now)
        opened = read.select("id", "url", "pos").join(page, "url").join(wanted, "id").select(F.struct("id", "pos").alias("page_id"), "url", "ean", "name", "html")
        seen = opened.repartition(parts, "page_id").withColumn("html", shown(F.col("html"))).persist()
        kinds = (ranked_data_urls(seen, DATA_PER_PAGE), _likely(seen, PER_PAGE))
        data, links_ = (found.select("page_id.id", F.col("page_id.pos").alias("at"), F.lit(k).alias("kind"), "n", F.col("link").alias("url")) for k, found in enumerate(kinds))
        before = visited.select(F.col("id").alias("_id"), F.col("url").alias("_url"), F.col("pos").alias("_pos"))
        fresh = data.unionByName(links_).join(before, (F.col("id") == F.col("_id")) & (F.col("url") == F.col("_url")) & (F.col("_pos") <= F.col("at")), "left_anti")
        totals = read.groupBy("id").agg(F.max("queued").alias("before"), F.max("turn").alias("done"))
        added = fresh.join(totals, "id").withColumn("k", F.row_number().over(own.orderBy("at", "kind", "n"))).where(F.col("before") + F.col("k") <= most_queued)
        queue = cut(added.select("id", "url", (F.col("before") + F.col("k") - 1).alias("pos"), (F.col("before") + F.count("*").over(own)).alias("queued"), "done"))
        seen.unpersist()
    dealt.unpersist()
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
