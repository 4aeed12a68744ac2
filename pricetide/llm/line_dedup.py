"""Line dedup by a tree of line templates: lines whose template recurs across documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import fresh, meet, stored, whole

#: Least tokens of a line that may recur; least different documents; tokens of a line without variable fields for which two documents suffice.
TOKENS, DOCUMENTS, LONG_TOKENS = 2, 3, 50
#: From so many tokens on one of a line's tokens may vary, and from so many on any two of STRETCHES equal stretches.
ONE_VARIES, TWO_VARY, STRETCHES = 6, 12, 8
#: Leading tokens that stay where a whole half of the others varies.
LEADING = 2
#: The mark of a long line in its hash; runs of stretches of a line by which it meets others, at most.
LONG, RUNS = 1, 3


def templates(docs: DataFrame, id_col: str, text_col: str, tokens: int, long_tokens: int) -> DataFrame:
    """k (hash of id and text), id, h (hash of the text), and x: for each line e, the hash of its tokens, b, the hashes of its stretches in order, and two, whether two of these may vary; if so
    halves, the hashes of the leading tokens and each half of the others.

    Tokens that hold a digit are variable and all alike. e is null for lines that never recur,
    b for lines too short for a variable field. Bit 0 of e tells long lines.
    """
    # anchored and possessive, so that a token without digits is read once whatever its length
    masked = lambda line: F.split(F.btrim(F.regexp_replace(line, r"(?<![^ \t\r])[^ \t\r0-9]*+[0-9][^ \t\r]*+", "<*>"), F.lit(" \t\r")), r"[ \t\r]+")

    def leaf(t: Column) -> Column:  # the tokens' hashes
        n = F.size(t)
        line = F.when(n >= tokens, F.xxhash64(t).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(n >= long_tokens, LONG).otherwise(0).cast("long")))
        stretches = F.when(n < TWO_VARY, n).otherwise(STRETCHES)
        edge = lambda j: F.floor(j * n / stretches).cast("int")
        parts = F.transform(F.sequence(F.lit(0), stretches - 1), lambda j: F.xxhash64(n, j, F.slice(t, edge(j) + 1, edge(j + 1) - edge(j))))
        half = F.floor((n - LEADING) / 2).cast("int")
        halves = F.array(*(F.xxhash64(F.lit(mark), n, F.slice(t, 1, LEADING), F.slice(t, start, length)) for mark, start, length in (("first", F.lit(LEADING + 1), half), ("second", half + LEADING + 1, n - LEADING - half))))
        return F.struct(line.alias("e"), F.when(n >= max(ONE_VARIES, tokens), parts).alias("b"), (n >= TWO_VARY).alias("two"), F.when(n >= TWO_VARY, halves).otherwise(F.array().cast("array<bigint>")).alias("halves"))

    rows = docs.select(F.xxhash64(id_col, text_col).alias("k"), F.col(id_col).alias("id"), F.xxhash64(whole(F.col(text_col))).alias("h"), F.transform(F.split(whole(F.col(text_col)), "\n"), lambda line: F.transform(masked(line), lambda w: F.xxhash64(w))).alias("t"))
    return rows.select("k", "id", "h", F.transform("t", leaf).alias("x"))


def _intact(b: Column, two: Column) -> Column:
    """Hashes of runs of stretches of which at least one holds no variable field: halves where one token varies, thirds where two stretches do."""
    run = lambda mark, start, length: F.xxhash64(F.lit(mark), F.size(b), F.slice(b, start, length))
    half = F.floor(F.size(b) / 2).cast("int")
    thirds = F.array(*(run(f"third {start}", F.lit(start), F.lit(n)) for start, n in ((1, 3), (4, 3), (7, STRETCHES - 6))))
    return F.when(two, thirds).otherwise(F.array(run("half", F.lit(1), half), run("rest", half + 1, F.size(b) - half)))


def _leaves(b: Column, two: Column) -> Column:
    """Hashes of the line's templates: each one token a wildcard, or each two stretches."""
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(STRETCHES) for j in range(i + 1, STRETCHES)))
    single = F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.struct(i.alias("i"), i.alias("j")))
    starred = lambda p: F.xxhash64(F.lit("template"), p["i"], p["j"], F.filter(b, lambda _, k: (k != p["i"]) & (k != p["j"])))
    return F.transform(F.when(two, pairs).otherwise(single), starred)


def _whole_lines(doc: DataFrame, documents: int, all_lines: int) -> DataFrame:
    """e and first (smallest id) of the lines that recur as they are, but for tokens with digits."""
    keys = F.array_distinct(F.array_compact(F.col("x.e")))
    lines = doc.select("k", F.explode(keys).alias("e"))
    common = stored(lines.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = meet(lines, "e", common, "n", all_lines).groupBy("k").agg(F.collect_set(F.struct("n", "e")).alias("held"))
    facts = doc.select("k", "id", "h", F.size(keys).alias("own")).groupBy("k").agg(F.min("id").alias("id"), F.min("h").alias("h"), F.max("own").alias("own"))
    # a line that no other document holds is as good as any other of its kind: the document's hash stands for it
    rarest = F.when(F.size("held") < F.col("own"), F.struct(F.lit(1).cast("long").alias("n"), F.col("k").alias("e"))).otherwise(F.array_min("held"))
    contexts = held.join(facts.hint("merge"), "k").select("id", "h", rarest.alias("r"), F.explode("held").alias("t"))
    sketch = F.when(F.col("r.n") < F.col("t.n"), F.col("r.e")).otherwise(F.col("h"))
    by_sketch = contexts.select("id", "t.e", "t.n", sketch.alias("sketch")).groupBy("e", "sketch").agg(F.min("id").alias("first"), F.max("n").alias("n"))
    counts = by_sketch.groupBy("e").agg(F.count(F.lit(1)).alias("sketches"), F.min("first").alias("first"), F.max("n").alias("n"))
    return counts.where(F.col("sketches") >= F.when(F.col("e").bitwiseAND(F.lit(LONG)) > 0, min(2, documents)).otherwise(documents)).select("e", "first", "n")


def _with_fields(doc: DataFrame, documents: int, all_lines: int) -> DataFrame:
    """e and first of the lines of recurring templates with variable fields, one row for each such template of a line.

    Different lines meet by a run of stretches that both hold as it is; only
    those get their templates. A template's documents are counted by their
    texts, of which each line brings at most as many as are needed.
    """
    rows = doc.select("id", "h", F.explode("x").alias("s")).where("s.b IS NOT NULL AND s.e IS NOT NULL").select("id", "h", "s.e", "s.b", "s.two", "s.halves")
    units = stored(rows.groupBy("e").agg(F.first("b").alias("b"), F.first("two").alias("two"), F.first("halves").alias("halves"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    runs = units.select("e", F.explode(_intact(F.col("b"), F.col("two"))).alias("run"))
    shared = stored(runs.groupBy("run").agg(F.min("e").alias("low"), F.max("e").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("run", "n"))
    runs_in_all = RUNS * units.count()
    met = meet(runs, "run", shared, "n", runs_in_all).select("e").distinct()
    leaves = stored(units.join(met.hint("merge"), "e").select("e", "n", "first", F.explode(F.concat(_leaves(F.col("b"), F.col("two")), "halves")).alias("leaf")))
    all_leaves = leaves.count()
    merged = leaves.groupBy("leaf").agg(F.min("e").alias("low"), F.max("e").alias("high"), F.min("first").alias("found"), F.count(F.lit(1)).alias("lines")).where("low < high")
    forms = stored(meet(leaves, "leaf", stored(merged.select("leaf", "found", "lines")), "lines", all_leaves).select("e", "n", "leaf", "found", "lines"))
    # as many texts of each line as can matter: the first ones by hash
    order = Window.partitionBy("e").orderBy("h")
    wanted = stored(forms.select("e", "n").distinct())
    few = meet(rows.select("e", "h"), "e", wanted, "n", all_lines).select("e", "h").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= documents)
    counts = forms.join(few.select("e", "h").hint("merge"), "e").groupBy("leaf", "h").agg(F.max("lines").alias("lines")).groupBy("leaf").agg(F.count(F.lit(1)).alias("texts"), F.max("lines").alias("size"))
    recurring = stored(counts.where(F.col("texts") >= documents).select("leaf", "size"))
    return meet(forms, "leaf", recurring, "size", all_leaves).select("e", F.col("found").alias("first"), "n")


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: int = TOKENS,
    documents: int = DOCUMENTS,
    long_tokens: int = LONG_TOKENS,
) -> DataFrame:
    """`docs` without the lines of recurring templates; all its columns, then n_lines and n_dropped.

    The tree's first level is the number of tokens; below come the stretches of
    tokens from the leading ones on, each with a child for any content. Tokens that hold a digit are
    variable fields. Further fields may be anywhere: one token of a line of ONE_VARIES tokens or more, or any two of STRETCHES equal
    stretches of a line of TWO_VARY or more, or one half of such a line behind its LEADING tokens.
    Lines whose other tokens are the same share a leaf.

    A line without further fields recurs if documents of at least `documents` different
    sketches hold it, or of two if it has `long_tokens` tokens or more.
    A document's sketch is its rarest line, if fewer documents hold
    that than the line in question, else its whole text. The lines of one
    passage, which the same documents hold, so never stand for each other. Whole
    copies of a document share their sketch, so copies alone make no line
    recur, and are left for the near-duplicate stage; copies that differ in a
    line are different documents. A template with further fields recurs if documents of
    `documents` different texts hold it in two or more forms. Of a recurring template the document with the
    smallest id keeps its lines; all others lose theirs.

    Blank lines and lines of one word never recur: they are layout and headings. Lines from
    `tokens` words on follow the rule above, however short.

    Counts are added up in map tasks before they move. A line or template in more than a share of
    all documents doesn't move where it meets what is known of it: such lines are few by the rule of `meet`. Templates with
    further fields are made of different lines, once each, and only where another
    line shares half or a third of the line. The lines to drop meet the texts in a merge join at every size.

    Null texts count as empty; a text without a dropped line stays as it is,
    null included, and a document that loses all lines stays with an empty
    text. Null ids come last in the choice of the first document. Repeated rows
    are treated alike. An empty table gives an empty result.
    """
    doc = stored(templates(docs, id_col, text_col, tokens, long_tokens))
    all_lines = doc.agg(F.sum(F.size("x"))).first()[0] or 0
    firsts = _whole_lines(doc, documents, all_lines).unionByName(_with_fields(doc, documents, all_lines)).select("e", F.struct("first").alias("first"), "n")
    recurring = stored(firsts.groupBy("e").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.max("n").alias("n")))

    k, gone = fresh(docs, "_k", "_dropped")
    places = doc.select("k", "id", F.posexplode("x.e").alias("at", "e"))
    places = meet(places, "e", recurring, "n", all_lines)
    dropped = places.where(~(F.col("low.first").eqNullSafe(F.col("id")) & F.col("high.first").eqNullSafe(F.col("id")))).groupBy("k").agg(F.collect_set("at").alias(gone))
    dropped = stored(dropped)

    split = F.split(whole(F.col(text_col)), "\n")
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains(gone, i)), "\n")
    found = docs.withColumn(k, F.xxhash64(id_col, text_col)).join(dropped.withColumnRenamed("k", k).hint("merge"), k, "left")
    lost = F.col(gone).isNotNull()
    return found.select(
        *(F.when(lost, kept).otherwise(F.col(text_col)).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns),
        F.size(split).cast("long").alias("n_lines"),
        F.when(lost, F.size(gone)).otherwise(0).cast("long").alias("n_dropped"),
    )
