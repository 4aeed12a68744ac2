"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import cut, fresh, per_row, spread
from pricetide.llm.graph import components

#: Words of a shingle, most differing bits of a link, rows that a block of a large bucket holds, salts of a hot fingerprint.
SHINGLE, RADIUS, BLOCK, SALTS = 4, 4, 1024, 64


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, hash (of the text as it is), fp (the 64 bits as a long) of every row, from its whole text."""

    def make():
        import numpy as np
        import xxhash

        low, digest = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))), xxhash.xxh64_intdigest

        def one(text):
            parts = (text or "").encode("utf-8", "surrogatepass").translate(low).split()
            n = len(parts)
            if not n:
                return 0
            joined, k = b" ".join(parts), min(shingle, n)
            ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, n)) + np.arange(n)).tolist()
            starts = [0, *(e + 1 for e in ends[: n - k])]
            hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :])], np.uint64)
            ones = np.zeros(64, np.int64)
            for at in range(0, len(hashes), 8192):
                ones += np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])

        return lambda rows: [(i, h, one(t)) for i, h, t in rows]

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return per_row(rows, make, f"id {kind}, hash long, fp long")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 masks of which one misses any `radius` bits.

    Bit i carries a non-zero vector m(i) of radius + 1 binary digits. Mask v
    holds the bits with an odd inner product of m(i) and v. The vectors of
    `radius` bits span too little to leave no v orthogonal to all of them, and
    that v's mask holds none of the bits: two values that differ in just those
    bits are equal under it.
    """
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % top) & v).bit_count() & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def classes(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """fp, label for the fingerprints that link to another; prints has fp (distinct) and n (rows that bear it).

    Every pair within the radius shares a bucket (mask, masked value) of some
    table. A bucket of two is one comparison. In larger ones each member is
    first compared with one pivot, the member that most rows bear, which makes
    no more links than members. Components of these links settle most buckets:
    any pair of different components in a bucket has a member outside its
    largest component. Such members, few where copies crowd, are compared with
    all members of the bucket, dealt in blocks of `block`; of the links found
    between two components one is kept. No pair of a bucket is left unchecked
    unless its two sides are known to be one component already. Where a bucket
    holds many fingerprints that link to none of each other, nearly all of its
    members are outside the largest component, and its comparisons grow with the
    square of its size: exact, spread over tasks by blocks, but slow.
    """
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(masks(radius))))
    rows = prints.select("fp", "n", F.explode(tables).alias("x")).select("fp", "n", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    buckets = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("n", "fp")).alias("top")).where("members > 1")
    members = cut(rows.join(buckets.select("t", "key", "members", F.col("top.fp").alias("pivot")), ["t", "key"]).select("t", "key", "fp", "members", "pivot"))

    stars = members.where((F.col("fp") != F.col("pivot")) & (_differ("fp", "pivot") <= radius)).select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = cut(stars)
    first = components(stars)

    label = F.coalesce("label", "fp")
    large = members.where("members > 2").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("t", "key", "fp", "members", label.alias("label"))
    large = cut(large)
    sizes = large.groupBy("t", "key", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("t", "key").agg(F.max(F.struct("size", "label")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    open_ = cut(large.join(mixed.select("t", "key", F.col("top.label").alias("main")), ["t", "key"]))
    parts = F.ceil(F.col("members") / block).cast("long")
    all_ = open_.select("t", "key", F.pmod(F.xxhash64("fp"), parts).alias("part"), F.col("fp").alias("b"), F.col("label").alias("lb"))
    few = open_.where("label != main").select("t", "key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("fp").alias("a"), F.col("label").alias("la"))
    more = (
        few.join(all_, ["t", "key", "part"])
        .where((F.col("la") != F.col("lb")) & (_differ("a", "b") <= radius))
        .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        .distinct()
    )
    second = components(more)
    linked = first.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")))
    linked = linked.groupBy("node").agg(F.min("label").alias("label"))
    final = spread(linked, "label", F.pmod(F.xxhash64("node"), F.lit(SALTS)), second.select(F.col("node").alias("label"), F.col("label").alias("last")))
    return cut(final.select(F.col("node").alias("fp"), F.coalesce("last", "label").alias("label")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Every row's fingerprint and the smallest id that links of fingerprints reach.

    Words are stretches without ASCII white space after A-Z went to lower case;
    fingerprints come from `shingle`-word shingles, repeats included, over whole
    texts. Rows of one fingerprint are one class however many they are; classes
    link at `radius` or fewer differing bits.

    Result: id_col, fp, component_id, one row for each input row. Null and empty
    texts have fingerprint zero and link like others. Null ids never become a
    component's id unless it has no other. Other columns are not read. An empty
    table gives an empty result.
    """
    rows, facts = _linked(docs, id_col, text_col, shingle, radius)
    return spread(rows, "fp", F.pmod(F.xxhash64("id"), F.lit(SALTS)), facts).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """`docs` with one row of each component of `near_dedup`, all its columns as they are.

    The row with the smallest id stays; null ids come last, and of rows that
    share an id with different texts the one with the smallest text hash stays.
    Rows that repeat id and text are one. An empty table stays empty.
    """
    rows, facts = _linked(docs, id_col, text_col, shingle, radius)
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "hash")).alias("best"))
    own, key, other = fresh(docs, "_id", "_hash", "_other")
    winners = best.join(facts, "fp").groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.id").alias(own), F.col("best.hash").alias(other))
    found = docs.withColumn(key, F.xxhash64(text_col)).join(winners, (F.col(key) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
    return found.dropDuplicates([id_col, key]).select(docs.columns)


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, hash of the text, fp), and label and component_id of each fingerprint."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = classes(prints, radius)
    named = prints.join(linked, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    tops = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows, spread(named, "label", F.pmod(F.xxhash64("fp"), F.lit(SALTS)), tops).select("fp", "label", "component_id")
