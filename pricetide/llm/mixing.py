"""Mixing sources to target weights by whole repeats and one hash-seeded copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import cut, fresh, stored, whole

#: Weights by the order of the sources, share of all words that the mix takes, most repeats of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


def words(text: Column) -> Column:
    """Words are stretches without ASCII white space."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(seed: str, key: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the key and the text alone; null counts as empty."""
    joined = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.md5(whole(text).cast("binary")))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds `place`, the number of the source from 0 by code point, null last.

    The order is made by ranges: a task numbers its own range, and the ranges'
    sizes, one row each, shift the numbers.
    """
    ordered = (
        sources.withColumn("_last", F.col("source").isNull())
        .repartitionByRange(F.col("_last"), F.col("source"))
        .sortWithinPartitions("_last", "source")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"_range": F.shiftrightunsigned("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    )
    ordered = cut(ordered)
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_shift"))
    return ordered.join(F.broadcast(shifts), "_range").withColumn("place", F.col("_row") + F.col("_shift")).drop("_last", "_at", "_range", "_row", "_shift")


def water_level(sources: DataFrame, total: float, most: float) -> float:
    """The level x at which sources take min(most * size, x * weight), `total` in all.

    Each round shares what the full sources leave over among the others; it ends
    when no further source is full. A round is one aggregate over the sources.
    """
    cap, level = F.col("source_size") * F.lit(most), 0.0
    full = -1
    while True:
        below = (cap <= F.col("weight") * F.lit(level)) if full >= 0 else F.lit(False)
        row = sources.agg(
            F.sum(F.when(below, cap).otherwise(0.0)).alias("caps"), F.sum(F.when(below, 0).otherwise(F.col("weight"))).alias("weights"), F.count_if(below).alias("full")
        ).first()
        if row["full"] == full or not row["weights"]:
            return level if row["weights"] else float("inf")
        full, level = row["full"], max(0.0, total - (row["caps"] or 0.0)) / row["weights"]


def targets(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, text_col: str = "text", source_col: str = "source", rows: DataFrame | None = None) -> DataFrame:
    """source, source_size, target, rate of every source, written so that Spark knows the table's size.

    `rows` may give source and size of every document where they are known.
    """
    rows = docs.select(F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")) if rows is None else rows
    sums = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    turns = F.array(*(F.lit(float(w)) for w in weights))
    sums = cut(sums.withColumn("weight", F.element_at(turns, (F.col("place") % len(weights) + 1).cast("int"))))
    total = share * float(sums.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sums, total, most)
    cap = F.col("source_size") * F.lit(most)
    target = F.when(cap <= F.col("weight") * F.lit(level), cap).otherwise(F.col("weight") * F.lit(level)).cast("double")
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(most))).otherwise(0.0)
    return stored(sums.select("source", "source_size", target.alias("target"), rate.alias("rate")))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more where the draw falls under the fraction."""
    return F.floor(rate).cast("long") + (draw < rate - F.floor(rate)).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The number of copies that the mix takes of every document.

    Method: words are added up by source (in map tasks first, so that a hot
    source costs no more than others). Sources by code point, null last, get the
    weights in turn and share `share` of all words by them; a source that would
    pass `most` times its size stops there and the rest is shared again. The
    rate of a source is target / size. A document is taken floor(rate) times,
    and once more if a hash of seed, id and text falls under the fraction.

    The same table gives the same mix. Result: id, source, size, source_size,
    target, rate, copies, one row for each input row. Null texts count as empty,
    a null source as a source of its own; a source without words has rate 0.
    Rows that repeat an id draw by their texts too; rows that repeat both are
    taken alike. An empty table gives an empty result.
    """
    text = F.col(text_col)
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text).alias("size"), uniform(seed, F.col(id_col), text).alias("_draw")))
    found = targets(docs, weights, share, most, rows=rows).withColumnRenamed("source", "_source")
    joined = rows.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("copies", copies(F.col("rate"), F.col("_draw")))
    return joined.select("id", "source", "size", "source_size", "target", "rate", "copies")


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents themselves, each as often as `mix` takes it, with all their columns.

    Copies follow from a document and its source's rate, so texts meet the table
    of sources and nothing else; where that is under Spark's limit for a
    broadcast, no text moves. Nulls, ties and repeats as in `mix`.
    """
    own, rate, turn = fresh(docs, "_source", "_rate", "_copy")
    found = targets(docs, weights, share, most, text_col, source_col).select(F.col("source").alias(own), F.col("rate").alias(rate))
    taken = copies(F.col(rate), uniform(seed, F.col(id_col), F.col(text_col))).cast("int")
    joined = docs.join(found, F.col(source_col).eqNullSafe(F.col(own)))
    return joined.withColumn(turn, F.explode(F.array_repeat(F.lit(1), taken))).select(docs.columns)
