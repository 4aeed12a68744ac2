"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import cut, whole

#: A level of the tree merges the runs of 2 ** BITS blocks; ROUNDS levels follow the first runs.
BITS, ROUNDS = 4, 2


def normalised(text: Column) -> Column:
    """Each stretch of ASCII white space as one space."""
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, rounds: int = ROUNDS) -> DataFrame:
    """Every row of `docs` with the smallest id among the rows of equal text.

    Method: rows start in 2 ** (bits * rounds) blocks, dealt by a hash of their
    id. A run holds, for each digest of a block, the smallest id and the number
    of rows, in the order of block and digest. In each round a block sends its
    run to the block that shares its number but for one group of bits, which the
    digest sets; the receiver merges the 2 ** bits runs that meet there. After
    the last round the digest alone sets the block, so each digest has one entry.
    Sorting and merging are Spark's: the smallest id is a minimum of a struct,
    which Spark keeps by sort aggregates alone, so every map task sorts its run,
    folds equal neighbours and sends it on, and the receiver's external sort
    brings the runs together, whose neighbours fold again. Digests are SHA-256;
    length and a second hash of the text travel along, so entries merge only
    when all three agree. Winners then go back down to the blocks and to the rows.

    A group of any size is pre-aggregated in each map task and spread over all
    blocks, on the way up and down. Nothing is collected.

    Result: id_col, keep_id, group_size, kept, text_sha256, one row for each
    input row. Null texts count as empty; null ids lose to others, and a group
    of none but null ids has a null keep_id. Rows that repeat the smallest id
    with equal text are the same record and are all kept. Other columns are not
    read. An empty table gives an empty result.
    """
    size = 1 << bits
    norm = normalised(F.col(text_col))
    hashed = docs.select(F.col(id_col).alias("id"), norm.alias("t")).select(
        "id", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("second"), F.length("t").alias("n")
    )
    block = F.pmod(F.xxhash64("id"), F.lit(size**rounds)).cast("int")
    rows = cut(hashed.select("id", F.struct("digest", "second", "n").alias("key"), block.alias("block")))

    first = F.struct(F.col("id").isNull().alias("none"), "id")
    level = rows.groupBy("block", "key").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
    for turn in range(rounds):
        shift, own = turn * bits, F.conv(F.hex(F.substring("key.digest", 1, 4)), 16, 10).cast("long")
        mask = (size - 1) << shift
        to = F.col("block").bitwiseAND(F.lit(~mask)).bitwiseOR(own.bitwiseAND(F.lit(mask)).cast("int"))
        level = level.withColumn("block", to).groupBy("block", "key").agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))

    groups = level.where("group_size > 1").select("key", F.col("first.id").alias("keep_id"), "group_size")
    down = rows.select("block", "key").distinct().join(groups, "key")
    found = rows.join(down, ["block", "key"], "left")
    lone = F.col("group_size").isNull()
    keep = F.when(lone, F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("key.digest")).alias("text_sha256"),
    )
