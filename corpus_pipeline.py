"""A training-data pipeline over `documents`: reject, clean, deduplicate, mix, encode.

Every stage takes what the one before kept, with all its columns, whatever they
are called. Null and empty texts are documents without words and pass through;
null ids and sources count as values of their own; an empty table gives an
empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import bpe, line_dedup, mixing, simhash, toxicity
from pricetide.llm.common import stored, table
from pricetide.llm.queries import VOCABULARY


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; clean ones stay as they are.

    Repeated rows are judged alike. Without labels of both classes nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, all documents stay; n_chars follows the text.

    Of documents that share a line the smallest id keeps it, null ids last; rows
    that repeat id and text are one document and keep or lose it alike.
    """
    found = line_dedup.line_dedup(docs)
    text = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", text).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Ties of one id go to the smallest text hash; null ids come last; rows that
    repeat id and text become one. Documents without words are copies of each other.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none, one or two times.

    A source's share follows from all its words, a null source's too; documents
    without words go with their source's rate. Rows that repeat id and text draw alike.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the tokens of every document, and of the text decoded from them, one row for each row."""
    return bpe.bpe(docs, VOCABULARY)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No stage but the mix can be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
