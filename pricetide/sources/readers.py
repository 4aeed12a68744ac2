"""Readers of domain inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, owner: str | None = None) -> DataFrame:
    """A table, newest first, of one owner if given."""
    rows = spark.read.parquet(path)
    if owner is not None:
        rows = rows.where(F.col("owner") == owner)
    return rows.orderBy(F.desc_nulls_first("created_at"))


def jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int = 32, **options: str) -> DataFrame:
    """An operational table, read in ranges of a numeric column."""
    bounds = {"partitionColumn": column, "lowerBound": lower, "upperBound": upper, "numPartitions": parts}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load()


def sheet(spark: SparkSession, path: str, columns: int = 30) -> DataFrame:
    """Cells of a delimited sheet whose heading may be any row: row_id, cells. One file is one sheet, in the order of its lines."""
    names = [f"c{k}" for k in range(columns)]
    rows = spark.read.csv(path, header=False, schema=", ".join(f"{n} string" for n in names), multiLine=True)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), F.array(*(F.coalesce(n, F.lit("")) for n in names)).alias("cells"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
