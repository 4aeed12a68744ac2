"""Table maintenance as whole new versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], set_cols: Sequence[str]) -> DataFrame:
    """Updates replace `set_cols` of rows with their key; other updates are new rows. Of updates that repeat a key any one counts."""
    new = updates.dropDuplicates(list(keys))
    b, u = base.alias("b"), new.withColumn("_new", F.lit(True)).alias("u")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    found = b.withColumn("_old", F.lit(True)).alias("b").join(u, on, "full_outer")
    pick = lambda c: F.when(F.col("u._new") & (F.col("b._old").isNull() | F.lit(c in set_cols)), F.col(f"u.{c}") if c in new.columns else F.lit(None)).otherwise(F.col(f"b.{c}")).alias(c)
    return found.select(*(pick(c) for c in base.columns))


def insert_ignore(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key is absent, one a key, behind the old ones."""
    return base.unionByName(new.dropDuplicates(list(keys)).join(base.select(*keys), list(keys), "left_anti").select(base.columns))


def apply_if_current(base: DataFrame, results: DataFrame, key: str, token: str, set_cols: Sequence[str]) -> DataFrame:
    """Results change a row only while it still bears their token."""
    r = results.select(F.col(key), F.col(token).alias("_token"), *(F.col(c).alias(f"_{c}") for c in set_cols), F.lit(True).alias("_hit"))
    joined = base.join(r, key, "left")
    current = F.coalesce(F.col("_hit") & (F.col(token) == F.col("_token")), F.lit(False))
    return joined.select(*(F.when(current, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c) for c in base.columns))


def without(table: DataFrame, ids: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """A table without the rows whose column names one of the ids."""
    return table.join(ids.select(F.col(id_col).alias(column)).distinct(), column, "left_anti").select(table.columns)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table (with its column of ids) without what belongs to the ids."""
    return {name: without(df, ids, column) for name, (df, column) in tables.items()}


def purge_owner(tables: dict[str, DataFrame], owner: str) -> dict[str, DataFrame]:
    return {name: df.where(~F.col("owner").eqNullSafe(owner)) for name, df in tables.items()}


def dedupe(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlay(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return incoming.unionByName(current.join(incoming.select(key), key, "left_anti").select(current.columns))


def newest(df: DataFrame, order: Sequence[Column], n: int, lo: int = 1, hi: int = 500) -> DataFrame:
    return df.orderBy(*order).limit(max(lo, min(hi, n)))


def missing_ids(base: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(base.select("id"), "id", "left_anti")


def ttl(df: DataFrame, column: str, now: str, days: int) -> DataFrame:
    return df.where(F.col(column) > F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def schema_drift(tables: dict[str, DataFrame], required: DataFrame) -> DataFrame:
    """table, column of the required columns that the tables lack; names in either case."""
    have = {(t.lower(), c.lower()) for t, df in tables.items() for c in df.columns}
    present = required.sparkSession.createDataFrame(sorted(have), "table string, column string")
    named = required.select(F.lower("table").alias("table"), F.lower("column").alias("column")).distinct()
    return named.join(F.broadcast(present), ["table", "column"], "left_anti")
