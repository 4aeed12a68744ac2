"""Export projections and sheet layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators.history import between


def products(df: DataFrame, matches_only: bool = False, most: int = 10_000) -> DataFrame:
    rows = df.where(F.col("status") == "found") if matches_only else df
    out = rows.select("id", "owner", "host", "name", "ean", "status", (F.col("price_cents") / 100).alias("price"), "currency", "in_stock", "last_checked_at", "created_at")
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def price_history(snaps: DataFrame, product_id: int | None = None, first: str | None = None, last: str | None = None, most: int = 10_000) -> DataFrame:
    rows = snaps if product_id is None else snaps.where(F.col("product_id") == product_id)
    out = rows.where(between(snaps, first, last)).select("product_id", "id", "host", (F.col("price_cents") / 100).alias("price"), "currency", "in_stock", "captured_at")
    return out.orderBy(F.desc("captured_at"), F.desc("id"), "product_id").limit(most)


def workbook(df: DataFrame) -> DataFrame:
    stock = F.when(F.col("in_stock"), "Yes").when(~F.col("in_stock"), "No").otherwise("")
    return df.select(
        F.col("name").alias("product"), "ean", F.col("website_url").alias("website"), (F.col("own_price_cents") / 100).alias("own_price"), (F.col("price_cents") / 100).alias("found_price"),
        "currency", stock.alias("stock"), "status", F.col("last_checked_at").alias("last_check"),
    )
