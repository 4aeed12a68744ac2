"""Writers of exports, and rows kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions.scalars import csv_cell

BOM = "﻿"


def export_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, formulas guarded, CRLF; the byte order mark leads the first heading."""
    cells = [csv_cell(F.col(f"`{c}`").cast("string")).alias((BOM if k == 0 else "") + c) for k, c in enumerate(df.columns)]
    df.select(*cells).write.option("lineSep", "\r\n").csv(path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue="", mode="overwrite")


def export_json(df: DataFrame, resource: str, path: str) -> None:
    """Rows as JSON lines, and a manifest of one row beside them."""
    df.write.json(f"{path}/rows", mode="overwrite")
    manifest = df.sparkSession.range(1).select(F.lit(1).alias("schemaVersion"), F.lit(resource).alias("resource"), F.current_timestamp().alias("exportedAt"))
    manifest.write.json(f"{path}/manifest", mode="overwrite")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the folder that spark.checkpoint.dir names: lineage ends here, and a lost executor loses nothing.

    Where none is set, Spark on this machine alone, as in tests, gets a temporary folder; a cluster must name one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)
