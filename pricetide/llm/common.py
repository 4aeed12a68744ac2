"""Helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a Python worker turns into Python objects at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after those that `df` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def whole(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def folder(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the one that the cluster names, or a temporary one where none is set and Spark runs on this machine alone, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder: lineage ends here."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and read again.

    Unlike after `cut`, Spark then knows the size, and broadcasts the table in a
    join only if that is under spark.sql.autoBroadcastJoinThreshold. The files
    stay, as those of checkpoints do, until the folder is cleared.
    """
    folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_row(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows of `df` through a Python function, in Arrow batches.

    `make` runs once a task and returns a function from a list of rows (one
    tuple for each) to a list of tuples as in `schema`. At most SLICE rows are
    Python objects at once.
    """
    names = df.columns
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = work(list(zip(*(part.column(name).to_pylist() for name in names), strict=True)))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def spread(rows: DataFrame, key: str, salt: Column, facts: DataFrame) -> DataFrame:
    """`rows` left-joined to `facts` (one row a key) without a hot key in one task.

    The facts first meet the sets of salts that the keys' rows bear, one for each
    key; the rows then meet those (salt, key) pairs, so that a key's rows are
    dealt by salt too. `salt` takes few values.
    Keys without facts keep nulls. A null key finds none.
    """
    salted = rows.withColumn("_salt", salt)
    pairs = salted.groupBy(key).agg(F.collect_set("_salt").alias("_salt")).join(facts, key).withColumn("_salt", F.explode("_salt"))
    return salted.join(pairs, ["_salt", key], "left").drop("_salt")


#: A key is hot if it has more than this part of all rows; there are never more hot keys than this.
HOT = 1024


def meet(rows: DataFrame, key: str, facts: DataFrame, count: str, total: int) -> DataFrame:
    """Inner join of `rows` to `facts` (one row a key; `count` is how many rows the key has or more, of `total`), without a hot key in one task.

    Rows of hot keys meet their facts where they are: keys with more than
    total / HOT rows are HOT at most, so these facts are broadcast. All others
    are moved to their facts. Reads `rows` twice. A null key finds none.
    """
    hot = F.broadcast(facts.where(F.col(count) * HOT > total))
    cold = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col(count) * HOT <= total).hint("merge"), key)
    return rows.join(hot, key).unionByName(cold)
