"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import cut, spread

#: Tasks that the rows of one label are dealt over.
SALTS = 64


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """node, label: the smallest node that can be reached, for every node of a link.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so that paths halve; it ends when no neighbour has a
    smaller label, as all nodes of a component then bear its smallest node. A
    hub's rows are split by the skew join and pre-aggregated before they move;
    nodes that share a label meet that label's own by salts.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node != other").distinct())
    labels = cut(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        own = labels.select("node", "label", F.col("label").alias("was"))
        lower = cut(near.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        if not lower.where("label != was").limit(1).count():
            return lower.select("node", "label")
        top = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = cut(spread(lower, "label", F.pmod(F.xxhash64("node"), F.lit(SALTS)), top).select("node", F.least("label", "top").alias("label")))
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
