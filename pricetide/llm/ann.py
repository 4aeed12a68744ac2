"""Approximate nearest neighbours: a robust-pruned graph in each shard, searched by beams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import cut

#: Rows of a shard, about; queries of a block (the index moves once a block); edges of a node; beam of building and searching; slack of the pruning.
SHARD, BLOCK, DEGREE, BUILD_BEAM, BEAM, ALPHA = 4096, 32_768, 32, 48, 96, 1.2
#: Nodes that enter the graph at once.
BATCH = 256


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0), F.lit(False))


def search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam searches of all queries at once: node numbers and similarities, best first; -1 where the beam isn't full."""
    n, rows = len(q), np.arange(len(q))[:, None]
    ids = np.full((n, beam), -1)
    sims = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = seen[:, start] = True
    ids[:, 0], sims[:, 0], done[:, 0] = start, q @ x[start], False
    while True:
        going = np.flatnonzero(~done.all(1))
        if not len(going):
            return ids, sims
        r = rows[: len(going)]
        first = np.argsort(done[going], axis=1, kind="stable")[:, :wide]
        fresh = ~done[going[:, None], first]
        done[going[:, None], first] = True
        near = np.where(fresh[:, :, None], edges[ids[going[:, None], first]], -1).reshape(len(going), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[going[:, None], near]] = -1
        seen[going[:, None], near] = True
        sim = np.einsum("qd,qed->qe", q[going], x[near], dtype=np.float32)
        sim[near < 0] = -np.inf
        all_ids, all_sims = np.hstack([ids[going], near]), np.hstack([sims[going], sim])
        all_done = np.hstack([done[going], near < 0])
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[going], sims[going], done[going] = all_ids[r, top], all_sims[r, top], all_done[r, top]


def prune(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` diverse edges of each node out of its candidates (-1: none).

    Takes the nearest candidate, drops those that lie `alpha` times nearer to it
    than to the node, and goes on with what is left.
    """
    near = near.copy()
    near[near == nodes[:, None]] = -1
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    own = 2 - 2 * np.einsum("nd,ncd->nc", x[nodes], x[near], dtype=np.float32)
    own[near < 0] = np.inf
    out, rows = np.full((len(nodes), degree), -1), np.arange(len(nodes))
    for k in range(degree):
        best = own.argmin(1)
        ok = np.isfinite(own[rows, best])
        if not ok.any():
            break
        out[ok, k] = near[ok, best[ok]]
        to_best = 2 - 2 * np.einsum("nd,ncd->nc", x[near[rows, best]], x[near], dtype=np.float32)
        own[ok[:, None] & (alpha * to_best <= own)] = np.inf
        own[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (node, degree; -1: none) of a directed graph over unit vectors, and the node where searches start."""
    n = len(x)
    start = int((x @ x.mean(0)).argmax())
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    for slack in (1.0, alpha):
        at, size = 1, 1
        while at < n:
            nodes = order[at : at + size]
            found, _ = search(x, edges, start, x[nodes], beam)
            edges[nodes] = prune(x, nodes, np.hstack([found, edges[nodes]]), degree, slack)
            a, b = np.repeat(nodes, degree), edges[nodes].ravel()
            a, b = a[b >= 0], b[b >= 0]
            by = np.argsort(b, kind="stable")
            a, b = a[by], b[by]
            targets, first, many = np.unique(b, return_index=True, return_counts=True)
            added = np.full((len(targets), min(int(many.max()), 4 * degree)), -1)
            place = np.arange(len(b)) - np.repeat(first, many)
            inside = place < added.shape[1]
            added[np.repeat(np.arange(len(targets)), many)[inside], place[inside]] = a[inside]
            joined = np.hstack([edges[targets], added])
            full = (joined >= 0).sum(1) > degree
            left = joined[~full]
            left = np.take_along_axis(left, np.argsort(left < 0, axis=1, kind="stable"), 1)[:, :degree]
            edges[targets[~full]] = left
            for s in range(0, int(full.sum()), 1024):
                t = targets[full][s : s + 1024]
                edges[t] = prune(x, t, joined[full][s : s + 1024], degree, slack)
            at += size
            size = min(2 * size, BATCH, n)
    return edges, start


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, keep: int = 6) -> DataFrame:
    """shard, place, ids, vec, edges: every distinct usable vector as a node of its shard's graph.

    Equal vectors are one node with their `keep` smallest ids, which is as many
    as a search for `keep` - 1 neighbours can return; a vector in a third of all
    rows costs no more than others. Shards are dealt by a hash of the vector, each
    to a task of its own. Rows of a null id, and vectors that are null, zero, not
    finite or of another width than most, are left out; an empty table gives an
    empty index.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where(usable(F.col("vec")) & F.col("id").isNotNull()).distinct()
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= keep)
    nodes = cut(first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    width = nodes.agg(F.mode(F.size("vec"), True)).first()[0]
    nodes = nodes.where(F.size("vec") == (width or 0))
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda v: v[0])).reset_index(drop=True)
        edges, start = build(unit(np.stack(pdf["vec"].to_list())))
        pdf["place"], pdf["start"] = np.arange(len(pdf)), start
        pdf["edges"] = [e[e >= 0] for e in edges]
        return pdf[["shard", "place", "start", "ids", "vec", "edges"]]

    return dealt.groupBy("shard").applyInPandas(make, "shard int, place int, start int, ids array<long>, vec array<double>, edges array<int>")


def nearest(indexed: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's `k` nearest by cosine over all shards.

    Queries meet every shard in blocks of about `block`, so that a task holds one
    shard and one block. A beam search proposes candidates in each; their scores
    are computed in double precision from the original vectors, and the best of
    all shards stay, ties to the smaller id. A query never finds its own id.
    Queries and rows whose vector is null, zero, of another width than most or
    not finite take no part; fewer candidates than `k` give fewer rows. Queries
    that repeat an id with another vector are separate searches that share their
    best `k`. An empty table gives an empty result.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("vec")).where(usable(F.col("vec")) & F.col("query_id").isNotNull()).distinct()
    asked = cut(asked)
    shards = indexed.agg(F.max("shard")).first()[0]
    blocks = max(1, -(-asked.count() // block))
    if shards is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(int(shards)))))
    copied = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(nodes: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(nodes) or not len(ask):
            return none
        nodes = nodes.sort_values("place").reset_index(drop=True)
        vec = np.stack(nodes["vec"].to_list()).astype(np.float64)
        ask = ask[ask["vec"].map(len) == vec.shape[1]].sort_values("query_id")
        if not len(ask):
            return none
        edges = np.full((len(nodes), max(1, int(nodes["edges"].map(len).max()))), -1)
        for i, e in enumerate(nodes["edges"]):
            edges[i, : len(e)] = e
        x, q = unit(vec), np.stack(ask["vec"].to_list()).astype(np.float64)
        names, ids = ask["query_id"].to_numpy(), nodes["ids"].to_list()
        norm_x, norm_q = np.sqrt((vec * vec).sum(1)), np.sqrt((q * q).sum(1))
        out = []
        for s in range(0, len(q), BATCH):
            found, _ = search(x, edges, int(nodes["start"].iloc[0]), unit(q[s : s + BATCH]), beam)
            for row, near in zip(range(s, s + len(found)), found[:, : k + 4], strict=True):
                near = near[near >= 0]
                score = (vec[near] * q[row]).sum(1) / (norm_x[near] * norm_q[row])
                out += [(names[row], i, c) for node, c in zip(near, score, strict=True) for i in ids[node] if i != names[row]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = copied.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
