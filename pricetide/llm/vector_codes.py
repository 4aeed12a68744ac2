"""Vector codes: product quantisation whose parts meet the codebook entries in a lexicographic trie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import spread, stored

#: Equal consecutive parts of a vector; entries of a part's codebook; rounds of assigning and averaging; whole steps for 1.0.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts that the trie handles at once; deeper levels of a larger subtree are descended one child after the other.
BLOCK = 4096
#: Rows that a task turns into parts at once; values that a hot label's rows are dealt over.
SLICE, SALTS = 4096, 64


class Books(NamedTuple):
    """Length of the vectors, and integer entries as (part, entry, component)."""

    length: int
    entries: np.ndarray


def usable(vector: Column) -> Column:
    """True for vectors that are neither null nor hold a null or a non-finite component."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def limit(dim: int) -> int:
    """Scaled components saturate here, so that a squared distance of `dim` components stays a 64-bit integer."""
    return int((2.0**62 / max(dim, 1)) ** 0.5) // 2


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, saturated by `limit`; one row for each vector."""
    most = limit(values.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)


class Trie:
    """Nearest entries of many parts, by a walk over the trie of the distinct parts.

    `parts` are distinct and sorted, so that a trie's node is a run of rows that
    share a prefix. A node's distances to all entries over its prefix are made
    once, for its parent's distances plus one squared difference, and all rows
    below share them. The walk goes depth first: a subtree over BLOCK rows is
    entered child by child; a smaller one is done level by level, at once.
    """

    def __init__(self, parts: np.ndarray, entries: np.ndarray):
        self.parts, self.entries = parts, entries
        self.code = np.zeros(len(parts), np.int64)
        self.error = np.zeros(len(parts), np.int64)
        # the length of the prefix that each row shares with the one before
        if len(parts) and parts.shape[1]:
            differs = parts[1:] != parts[:-1]
            self.shared = np.concatenate([[-1], np.where(differs.any(1), differs.argmax(1), parts.shape[1])])
        else:
            self.shared = np.full(len(parts), -1)
        if len(parts):
            self.walk(0, len(parts), 0, np.zeros(len(entries), np.int64))

    def walk(self, low: int, high: int, depth: int, distance: np.ndarray) -> None:
        if high - low <= BLOCK or depth == self.parts.shape[1]:
            self.block(low, high, depth, distance)
            return
        # the rows at which another child begins
        starts = low + np.flatnonzero(self.shared[low:high] <= depth)
        starts = np.unique(np.append(starts, low))
        for a, b in zip(starts, np.append(starts[1:], high), strict=True):
            self.walk(a, b, depth + 1, distance + (self.parts[a, depth] - self.entries[:, depth]) ** 2)

    def block(self, low: int, high: int, depth: int, distance: np.ndarray) -> None:
        shared = self.shared[low:high].copy()
        shared[0] = -1
        nodes, distances = np.zeros(high - low, np.int64), distance[None, :]
        for level in range(depth, self.parts.shape[1]):
            begins = shared <= level
            first = np.flatnonzero(begins)
            distances = distances[nodes[first]] + (self.parts[low:high][first, level][:, None] - self.entries[None, :, level]) ** 2
            nodes = np.cumsum(begins) - 1
        best = distances.argmin(1)  # the first of equal ones
        self.code[low:high] = best[nodes]
        self.error[low:high] = distances[np.arange(len(best)), best][nodes]


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, the place of every row among them, and how often each occurs."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    ranked = parts[order]
    begins = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)])
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(begins) - 1
    return ranked[begins], place, np.bincount(place)


def blocks(batches: Iterator[pa.RecordBatch], parts: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the rows, and their vectors as integers (row, part, component); short last parts are filled up with zeros."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            piece = batch.slice(at, SLICE)
            flat = piece.column("v").flatten().to_numpy(zero_copy_only=False)
            values = integers(flat.reshape(piece.num_rows, -1), scale)
            short = -values.shape[1] % parts
            yield piece, np.pad(values, ((0, 0), (0, short))).reshape(piece.num_rows, parts, -1)


def _first(rows: DataFrame, n: int, parts: int, scale: int) -> np.ndarray:
    """The codebooks at the start: parts of the vectors of the smallest ids, ties by the vector, null ids last."""
    found = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(n).select("v").collect()
    values = integers(np.array([r["v"] for r in found], np.float64), scale)
    values = np.pad(values, ((0, 0), (0, -values.shape[1] % parts)))
    return values.reshape(len(found), parts, -1).transpose(1, 0, 2).copy()


def _averaged(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: every part meets its nearest entry; each used entry becomes the floor of its parts' means.

    A task adds up its own parts; only sums by part and entry move and reach the driver.
    """
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, values in blocks(batches, parts, scale):
            for p in range(parts):
                rows_, _, weight = distinct(values[:, p])
                code = Trie(rows_, books[p]).code
                np.add.at(total[p], code, rows_ * weight[:, None])
                np.add.at(count[p], code, weight)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["p", "e", "n", "s"])

    made = rows.select("v").mapInArrow(sums, "p int, e int, n long, s array<long>")
    added = made.groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[k]) for k in range(width))).alias("s"))
    out = books.copy()
    for r in added.collect():  # at most parts x entries rows
        out[r["p"], r["e"]] = [s // r["n"] for s in r["s"]]
    return out


def codebooks(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Books | None:
    """Codebooks fitted on all usable vectors of the commonest length (of equally common ones the longer), or None without any."""
    found = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    common = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None
    kept = found.where(F.size("v") == common["d"])
    books = _first(kept, entries, parts, scale)
    for _ in range(rounds):
        books = _averaged(kept, books, scale)
    return Books(common["d"], books)


def digest(books: Books | None) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(b"" if books is None else ",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, books: Books | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """Codes of the vectors of `rows` by codebooks from `codebooks`.

    Method: a task cuts its vectors into parts and puts the distinct parts of
    a slice into a lexicographic trie for each part's place. A depth-first walk adds up
    distances to all entries, shared by all parts with a prefix; a leaf takes the
    nearest entry, the first of equally near ones. In training its sums count as
    often as the part occurs. Only sums by part and entry leave a task, so a round
    reads the vectors once and moves a table of fixed size.

    Result: id_col, code (two hex digits for each part; as many digits as the
    last entry needs, with more than 256), error (squared integer distance), label_error (errors of
    all rows of the label, null labels together), one row for each kept row.
    Rows leave whose vector is null, empty, holds a null or non-finite component,
    or is of another length than most. Lengths that don't divide into parts are
    filled up with zeros. Scaled components saturate at 2^30 / sqrt(length), so that
    errors are exact 64-bit integers. Repeated rows and ids are coded each by
    themselves; null ids stay. With no usable vector the result is empty.
    """
    typed = dict(rows.dtypes)
    if books is None:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {typed[id_col]}, code string, error long, label_error long")
    length, entries = books
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))
    found = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), label.alias("label")).where(usable(F.col("v")) & (F.size("v") == length))
    digits = max(2, len(f"{entries.shape[1] - 1:x}"))

    def encode(batches):
        names = [f"{e:0{digits}x}" for e in range(entries.shape[1])]
        for piece, values in blocks(batches, len(entries), scale):
            error, codes = np.zeros(piece.num_rows, np.int64), []
            for p, book in enumerate(entries):
                parts, place, _ = distinct(values[:, p])
                trie = Trie(parts, book)
                error += trie.error[place]
                codes.append([names[c] for c in trie.code[place]])
            code = ["".join(c) for c in zip(*codes, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(code), pa.array(error), piece.column("label")], ["id", "code", "error", "label"])

    coded = stored(found.mapInArrow(encode, f"id {typed[id_col]}, code string, error long, label string"))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALTS))
    return spread(coded, "label", salt, totals).select(F.col("id").alias(id_col), "code", "error", "label_error")
