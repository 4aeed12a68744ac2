"""Cross-entropy difference of two matched n-gram models over one vocabulary, which grows with the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pricetide.llm.common import SLICE, stored

#: Word classes of the models' contexts (a power of two); weight of a class's own frequency in a pair's; what each word's count starts from.
CLASSES, PRIOR, START = 512, 4.0, 0.5
#: Bytes of text of a block, about: its words' counts are in memory at once.
BLOCK_BYTES = 48 << 20
#: Words that a worker remembers, words that a task holds before it adds them up, rows of a batch.
REMEMBERED, FLUSH, ROWS = 200_000, 1_000_000, 65_536
#: Kinds of a block's rows, in the order in which rows of one id come: counts of a word, the mark of a target id, a text.
COUNTS, MARK, TEXT = 0, 1, 2


class Words:
    """Words (ASCII lower case, split at ASCII white space) as XXH64 of their bytes, in signed form."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh64_intdigest
        self.low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(self.low).split()
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, digest = self.known, self.digest
        for w in set(words):
            if w not in known:
                known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)).view(np.int64)


def pairs(words: np.ndarray, classes: int) -> np.ndarray:
    """The pair (class before, own class) of each word, as before * classes + own; class `classes` begins a text."""
    own = words & (classes - 1)
    return np.concatenate(([classes], own))[: len(own)] * classes + own


class Counts:
    """How often words occur in all texts of a block and in those of the target."""

    def __init__(self):
        self.words: list[np.ndarray] = []
        self.targets: list[np.ndarray] = []
        self.held = 0
        self.sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, words: np.ndarray, target: bool) -> None:
        self.words.append(words)
        self.targets.append(np.full(len(words), target, np.int8))
        self.held += len(words)
        if self.held >= FLUSH:
            self.fold()

    def fold(self) -> None:
        if self.held:
            words = np.concatenate(self.words)
            self.sums.append(self.summed(words, np.ones(len(words), np.int64), np.concatenate(self.targets)))
        self.words, self.targets, self.held = [], [], 0

    @staticmethod
    def summed(words: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(words, kind="stable")
        words = words[order]
        at = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        return words[at], np.add.reduceat(n[order], at), np.add.reduceat(t[order], at, dtype=np.int64)

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        self.fold()
        if self.sums:
            yield from sent(block, *self.summed(*(np.concatenate(c) for c in zip(*self.sums, strict=True))))


def sent(block: int, words: np.ndarray, n: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(words), ROWS):
        part = [c[s : s + ROWS] for c in (words, n, t)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), block, np.int32)), *map(pa.array, part)], ["block", "word", "background", "target"])


def texts(part: pa.RecordBatch, mark: list) -> Iterator[tuple]:
    """(id, text, whether the target holds the id) of a block's texts, which come by id and after their mark; mark[0] is the last."""
    for kind, i, text in zip(*(part.column(c).to_pylist() for c in ("kind", "id", "text")), strict=True):
        if kind == MARK:
            mark[0] = i
        else:
            yield i, text, i == mark[0]


def counts(dealt: DataFrame, classes: int) -> DataFrame:
    """block, word, background, target of the words of each block; block -1 holds the class pairs, to be added up over its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = Words(), np.zeros((2, (classes + 1) * classes), np.int64)
        now, mark, held = None, [known], Counts()
        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
            for s, e in zip(edges, edges[1:]):
                if block[s] != now:
                    yield from held.batches(now)
                    now, mark, held = int(block[s]), [known], Counts()
                for at in range(s, e, SLICE):
                    for _, text, target in texts(batch.slice(at, min(SLICE, e - at)), mark):
                        words = known.of(text)
                        if len(words):
                            np.add.at(table[0], both := pairs(words, classes), 1)
                            if target:
                                np.add.at(table[1], both, 1)
                            held.add(words, target)
        yield from held.batches(now)
        at = np.flatnonzero(table[0])
        yield from sent(-1, at, table[0][at], table[1][at])

    return dealt.mapInArrow(run, "block int, word long, background long, target long")


def contexts(table: np.ndarray, distinct: np.ndarray, prior: float, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Of both models: -log p(class | class before), and log of the divisor of a word's count in its class.

    `table` holds [model, class before, class] counts, `distinct` the words of each class.
    """
    own, before = table.sum(1), table.sum(2)
    alone = (own + 1.0) / (own.sum(1, keepdims=True) + own.shape[1])
    pair = -np.log((table + prior * alone[:, None, :]) / (before[:, :, None] + prior))
    return pair, np.log(np.maximum(own + start * distinct, start))


class Target:
    """Counts of the target model, to be lessened by those of a text of its own."""

    def __init__(self, table: np.ndarray, distinct: np.ndarray, prior: float, start: float):
        self.table, self.own, self.before = table.ravel(), table.sum(0), table.sum(1)
        self.distinct, self.prior, self.start = distinct, prior, start

    def loss(self, words: np.ndarray, both: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """-log p of each word of a text; `counts` are its words' counts in the target, this text's own among them."""
        classes, n = len(self.own), len(words)
        before, own = np.divmod(both, classes)
        less = lambda x: (u := np.unique(x, return_inverse=True, return_counts=True))[2][u[1]]
        of_class = self.own[own] - np.bincount(own, minlength=classes)[own]
        alone = (of_class + 1.0) / (self.own.sum() - n + classes)
        pair = (self.table[both] - less(both) + self.prior * alone) / (self.before[before] - np.bincount(before, minlength=classes + 1)[before] + self.prior)
        return np.log(of_class + self.start * self.distinct[own]) - np.log(pair) - np.log(counts - less(words) + self.start)


def lm_score(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, leave_out: bool = True
) -> DataFrame:
    """Per-token loss under a target model less that under a background model.

    Method: two class-bigram models are matched in all but their text. A word's
    probability is that of its class after the class before it, times the word's
    share of its class. Both share one vocabulary: every distinct word of the
    corpus, known by its 64-bit hash. The background model counts all documents,
    the target model those whose id is in `target` (id_col). A class pair is
    smoothed by the class's own frequency, a word's count starts from START. With
    `leave_out` a document of the target is scored by the target's counts less
    its own, so that it gains nothing from being there itself.

    The vocabulary grows with the corpus and is never in one place. Texts are
    dealt to blocks of about `block_bytes` by id and text. Target ids meet the
    documents' ids and blocks, without texts, and go to the blocks as marks ahead
    of their documents. A block adds up its own words; the blocks' counts are
    added up by word, and each block gets the totals of its own words, ahead of
    its texts, which stream past them. The classes' pairs, fixed in number, come
    to the driver. The plan is the same at every size.

    Result: id_col, n_tokens, loss_target, loss_background, score (the mean
    difference; lower is closer to the target), one row for each input row.
    Texts without words, null included, have 0 for all. A null id is never in
    the target; rows that repeat an id of the target all belong to it, and each
    leaves out itself alone. Without targets the target model knows no counts.
    Other columns are not read. An empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, -(-total // block_bytes))
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block")
    rows = docs.select(block, F.lit(TEXT).alias("kind"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = target.select(F.col(id_col).cast(kind).alias("id")).where(F.col("id").isNotNull()).distinct()
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    marks = stored(rows.select("block", "id").distinct().join(chosen, "id").select("block", F.lit(MARK).alias("kind"), "id", none("text", "string")))
    deal = lambda all_: all_.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "id", "kind")
    counted = stored(counts(deal(rows.unionByName(marks)), classes))

    words = counted.where("block >= 0")
    totals = stored(words.groupBy("word").agg(F.sum("background").alias("background"), F.sum("target").alias("target")))
    vocabulary = words.select("block", "word").join(totals.hint("merge"), "word")
    table, distinct = np.zeros((2, (classes + 1) * classes)), np.zeros(classes)
    for c in counted.where("block < 0").groupBy("word").agg(F.sum("background"), F.sum("target")).toArrow().to_batches():
        at, n, t = (v.to_numpy() for v in c.columns)
        table[0, at], table[1, at] = n, t
    for c, n in totals.groupBy(F.col("word").bitwiseAND(F.lit(classes - 1)).alias("c")).count().collect():
        distinct[c] = n
    table = table.reshape(2, classes + 1, classes)
    shared = spark.sparkContext.broadcast((*contexts(table, distinct, prior, START), Target(table[1], distinct, prior, START)))

    ahead = vocabulary.select("block", F.lit(COUNTS).alias("kind"), none("id", kind), none("text", "string"), "word", "background", "target")
    behind = (rows.unionByName(marks) if leave_out else rows).select("*", none("word", "long"), none("background", "long"), none("target", "long"))
    schema = f"id {kind}, n_tokens long, loss_target double, loss_background double, score double"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pair, divisor, own), known = shared.value, Words()
        flat = pair.reshape(2, -1)
        now, mark, held, keys, seen, loss = None, [known], [], np.zeros(0, np.int64), np.zeros(0), np.zeros((2, 0))
        for batch in batches:
            block, late = batch.column("block").to_numpy(), batch.column("kind").to_numpy() != COUNTS
            edges = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (late[1:] != late[:-1]), [True])))
            for s, e in zip(edges, edges[1:]):
                part = batch.slice(s, e - s)
                if block[s] != now:
                    now, mark, held = block[s], [known], []
                if not late[s]:
                    held.append([part.column(c).to_numpy() for c in ("word", "background", "target")])
                    continue
                if held:
                    keys, *both = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(keys)
                    keys, both, held = keys[order], np.stack(both)[:, order], []
                    loss, seen = divisor[:, keys & (classes - 1)] - np.log(both + START), both[1]
                for at in range(0, part.num_rows, SLICE):
                    found = []
                    for i, text, target in texts(part.slice(at, SLICE), mark):
                        w = known.of(text)
                        b, t = 0.0, 0.0
                        if len(w):
                            places, two = np.searchsorted(keys, w), pairs(w, classes)
                            b, t = (loss[:, places] + flat[:, two]).mean(1).tolist()
                            if target:
                                t = float(own.loss(w, two, seen[places]).mean())
                        found.append((i, len(w), t, b, t - b))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    return deal(ahead.unionByName(behind)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
