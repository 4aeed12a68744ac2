"""Toxicity: Levenshtein automata over a lexicon trie, and windows that tell quotation from abuse."""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pricetide.llm.common import cut, whole

#: Labelled rows of each class that the lexicon and the weights are fitted on, at most; terms of the lexicon, at most.
FIT_ROWS, TERMS = 6000, 400
#: Least G-squared and least ratio of the shares of toxic and other texts that hold a term; least and most characters of a word start.
SIGNIFICANT, RATIO, STARTS = 25.0, 20.0, (4, 9)
#: Words on each side of a hit that its score reads.
AROUND = 6
#: Words by which a text reports others' words, in the corpus's four languages, and by which it turns to a reader.
REPORTS = frozenset("said says say called calls wrote word words term quote quoted quotes cited insult insults slur dit mot mots terme cite sagte sagt wort zitat nannte dijo dice palabra cita".split())
ADDRESS = frozenset("you your you're youre ur u are du dein bist tu ton es eres tú vous toi te ihr".split())
QUOTES = "\"“”„«»‘’"
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
FEATURES = 9


class Automaton:
    """All words within each term's edit distance of the lexicon, as one automaton made state by state.

    A state is a set of (trie node, edits so far): the Levenshtein automaton of
    the word read so far, intersected with the trie. Short terms allow no edit,
    longer ones one, the longest two. A term that ends in * matches any word
    that starts with it exactly.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.start: dict[int, str] = {}
        self.allowed = [0]
        for term in terms:
            bare, edits = term.rstrip("*"), 0 if term.endswith("*") else self.edits(term)
            node = 0
            for c in bare:
                self.allowed[node] = max(self.allowed[node], edits)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                node = self.children[node][c]
            self.allowed[node] = max(self.allowed[node], edits)
            (self.start if term.endswith("*") else self.term)[node] = term
        self.states: list[dict[str, int]] = [{}]
        self.sets: list[frozenset] = [self._close({(0, 0)})]
        self.numbers = {self.sets[0]: 0}
        self.out: list[tuple[str, int] | None] = [self._result(self.sets[0])]
        self.begun: list[str | None] = [None]

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """With the terms' characters that the word leaves out."""
        least: dict[int, int] = {}
        todo = sorted(states, key=lambda s: s[1])
        while todo:
            node, e = todo.pop(0)
            if least.get(node, 99) <= e or e > self.allowed[node]:
                continue
            least[node] = e
            todo += [(to, e + 1) for to in self.children[node].values() if e < self.allowed[node]]
        return frozenset(least.items())

    def _result(self, states: frozenset) -> tuple[str, int] | None:
        return min(((e, t) for node, e in states if (t := self.term.get(node)) and e <= self.edits(t)), default=None)

    def _step(self, state: int, c: str) -> int:
        to = set()
        for node, e in self.sets[state]:
            for d, child in self.children[node].items():
                if d == c:
                    to.add((child, e))
                elif e < self.allowed[node]:
                    to.add((child, e + 1))
            if e < self.allowed[node]:
                to.add((node, e + 1))
        closed = self._close(to)
        number = self.numbers.get(closed)
        if number is None:
            number = self.numbers[closed] = len(self.sets)
            self.sets.append(closed)
            self.states.append({})
            self.out.append(self._result(closed))
            self.begun.append(next((self.start[n] for n, e in closed if e == 0 and n in self.start), None))
        self.states[state][c] = number
        return number

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term, or None."""
        state = 0
        for c in word:
            state = self.states[state].get(c, -1) if c in self.states[state] else self._step(state, c)
            if self.begun[state]:
                return 0, self.begun[state]
            if not self.sets[state]:
                return None
        return self.out[state]


@dataclass
class Model:
    """What scoring needs; its size is bounded by TERMS."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))


class Features:
    """Counts of a text's hits by edits and by whether the words around quote or abuse."""

    def __init__(self, terms: list[str]):
        self.automaton = Automaton(terms)
        self.known: dict[str, tuple[int, str] | None] = {}
        self.starts: dict[str, bool] = {}

    def hit(self, word: str) -> tuple[int, str] | None:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known = {}
            self.known[word] = self.automaton.match(word)
        return self.known[word]

    def of(self, text: str) -> list[float]:
        low = text.lower()
        hits = {w for w in set(WORD.findall(low)) if self.hit(w)}
        out = [0.0] * FEATURES
        if not hits:
            return out
        spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
        words = [low[s:e] for s, e in spans]
        terms = set()
        for k, w in enumerate(words):
            if w not in hits:
                continue
            edits, term = self.known.get(w) or self.hit(w)
            terms.add(term)
            near = words[max(0, k - AROUND) : k] + words[k + 1 : k + 1 + AROUND]
            left, right = spans[max(0, k - AROUND)][0], spans[min(len(spans) - 1, k + AROUND)][1]
            before, after = low[left : spans[k][0]], low[spans[k][1] : right]
            quoted = any(c in QUOTES for c in before) and any(c in QUOTES for c in after) or any(n in REPORTS for n in near)
            out[(0 if not edits else 2) + quoted] += 1
            out[4] += any(n in ADDRESS for n in near)
        hit, clean = sum(out[:4]), out[0] + out[2]
        return [math.log1p(v) for v in out[:5]] + [math.log1p(len(terms)), float(out[0] > 0), clean / hit, math.log1p(1000 * hit / max(1, len(words)))]


def split(label_id: Column) -> Column:
    """True for held-out rows: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(label_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _in_order(rows: DataFrame, first: int) -> Iterator[Row]:
    """All rows of a sorted table in order: at first `first` of them are looked up, then, if they don't do, four times as many, and so on."""
    done, most = 0, first
    while True:
        got = rows.limit(most).collect()
        yield from got[done:]
        if len(got) < most:
            return
        done, most = most, 4 * most


def lexicon(sample: DataFrame, most: int = TERMS) -> list[str]:
    """Words, and starts of words (with *), that mark toxic texts of a labelled sample, at most `most`.

    The sample is bounded, and so are its candidate terms; they come to the
    driver by the thousand, the most telling first, until `most` are chosen.
    """
    words = F.array_distinct(F.split(F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}\p{N}'’]+", " "), " "))
    starts = F.flatten(F.transform(F.filter("w", lambda w: F.length(w) >= STARTS[0]), lambda w: F.array(*(F.concat(F.substring(w, 1, k), F.lit("*")) for k in range(STARTS[0], STARTS[1] + 1)))))
    terms = sample.select("toxic", words.alias("w")).select("toxic", F.explode(F.array_distinct(F.concat("w", starts))).alias("term")).where(F.length("term") >= 3)
    totals = sample.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()
    a, b = float(totals["a"] or 0), float(totals["b"] or 0)
    if not a or not b:
        return []
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    both = (x + y) / (a + b)
    part = lambda seen, n: F.when(seen > 0, seen * F.log(seen / (n * both))).otherwise(0.0) + F.when(seen < n, (n - seen) * F.log((n - seen) / (n * (1 - both)))).otherwise(0.0)
    found = terms.groupBy("term").agg(F.sum("toxic").alias("x"), F.sum(1 - F.col("toxic")).alias("y")).withColumn("ratio", (x / a) / ((y + 0.5) / b)).where(F.col("ratio") >= RATIO)
    rows = found.withColumn("g", 2 * (part(x, a) + part(y, b))).where(F.col("g") >= SIGNIFICANT)
    order = [F.desc("g"), F.col("term").endswith("*"), F.desc(F.length("term")), F.col("term")]
    chosen: list[tuple[str, int]] = []
    for r in _in_order(rows.orderBy(*order), 8 * most):
        if len(chosen) == most:
            break
        t, bare = r["term"], r["term"].rstrip("*")
        covered = any(c.endswith("*") and bare.startswith(c[:-1]) or bare == c for c, _ in chosen)
        wider = t.endswith("*") and any(c.rstrip("*").startswith(bare) and r["x"] < 1.5 * n for c, n in chosen)
        if not covered and not wider:
            chosen.append((t, r["x"]))
    return [t for t, _ in chosen]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> list[float]:
    """Weights and the constant of a ridge logistic regression, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x1.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + keep, x1.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon and weights from labelled rows that are not held out, at most `fit_rows` of each class by a hash of the id.

    The rest of the labels isn't needed for ten weights; the bound keeps what
    reaches the driver (ids, terms, features) at one size. Labels of null, or of
    an id that repeats with different labels, are left out. Of rows that repeat
    an id the text with the smallest hash is taken. Without documents, labels or
    one of the classes the model knows no terms or no weights, and scores 0.5.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(~split(F.col("id")))
    one = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("id", "toxic")
    picked = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(fit_rows) for k in (0, 1)]
    chosen = cut(picked[0].unionByName(picked[1]))
    found = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")).join(F.broadcast(chosen), "id")
    sample = cut(found.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"))
    terms = lexicon(sample)

    def features(batches):
        make = Features(terms)
        for batch in batches:
            yield pd.DataFrame([[float(t), *make.of(x)] for x, t in zip(batch["text"], batch["toxic"], strict=True)], columns=["toxic", *(f"f{k}" for k in range(FEATURES))])

    rows = sample.mapInPandas(features, "toxic double, " + ", ".join(f"f{k} double" for k in range(FEATURES))).toPandas().to_numpy()
    if not len(rows) or rows[:, 0].min() == rows[:, 0].max():
        return Model(terms)
    rows = rows[np.lexsort(rows.T)]
    return Model(terms, logistic(rows[:, 1:], rows[:, 0]))


def scored(text: Column, model: Model, spark) -> Column:
    """A score of 0 to 1 for every text; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make, w = Features(shared.value.terms), np.array(shared.value.weights)
        for texts in batches:
            x = np.array([make.of(t or "") for t in texts]).reshape(-1, FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    return score(text)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text by a fitted model.

    Method: each distinct word runs through one automaton, the Levenshtein
    automata of the lexicon's terms intersected with its trie, so misspelled
    terms are found at their number of edits. The words around a hit tell
    whether it is quoted or reported, or aimed at the reader. A logistic
    regression weighs the counts. Neither ids nor other columns are read.

    Result: id_col, score (0 to 1), predicted (1 from 0.5 on), one row for each
    input row. Null and empty texts score as texts without hits. Rows that
    repeat score alike, null ids too. An empty table gives an empty result.
    """
    score = scored(F.col(text_col), model, docs.sparkSession)
    return docs.select(F.col(id_col), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score 0.5 or more; all columns stay.

    A model that knows no weights rejects nothing. Null and empty texts count as
    texts without hits, null ids and repeated rows are like any others, and an
    empty table stays empty.
    """
    return docs.where(scored(F.col(text_col), model, docs.sparkSession) < 0.5) if any(model.weights) else docs
