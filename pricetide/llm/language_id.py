"""Language ID: interpolated Kneser-Ney models of characters, one for each language, in sorted hash arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import cut, per_row, stored, whole
from pricetide.llm.toxicity import logistic

#: Characters of the longest n-gram; languages learned, the commonest first; rows drawn for each, about; distinct longest n-grams that all models hold together.
ORDER, LANGUAGES, FIT_ROWS, GRAMS = 5, 256, 800, 1 << 21
#: Of this many drawn rows one calibrates the scores and is not counted; characters of the short pieces that calibrate beside whole texts.
CALIBRATE, SHORT = 4, 60
#: Characters that are scored at once; cells of the table of whole scores of known n-grams.
PIECE, CELLS = 1 << 18, 1 << 24
#: Distinct n-grams that a task counts before it passes them on.
COUNTED = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def codes(text: str) -> np.ndarray:
    """Code points of the lower-case text; every run of other characters than letters is one 0."""
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.where(letters()[found], found, 0)
    return found[(found != 0) | np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def pieces(text: str) -> Iterator[np.ndarray]:
    """The whole text's codes, PIECE characters at a time, each behind the ORDER - 1 codes before it (0 before the text)."""
    before = np.zeros(ORDER - 1, np.uint32)
    for at in range(0, len(text), PIECE):
        found = codes(text[at : at + PIECE])
        if len(found) and found[0] == 0 and before[-1] == 0:
            found = found[1:]
        if len(found):
            joined = np.concatenate([before, found])
            yield joined
            before = joined[1 - ORDER :]


def hashed(columns: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, whose characters are given column by column."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for column in columns:
        out = (out ^ column.astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Level:
    """One order of one language's model: sorted hashes with discounted shares, and sorted hashes of contexts with what they leave to the order below."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


@dataclass
class Model:
    """All languages' models over one vocabulary of characters, and what turns entropies into a score."""

    names: list[str]
    levels: list[list[Level]]
    vocabulary: int
    known: np.ndarray
    scores: np.ndarray
    usual: list[float]
    weights: list[float] | None


def found_at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the value is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def level(grams: np.ndarray, counts: np.ndarray) -> Level:
    """Absolute discounting of the counts of distinct n-grams, by the discount that their ones and twos give."""
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    context = hashed(grams[:, :-1].T) if grams.shape[1] > 1 else np.zeros(len(grams), np.uint64)
    names, place = np.unique(context, return_inverse=True)
    total = np.bincount(place, counts)
    keys = hashed(grams.T)
    order = np.argsort(keys)
    share = (counts - discount) / total[place]
    return Level(keys[order], share[order], names, discount * np.bincount(place) / total)


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels from one character to the longest n-grams; below these an n-gram counts once for each character that comes before it."""
    out = [level(grams, counts.astype(np.float64))]
    while grams.shape[1] > 1:
        grams, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)
        out.insert(0, level(grams, counts.astype(np.float64)))
    return out


def logarithms(levels: list[Level], vocabulary: int, grams: np.ndarray) -> np.ndarray:
    """log2 of the interpolated probability of each n-gram's last character after the others."""
    p = np.full(len(grams), 1.0 / vocabulary)
    for n, one in enumerate(levels, 1):
        part = grams[:, ORDER - n :].T
        at, there = found_at(one.contexts, hashed(part[:-1]) if n > 1 else np.zeros(len(grams), np.uint64))
        rest = np.where(there, one.rest[at], 1.0) if len(one.rest) else 1.0
        at, there = found_at(one.grams, hashed(part))
        p = rest * p + (np.where(there, one.share[at], 0.0) if len(one.share) else 0.0)
    return np.log2(p)


class Scorer:
    """Cross-entropies of texts by all languages' models."""

    def __init__(self, model: Model):
        self.model = model
        # where the hashes with each value of their first bits begin, so that a search starts at its place
        self.shift = np.uint64(64 - max(1, int(len(model.known)).bit_length()))
        self.first = np.searchsorted(model.known >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64))
        self.keys = np.append(model.known, np.uint64(2**64 - 1))

    def place(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As found_at in the known n-grams' hashes."""
        at = self.first[wanted >> self.shift]
        behind = np.flatnonzero(self.keys[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < wanted[behind]]
        return at, (self.keys[at] == wanted) & (at < len(self.model.known))

    def entropies(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """For each text bits a character by language, and characters read; a text without letters has none of them."""
        bits, n = np.zeros((len(texts), len(self.model.names))), [0] * len(texts)
        new, new_n = [], 0
        for k, text in enumerate(texts):
            for piece in pieces(text):
                at, there = self.place(hashed([piece[c : len(piece) - ORDER + 1 + c] for c in range(ORDER)]))
                bits[k] -= self.model.scores[at[there]].sum(0, dtype=np.float64)
                n[k] += len(at)
                if not there.all():
                    grams = np.lib.stride_tricks.sliding_window_view(piece, ORDER)[~there]
                    new.append((k, grams))
                    new_n += len(grams)
                    if new_n > PIECE:
                        self._add(bits, new)
                        new, new_n = [], 0
        self._add(bits, new)
        return [(b / max(m, 1), m) for b, m in zip(bits, n, strict=True)]

    def _add(self, bits: np.ndarray, new: list[tuple[int, np.ndarray]]) -> None:
        """Adds the bits of n-grams that are in no table of whole scores, of several texts at once."""
        if new:
            grams, row = np.concatenate([g for _, g in new]), np.repeat([k for k, _ in new], [len(g) for _, g in new])
            for k, levels in enumerate(self.model.levels):
                bits[:, k] -= np.bincount(row, logarithms(levels, self.model.vocabulary, grams), len(bits))

    def facts(self, entropies: np.ndarray, n: int) -> tuple[int, list[float]]:
        """The language of the lowest entropy, the first of equal ones, and what tells how sure that is."""
        best = int(entropies.argmin())
        others = np.delete(entropies, best)
        margin = min(float(others.min() - entropies[best]), 8.0) if len(others) else 8.0
        return best, [float(entropies[best]) - self.model.usual[best], margin, 1.0 / np.sqrt(n)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the language and the probability that it is right."""
        return [self._chosen(*found) for found in self.entropies([t or "" for t in texts])]

    def _chosen(self, entropies: np.ndarray, n: int) -> tuple[str, float]:
        if not n or not self.model.names:
            return UNDETERMINED, 0.0
        best, facts = self.facts(entropies, n)
        if self.model.weights is None:
            return self.model.names[best], 1.0
        z = float(np.dot(self.model.weights[:-1], facts) + self.model.weights[-1])
        return self.model.names[best], float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """True for rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drawn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit_rows: int, languages: int) -> DataFrame:
    """lang, text and fold of about `fit_rows` rows of each language, drawn by a hash of the id; one text an id and language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("id")))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    chance = F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(sizes), "lang").where(chance * F.col("count") < fit_rows)
    one = picked.groupBy("lang", "id").agg(F.min_by(whole(F.col("text")), F.xxhash64("text")).alias("text"))
    return cut(one.select("lang", "text", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(CALIBRATE)).cast("int").alias("fold")))


def counted(sample: DataFrame, grams: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language the commonest n-grams of its rows and their counts, at most `grams` of all languages together."""

    def count(batches):
        found: Counter = Counter()

        def out():
            rows = [(lang, gram, n) for (lang, gram), n in found.items()]
            found.clear()
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for piece in pieces(text):
                    s = piece.tobytes().decode("utf-32-le", "surrogatepass")
                    found.update((lang, s[k : k + ORDER]) for k in range(len(s) - ORDER + 1))
                    if len(found) > COUNTED:
                        yield out()
        yield out()

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts)
    names = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    out = {}
    for name in names:
        rows = counts.where(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(max(1, grams // len(names))).select("gram", "n").toPandas()
        if len(rows):
            text = "".join(rows["gram"])
            out[name] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER), rows["n"].to_numpy(np.int64)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, languages: int = LANGUAGES, grams: int = GRAMS) -> Model:
    """Models of the languages of `docs`, from rows that are not held out.

    About `fit_rows` rows of each of the `languages` commonest languages are drawn, whole
    texts; their n-grams are counted by Spark, and the commonest come to the
    driver, at most `grams` in all, so the model's size is bounded. One in CALIBRATE drawn
    rows isn't counted: whole and cut to a short piece, with and without its own
    language's model, it shows how entropy and margin tell right answers from
    wrong ones, and a logistic regression learns that. Null ids, languages and texts
    teach nothing. Without languages the model knows none and predicts `und`.
    """
    sample = drawn(docs, id_col, text_col, lang_col, fit_rows, languages)
    tables = counted(sample.where("fold > 0"), grams)
    names = list(tables)
    if not names:
        return Model([], [], 1, np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), [], None)
    vocabulary = len(np.unique(np.concatenate([g.ravel() for g, _ in tables.values()]))) + 1
    levels = [kneser_ney(*tables[name]) for name in names]
    # the whole scores of the commonest n-grams, so that most are looked up once and not once a language and order
    both = np.concatenate([np.concatenate([g, n[:, None].astype(np.uint32)], axis=1) for g, n in tables.values()])
    both = both[np.argsort(-both[:, -1].astype(np.int64), kind="stable")][: max(1, CELLS // len(names)), :-1]
    both = np.unique(both, axis=0)
    keys = hashed(both.T)
    order = np.argsort(keys)
    scores = np.stack([logarithms(one, vocabulary, both) for one in levels], axis=1).astype(np.float32)
    model = Model(names, levels, vocabulary, keys[order], scores[order], [0.0] * len(names), None)
    return calibrated(model, sample.where("fold = 0"))


def calibrated(model: Model, sample: DataFrame) -> Model:
    """`model` with each language's usual entropy and the weights of the score, from rows that were not counted."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer, names = Scorer(shared.value), shared.value.names

        def work(rows):
            out = []
            for lang, text in rows:
                if lang not in names:
                    continue
                middle = text[len(text) // 2 :][:SHORT]
                for entropies, n in scorer.entropies([text] if text == middle else [text, middle]):
                    if n:
                        out.append((names.index(lang), n, entropies.tolist()))
            return out

        return work

    rows = per_row(sample.select("lang", "text"), make, "lang int, n int, entropies array<double>").collect()
    rows = sorted((r["lang"], r["n"], r["entropies"]) for r in rows)
    for k in range(len(model.names)):
        own = [e[k] for lang, _, e in rows if lang == k]
        model.usual[k] = float(np.median(own)) if own else float(np.median([min(e) for _, _, e in rows])) if rows else 0.0
    scorer, x, y = Scorer(model), [], []
    for lang, n, e in rows:
        for hidden in (False, True):
            seen = np.array(e)
            if hidden:
                if len(seen) == 1:
                    continue
                seen[lang] = np.inf
            best, facts = scorer.facts(seen, n)
            x.append(facts)
            y.append(float(best == lang))
    if y and min(y) < max(y):
        model.weights = logistic(np.array(x), np.array(y))
    return model


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text by a fitted model.

    Method: texts are lower-case letters with single gaps. Each language has an
    interpolated Kneser-Ney model of its characters, kept as sorted arrays of
    n-gram hashes; all share one vocabulary. The language of the lowest bits a
    character is taken; a calibrated score, from how usual that figure is for the
    language, its margin and the length, is the probability that it is right, and
    below 0.5 the language is rejected. No column but the text is read.

    Result: id_col, lang (`und` where text is null or has no letter, or the model
    knows no language), score (0 for `und`), rejected; one row for each input row. Texts
    of any length are read in pieces. Equal entropies go to the language first in
    order. Repeated rows are predicted alike, null ids stay, and an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda rows: [(r[0], *found) for r, found in zip(rows, scorer.predict([r[1] for r in rows]), strict=True)]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = per_row(rows, make, f"id {dict(docs.dtypes)[id_col]}, lang string, score double")
    return found.select(F.col("id").alias(id_col), "lang", "score", (F.col("score") < 0.5).alias("rejected"))
