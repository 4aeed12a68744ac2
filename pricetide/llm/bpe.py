"""BPE encoding and decoding: speculate tokens by longest match, verify them, merge exactly where that fails."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import per_row

#: Words that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Stands for the end of a word within token strings; a private-use character that no byte maps to.
END = ""
FAR = np.int64(1) << 40


def byte_characters() -> dict[int, str]:
    """The printable character of each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@dataclass
class Model:
    """A vocabulary as arrays that tasks share; its size is that of the vocabulary file."""

    tokens: list[str]
    special: dict[str, int]
    single: np.ndarray  # token of a byte, and of a byte that ends a word in the second row
    pair_keys: np.ndarray  # left * V + right of all merges, sorted
    pair_ranks: np.ndarray
    pair_results: np.ndarray
    left: np.ndarray  # parts of a merged token, -1 for a single byte
    right: np.ndarray
    rank: np.ndarray  # of the merge that makes a token, -1 for a single byte
    step_keys: np.ndarray  # node * 257 + byte of all trie steps, sorted; byte 256 ends a word
    step_nodes: np.ndarray
    node_tokens: np.ndarray  # the token that ends in a node, or -1


def _merge(model: Model, symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Exact merging: the lowest rank first, the leftmost of equals, one pair at a time."""
    n = len(symbols)
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    queue = [(*ranks[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in ranks]
    queue = [(r, i, p, made) for r, made, i, p in queue]
    heapq.heapify(queue)
    while queue:
        _, i, pair, made = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j < 0 or (symbols[i], symbols[j]) != pair:
            continue
        symbols[i], alive[j], after[i] = made, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for at in (before[i], i):
            if at >= 0 and after[at] >= 0 and (p := (symbols[at], symbols[after[at]])) in ranks:
                heapq.heappush(queue, (ranks[p][0], at, p, ranks[p][1]))
    return [s for s, a in zip(symbols, alive, strict=True) if a]


def _ranks(model: Model) -> dict[tuple[int, int], tuple[int, int]]:
    v = len(model.tokens)
    return {(int(k) // v, int(k) % v): (int(r), int(m)) for k, r, m in zip(model.pair_keys, model.pair_ranks, model.pair_results, strict=True)}


def load(path: str) -> Model:
    """Reads a BPE vocabulary whose words end in a suffix and whose characters stand for bytes."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, suffix = whole["model"]["vocab"], whole["model"]["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    v = 1 + max([*vocab.values(), *special.values()])
    tokens = [""] * v
    for text, number in [*vocab.items(), *special.items()]:
        tokens[number] = text
    chars = byte_characters()
    single = np.array([[vocab.get(chars[b], -1) for b in range(256)], [vocab.get(chars[b] + suffix, -1) for b in range(256)]], np.int64)
    left, right, rank = (np.full(v, -1, np.int64) for _ in range(3))
    pairs = []
    for r, pair in enumerate(whole["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        x, y, made = vocab[a], vocab[b], vocab[a + b]
        pairs.append((x * v + y, r, made))
        left[made], right[made], rank[made] = x, y, r
    keys, ranks, made = (np.array(c, np.int64) for c in zip(*sorted(pairs), strict=True))
    model = Model(tokens, special, single, keys, ranks, made, left, right, rank, *(np.zeros(0, np.int64) for _ in range(3)))

    # a token that its own bytes don't merge to is never proposed
    byte_of = {c: b for b, c in chars.items()}
    lookup, steps, ends = _ranks(model), {}, {0: -1}
    for text, number in vocab.items():
        if text in special:
            continue
        ended = text.endswith(suffix) and len(text) > len(suffix)
        raw = [byte_of[c] for c in (text.removesuffix(suffix) if ended else text)]
        symbols = [int(single[int(ended and k == len(raw) - 1), b]) for k, b in enumerate(raw)]
        if _merge(model, symbols, lookup) != [number]:
            continue
        node = 0
        for b in [*raw, *[256] * ended]:
            node = steps.setdefault((node, b), len(steps) + 1)
            ends.setdefault(node, -1)
        ends[node] = number
    walked = sorted((node * 257 + b, to) for (node, b), to in steps.items())
    model.step_keys, model.step_nodes = (np.array(c, np.int64) for c in zip(*walked, strict=True))
    model.node_tokens = np.array([ends[k] for k in range(len(ends))], np.int64)
    return model


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def propose(model: Model, flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest matches of all words at once: (word, token) in order of the words; words with no match at some byte.

    `flat` holds the bytes of all words, each followed by 256.
    """
    at, todo = begins.copy(), np.arange(len(begins))
    whose, what, lost = [], [], []
    while len(todo):
        place, node = at[todo].copy(), np.zeros(len(todo), np.int64)
        best, best_end = np.full(len(todo), -1, np.int64), place.copy()
        going = np.arange(len(todo))
        while len(going):
            found, hit = _find(model.step_keys, node[going] * 257 + flat[place[going]])
            going, to = going[hit], model.step_nodes[found[hit]]
            node[going] = to
            place[going] += 1
            token = model.node_tokens[to]
            ok = token >= 0
            best[going[ok]], best_end[going[ok]] = token[ok], place[going[ok]]
            going = going[place[going] < ends[todo[going]]]
        none = best < 0
        lost.append(todo[none])
        whose.append(todo[~none])
        what.append(best[~none])
        at[todo] = best_end
        todo = todo[~none & (best_end < ends[todo])]
    whose, what = np.concatenate(whose), np.concatenate(what)
    order = np.argsort(whose, kind="stable")
    return whose[order], what[order], np.concatenate(lost)


def compatible(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging keeps the border of each adjacent pair of tokens.

    Undoes the merges that touch the border in reverse order, on either side.
    At each moment the two symbols at the border must have no merge that comes
    before the merges that took them up: of equal ranks, the one on the left is first.
    """
    v = len(model.tokens)
    x, y = a.copy(), b.copy()
    x_until, y_until = np.full(len(x), FAR), np.full(len(x), FAR)
    good, going = np.ones(len(x), bool), np.arange(len(x))
    while len(going):
        found, hit = _find(model.pair_keys, x[going] * v + y[going])
        r = model.pair_ranks[found]
        bad = hit & (r < x_until[going]) & (r <= y_until[going])
        good[going[bad]] = False
        going = going[~bad]
        rx, ry = model.rank[x[going]], model.rank[y[going]]
        last_x, last_y = rx > ry, (ry >= rx) & (ry >= 0)
        gx, gy = going[last_x], going[last_y]
        x_until[gx], x[gx] = rx[last_x], model.right[x[gx]]
        y_until[gy], y[gy] = ry[last_y], model.left[y[gy]]
        going = going[last_x | last_y]
    return good


class Encoder:
    """Turns words into tokens and remembers them."""

    def __init__(self, model: Model, remembered: int = REMEMBERED):
        import re

        import regex

        self.model, self.remembered = model, remembered
        self.ranks: dict | None = None
        self.known: dict[str, tuple[int, str, str]] = {}
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+")
        self.any = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(model.special, key=len, reverse=True))) + ")") if model.special else None
        self.proposed = self.failed = 0

    def words(self, text: str) -> list[str]:
        """Words of a text in lower case; special tokens stay whole, with a mark before them."""
        import unicodedata

        found: list[str] = []
        for k, part in enumerate(self.special.split(text) if self.special and "<|" in text else [text]):
            if k % 2:
                found.append(END + part)
            elif part.isascii():
                found += self.ascii.findall(part.lower())
            else:
                part = unicodedata.normalize("NFC", part)
                found += self.any.findall((part.replace("Σ", "σ") if "Σ" in part else part).lower())
        return found

    def exact(self, word: bytes) -> list[int]:
        """Exact merging of one word: in a list if it is short, by a heap otherwise."""
        if self.ranks is None:
            self.ranks = _ranks(self.model)
            self.single, self.single_last = self.model.single.tolist()
            self.flat = {a * len(self.model.tokens) + b: (r << 20) + made for (a, b), (r, made) in self.ranks.items()}
        symbols = [self.single[b] for b in word]
        symbols[-1] = self.single_last[word[-1]]
        if len(symbols) > 48:
            return _merge(self.model, symbols, self.ranks)
        v, get, never = len(self.model.tokens), self.flat.get, 1 << 60
        ranks = [get(a * v + b, never) for a, b in zip(symbols, symbols[1:])]
        while ranks and (low := min(ranks)) != never:
            i = ranks.index(low)
            symbols[i : i + 2] = [low & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] * v + symbols[i], never)
            if i < len(ranks):
                ranks[i] = get(symbols[i] * v + symbols[i + 1], never)
        return symbols

    def encode(self, words: list[str]) -> list[list[int]]:
        """Tokens of distinct words, none of them special."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        ends = np.cumsum(lengths)
        flat = np.zeros(int(ends[-1]), np.int64)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        flat[inside] = np.frombuffer(b"".join(raw), np.uint8)
        flat[ends - 1] = 256
        whose, what, lost = propose(self.model, flat, ends - lengths, ends)
        same = whose[1:] == whose[:-1]
        pairs, back = np.unique(what[:-1][same] * len(self.model.tokens) + what[1:][same], return_inverse=True)
        good = compatible(self.model, pairs // len(self.model.tokens), pairs % len(self.model.tokens))[back]
        failed = np.zeros(len(words), bool)
        failed[lost] = True
        failed[whose[1:][same][~good]] = True
        self.proposed += len(words)
        self.failed += int(failed.sum())
        cuts = np.searchsorted(whose, np.arange(len(words) + 1)).tolist()
        every = what.tolist()
        out = [every[s:e] for s, e in zip(cuts, cuts[1:])]
        for k in np.flatnonzero(failed).tolist():
            out[k] = self.exact(raw[k])
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.remembered:
            self.known = {}
        new = [w for w in words if w not in self.known]
        tokens, special = self.model.tokens, self.model.special
        plain = [w for w in new if not w.startswith(END) or w[1:] not in special]
        for w in set(new).difference(plain):
            self.known[w] = (1, str(special[w[1:]]), w[1:])
        if plain:
            for w, ids in zip(plain, self.encode(plain), strict=True):
                self.known[w] = (len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids]))


def bpe(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """Every whole text as tokens of a public vocabulary, and decoded again.

    Method: texts split into words by the vocabulary's rules. Greedy longest
    match proposes each distinct word's tokens; vectorised checks test every
    adjacent pair of proposals; words with a pair that merging would not leave
    apart are merged exactly, be they few or, as in invented prose, most of the
    distinct words. A proposal whose pairs all hold is
    what merging gives, since no merge crosses a border and each token's own
    bytes merge to it. The vocabulary, whose size its file fixes, is broadcast.

    Result: id_col, n_tokens, then ids and decoded as text (ids and tokens
    joined by one space, as the vocabulary names no decoder), or with `digest`
    ids_sha256 and decoded_sha256. One row for each input row. Null and empty
    texts have no tokens. Rows are independent of each other; repeated ids stay
    repeated. Other columns are not read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def make() -> Callable[[list[tuple[Any, ...]]], list[tuple[Any, ...]]]:
        from hashlib import sha256

        encoder = Encoder(shared.value)

        def run(rows):
            split = [(i, encoder.words(t or "")) for i, t in rows]
            encoder.learn({w for _, words in split for w in words})
            out = []
            for i, words in split:
                parts = [encoder.known[w] for w in words]
                ids, text = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
                if digest:
                    ids, text = sha256(ids.encode()).hexdigest(), sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((i, sum([p[0] for p in parts]), ids, text))
            return out

        return run

    kind, names = dict(docs.dtypes)[id_col], ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    made = per_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, n_tokens long, {names[0]} string, {names[1]} string")
    return made.withColumnRenamed("id", id_col)
