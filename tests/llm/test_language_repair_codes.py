"""Language ID, conversation repair and vector codes against brute force and held-out labels."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricetide.llm import language_id, queries, repair, vector_codes

# --- 11 language ID


def test_language_held_out(spark, sf_dir):
    got = queries.op11_language_id(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert len(got) == len(docs)
    want = docs.set_index("doc_id")["lang"]
    out = [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]
    assert list(got["held_out"]) == out
    known = got[got["held_out"] & got["doc_id"].map(want).notna() & (got["lang_pred"] != "und")]
    right = known["lang_pred"] == known["doc_id"].map(want)
    assert right.mean() > 0.97
    assert got["score"].between(0, 1).all()
    assert known["score"][right].mean() > 0.9


def kneser_ney_by_definition(texts, order, vocabulary):
    """p(last | before) by the textbook's recursion over counted strings."""
    counts = [defaultdict(int) for _ in range(order + 1)]
    for t in texts:
        s = "\0" * (order - 1) + t
        for k in range(len(s) - order + 1):
            counts[order][s[k : k + order]] += 1
    for n in range(order - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1

    def p(gram):
        if not gram:
            return 1 / vocabulary
        level = counts[len(gram)]
        ones, twos = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = [c for g, c in level.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return (max(level.get(gram, 0) - d, 0) if gram in level else 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    return p


def test_language_probabilities_are_kneser_ney():
    texts = ["abracadabra", "banana bandana", "cab"]
    grams, n = language_id.ORDER, defaultdict(int)
    for t in texts:
        for piece in language_id.pieces(t):
            for row in np.lib.stride_tricks.sliding_window_view(piece, grams):
                n[tuple(row)] += 1
    levels = language_id.kneser_ney(np.array(list(n), np.uint32), np.array(list(n.values())))
    p = kneser_ney_by_definition([t.replace(" ", "\0") for t in texts], grams, 30)
    for gram in ["abrac", "anana", "zzzzz", "banax", "\0\0\0\0a", "\0band", "xxxab", "dabra"]:
        got = language_id.logarithms(levels, 30, np.array([[ord(c) for c in gram]], np.uint32))[0]
        assert abs(got - math.log2(p(gram))) < 1e-9, gram


def test_language_pieces_of_long_texts(monkeypatch):
    text = "Ab, c!  déf\n" * 50 + "7"
    whole = np.concatenate([p[language_id.ORDER - 1 :] for p in language_id.pieces(text)])
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(language_id, "PIECE", size)
        cut = list(language_id.pieces(text))
        assert np.array_equal(np.concatenate([p[language_id.ORDER - 1 :] for p in cut]), whole)
    assert not list(language_id.pieces(" 12 \n"))


def test_language_odd_rows(spark):
    schema = "doc_id long, text string, lang string, id int, bits int"
    words = {"xx": "lorem ipsum dolor sit amet", "yy": "żółw gęś jaźń łódź"}
    rows = [(k, " ".join(random.Random(k).choices(words[lang].split(), k=30)), lang, 1, 2) for lang in words for k in range(len(lang), 900, 3 if lang == "xx" else 4)]
    odd = [(None, "lorem ipsum", "xx", 0, 0), (5000, None, "xx", 0, 0), (5001, "", None, 0, 0), (5002, "12 345 !?", "yy", 0, 0), (5003, "lorem ipsum dolor " * 40_000, None, 0, 0), (5003, "lorem ipsum dolor " * 40_000, None, 0, 0), (5004, "ŁÓDŹ ŻÓŁW", "xx", 0, 0), (5005, "漢字仮名交じり文", None, 0, 0)]
    docs = spark.createDataFrame(rows + odd, schema).repartition(3)
    model = language_id.fit(docs)
    got = language_id.language_id(docs, model).collect()
    assert len(got) == len(rows + odd)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["lang"], r["rejected"]))
    assert by[None][0][0] == "xx" and by[5003] == [("xx", False)] * 2 and by[5004][0][0] == "yy"
    assert by[5000] == by[5001] == by[5002] == [("und", True)]
    assert by[5005][0][1]
    none = docs.where("false")
    assert language_id.language_id(none, language_id.fit(none)).count() == 0
    assert {r["lang"] for r in language_id.language_id(docs, language_id.fit(none)).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'xx'"))
    assert one.names == ["xx"] and one.weights is None


# --- 12 repair of conversations


def cheapest(rows):
    """Cost and edits by Dijkstra over (row, grammar state), least strings first."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, edits, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, edits
        step = lambda role: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2, (q, ""): q}.get((q, role))  # noqa: E731, B023
        for role in "ua":
            if step(role) is not None:
                heapq.heappush(heap, (cost + 2, edits + "I", i, step(role)))
        if i < len(rows):
            role, must_go, cut = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, q))
            if not must_go:
                if step(role) is not None:
                    heapq.heappush(heap, (cost + cut, edits + "K", i + 1, step(role)))
                for to in "ua":
                    if step(to) is not None:
                        heapq.heappush(heap, (cost + cut + 2, edits + "R", i + 1, step(to)))


def symbol(row):
    role, must_go, cut = row
    low = role if role in ("s", "u", "a") else "e" if not role else "x"
    return "d" if must_go else low.upper() if cut else low


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([False, False, False, True]), st.sampled_from([False, False, True])), max_size=14)


@settings(max_examples=300, deadline=None)
@given(ROWS)
def test_repair_search_is_cheapest(rows):
    assert repair.Search().best("".join(map(symbol, rows)), 0, repair.DONE) == cheapest(rows)


@settings(max_examples=100, deadline=None)
@given(ROWS, st.integers(1, 5))
def test_repair_chained_stretches(rows, size):
    search, chain, text = repair.Search(), repair.Chain(), "".join(map(symbol, rows))
    for at in range(0, len(text), size):
        chain.add(search.table(text[at : at + size]))
    assert min(v for (p, q), v in chain.all().items() if p == 0 and q in repair.DONE) == cheapest(rows)


def faulty(rows):
    """The damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute_repair(original):
    out = {}
    rows = faulty(original)
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            kinds.append((role[:1], fault < 2, fault == 2))
        cost, edits = cheapest(kinds)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        left, texts, last = iter(mine), [], ""
        for letter in edits:
            role, text = ("", "") if letter == "I" else next(left)[2:]
            if letter == "D":
                continue
            role = role if letter == "K" else "assistant" if last == "u" else "user"
            last = role[:1] or last
            texts.append(f"{role}:{text}")
        out[conv] = (gaps, *counts, illegal, cost, edits, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


SHOWN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_query(spark, sf_dir):
    got = {r["conv_id"]: tuple(r[c] for c in SHOWN) for r in queries.op12_repair(spark, sf_dir).collect()}
    assert got == brute_repair([tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def odd_conversations(seed=0, n=40, most=9):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uber"])
            text = rng.choice(["Yes.", "No!", "Why?", "so on", "", None, " \n\t", "Long " * 50 + ".", "Ends. \r\n"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repair_odd_rows(spark, seed, tmp_path):
    rows = odd_conversations(seed) + [(99, 2, "user", None)] + odd_conversations(seed)[:20]
    schema = "conv_id long, turn long, role string, text string, part int, same int, known string"
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[c] for c in SHOWN) for r in queries.op12_repair(spark, str(tmp_path)).collect()}
    assert got == brute_repair(rows)


def test_repair_long_conversation_over_partitions(spark):
    """One conversation holds most rows: it lies in several partitions and stretches."""
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Fine.", f"Row {t}.", f"cut {t}", ""])) for t in range(1500)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in (3, 9) for t in range(4)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        data = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
        parts = repair.pieces(repair.shapes(repair.keyed(data, "conv_id", "turn", "role", "text")), "bigint", "int").groupBy("conv").count().collect()
        got = {r["conv_id"]: r for r in repair.repair(data).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in parts if r["conv"] == 7) > 1
    seen, kinds = set(), []
    for _, _, role, text in rows[:1500]:
        gone = not text or (role, text) in seen
        seen.add((role, text))
        kinds.append((role[:1], gone, not gone and text[-1] not in ".!?"))
    assert (got[7]["cost"], got[7]["audit"]) == cheapest(kinds)
    assert got[3]["audit"] == got[9]["audit"] == "KKKK"


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "What?"), (1, 3, "assistant", "cut"), (2, 5, "assistant", "Alone.")]
    data = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = sorted(tuple(r) for r in repair.repaired_turns(data).collect())
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "What?"), (1, 3, "K", "assistant", "cut"), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Alone.")]
    assert repair.repair(data.where("false")).count() == 0 and repair.repaired_turns(data.where("false")).count() == 0


# --- 13 vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in kept]
    w = len(ints[0][1]) // parts
    books = [[v[p * w : p * w + w] for _, v, _ in ints[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            took = defaultdict(list)
            for _, v, _ in ints:
                part = v[p * w : p * w + w]
                took[near(part, book)[1]].append(part)
            books[p] = [[sum(c) // len(took[k]) for c in zip(*took[k])] if k in took else e for k, e in enumerate(book)]
    out, totals = {}, defaultdict(int)
    for i, v, label in ints:
        found = [near(v[p * w : p * w + w], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), label)
        totals[label] += out[i][1]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return {i: (code, error, totals[label]) for i, (code, error, label) in out.items()}, hashlib.sha256(text.encode()).hexdigest()


def vectors(n, dim=32, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in np.round(rng.normal(0, 0.02, dim), 2 if i % 3 else 5)], None if i % 7 == 0 else int(i % labels)) for i in rng.permutation(n)]


@pytest.mark.parametrize("n", [1, 40, 300])
def test_codes_against_brute_force(spark, tmp_path, n):
    rows = vectors(n) + [(1000, None, 1), (1001, [None] + [0.1] * 31, 1), (1002, [float("nan")] * 32, None), (1003, [float("inf")] + [0.0] * 31, 0), (1004, [0.5] * 8, 0), (1005, [], 0)]
    schema = "vec_id long, embedding array<float>, label int, id int, v string, code int"
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema).repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    want, digest = brute_codes(rows[:n])
    got = queries.op13_vector_codes(spark, str(tmp_path)).collect()
    if n == 1:  # the one of 32 components is as common as the shorter one, and longer
        assert len(got) == 1
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_repeat_and_empty(spark):
    rows = vectors(50)
    data = spark.createDataFrame(rows + rows[:5] + [(None, rows[0][1], 1)], "vec_id long, embedding array<float>, label int")
    books = vector_codes.codebooks(data)
    got = vector_codes.vector_codes(data, books).collect()
    assert len(got) == 56 and len({(r["vec_id"], r["code"]) for r in got}) == 51
    assert vector_codes.vector_codes(data.where("false"), vector_codes.codebooks(data.where("false"))).count() == 0
    assert vector_codes.vector_codes(data, None).count() == 0


def test_codes_of_odd_lengths_and_sizes(spark):
    rows = [(k, [float(k), 1e300 if k == 3 else -2.5, 0.125], 0) for k in range(5)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_codes.vector_codes(data, vector_codes.codebooks(data)).collect()
    assert {r["error"] for r in got} == {0} and {len(r["code"]) for r in got} == {32}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(1, 200))
def test_trie_walk(seed, width, n):
    rng = np.random.default_rng(seed)
    parts, _, weight = vector_codes.distinct(rng.integers(-4, 4, (n, width)))
    assert weight.sum() == n
    entries = rng.integers(-4, 4, (9, width))
    want = ((parts[:, None] - entries[None]) ** 2).sum(2)
    block, vector_codes.BLOCK = vector_codes.BLOCK, 5
    try:
        trie = vector_codes.Trie(parts, entries)
    finally:
        vector_codes.BLOCK = block
    assert np.array_equal(trie.code, want.argmin(1)) and np.array_equal(trie.error, want.min(1))
