"""Line dedup against a brute force that tries every template of every line."""

import random
import re
from collections import defaultdict

import pytest

from pricetide.llm import line_dedup

WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lines_of(text):
    return [tuple("<*>" if re.search("[0-9]", w) else w for w in line.strip(" \t\r").split()) for line in (text or "").split("\n")]


def templates_of(t):
    """The line itself, and with each choice of variable places that the rule allows."""
    n = len(t)
    out = [(n, t)] if n >= 2 else []
    if n < 6:
        return out
    count = n if n < 12 else 8
    places = [set(range(j * n // count, (j + 1) * n // count)) for j in range(count)]
    starred = [(i,) for i in range(count)] + ([(i, j) for i in range(8) for j in range(i)] if n >= 12 else [])
    for stars in starred:
        gone = set().union(*(places[i] for i in stars))
        out.append((n, stars, tuple(None if k in gone else w for k, w in enumerate(t))))
    if n >= 12:
        half = (n - 2) // 2
        out += [(n, "first", t[: 2 + half]), (n, "second", t[:2] + t[2 + half :])]
    return out


def brute(texts, documents=3):
    """Lines to drop by document; every document here has a line of its own, so whole lines count by documents of different texts."""
    texts = dict(texts)
    holders, forms = defaultdict(set), defaultdict(set)
    for doc, text in texts.items():
        for t in lines_of(text):
            for template in templates_of(t):
                holders[template].add(doc)
                forms[template].add(t)
    recurs = {}
    for template, docs in holders.items():
        need = 2 if len(template) == 2 and template[0] >= 50 else documents
        if len({texts[d] for d in docs}) >= need and (len(template) == 2 or len(forms[template]) > 1):
            recurs[template] = min(docs)
    return {doc: sum(any(recurs.get(x, doc) != doc for x in templates_of(t)) for t in lines_of(text)) for doc, text in texts.items()}


def corpus(seed):
    rng = random.Random(seed)
    notices = [rng.sample(WORDS, n) for n in (2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 17, 24, 40, 55)]
    texts = []
    for doc in range(70):
        lines = [" ".join([f"own{'abcdefghij'[doc // 10]}{'abcdefghij'[doc % 10]}x", *rng.choices(WORDS, k=rng.randint(20, 30))])]
        for notice in rng.sample(notices, 5):
            words = list(notice)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(["12", "x7", *rng.choices(WORDS, k=3), f"v{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}"])
            lines.insert(rng.randint(0, len(lines)), " ".join(words))
        lines += rng.choice([[], [""], ["Title"], ["All rights reserved."], ["  \t"]])
        texts.append((doc, "\n".join(lines)))
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_templates_at_any_place(spark, seed):
    texts = corpus(seed)
    want = brute(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA).repartition(5)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(docs).collect()}
    assert got == want and sum(want.values()) > 50


def test_names_and_two_fields(spark):
    """A changing name, and a changing word in each half of a longer notice."""
    name = lambda k: "".join("bcdfghjklm"[int(c)] + "aeiou"[int(c) % 5] for c in f"{k:03}")
    rng = random.Random(5)
    texts = []
    for k in range(60):
        own = " ".join([f"own{name(k)}", *rng.choices(WORDS, k=25)])
        long = f"We thank our customer {name(200 + k)} for the order that was sent to the town of {name(300 + k)} today"
        texts.append(f"Dear {name(k)} welcome to our shop\n{own}\n{long}\nAll rights reserved.\nOnly")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = line_dedup.line_dedup(docs).toPandas().set_index("doc_id").sort_index()
    assert got["n_dropped"].tolist() == [0] + [3] * 59
    assert all(t.endswith("\nOnly") and len(t.split("\n")) == 2 for t in got["text"][1:])


def test_copies_with_a_field_stay(spark):
    """Two texts of one template aren't enough, however often they occur."""
    a, b = (" ".join(["Offer", w, "holds", "for", "all", "days", "of", "May"]) for w in ("one", "two"))
    docs = spark.createDataFrame([(i, a if i % 2 else b, "en", "s", 1) for i in range(40)], SCHEMA)
    assert line_dedup.line_dedup(docs).where("n_dropped > 0").count() == 0
