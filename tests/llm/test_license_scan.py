"""License scans against a scan that looks at every stretch, on long texts, and with full license texts."""

import random
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pricetide.llm import licenses

WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def every_stretch(words, template, coverage):
    """The first stretch that covers enough, then the same before and behind it; all stretches are tried."""
    need, size, counts, out, todo = coverage * len(template), int(len(template) * licenses.STRETCH) + 1, Counter(template), [], [(0, len(words))]
    while todo:
        low, high = todo.pop()
        for end in range(low, high):
            stretch = words[max(low, end - size + 1) : end + 1]
            shared = sum((Counter(stretch) & counts).values())
            closes = words[end] in counts and (end + 1 == high or words[end + 1] not in counts or shared == len(template))
            if shared >= need and closes and len(pairs := licenses.align(stretch, template)) >= need:
                s = max(low, end - size + 1) + pairs[0][0]
                e = s + pairs[-1][0] - pairs[0][0] + 1
                if len(more := licenses.align(words[s : min(high, s + size)], template)) > len(pairs):
                    pairs, s, e = more, s + more[0][0], s + more[-1][0] + 1
                out.append((len(pairs) / len(template), s, e))
                todo += [(low, s), (e, high)]
                break
    return out


def brute_scan(text, templates, coverage):
    found = licenses.words(text)
    only, hits, taken = [w for w, _, _ in found], [], []
    for name, template in templates.items():
        ws = [w for w, _, _ in licenses.words(template)]
        hits += [(-len(ws) * share, s, name, e, share) for share, s, e in every_stretch(only, ws, coverage)]
    for _, s, name, e, share in sorted(hits):
        if all(e <= t[0] or s >= t[1] for t in taken):
            taken.append((s, e, name, share))
    return [(found[s][1], found[e - 1][2], name, share) for s, e, name, share in sorted(taken)]


VOCABULARY = ["grant", "license", "copies", "holder", "notice", "permit", "the", "of"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(VOCABULARY), min_size=3, max_size=9), min_size=1, max_size=3), st.lists(st.sampled_from([*VOCABULARY, "x", "y", 0, 1, 2]), max_size=40), st.sampled_from([0.6, 0.8, 1.0]))
def test_scan_is_that_of_every_stretch(templates, pieces, coverage):
    named = {f"t{k}": " ".join(t) for k, t in enumerate(templates) if set(t) - licenses.COMMON}
    text = " ".join(p if isinstance(p, str) else " ".join(templates[p % len(templates)]) for p in pieces)
    spare = {name: (1 - coverage) * len(t.split()) for name, t in named.items()}
    # a template of common words alone beyond its coverage has no word that points to it
    named = {name: t for name, t in named.items() if sum(w not in licenses.COMMON for w in t.split()) > spare[name]}
    scanner = licenses.Scanner(named, coverage)
    assert scanner.scan(text) == brute_scan(text, named, coverage)


def test_text_full_of_notices():
    rng = random.Random(2)
    short = [t for t in licenses.TEMPLATES.values() if len(t) < 120]
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    took = []
    for n in (4_000, 16_000):
        text = " ".join(rng.choice(short) + " " + " ".join(rng.choices(WORDS, k=4)) for _ in range(n))
        began = time.process_time()
        assert len(scanner.scan(text)) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1


def test_full_license_texts(spark, tmp_path):
    """Templates of thousands of words from files; a copy with changed words in it is found at its place."""
    rng = random.Random(3)
    full = {name: " ".join(f"{name}x{k}y" if rng.random() < 0.3 else rng.choice(WORDS) for k in range(3000)) for name in ("long", "wide")}
    for name, text in full.items():
        (tmp_path / f"{name}.txt").write_text(text)
    templates = licenses.read_templates(spark, str(tmp_path))
    assert templates == full
    changed = [w if rng.random() > 0.05 else "changed" for w in full["long"].split()]
    before = " ".join(rng.choices(["other", "prose", "here"], k=500))
    docs = spark.createDataFrame([(1, f"{before} {' '.join(changed)} {before}"), (2, before), (3, full["wide"][: len(full["wide"]) // 2])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.licenses(docs, templates=templates).collect()}
    assert got[1]["licenses"] == "long" and got[1]["best_coverage"] > 0.9 and got[2]["licenses"] == got[3]["licenses"] == ""
    start, end = map(int, got[1]["spans"].split(":")[:2])
    assert abs(start - len(before) - 1) < 40 and abs(end - start - len(" ".join(changed))) < 80
