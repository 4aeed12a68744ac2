"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import per_row

# Short license notices as their publishers word them.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit": "Released under the MIT License.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}

#: Least share of a template's words that align in order; most words in a stretch, as a multiple of the template.
COVERAGE, STRETCH = 0.8, 1.5
#: Most license texts, in MB, that a folder of templates may hold.
TEMPLATE_MB = 16
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
#: Words too common to point to a notice.
COMMON = frozenset("a an and any are as at be by for from in is it its no not of on or such that the this to under use was with you".split())


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def rising(places: list[int]) -> list[int]:
    """Indices of a longest rising run of `places`, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    under: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        under.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            piles.append(i)
        else:
            tops[k], piles[k] = p, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = under[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, rising in both.

    Equal ends align first. Then words that occur once in each list are anchors
    where they rise in both, and the gaps between anchors align the same way. A
    gap without anchors and equal ends aligns nothing.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1}
        once = [(at[w], j) for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and w in at]
        anchors = [once[k] for k in rising([i for i, _ in once])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: [w for w, _, _ in words(text)] for name, text in sorted(templates.items())}
        self.counts = {name: Counter(ws) for name, ws in self.templates.items()}
        held = Counter(w for ws in self.templates.values() for w in set(ws))
        self.marks: dict[str, list[str]] = {}
        for name, ws in self.templates.items():
            for w in set(ws).difference(COMMON):
                self.marks.setdefault(w, []).append(name)
        # a text that holds a share of a template's words holds one of any set of its words that weighs more than the rest
        self.any = {}
        for name, ws in self.templates.items():
            spare, picked = len(ws) - coverage * len(ws), 0
            for w in sorted(set(ws).difference(COMMON), key=lambda w: (held[w], -len(w), w)):
                self.any.setdefault(w, []).append(name)
                picked += self.counts[name][w]
                if picked > spare:
                    break

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coverage) of notices in a whole text, by start; they don't overlap."""
        low = text.lower()
        if not any(w in low for w in self.any):
            return []
        found = words(text)
        only = [w for w, _, _ in found]
        seeds: dict[str, list[int]] = {}
        for i, w in enumerate(only):
            for name in self.any.get(w, ()):
                seeds.setdefault(name, []).append(i)
        hits = []
        for name, at in seeds.items():
            template = self.templates[name]
            reach = int(len(template) * STRETCH) + 1
            todo, start = [], 0
            for k in range(len(at)):
                if k + 1 == len(at) or at[k + 1] - at[k] > reach:
                    todo.append((max(0, at[start] - reach), min(len(only), at[k] + reach + 1)))
                    start = k + 1
            while todo:
                lo, hi = todo.pop()
                best = self._best(only, lo, hi, name)
                if best:
                    s, e, share = best
                    hits.append((share, len(template), s, e, name))
                    todo += [(lo, s), (e, hi)]
        taken: list[tuple[int, int, str, float]] = []
        held = bytearray(len(only))  # one mark a word
        for share, _, s, e, name in sorted(hits, key=lambda h: (-h[1] * h[0], h[2], h[4])):
            if not any(held[s:e]):
                held[s:e] = b"\1" * (e - s)
                taken.append((s, e, name, share))
        return [(found[s][1], found[e - 1][2], name, share) for s, e, name, share in sorted(taken)]

    def _best(self, only: list[str], lo: int, hi: int, name: str) -> tuple[int, int, float] | None:
        """The first stretch in lo..hi that covers enough of the template, with what follows if that covers more."""
        template, counts = self.templates[name], self.counts[name]
        n, need = len(template), self.coverage * len(template)
        size = int(n * STRETCH) + 1
        inside: Counter = Counter()
        shared = 0
        for i in range(lo, hi):
            w = only[i]
            if w in counts:
                inside[w] += 1
                shared += inside[w] <= counts[w]
            if i - size >= lo and (old := only[i - size]) in counts:
                shared -= inside[old] <= counts[old]
                inside[old] -= 1
            if shared >= need and w in counts and (i + 1 == hi or only[i + 1] not in counts or shared == n):
                first = max(lo, i - size + 1)
                pairs = align(only[first : i + 1], template)
                if len(pairs) >= need:
                    first += pairs[0][0]
                    more = align(only[first : min(hi, first + size)], template)
                    if len(more) > len(pairs):
                        return first + more[0][0], first + more[-1][0] + 1, len(more) / n
                    return first, first + pairs[-1][0] - pairs[0][0] + 1, len(pairs) / n
        return None


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from a folder of text files, full license texts say, named by the files; they travel with the tasks, so the folder is to be small.

    At most TEMPLATE_MB of texts are taken; a larger folder is an error.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt)?$", 1).alias("name"), "value")
    if (files.agg(F.sum(F.length("value"))).first()[0] or 0) > TEMPLATE_MB << 20:
        raise ValueError(f"more than {TEMPLATE_MB} MB of license texts in {path}")
    return {r["name"]: r["value"] for r in files.collect()}


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """License notices in every whole text.

    Method: rare words of a template point to the stretches of a text that may
    hold it. A stretch with enough of its words is aligned: words that occur
    once in both anchor the alignment on a longest rising run, the gaps between
    anchors align the same way, and the share of the template's words in the
    alignment is the coverage. Of overlapping notices the one that aligns most
    words stays. The templates, a fixed set or those of `read_templates`, travel with the
    tasks. Work grows with the text's length, however many notices it holds.

    Result: id_col, n_licenses (long), licenses (distinct names by name, comma-
    joined), best_coverage (double, 0 without a notice), spans
    (start:end:name:coverage in per cent, by start, comma-joined; code points,
    end exclusive). One row for each input row; null and empty texts have none.
    Other columns are not read. An empty table gives an empty result.
    """
    chosen = TEMPLATES if templates is None else templates

    def make() -> Callable:
        scanner = Scanner(chosen, coverage)

        def run(rows):
            out = []
            for i, text in rows:
                hits = scanner.scan(text or "")
                spans = ",".join(f"{s}:{e}:{n}:{round(100 * c)}" for s, e, n, c in hits)
                out.append((i, len(hits), ",".join(sorted({h[2] for h in hits})), max([0.0, *(h[3] for h in hits)]), spans))
            return out

        return run

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return per_row(rows, make, f"id {kind}, n_licenses long, licenses string, best_coverage double, spans string").withColumnRenamed("id", id_col)
