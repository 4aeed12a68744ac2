"""Secret scans: patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import per_row

# The patterns, their order and least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
HINTS = ("passw", "secret", "token", "api")

#: Width of the window, and the least bits a character by class of the candidate.
WINDOW = 24
LEAST_BITS = {"hex": 3.0, "base64": 3.9}
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
CLASSES = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"))
HEX_ONLY = re.compile(r"(?:[0-9A-F-]+|[0-9a-f-]+)\Z")



def run_of(letters: str, least: int = 8) -> str:
    """A pattern of the first `least` letters in order, and of those that follow as far as they do."""
    rest = ""
    for c in reversed(letters[least:]):
        rest = f"(?:{c}{rest})?"
    return letters[:least] + rest


#: Parts of a candidate that are no secret: samples and runs in order. What lies on either side is looked at by itself.
RUNS = "|".join(map(run_of, (string.ascii_lowercase, string.ascii_uppercase, string.digits, string.digits[1:])))
SAMPLES = re.compile(r"(?i:example|sample|dummy|placeholder|changeme|xxxx+)|" + RUNS)
#: Whole pieces that are no secrets though they look random: identifiers, paths of words.
ALLOWED = (
    re.compile(r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\Z"),
    re.compile(r"\A[/_=-]*(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4})(?:[/_=-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}))+[/_=-]*\Z"),
)


def entropy_spans(text: str, windows: int, least: float) -> list[tuple[int, int]]:
    """Spans of the windows whose Shannon entropy is `least` bits or more, joined where they touch.

    The sum of c * log2(c) over character counts changes by two counts as the
    window moves on, so a step costs the same at any width.
    """
    if len(text) < windows:
        return []
    log = [0.0] + [c * math.log2(c) for c in range(1, windows + 1)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    most = (math.log2(windows) - least) * windows + 1e-9
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += log[n + 1] - log[n]
        if i >= windows:
            out = text[i - windows]
            n = counts[out]
            counts[out] = n - 1
            total += log[n - 1] - log[n]
        if i >= windows - 1 and total <= most:
            at = i - windows + 1
            if spans and spans[-1][1] >= at:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((at, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches that are long enough."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def outside(start: int, end: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of start..end that no cut covers; cuts are sorted and don't overlap."""
    out = []
    for a, b in cuts:
        if start < a:
            out.append((start, a))
        start = b
    return [*out, (start, end)] if start < end else out


def scan(text: str, window: int = WINDOW) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Pattern spans and entropy spans of a whole text, each sorted; the latter overlap none of the former.

    Pattern spans and then samples are cut out of a candidate, and the pieces
    left are looked at by themselves. Both lists rise, so one pass over each does.
    """
    base = sorted(base_spans(text))
    covered: list[tuple[int, int]] = []
    for start, _, end in base:
        if covered and start <= covered[-1][1]:
            covered[-1] = covered[-1][0], max(end, covered[-1][1])
        else:
            covered.append((start, end))
    added, at = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        cuts, k = [], at
        while k < len(covered) and covered[k][0] < end:
            cuts.append(covered[k])
            k += 1
        for a, b in outside(start, end, cuts):
            if any(p.match(text[a:b]) for p in ALLOWED):
                continue
            for c, d in outside(a, b, [x.span() for x in SAMPLES.finditer(text, a, b)]):
                s = text[c:d]
                if d - c < window or sum(1 for x in CLASSES if x.search(s)) < 2 or any(p.match(s) for p in ALLOWED):
                    continue
                kind = "hex" if HEX_ONLY.match(s) else "base64"
                added += [(c + x, 3, c + y) for x, y in entropy_spans(s, window, LEAST_BITS[kind])]
    return base, added


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Secrets in every whole text.

    Method: patterns for assigned passwords and keys, access identifiers and
    long hexadecimal strings, each leftmost and without overlaps by kind. Beyond
    them, candidate strings of 24 or more characters with at least two classes
    of letters and digits get a sliding window, whose Shannon entropy follows
    from counts that change by one character in and one out. Windows above the
    limit of the candidate's class (hexadecimal or wider) are joined to spans.
    An allow-list suppresses identifiers and word paths as a whole, and samples
    and ordered runs where they stand: they and pattern spans cut a candidate,
    and what is left on either side is looked at by itself.

    Result: id_col, n_assign, n_access, n_hex, n_entropy (long), base and spans
    (strings of kind:start:end by start, then kind; code points, end exclusive;
    base without entropy spans). One row for each input row, whatever its id;
    null and empty texts have no spans. Other columns are not read. An empty
    table gives an empty result.
    """

    def make() -> Callable:
        def run(rows):
            out = []
            for i, text in rows:
                base, added = scan(text or "", window)
                n = [sum(1 for s in base if s[1] == k) for k in range(3)]
                out.append((i, *n, len(added), joined(base), joined(sorted(base + added))))
            return out

        return run

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = per_row(rows, make, f"id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base string, spans string")
    return found.withColumnRenamed("id", id_col)
