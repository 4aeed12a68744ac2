"""The scalar rules that jobs apply within one pass over a page's text, as functions of Python texts; each gives what its Column form in `scalars` or `elements` gives."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache
from itertools import product

from pricetide.functions import scalars as S


def pattern(text: str, flags: int = 0) -> re.Pattern:
    """A pattern as Spark reads it: classes and letters' cases are those of ASCII, ends of words those of any script."""
    return re.compile(text.replace(r"\b", r"(?u:\b)"), re.ASCII | flags)


# Entities in the order in which they are decoded; numbers come after them.
_ENTITIES = tuple((pattern(p, re.IGNORECASE), char) for p, char in (("&nbsp;|&#160;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")))
_NUMBERED = pattern(r"(?i)&#x[0-9a-f]{1,6};|&#[0-9]{1,7};")
#: An ampersand in letters that a plain replacement would miss.
_ODD_AMP = pattern("&(?!amp;)(?i:amp;)")
_SCRIPT, _TAG = pattern(r"(?is)<(script|style)\b.*?</\1>"), pattern(r"<[^>]+>")
_SILENT, _MARKUP, _BARE = pattern(r"(?is)<(script|style|noscript)\b.*?</\1>"), pattern(r"(?s)<!--.*?-->|<[^>]*>"), pattern(r"<[^>]*>")
_SPACES = dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")
_HARD_SPACES = _SPACES | {0xA0: " "}
_WIDE, _HARD = pattern(r"[\t\n\v\f\r]"), pattern("[\t\n\v\f\r\u00a0]")


def _folded(text: str) -> str:
    """Runs of blanks as one, and none at the ends."""
    return " ".join([w for w in text.split(" ") if w])


@lru_cache(maxsize=4096)
def _char(entity: str) -> str:
    point = int(entity[3:-1], 16) if entity[2] in "xX" else int(entity[2:-1])
    if point > 0x10FFFF or 0xD800 <= point <= 0xDFFF:
        return entity
    return "" if point == 0xFEFF else chr(point)


def decoded(text: str | None) -> str | None:
    """Text with its named and numbered entities as characters."""
    if text is None or "&" not in text:
        return text
    for named, char in _ENTITIES:
        text = text.replace("&amp;", "&") if char == "&" and not _ODD_AMP.search(text) else named.sub(char, text)
    if "&#" in text:
        for entity in dict.fromkeys(_NUMBERED.findall(text)):
            text = text.replace(entity, _char(entity))
    return text


def text_of(html: str) -> str:
    """What a stretch of a page says: no scripts, styles and tags, entities decoded, white space folded."""
    bare = _TAG.sub(" ", _SCRIPT.sub(" ", html)) if "<" in html else html
    said = decoded(bare)
    return _folded(said.translate(_HARD_SPACES) if _HARD.search(said) else said)


def visible(html: str | None) -> str | None:
    """Text without scripts, styles and tags, named and numbered entities decoded, white space folded."""
    if html is None:
        return None
    bare = _SILENT.sub(" ", html) if "<" in html else html
    bare = (_MARKUP if "<!--" in bare else _BARE).sub(" ", bare) if "<" in bare else bare
    said = decoded(bare.replace("&euro;", "€"))
    return _folded(said.translate(_SPACES) if _WIDE.search(said) else said)


_AMOUNT = pattern(r"[0-9]{1,3}(?:(?:[ .,'’][0-9]{3})+)(?:[.,][0-9]{1,2})?|[0-9]{1,8}(?:[.,][0-9]{1,2})?")
_MARKS = pattern(r"[\s'’]")
MOST_CENTS, MOST_DIGITS = 10_000_000_000, 20


def price_values(text: str | None) -> list[int]:
    """Distinct amounts in cents in the order of the text; null gives none."""
    out: dict[int, None] = {}
    for raw in _AMOUNT.findall(text or ""):
        token = _MARKS.sub("", raw)
        whole = token.replace(".", "").replace(",", "")
        if len(whole) > MOST_DIGITS:
            continue
        tail = len(token) - max(token.rfind("."), token.rfind(",")) - 1 if len(whole) < len(token) else 0
        marks, both = len(token) - len(whole), "." in token and "," in token
        decimal = tail < 3 or (tail == 3 and marks == 2) if both else marks == 1 and tail < 3
        cents = math.floor(float(whole) * (10.0 ** (2 - tail) if decimal else 100.0) + 0.5)
        if 0 < cents < MOST_CENTS:
            out[cents] = None
    return list(out)


_CODES = tuple(code for code, _ in S.CURRENCIES)
# what stands between ends of words in a currency's pattern is a word in letters of any size, the rest a mark that counts anywhere
_NAMED = {"".join(w): k for k, (_, p) in reversed([*enumerate(S.CURRENCIES)]) for x in p.split("|") if x.startswith(r"\b") for w in product(*((c.lower(), c.upper()) for c in x.replace(r"\b", "")))}
_MARKED = tuple(("".join(w), k) for k, (_, p) in enumerate(S.CURRENCIES) for x in p.split("|") if not x.startswith(r"\b") for w in product(*({c.lower(), c.upper()} if c.isascii() else {c} for c in x.replace("\\", ""))))
_WORD = re.compile(r"\w+")
_CODE = pattern(r"\b([A-Z]{3})\b")
#: Numbers that are no digits, such as fractions: they end a word for Spark, and go on with it for Python.
_ENDING = {c: "\0" for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) in ("No", "Nl")}


def currency_rank(text: str) -> int:
    """The place, in the order in which they are tried, of the first currency that a text names; behind the last for none."""
    words = _WORD.findall(text if text.isascii() else text.translate(_ENDING))
    return min([_NAMED[w] for w in words if w in _NAMED] + [k for mark, k in _MARKED if mark in text], default=len(_CODES))


def detect_currency(text: str | None) -> str | None:
    return None if text is None or (rank := currency_rank(text)) == len(_CODES) else _CODES[rank]


@lru_cache(maxsize=1024)
def normalize_currency(text: str | None) -> str | None:
    """A detected currency, else the first three-letter word, else null."""
    if text is None:
        return None
    if found := detect_currency(text):
        return found
    code = _CODE.search(text.strip(" ").upper().translate(_ENDING))
    return code[1] if code else None


_LETTERS = {ord(c): form + " " * (c in S._MARKED) for c, form in zip(S._LETTERS, S._FORMS, strict=True)}
_OTHER = pattern("[^a-z0-9]+")


def plain_words(text: str | None) -> str:
    """Runs of a-z and 0-9 of a text in small letters and decomposed, one space between."""
    low = (text or "").lower()
    return _OTHER.sub(" ", low if low.isascii() else low.translate(_LETTERS))


@lru_cache(maxsize=4096)
def name_tokens(name: str | None) -> tuple[str, ...]:
    return tuple(t for t in plain_words(name).split(" ") if len(t) > 1)


def name_score(expected: str | None, candidate: str | None) -> float:
    """Share of the longer-than-one tokens of a name that a candidate contains; 0 without tokens."""
    tokens, words = name_tokens(expected), plain_words(candidate)
    return sum(t in words for t in tokens) / len(tokens) if tokens else 0.0


_NO_DIGIT, DIGITS, _RUN = pattern("[^0-9]"), pattern(r"[0-9]+\Z"), pattern(r"[0-9](?:[\s-]*[0-9])*")


def digits(text: str | None) -> str | None:
    return None if text is None else _NO_DIGIT.sub("", text)


def spaced(text: str, code: str):
    """Where each occurrence of a code of digits begins and ends in a text, blanks and dashes between its digits allowed, in order."""
    for run in _RUN.finditer(text):
        at = [k for k in range(run.start(), run.end()) if "0" <= text[k] <= "9"] if run.end() - run.start() >= len(code) else ()
        if at:
            plain = "".join([text[k] for k in at])
            k = plain.find(code)
            while k >= 0:
                yield at[k], at[k + len(code) - 1] + 1
                k = plain.find(code, k + 1)


@lru_cache(maxsize=256)
def _barcode(code: str) -> re.Pattern | None:
    try:
        return pattern("(?<![0-9])" + r"[\s-]*".join(code) + "(?![0-9])")
    except re.error:
        return None


def contains_barcode(text: str | None, code: str | None) -> bool:
    """The code in a text, with blanks or dashes between digits, and not inside a longer number."""
    if text is None or code is None:
        return False
    if not DIGITS.match(code):
        return bool((wanted := _barcode(code)) and wanted.search(text))
    digit = lambda k: 0 <= k < len(text) and "0" <= text[k] <= "9"
    return any(not digit(a - 1) and not digit(b) for a, b in spaced(text, code))
