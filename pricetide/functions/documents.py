"""A page's JSON documents as Python values: what Spark's variants hold, their texts, and the objects in them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pricetide.functions.plain import pattern


class Number(str):
    """A number that is no plain integer, as the text that Spark makes of it."""


Value = dict | list | str | Number | int | bool | None

# Digits of a decimal, and of a number's text; the least and the first too large integer of 64 bits.
MOST_DIGITS, MOST_CHARS, LEAST, PAST = 38, 1000, -(2**63), 2**63
_PLAIN = re.compile(r"-?[0-9]+\.[0-9]+\Z")
_LONE = re.compile("[\ud800-\udfff]")


def _double(value: float) -> Number:
    """A double as Java writes it."""
    if value != value or value in (float("inf"), float("-inf")):
        return Number({float("inf"): "Infinity", float("-inf"): "-Infinity"}.get(value, "NaN"))
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return Number(repr(value) if "e" not in repr(value) else f"{value:.17f}".rstrip("0"))
    digits, exponent = f"{value!r}e0".split("e")[:2] if "e" in repr(value) else f"{value:.16e}".split("e")
    if "e" not in repr(value):
        whole = repr(value).lstrip("-").replace(".", "").strip("0") or "0"
        digits = ("-" if value < 0 else "") + whole[0] + "." + (whole[1:] or "0")
    elif "." not in digits:
        digits += ".0"
    return Number(f"{digits}E{int(exponent)}")


def _real(text: str) -> Number:
    if len(text) > MOST_CHARS:
        raise ValueError("a number is too long")
    if _PLAIN.match(text):
        whole, part = text.lstrip("-").split(".")
        if len((whole + part).lstrip("0")) <= MOST_DIGITS and len(part) <= MOST_DIGITS:
            bare = text.rstrip("0").rstrip(".")
            return Number("0" if bare == "-0" else bare)
    return _double(float(text))


def _integer(text: str) -> int | Number:
    if len(text) > MOST_CHARS:
        raise ValueError("a number is too long")
    value = int(text)
    return value if LEAST <= value < PAST else Number(str(value)) if len(text.lstrip("-")) <= MOST_DIGITS else _double(float(text))


def _object(pairs: list[tuple[str, Value]]) -> dict[str, Value]:
    """An object's fields in the order of their keys; one that names a key twice is no document."""
    out = dict(sorted(pairs, key=lambda p: p[0]))
    if len(out) < len(pairs):
        raise ValueError("a key comes twice")
    return out


def _constant(text: str) -> None:
    raise ValueError(text)


_decoder = json.JSONDecoder(object_pairs_hook=_object, parse_float=_real, parse_int=_integer, parse_constant=_constant)
_BLANK = re.compile(r"[ \t\n\r]*")


def parsed(text: str) -> Value:
    """A document, null for what is none; what follows it isn't looked at."""
    try:
        return _decoder.raw_decode(text, _BLANK.match(text).end())[0]
    except (ValueError, RecursionError):
        return None


def text_of(v: Value) -> str | None:
    """A scalar but a text, as text; null for objects, arrays and null."""
    if type(v) is bool:
        return "true" if v else "false"
    return str(v) if type(v) in (int, Number) else None


def number(text: str | None) -> float | None:
    """A text as a number, null if it is none."""
    if text is None or not re.match(r"[\s]*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[dDfF]?[\s]*\Z", text):
        return None
    return float(text.strip().rstrip("dDfF"))


def whole(text: str | None) -> str | None:
    """A text whose halves of characters that stand alone are question marks, as in UTF-8 of Java."""
    return text if text is None or text.isascii() else _LONE.sub("?", text)


def json_text(v: Value) -> str:
    """A text as it is, any other value as JSON."""
    return v if type(v) is str else _json(v)


def _json(v: Value) -> str:
    if type(v) is dict:
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(x)}" for k, x in v.items()) + "}"
    if type(v) is list:
        return "[" + ",".join(map(_json, v)) + "]"
    return json.dumps(v, ensure_ascii=False) if type(v) is str or v is None else text_of(v)


_PAGE = pattern(r"(?s)^\s*(\{.*\}|\[.*\])\s*$")
_SCRIPT, _HEAD = pattern(r"(?is)<script\b[^>]*>.*?</script>"), pattern(r"(?i)^<script\b([^>]*)>")
_KIND = pattern(r"""(?i)\stype=["']?application/(ld\+)?json(;|["'\s]|$)|\sid=["']?__(next|nuxt)_data__(["'\s]|$)""")


def documents(html: str) -> list[str]:
    """Texts of a page's JSON scripts (linked data, plain JSON and the state of two known frameworks), or the page itself if it is JSON."""
    if html.lstrip(" \t\n\r\f\v")[:1] in ("{", "[") and _PAGE.search(html):
        return [html]
    scripts = ((m[0], _HEAD.search(m[0])) for m in _SCRIPT.finditer(html))
    return [s[head.end() : -len("</script>")] for s, head in scripts if head and _KIND.search(head[1])]


def nodes(html: str | None, depth: int) -> Iterator[tuple[str, dict[str, Value]]]:
    """path, node: every object down to `depth` levels in a page's documents; bad JSON has none."""
    for place, text in enumerate(() if html is None else documents(html)):
        top = parsed(text)
        level = [(str(place), top)] if type(top) in (dict, list) else []
        for k in range(depth + 1):
            below = []
            for path, node in level:
                if type(node) is dict:
                    yield path, node
                if k < depth:
                    below += [(f"{path}/{key}", v) for key, v in (node.items() if type(node) is dict else enumerate(node)) if type(v) in (dict, list)]
            if not (level := below):
                break
