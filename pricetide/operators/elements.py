"""Elements of pages: one pass over a page's tags, and the rules that read them: selectors, texts, attributes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-z][\w:-]*)\b(?P<head>[^>]*)>", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
ELEMENT = "struct<name:string,head:string,attributes:map<string,string>,start:int,inner:int,close:int,end:int,parent:int>"
#: Elements that hold their text in an attribute, in this order.
STATING = ("meta", "link", "input")
VALUES = ("content", "value")
#: Entities in the order in which they are decoded; numbers come after them.
ENTITIES = (("&nbsp;|&#160;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"))


def attributes_of(head: str) -> dict[str, str]:
    """Attributes of an opening tag by their names in small letters; the last of a name counts, and one without a value is empty."""
    return {name.lower(): a or b or c for name, a, b, c in ATTRIBUTE.findall(head)}


#: Tags, and facts of them, that a process keeps, and the longest heads of them: pages of one shop repeat them.
KEPT_TAGS, KEPT_CHARS = 4096, 400


@lru_cache(maxsize=KEPT_TAGS)
def _kept(name: str, head: str, keep: re.Pattern | None) -> dict[str, str] | None:
    """The attributes of a tag that meets the pattern `keep`, else None."""
    return attributes_of(head) if keep is None or keep.search(f"{name} {head}") else None


def spans_of(page: str, keep: re.Pattern | None) -> list[tuple]:
    """Every element in order: name, head, attributes, where its tag and its content begin, where the first end tag of its name begins and ends (the end of its own tag without one), and the place of the element around it (-1: none)."""
    tags = [(tag.start(), tag.end(), *tag.groups()) for tag in TAG.finditer(page)]
    closes: dict[str, tuple[int, int]] = {}
    rest = []
    for start, inner, closing, name, head in reversed(tags):
        name = name.lower()
        if closing:
            closes[name] = start, inner
        rest.append((start, inner, closing, name, head, closes.get(name)))
    out, around = [], []
    for start, inner, closing, name, head, end in reversed(rest):
        if closing:
            for depth in range(len(around) - 1, -1, -1):
                if around[depth][0] == name:
                    del around[depth:]
                    break
            continue
        attributes = (_kept if len(head) <= KEPT_CHARS else _kept.__wrapped__)(name, head, keep)
        if attributes is not None:
            out.append((name, head, attributes, start, inner, *(end or (-1, inner)), next((p for n, p in reversed(around) if p >= 0), -1)))
        if end and not head.rstrip().endswith("/"):
            around.append((name, len(out) - 1 if attributes is not None else -1))
    return out


def spans(html: Column, keep: str | None = None) -> Column:
    """`spans_of` as an array of ELEMENT, of the elements whose name and head meet the pattern `keep`; null has none. Places count characters from 0."""

    @F.pandas_udf(f"array<{ELEMENT}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wanted = None if keep is None else re.compile(keep, re.IGNORECASE)
        names = ("name", "head", "attributes", "start", "inner", "close", "end", "parent")
        for pages in batches:
            yield pages.map(lambda p: [] if p is None else [dict(zip(names, e, strict=True)) for e in spans_of(p, wanted)])

    return run(html)


#: Rows whose texts are Python objects at a time; the rest of a batch stays in Arrow's memory.
AT_A_TIME = 64


def passed(rows: DataFrame, keep: list[str], reads: list[str], rule: Callable[..., Iterable[tuple]], fields: str) -> DataFrame:
    """The columns to keep, once for each tuple (of `fields`) that `rule` makes of a row's columns `reads`: one pass over the rows, which no filter behind it takes anew."""
    made = StructType.fromDDL(fields)
    types = [f.type for f in to_arrow_schema(made)]
    names = [*keep, *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(k, AT_A_TIME)
                at, found = [], []
                for i, values in enumerate(zip(*(part.column(c).to_pylist() for c in reads), strict=True)):
                    for made_ in rule(*values):
                        at.append(i)
                        found.append(made_)
                if found:
                    columns = [pa.array(values, t) for values, t in zip(zip(*found, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at, pa.int32())) for c in keep), *columns], names)

    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in keep), *made.fields])
    return rows.select(*dict.fromkeys([*keep, *reads])).mapInArrow(run, schema)


def decoded(text: Column) -> Column:
    """Text with its named and numbered entities as characters, numbers of any base that pages use; a text without any is passed on as it is."""

    def named(t: Column) -> Column:
        out = t
        for pattern, char in ENTITIES:
            out = F.regexp_replace(out, f"(?i){pattern}", char)
        return F.when(t.contains("&"), out).otherwise(t)

    number = F.lit(r"(?i)&#x[0-9a-f]{1,6};|&#[0-9]{1,7};")

    def char(entity: Column) -> Column:
        hexed = F.when(F.lower(entity).startswith("&#x"), F.regexp_extract(entity, "(?i)x([0-9a-f]+)", 1)).otherwise(F.conv(F.regexp_extract(entity, "([0-9]+)", 1), 10, 16))
        point = F.conv(hexed, 16, 10).cast("long")
        valid = (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")).otherwise(entity)

    numbered = lambda t: F.when(t.contains("&#"), F.aggregate(F.array_distinct(F.regexp_extract_all(t, number, 0)), t, lambda x, entity: F.replace(x, entity, char(entity)))).otherwise(t)
    return F.get(F.transform(F.transform(F.array(text), named), numbered), 0)


def text_of(html: Column) -> Column:
    """What a stretch of a page says: no scripts, styles and tags, entities decoded, white space folded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(decoded(bare), r"[\s ]+", " "))


def between(html: Column, start: Column, end: Column) -> Column:
    """Characters from `start` up to `end`, counted from 0."""
    return F.substr(html, start + 1, end - start)


def stated(element: Column) -> Column:
    """What a meta, link or input element states: its content, else its value."""
    return decoded(F.coalesce(*(F.nullif(element["attributes"][name], F.lit("")) for name in VALUES)))


# A selector: a tag, an id, a class or an attribute with or without a value, or a tag and one of these.
SELECTOR = re.compile(r"""(?:(?P<tag>[a-z][\w-]*))?(?:#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[(?P<attribute>data-[\w-]+|itemprop|id|class)(?:=(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[\w.-]+)))?\])?""", re.IGNORECASE)


def first_selected(page: str | None, selector: str | None) -> tuple[str | None, str | None]:
    """Of the first element that a selector names: what it states (meta, link, input), and else its html up to the first end tag of its name.

    A selector that isn't one names nothing; an element that is never closed has its tag alone.
    """
    wanted = SELECTOR.fullmatch((selector or "").strip())
    if page is None or wanted is None or not wanted[0]:
        return None, None
    value = next((v for v in wanted.group("a", "b", "c") if v is not None), None)
    for tag in TAG.finditer(page):
        name = tag["name"].lower()
        if tag["end"] or (wanted["tag"] and wanted["tag"].lower() != name):
            continue
        has = attributes_of(tag["head"])
        own = (wanted["attribute"] or "").lower()
        if wanted["id"] and has.get("id") != wanted["id"] or wanted["class"] and wanted["class"] not in has.get("class", "").split() or own and (own not in has or value is not None and has[own] != value):
            continue
        if name in STATING:
            return has.get("content") or has.get("value") or has.get(own) or None, None
        end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, tag.end())
        return None, page[tag.start() : end.end() if end else tag.end()]
    return None, None


def selected_text(html: Column, selector: Column) -> Column:
    """The text of the first element that a selector names, nested elements included; of a meta, link or input element what it states. Null where none is."""

    @F.pandas_udf("stated string, html string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, selectors in batches:
            yield pd.DataFrame([first_selected(p, s) for p, s in zip(pages, selectors, strict=True)], columns=["stated", "html"], dtype=object)

    found = run(html, selector)
    return F.coalesce(decoded(found["stated"]), text_of(found["html"]))
