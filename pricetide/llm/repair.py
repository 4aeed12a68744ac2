"""Conversation structure repair: cheapest edits by iterative-deepening A* over stretches of a conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pricetide.llm.common import SLICE, spread, stored

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows that one search covers; searches that a task remembers; characters of a role and a text that order ties across partitions.
STRETCH, REMEMBERED, PREFIX = 32, 100_000, 64
#: Values that the rows of a text that recurs in a conversation are dealt over.
SALTS = 64
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. The role that leads from one to the next.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
DONE = frozenset({NOTHING, ASSISTANT})
LEGAL = frozenset({"su", "ua", "au"})
NAMES = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"
#: A conversation's rows are taken in this order, nulls first.
ORDER = ["turn", "lead", "head", "same"]


class Search:
    """Cheapest edits of stretches of rows, each row one symbol.

    Symbols: d must go; s, u, a and e are roles (e: no initial), x is any other; a
    capital is a truncated row of that role.
    """

    def __init__(self):
        self.known: dict[tuple, tuple[int, str] | None] = {}

    def best(self, rows: str, state: int, ends: frozenset) -> tuple[int, str] | None:
        """Cost and edits of the cheapest way from `state` to one of `ends`, of equal ones the least string; None without a way."""
        key = (rows, state, ends)
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = self._deepen(rows, state, ends)
        return self.known[key]

    @staticmethod
    def _reachable(rows: str, state: int, ends: frozenset) -> bool:
        # user and assistant can be inserted; a system row must be there
        return bool(ends & {USER, ASSISTANT}) or state in ends or SYSTEM in ends and state == NOTHING and "s" in rows.lower()

    def _deepen(self, rows: str, state: int, ends: frozenset) -> tuple[int, str] | None:
        """Depth-first searches under growing bounds; the first accepting path in the order of the edits' letters is the answer."""
        if not self._reachable(rows, state, ends):
            return None
        n = len(rows)
        # what the rows from i on cost at least: deletions, truncated rows, foreign roles; and how many system rows they hold
        least, systems = [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            c = rows[i]
            low = c.lower()
            least[i] = least[i + 1] + (DELETE if c == "d" else min(DELETE, (REROLE if low == "x" else 0) + (TRUNCATED if c != low else 0)))
            systems[i] = systems[i + 1] + (low == "s")

        def guess(i: int, q: int) -> int:
            return least[i] + min(REROLE, DELETE - TRUNCATED) * max(0, systems[i] - (q == NOTHING))

        failed: dict[tuple[int, int], int] = {}
        excess = 0

        def descend(i: int, q: int, left: int) -> str | None:
            """The edits from row i in state q at `left` or less."""
            nonlocal excess
            over = guess(i, q) - left
            if over > 0:
                excess = min(excess, over)
                return None
            if failed.get((i, q), -1) >= left:
                excess = min(excess, failed[i, q] + 1 - left)
                return None
            if i == n and q in ends:
                return ""
            for letter, to, state_, cost in self._edits(rows, i, q):
                if cost > left:
                    excess = min(excess, cost - left)
                elif (rest := descend(to, state_, left - cost)) is not None:
                    return letter + rest
            failed[i, q] = left
            return None

        bound = guess(0, state)
        while True:
            excess = 1 << 30
            found = descend(0, state, bound)
            if found is not None:
                return bound, found
            bound += excess

    @staticmethod
    def _edits(rows: str, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        """Letter, next row, next state and cost of the edits at row i, in the order of their letters."""
        if i < len(rows):
            yield "D", i + 1, q, DELETE
        for role in "au":
            if (q, role) in STEP:
                yield "I", i, STEP[q, role], INSERT
        if i < len(rows) and rows[i] != "d":
            low = rows[i].lower()
            extra = TRUNCATED if rows[i] != low else 0
            if low == "e":
                yield "K", i + 1, q, extra
            elif (q, low) in STEP:
                yield "K", i + 1, STEP[q, low], extra
            for role in "au":
                if (q, role) in STEP:
                    yield "R", i + 1, STEP[q, role], REROLE + extra

    def table(self, rows: str) -> dict[tuple[int, int], tuple[int, str]]:
        """The cheapest way of a stretch for each pair of states at its ends."""
        found = {(p, q): self.best(rows, p, frozenset({q})) for p, q in product(range(4), range(4))}
        return {k: v for k, v in found.items() if v is not None}


def chained(left: dict, right: dict) -> dict[tuple[int, int], tuple[int, str]]:
    """The tables of two stretches in a row as one. Of equal costs the least string of edits is kept, which stays right under further chaining."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for (p, q), (cost, edits) in left.items():
        for r in range(4):
            if (q, r) in right:
                more = (cost + right[q, r][0], edits + right[q, r][1])
                if (p, r) not in out or more < out[p, r]:
                    out[p, r] = more
    return out


class Chain:
    """Tables in a row, chained in pairs of like length, so that strings are copied seldom."""

    def __init__(self):
        self.stack: list[tuple[int, dict]] = []

    def add(self, table: dict) -> None:
        rank = 0
        while self.stack and self.stack[-1][0] == rank:
            table, rank = chained(self.stack.pop()[1], table), rank + 1
        self.stack.append((rank, table))

    def all(self) -> dict:
        out = {(q, q): (0, "") for q in range(4)}
        for _, table in self.stack:
            out = chained(out, table)
        return out


def keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, and what orders ties of a turn: lead and head (the starts of role and text), same (hash of conversation, role and text)."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    found = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"))
    same = F.concat_ws("\n", F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text")
    return found.withColumns({"lead": F.substring("role", 1, PREFIX), "head": F.substring("text", 1, PREFIX), "same": F.unhex(F.sha2(same, 256))})


def shapes(rows: DataFrame) -> DataFrame:
    """What searches need of the rows of `keyed`: order, symbol, initial, n of equal rows, again (role and text came in an earlier turn)."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "", "e").when(initial.isin("s", "u", "a"), initial).otherwise("x")
    trimmed = F.rtrim("text", F.lit(SPACES))
    symbol = F.when(trimmed == "", "b").when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    found = rows.select("conv", *ORDER, symbol.alias("symbol"), initial.alias("initial"))
    found = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = found.groupBy("same").agg(F.min(order).alias("first"))
    salted = spread(found, "same", F.pmod(F.xxhash64("turn"), F.lit(SALTS)), first)
    return stored(salted.withColumn("again", order > F.col("first")).drop("first"))


PIECE = "conv {}, part int, counts array<long>, low {turn}, high {turn}, first string, last string, keys array<int>, costs array<long>, edits array<string>"


class Piece:
    """The rows of one conversation in one partition, as they come in order: counts, and stretches chained into one table."""

    def __init__(self, conv):
        self.conv, self.chain, self.rows = conv, Chain(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.seen = 0
        self.low = self.high = self.first = self.last = None

    def add(self, search: Search, turn, symbol: str, initial: str, n: int, again: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        pair = self.last is not None and self.last + initial not in LEGAL
        self.illegal += pair + (n - 1) * (initial * 2 not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        self.seen += n
        if symbol == "b":
            self.blank += n
            gone, kept = n, ""
        elif again:
            self.duplicate += n
            gone, kept = n, ""
        else:
            self.duplicate += n - 1
            self.truncated += symbol != symbol.lower()
            gone, kept = n - 1, symbol
        if kept:
            self._push(search, kept)
        for _ in range(gone):
            self._push(search, "d")

    def _push(self, search: Search, symbol: str) -> None:
        if len(self.rows) == STRETCH:
            self.chain.add(search.table("".join(self.rows)))
            self.rows = []
        self.rows.append(symbol)

    def done(self, search: Search, part: int, alone: bool) -> tuple:
        """One row: with the answer alone if the conversation lies in this partition, else with its table."""
        rows = "".join(self.rows)
        if alone and not self.chain.stack:
            cost, edits = search.best(rows, NOTHING, DONE)
            table = {(NOTHING, ASSISTANT): (cost, edits)}
        else:
            self.chain.add(search.table(rows))
            table = self.chain.all()
        counts = [self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.seen]
        return self.conv, part, counts, self.low, self.high, self.first, self.last, [4 * p + q for p, q in table], [c for c, _ in table.values()], [e for _, e in table.values()]


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from batch.slice(at, SLICE).to_pylist()


def emitted(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    out = []
    for row in rows:
        out.append(row)
        if len(out) == SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def pieces(shaped: DataFrame, conv: str, turn: str) -> DataFrame:
    """One row for each conversation and partition of the rows in order.

    Range partitions cut a long conversation anywhere, so its searches run in
    many tasks. Only the first and the last conversation of a partition may go
    on in another one.
    """
    ddl = PIECE.format(conv, turn=turn)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def work(batches):
        part, search = TaskContext.get().partitionId(), Search()

        def rows():
            now, opening = None, True
            for r in in_slices(batches):
                if now is None or r["conv"] != now.conv:
                    if now is not None:
                        yield now.done(search, part, alone=not opening)
                        opening = False
                    now = Piece(r["conv"])
                now.add(search, r["turn"], r["symbol"], r["initial"], r["n"], r["again"])
            if now is not None:
                yield now.done(search, part, alone=False)

        yield from emitted(rows(), schema)

    ranges, within = (["conv", *ORDER[:3]], ["conv", *ORDER])
    dealt = shaped.repartitionByRange(*(F.col(c).asc_nulls_first() for c in ranges))
    return dealt.sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in within)).mapInArrow(work, ddl)


def combined(found: list[dict]) -> tuple[dict, int, str]:
    """Counts, cost and edits of a conversation from its pieces in order."""
    counts, low, high, first, last, chain = [0] * 6, None, None, None, None, Chain()
    for r in found:
        for k, n in enumerate(r["counts"]):
            counts[k] += n
        if high is not None and high == r["low"]:
            counts[4] -= 1
        if last is not None and r["first"] is not None:
            counts[3] += last + r["first"] not in LEGAL
        low, high = r["low"] if low is None else low, r["high"] if r["high"] is not None else high
        first, last = r["first"] if first is None else first, r["last"]
        chain.add({divmod(k, 4): (c, e) for k, c, e in zip(r["keys"], r["costs"], r["edits"], strict=True)})
    table = chain.all()
    cost, edits = min(table[NOTHING, q] for q in DONE if (NOTHING, q) in table)
    gaps = 0 if low is None else high - low + 1 - counts[4]
    names = dict(zip(("blank", "duplicate", "truncated", "illegal"), counts, strict=False))
    return {"gaps": gaps, **names}, cost, edits


def repaired(edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str | None, str | None]]:
    """Edit, role and text of each row of the repaired conversation, in order; deleted rows have no role and text."""
    q = NOTHING
    for letter in edits:
        if letter == "D":
            next(rows)
            yield letter, None, None
            continue
        role, text = ("", "") if letter == "I" else next(rows)
        if letter != "K":
            role = NAMES["a" if q == USER else "u"]
        q = STEP.get((q, role[:1]), q)
        yield letter, role, text


def _streamed(rows: DataFrame, conv: str, turn: str, role: str, text: str, make, schema: str) -> DataFrame:
    """The rows that `make(conv, pieces, rows)` yields for each conversation, from its pieces and then its rows in order.

    A conversation's texts go through one task as a stream, and its edits, one letter a row, are
    held there; no more of it is.
    """
    kinds = dict(rows.dtypes)
    known = keyed(rows, conv, turn, role, text)
    both = pieces(shapes(known), kinds[conv], kinds[turn]).unionByName(known, allowMissingColumns=True)
    order = [F.col("conv"), F.col("part").isNull(), F.col("part"), *(F.col(c).asc_nulls_first() for c in ORDER)]
    sorted_ = both.repartition("conv").sortWithinPartitions(*order).drop("lead", "head", "same", "turn")

    out = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches):
        stream = in_slices(batches)
        ahead = [next(stream, None)]

        def take(conv_, piece: bool):
            while (r := ahead[0]) is not None and r["conv"] == conv_ and (r["part"] is not None) == piece:
                ahead[0] = next(stream, None)
                yield r

        def rows_():
            while ahead[0] is not None:
                conv_ = ahead[0]["conv"]
                found = combined(list(take(conv_, True)))
                texts_ = ((r["role"], r["text"]) for r in take(conv_, False))
                yield from make(conv_, found, texts_)
                for _ in texts_:
                    pass

        yield from emitted(rows_(), out)

    return sorted_.mapInArrow(work, schema)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired text of every conversation.

    A conversation's rows are taken by turn, null turns first, ties by the first
    PREFIX characters of role and text, then by a hash of both. A row is blank, a
    duplicate of an earlier role and text, truncated, or in order. Kept roles
    must read (s?(ua)+)? by their initials: rows are kept, deleted, given another
    role, or empty ones inserted, at the least cost; of equal costs the least
    string of edits is taken.

    Method: iterative-deepening A*. Depth-first searches in the order of the
    edits' letters run under growing bounds, by an admissible estimate of what the further
    rows cost, and a table of states that failed at a remaining cost. A search
    covers STRETCH rows, for each pair of grammar states at its ends; stretches
    are chained by the states where they meet. A conversation of up to STRETCH rows that
    lies in one partition takes a single search.

    Scale: searches read rows without their texts, dealt by ranges of
    conversation and turn, so that one conversation's searches run in many tasks.
    The digest needs its texts in order, so they pass one task as a stream.

    Result: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit (letters of the edits in order),
    repaired_sha256 (of role:text, joined by newlines). Null roles and texts count
    as one space, a null conversation is one of its own, gaps are 0 if all turns are null. An empty
    role adds nothing to the initials. An empty table gives an empty result; other columns aren't read.
    """
    kind = dict(rows.dtypes)[conv_col]

    def make(conv_, found, texts):
        facts, cost, edits = found
        digest, started = hashlib.sha256(), False
        for letter, role, text in repaired(edits, texts):
            if letter != "D":
                digest.update((("\n" if started else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                started = True
        yield conv_, facts["gaps"], facts["blank"], facts["duplicate"], facts["truncated"], facts["illegal"], cost, edits, digest.hexdigest()

    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _streamed(rows, conv_col, turn_col, role_col, text_col, make, schema).withColumnRenamed("conv", conv_col)


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_col, turn_col (from 0), edit, role_col and text_col of every row that stays or was inserted.

    Rules, method and odd cases are those of `repair`.
    """
    kind = dict(rows.dtypes)[conv_col]

    def make(conv_, found, texts):
        at = 0
        for letter, role, text in repaired(found[2], texts):
            if letter != "D":
                yield conv_, at, letter, role, text
                at += 1

    found = _streamed(rows, conv_col, turn_col, role_col, text_col, make, f"conv {kind}, at long, edit string, role_ string, text_ string")
    return found.select(F.col("conv").alias(conv_col), F.col("at").alias(turn_col), "edit", F.col("role_").alias(role_col), F.col("text_").alias(text_col))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_col, turn_col, role_col and text_col of `rows` with faults, by crc32 of conversation and turn modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes its role user. Nulls count as one space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced(text_col), "[.!?]", "")).otherwise(spaced(text_col))
    role = F.when(fault == 4, "user").otherwise(spaced(role_col))
    times = F.when(fault == 3, 2).otherwise(1)
    found = rows.where(fault != 0).select(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), F.explode(F.array_repeat(F.lit(0), times)).alias("_time"))
    return found.select(conv_col, turn_col, role_col, text_col)
