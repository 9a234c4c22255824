"""Repair of damaged conversations: the cheapest edits that make roles a legal sequence.

A legal conversation is empty, or a system turn at most and then user and assistant in turn, ending with an assistant. A turn may be
kept (0), given the role user or assistant (1) or deleted (2); a blank or repeated one must be deleted, a truncated
one that stays costs 5 more, and an empty user or assistant turn can be inserted anywhere for 5.

What was seen so far is one of four states (nothing, system, user, assistant), and a turn is one of a few symbols (its role and
fault), so a turn is a 4 x 4 matrix of costs and turns follow each other by min-plus products. Equal consecutive symbols are a
run, and a run is passed through the binary powers of its matrix, which are kept. Costs are passed from the last turn to
the first; then the choices are unrolled from the first on, the least letter first where edits cost the same, which
gives the least audit of all cheapest ones.

Turns are sorted over all tasks by range, numbered and stored. Up to ``SEGMENT`` turns in a row make a segment; a conversation
may span many segments and tasks. A segment is one string of symbols; a conversation's segments are read as a stream, backwards for
the costs and forwards for the choices. Texts stay out of this: they meet their edits segment by segment, and only
those of a conversation that spans segments move once more, as chunks, to be hashed in order.

Defined cases: nulls are one space (a role of one space can't be kept); turns of one number follow by role and text, null
numbers first; a conversation without turns has zeros, an empty audit and no text; null is a conversation of its own; other
columns are not kept; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from postlab.llm.store import stored

KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: More than any conversation can cost.
FAR = 1 << 60
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that may be named or inserted behind a state, and the state behind it.
DUE = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Kept turns by state and role initial.
LEGAL = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Symbol of a turn that must go. Others are the role initial (x for any other), in capitals for a truncated turn.
GONE = "-"
#: Turns of a segment, as a power of two; bytes of a chunk of text.
SEGMENT_BITS, CHUNK = 12, 1 << 20
_WHITE = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


def _inserts() -> Matrix:
    """Costs of any number of inserted turns."""
    one = tuple(tuple(0 if j == i else INSERT if j == DUE[i][1] else FAR for j in range(4)) for i in range(4))
    return times(times(one, one), times(one, one))


def choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state behind it) of a turn, by letter."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        more = TRUNCATED if symbol.isupper() else 0
        if (state, symbol.lower()) in LEGAL:
            out.append(("K", KEEP + more, LEGAL[state, symbol.lower()]))
        out.append(("R", RENAME + more, DUE[state][1]))
    return out


_FREE = _inserts()
_END = applied(_FREE, (0, FAR, FAR, 0))


@functools.cache
def power(symbol: str, k: int) -> Matrix:
    """2 ** k turns of one symbol, inserted turns before each included."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    turn = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, then in choices(symbol, state):
            turn[state][then] = min(turn[state][then], cost)
    return times(_FREE, tuple(map(tuple, turn)))


def before_run(symbol: str, n: int, after: Vector) -> Vector:
    k = 0
    while n:
        if n & 1:
            after = applied(power(symbol, k), after)
        n, k = n >> 1, k + 1
    return after


def runs_of(symbols: str) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in same)) for s, same in itertools.groupby(symbols)]


@functools.lru_cache(1 << 14)
def costs(symbols: str, after: Vector) -> Vector:
    """Least cost from each state, before these turns, given those behind them."""
    for symbol, n in reversed(runs_of(symbols)):
        after = before_run(symbol, n, after)
    return after


@functools.lru_cache(1 << 14)
def unrolled(symbols: str, after: Vector, state: int, last: bool) -> tuple[str, int]:
    """The least cheapest edits from a state, and the state behind them. ``last``: nothing follows, so turns may be inserted."""
    runs, behind = runs_of(symbols), []
    for symbol, n in reversed(runs):
        behind.append(after)
        after = before_run(symbol, n, after)
    out = []
    for (symbol, n), end in zip(runs, reversed(behind)):
        here = [end]
        for _ in range(n):
            here.append(applied(power(symbol, 0), here[-1]))
        for now, then in zip(here[:0:-1], here[-2::-1]):
            while True:
                options = choices(symbol, state)
                edit, cost, to = options[0]
                if cost + then[to] == now[state]:
                    break
                if INSERT + now[DUE[state][1]] == now[state]:
                    out.append("I")
                    state = DUE[state][1]
                    continue
                edit, cost, to = next(o for o in options[1:] if o[1] + then[o[2]] == now[state])
                break
            out.append(edit)
            state = to
    while last and _END[state]:
        out.append("I")
        state = DUE[state][1]
    return "".join(out), state


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


class Lines:
    """Turns of a segment with their edits: what stays, in order."""

    def __init__(self, edits: str, state: int):
        self.edits, self.state = iter(edits), state

    def _named(self) -> str:
        role, self.state = DUE[self.state]
        return role

    def turn(self, initial: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        for edit in self.edits:
            if edit == "I":
                yield edit, self._named(), ""
                continue
            if edit == "K":
                self.state = LEGAL[self.state, initial]
                yield edit, role, text
            elif edit == "R":
                yield edit, self._named(), text
            return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for _ in self.edits:
            yield "I", self._named(), ""


def _flow(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight=lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most some thousand, or of few megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 512 + weight(row)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def initial_of(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


@dataclass
class Repaired:
    """``audits``: a row per conversation that has turns: ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    ``turns()``: the repaired turns: ``conv``, ``place`` (rising within a conversation), ``edit``, ``role``, ``text``.
    ``hashes()``: ``conv`` and the SHA-256 of its repaired ``role:text`` lines, where it has any.
    """

    audits: DataFrame
    flow: DataFrame
    kind: str

    def turns(self) -> DataFrame:
        columns = f"conv {self.kind}, place long, edit string, role string, text string"
        schema = _schema(columns)

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((plan["conv"], plan["pos"] * 4 + i, *line) for plan, lines in _segments(batches) for i, line in enumerate(lines))
            yield from _batches(rows, schema, lambda r: len(r[4]))

        return self.flow.mapInArrow(made, columns)

    def hashes(self) -> DataFrame:
        columns, out_columns = f"conv {self.kind}, pos long, chunk int, sha256 string, bytes binary", f"conv {self.kind}, sha256 string"
        schema, out_schema = _schema(columns), _schema(out_columns)

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for plan, lines in _segments(batches):
                    digest, held, size, n = hashlib.sha256(), [], 0, 0
                    start = plan["state"] == NOTHING
                    for _, role, text in lines:
                        line = (b"" if start else b"\n") + f"{role}:{text}".encode()
                        start = False
                        if plan["whole"]:
                            digest.update(line)
                            n = 1
                            continue
                        held.append(line)
                        size += len(line)
                        if size > CHUNK:
                            yield plan["conv"], plan["pos"], n, None, b"".join(held)
                            held, size, n = [], 0, n + 1
                    if plan["whole"] and n:
                        yield plan["conv"], plan["pos"], 0, digest.hexdigest(), None
                    elif held:
                        yield plan["conv"], plan["pos"], n, None, b"".join(held)

            yield from _batches(rows(), schema, lambda r: len(r[4] or b""))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for conv, chunks in itertools.groupby(_flow(batches), lambda r: (r["conv"] is None, r["conv"])):
                    digest = hashlib.sha256()
                    for r in chunks:
                        digest.update(r["bytes"])
                    yield conv[1], digest.hexdigest()

            yield from _batches(rows(), out_schema)

        made_once = stored(self.flow.mapInArrow(made, columns), "talk-hashes")
        parts = made_once.filter("sha256 is null").repartition("conv").sortWithinPartitions("conv", "pos", "chunk")
        return made_once.filter("sha256 is not null").select("conv", "sha256").union(
            parts.select("conv", "pos", "chunk", "bytes").mapInArrow(joined, out_columns))


def _schema(columns: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(columns))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """Each plan row of a sorted flow with the lines of the turns behind it. Lines must be read before the next plan."""
    rows = _flow(batches)
    waiting = [next(rows, None)]

    def lines(plan: dict) -> Iterator[tuple[str, str, str]]:
        own = Lines(plan["edits"], plan["state"])
        for row in rows:
            if row["edits"] is not None:
                waiting[0] = row
                break
            yield from own.turn(row["initial"], row["role"], row["text"])
        yield from own.rest()

    while waiting[0] is not None:
        plan, waiting[0] = waiting[0], None
        yield plan, lines(plan)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Find the faults of all conversations and the cheapest edits that repair them."""
    given = rows.select(rows[f"`{conv}`"].alias("conv"), rows[f"`{turn}`"].alias("turn"),
                        F.coalesce(rows[f"`{role}`"], F.lit(" ")).alias("role"), F.coalesce(rows[f"`{text}`"], F.lit(" ")).alias("text"))
    kind = dict(given.dtypes)["conv"]
    ended = F.rtrim("text", F.lit(_WHITE))
    sorted_rows = given.withColumn("head", F.substring("text", 1, 32)).repartitionByRange("conv", "turn", "role", "head").sortWithinPartitions(
        "conv", "turn", "role", "head", "text")
    turns = stored(sorted_rows.select(
        F.monotonically_increasing_id().alias("pos"), "conv", "turn", "role", "text", initial_of(F.col("role")).alias("initial"),
        F.unhex(F.sha2("text", 256)).alias("digest"), (ended == "").alias("blank"),
        (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("cut")), "talk-turns")

    first = turns.filter("not blank").groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    marked = turns.select("pos", "conv", "initial", "blank", "cut").join(first, "pos", "left").withColumn(
        "fault", F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("cut"), "t").otherwise(""))
    symbol = F.when(F.col("fault").isin("b", "d"), GONE).when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", symbol.alias("symbol"), "initial")))
    is_fault = lambda f: F.count_if(F.col("fault") == f)
    segments = marked.groupBy("conv", F.shiftright("pos", SEGMENT_BITS).alias("segment")).agg(
        F.min("pos").alias("pos"), is_fault("b").alias("blank"), is_fault("d").alias("duplicate"), is_fault("t").alias("truncated"),
        ordered.alias("list")).select(
        "conv", "pos", "blank", "duplicate", "truncated", F.array_join("list.symbol", "").alias("symbols"),
        F.array_join("list.initial", "").alias("initials"))

    counts = f"conv {kind}, pos long, blank long, duplicate long, truncated long, illegal long, cost long"
    back_columns = f"{counts}, edits array<string>, states array<int>, more boolean"
    plan_columns = f"{counts}, edits string, state int, whole boolean"
    back_schema, plan_schema = _schema(back_columns), _schema(plan_columns)

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments from the last on: for each state before one, its edits and the state behind them."""

        def made() -> Iterator[tuple]:
            for _, own in itertools.groupby(_flow(batches), lambda r: (r["conv"] is None, r["conv"])):
                after, following = _END, ""
                for r in own:
                    ways = [unrolled(r["symbols"], after, s, not following) for s in range(4)]
                    cost = costs(r["symbols"], after)
                    yield (r["conv"], r["pos"], r["blank"], r["duplicate"], r["truncated"], illegal_pairs(r["initials"] + following),
                           cost[NOTHING], [w[0] for w in ways], [w[1] for w in ways], bool(following))
                    after, following = cost, r["initials"][0]

        yield from _batches(made(), back_schema, lambda r: 4 * len(r[7][0]))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments from the first on: the edits that follow from those before."""

        def made() -> Iterator[tuple]:
            for _, own in itertools.groupby(_flow(batches), lambda r: (r["conv"] is None, r["conv"])):
                state, first = NOTHING, True
                for r in own:
                    yield (r["conv"], r["pos"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"] if first else 0,
                           r["edits"][state], state, first and not r["more"])
                    state, first = r["states"][state], False

        yield from _batches(made(), plan_schema, lambda r: len(r[7]))

    by_conv = segments.repartition("conv").sortWithinPartitions("conv", F.desc("pos"))
    plans = stored(by_conv.mapInArrow(backward, back_columns).sortWithinPartitions("conv", "pos").mapInArrow(forward, plan_columns), "talk-plans")

    audits = plans.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "edits"))), lambda x: x["edits"]), "").alias("audit"))
    span = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps")).withColumnRenamed("conv", "c")
    audits = audits.join(span, audits.conv.eqNullSafe(span.c)).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    segment = F.shiftright("pos", SEGMENT_BITS).alias("segment")
    none = F.lit(None)
    flow = plans.select(segment, "pos", F.lit(0).alias("order"), "conv", "edits", "state", "whole", none.cast("string").alias("initial"),
                        none.cast("string").alias("role"), none.cast("string").alias("text")).union(
        turns.select(segment, "pos", F.lit(1), none.cast(kind), none.cast("string"), none.cast("int"), none.cast("boolean"),
                     "initial", F.when(~F.col("blank"), F.col("role")), F.when(~F.col("blank"), F.col("text"))))
    return Repaired(audits, flow.repartition("segment").sortWithinPartitions("segment", "pos", "order"), kind)
