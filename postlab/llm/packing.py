"""Pack documents into sequences by cutting-stock column generation.

A document's ids are cut into pieces of ``size`` and one remainder. Whole pieces fill sequences by themselves. The
remainders are a cutting-stock problem over the histogram of their lengths, in classes of ``unit`` ids: a linear program
chooses how often each pattern (a multiset of classes that fits a sequence) is used; new patterns are priced by a
knapsack over the dual values, until the program is within ``gap`` of its bound. Pattern counts are rounded down, and
the k-th remainder of a class, ranked by exact length, goes to the k-th free place for that class; since the whole histogram
is known, the exact lengths of its neighbours are too, so pieces lie without gaps. What rounding leaves, and what only
patterns with more than ``slack`` free units would take (a third of the documents may have one awkward length), is laid
end to end and cut at sequence borders; the last sequence of that is split into powers of two, which need no padding.

The driver sees only the histogram (``size - 1`` counts at most) and the plan. Ranks are taken in two steps, inside
the tasks that encode the texts and over their counts per length, so a length that a third of the documents share is
spread like any other. The encoded ids are stored once, and moved at most once, to be joined to the offsets of their task.

With ``order``, a column of numbers from 0 up (the place in a mixed corpus), sequences follow it: the corpus is cut into at most
``WINDOWS`` windows of order, each has a plan of its own, and sequence ids go through the windows in turn. Inside a window
ranks follow the order, and whole pieces lie evenly among the other sequences. So the sequences up to any id hold what the
order has up to there, but for one window.

Defined cases: null text has the end id alone; equal or null keys are documents of their own; an empty table gives an empty
table; other columns are not kept.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postlab.llm.encoded import ENCODE_BYTES, id_width, ids_of, slices, with_end, binary
from postlab.llm.store import stored
from postlab.llm.tokens import encoder, relieve

SIZE = 1024
UNIT = 8
GAP = 0.002
#: Most windows of an ordered corpus (the driver gets a histogram and makes a plan for each), and the least units of order in one.
WINDOWS, WINDOW = 32, 1 << 20
SLACK = 1


def best_pattern(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the multiset of lengths of most worth that fits, and its worth."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(int(lengths[0]) if len(lengths) else size + 1, size + 1):
        n = int(np.searchsorted(lengths, room, "right"))
        worth = best[room - lengths[:n]] + prices[:n]
        i = int(worth.argmax())
        if worth[i] > best[room - 1]:
            best[room], last[room] = worth[i], i
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(lengths)), size
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        pattern[last[room]] += 1
        room -= int(lengths[last[room]])
    return float(best[size]), pattern


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float,
                      rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per column) and how often each is used, for ascending lengths.

    Revised simplex method. Starts with each length by itself; ends when the best price of a new pattern, or the
    material itself, proves that at most ``gap`` of the sequences could be saved, or after ``rounds`` patterns: any
    basis on the way meets the demand. Demands are moved by up to a hundredth of their mean, which keeps pivots from standing still; the
    caller rounds down to what is really there.
    """
    m = len(lengths)
    fits = (size // lengths).astype(float)
    basis, inverse = np.diag(fits), np.diag(1 / fits)
    demand = demand + 0.01 * demand.mean() * ((np.arange(m) * 0.6180339887) % 1) if m else demand
    amount = demand / fits
    bound = float((lengths * demand).sum()) / size
    for _ in range(rounds if m else 0):
        if amount.sum() <= bound * (1 + gap):
            break
        prices = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = best_pattern(lengths, prices, size)
        bound = max(bound, float(prices @ demand) / worth)
        if worth <= 1 + gap:
            break
        direction = inverse @ pattern
        rising = direction > 1e-9
        steps = np.full(m, np.inf)
        steps[rising] = amount[rising] / direction[rising]
        out = int(steps.argmin())
        amount -= steps[out] * direction
        amount[out] = steps[out]
        basis[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        np.maximum(amount, 0, out=amount)
    return basis, amount


class Plan:
    """Where the k-th remainder of a length goes. Remainders of a class are ranked by length, then within it."""

    def __init__(self, histogram: dict[int, int], size: int, unit: int, gap: float, slack: int):
        self.size, self.unit = size, unit
        lengths = np.array(sorted(k for k, n in histogram.items() if n and 0 < k < size), np.int64)
        counts = np.array([histogram[int(k)] for k in lengths], np.int64)
        kinds = -(-lengths // unit)
        self.classes = np.unique(kinds)
        self.lengths = {int(c): lengths[kinds == c] for c in self.classes}
        self.before = {int(c): np.concatenate(([0], np.cumsum(counts[kinds == c]))) for c in self.classes}
        self.tokens = {c: np.concatenate(([0], np.cumsum(np.diff(n) * self.lengths[c]))) for c, n in self.before.items()}
        demand = np.array([self.before[int(c)][-1] for c in self.classes], np.int64)

        patterns, amount = column_generation(self.classes, demand.astype(float), size // unit, gap)
        covered = np.zeros(len(demand), np.int64)
        self.patterns: list[tuple[int, list[tuple[int, int, int]]]] = []     # first sequence, (class, copies, first rank)
        self.spans: dict[int, list[tuple[int, int]]] = {int(c): [] for c in self.classes}     # first rank, pattern
        sequences = 0
        for j in np.argsort(-amount, kind="stable"):
            copies = np.rint(patterns[:, j]).astype(np.int64)
            used = np.flatnonzero(copies)
            if not len(used) or size // unit - int(copies @ self.classes) > slack:
                continue
            count = min(int(amount[j] + 1e-9), int(((demand - covered)[used] // copies[used]).min()))
            if count <= 0:
                continue
            parts = [(int(self.classes[i]), int(copies[i]), int(covered[i])) for i in used[::-1]]
            for c, _, first in parts:
                self.spans[c].append((first, len(self.patterns)))
            self.patterns.append((sequences, parts))
            covered += copies * count
            sequences += count
        self.covered = {int(c): int(n) for c, n in zip(self.classes, covered)}

        self.first_rest, self.rest_size, self.rest = sequences, 0, {}
        for c in map(int, self.classes[::-1]):
            self.rest[c] = self.rest_size
            self.rest_size += int(self.tokens[c][-1]) - self._tokens_before(c, self.covered[c])
        self.tails, at = [], 0                                                # parts of the last rest sequence
        for bit in range(size.bit_length(), -1, -1):
            if self.rest_size % size >> bit & 1:
                self.tails.append(at)
                at += 1 << bit
        self.first_whole = self.first_rest + self.rest_size // size + len(self.tails)

    def _length(self, c: int, rank: int) -> int:
        return int(self.lengths[c][bisect.bisect_right(self.before[c], rank) - 1])

    def _tokens_before(self, c: int, rank: int) -> int:
        if rank >= self.before[c][-1]:
            return int(self.tokens[c][-1])
        i = bisect.bisect_right(self.before[c], rank) - 1
        return int(self.tokens[c][i] + (rank - self.before[c][i]) * self.lengths[c][i])

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) for the k-th remainder of a length."""
        c = -(-length // self.unit)
        rank += int(self.before[c][bisect.bisect_left(self.lengths[c], length)])
        if rank < self.covered[c]:
            spans = self.spans[c]
            sequence, parts = self.patterns[spans[bisect.bisect_right(spans, (rank, len(self.patterns))) - 1][1]]
            turn = next((rank - first) // copies for k, copies, first in parts if k == c)
            offset = 0
            for k, copies, first in parts:
                for at in range(first + turn * copies, first + (turn + 1) * copies):
                    if k == c and at == rank:
                        return [(0, length, sequence + turn, offset)]
                    offset += self._length(k, at)
        at = self.rest[c] + self._tokens_before(c, rank) - self._tokens_before(c, self.covered[c])
        out, done = [], 0
        while done < length:
            number, offset = divmod(at + done, self.size)
            n = min(length - done, self.size - offset)
            if number == self.rest_size // self.size:
                part = bisect.bisect_right(self.tails, offset) - 1
                end = self.tails[part + 1] if part + 1 < len(self.tails) else self.rest_size % self.size
                n = min(n, end - offset)
                out.append((done, n, self.first_rest + number + part, offset - self.tails[part]))
            else:
                out.append((done, n, self.first_rest + number, offset))
            done += n
        return out


class Numbers:
    """Sequence ids of a window: its whole pieces lie evenly among its other sequences."""

    def __init__(self, first: int, others: int, wholes: int):
        self.first, self.others, self.wholes = first, others, wholes

    def whole(self, i: int) -> int:
        return self.first + i + i * self.others // self.wholes

    def other(self, i: int) -> int:
        return self.first + i + (-(-(i + 1) * self.wholes // self.others))


def pack(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", size: int = SIZE,
         unit: int = UNIT, gap: float = GAP, slack: int = SLACK, order: str | None = None) -> DataFrame:
    """Pieces of all documents: ``key``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``
    (little-endian unsigned 32-bit integers). ``order``: the column that sequences follow."""
    width = id_width(tokenizer)
    source = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"),
                         (docs[f"`{order}`"] if order else F.lit(0)).cast("long").alias("at"))
    windows, span = 1, 1
    if order:
        last = source.agg(F.max("at")).first()[0] or 0
        span = max(WINDOW, -(-(last + 1) // WINDOWS))
        windows = last // span + 1
        source = source.repartitionByRange("at", "key").sortWithinPartitions("at", "key")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, kind = TaskContext.get().partitionId(), np.dtype("<u2") if width == 2 else np.dtype("<u4")
        seen, whole = np.zeros(windows * size, np.int64), np.zeros(windows, np.int64)
        for batch in slices(batches, "text", ENCODE_BYTES):
            flat, counts = with_end(*encoder(tokenizer).encode(batch["text"]), end)
            rest = counts % size
            window = np.asarray(batch["at"]).astype(np.int64) // span
            kind_of = window * size + rest
            rank = np.zeros(len(rest), np.int64)
            by_kind = np.argsort(kind_of, kind="stable")
            new = np.bincount(kind_of, minlength=windows * size)
            rank[by_kind] = np.arange(len(rest)) - np.repeat(np.cumsum(new) - new, new) + seen[kind_of[by_kind]]
            seen += new
            whole_rank = np.zeros(len(rest), np.int64)
            for w in np.unique(window):
                own = counts[window == w] // size
                whole_rank[window == w] = whole[w] + np.cumsum(own) - own
                whole[w] += own.sum()
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.repeat(pa.scalar(part, pa.int32()), len(rest)), pa.array(window.astype(np.int32)), pa.array(counts),
                 pa.array(rest.astype(np.int32)), pa.array(rank), pa.array(whole_rank), binary(flat.astype(kind), counts).cast(pa.binary())],
                ["key", "part", "window", "n_tokens", "rest", "rank", "whole_rank", "ids"])
        relieve()

    kind = dict(source.dtypes)["key"]
    encoded = stored(source.mapInArrow(
        ranked, f"key {kind}, part int, window int, n_tokens long, rest int, rank long, whole_rank long, ids binary"), "pack-ids")

    counts = encoded.groupBy("window", "part", "rest").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n_tokens") / size)).alias("wholes"))
    before = lambda w: w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("rank_start", F.coalesce(F.sum("n").over(before(Window.partitionBy("window", "rest"))), F.lit(0)))
    parts = counts.groupBy("window", "part").agg(F.sum("wholes").alias("wholes")).select(
        "window", "part", F.coalesce(F.sum("wholes").over(before(Window.partitionBy("window"))), F.lit(0)).alias("whole_start"))
    counts = stored(counts.join(parts, ["window", "part"]), "pack-offsets")
    histograms: list[dict[int, int]] = [{} for _ in range(windows)]
    n_wholes = [0] * windows
    for r in counts.groupBy("window", "rest").agg(F.sum("n").alias("n"), F.sum("wholes").alias("wholes")).collect():
        histograms[r.window][r.rest] = r.n
        n_wholes[r.window] += r.wholes
    plans, numbers, first = [], [], 0
    for histogram, wholes in zip(histograms, n_wholes):
        plans.append(Plan(histogram, size, unit, gap, slack))
        numbers.append(Numbers(first, plans[-1].first_whole, wholes))
        first += plans[-1].first_whole + wholes

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch[c].to_pylist() for c in ("window", "n_tokens", "rest", "rank", "rank_start", "whole_rank", "whole_start")]
            flat, _ = ids_of(batch["ids"], width)
            raw, at = memoryview(flat.astype("<u4").tobytes()), 0
            for i, (w, n, rest, rank, rank_start, whole, whole_start) in enumerate(zip(*columns)):
                plan, number, cut = plans[w], numbers[w], n - rest
                if order:
                    id_of_whole, id_of_other = number.whole, number.other
                else:
                    id_of_whole, id_of_other = plan.first_whole.__add__, int
                pieces = [(a, size, id_of_whole(whole + whole_start + a // size), 0) for a in range(0, cut, size)]
                if rest:
                    pieces += [(cut + a, m, id_of_other(s), o) for a, m, s, o in plan.pieces(rest, rank + rank_start)]
                rows += [(i, a, m, n, s, o, bytes(raw[4 * (at + a):4 * (at + a + m)])) for a, m, s, o in pieces]
                at += n
            index, *rest_columns = zip(*rows) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch["key"].take(pa.array(index, pa.int64())), *(pa.array(c, k) for c, k in zip(rest_columns, kinds))],
                ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    joined = encoded.join(counts.select("window", "part", "rest", "rank_start", "whole_start"), ["window", "part", "rest"])
    return joined.select("key", "window", "n_tokens", "rest", "rank", "rank_start", "whole_rank", "whole_start", "ids").mapInArrow(
        placed, f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
