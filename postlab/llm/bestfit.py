"""Best-fit packing of documents in bulk-synchronous rounds.

Each document's ids are cut into pieces of ``size`` from its end, so only the first piece may be shorter. A round places all
pieces of one length, the longest first. Open sequences are gaps, sorted by their free room; gaps of one room that came about in
one way are a run of consecutive sequence ids, so the sorted list stays short (a round adds at most four runs) however many
sequences there are. A sweep goes from the least room that takes the length upwards: each gap takes as many pieces as fit, a run
takes a range of ranks, and where pieces want the same gap their rank decides. What no gap takes opens new sequences. The gaps that
took pieces move down in the list before the next round. As pieces of one length are alike, this is exactly best fit in descending
order, one piece after the other.

The tasks that encode the texts rank the pieces of each length; counts per task and length give the global ranks, so a length
that a third of the pieces share is spread like any other. The driver sees one count per length (``size`` at most) and the runs.
Each task then finds the run of its pieces by a successor search over the ranks. Ids are encoded and stored once, and never moved.

Defined cases: null text has the end id alone; equal or null keys are documents of their own; an empty table gives an empty
table; other columns are not kept.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from postlab.llm.encoded import ENCODE_BYTES, binary, slices, with_end
from postlab.llm.store import stored
from postlab.llm.tokens import encoder, relieve

SIZE = 1024


class Rounds:
    """The placement of all pieces, from the count of each length.

    Ranges of ranks, sorted by length and first rank: the first sequence that takes them, pieces per sequence, room before.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.sequences = size, 0
        rooms: list[int] = []                                   # rooms of open sequences, ascending
        runs: dict[int, list[tuple[int, int]]] = {}             # room -> (first sequence, sequences)
        placed: list[tuple[int, int, int, int, int]] = []       # length, first rank, first sequence, pieces in each, offset

        def open_runs(moved: list[tuple[int, int, int]]) -> None:
            for room, first, n in moved:
                if n and room:
                    if room not in runs:
                        bisect.insort(rooms, room)
                        runs[room] = []
                    runs[room].append((first, n))

        for length in sorted((k for k, n in counts.items() if n), reverse=True):
            left, rank, moved = counts[length], 0, []
            start = bisect.bisect_left(rooms, length)
            touched = start
            for room in itertools.chain(rooms[start:], [size]):
                fits = room // length
                waiting = runs.pop(room) if room in runs else []
                if not waiting:                                 # nothing open takes the rest
                    n = -(-left // fits)
                    waiting, self.sequences = [(self.sequences, n)], self.sequences + n
                else:
                    touched += 1
                for i, (first, n) in enumerate(waiting):
                    if not left:
                        moved += [(room, f, m) for f, m in waiting[i:]]
                        break
                    placed.append((length, rank, first, fits, size - room))
                    full = min(n, left // fits)
                    moved.append((room - fits * length, first, full))
                    rank, left = rank + full * fits, left - full * fits
                    if full < n:
                        if left:
                            moved.append((room - left * length, first + full, 1))
                            rank, full, left = rank + left, full + 1, 0
                        moved.append((room, first + full, n - full))
                if not left:
                    break
            del rooms[start:touched]
            open_runs(moved)

        placed.sort()
        columns = np.array(placed, np.int64).reshape(-1, 5).T
        self.lengths, self.ranks, self.firsts, self.fits, self.offsets = columns
        self.begin = {k: (int(np.searchsorted(self.lengths, k)), int(np.searchsorted(self.lengths, k, "right"))) for k in counts}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        at = np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            own = np.flatnonzero(length == k)
            a, b = self.begin[k]
            at[own] = a + np.searchsorted(self.ranks[a:b], rank[own], "right") - 1
        nth = rank - self.ranks[at]
        return self.firsts[at] + nth // self.fits[at], self.offsets[at] + nth % self.fits[at] * length


def pack_best_fit(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Pieces of all documents: ``key``, ``piece``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``,
    ``ids_crc32`` and ``ids`` (little-endian unsigned 32-bit integers)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in slices(batches, "text", ENCODE_BYTES):
            flat, counts = with_end(*encoder(tokenizer).encode(batch["text"]), end)
            pieces = -(-counts // size)
            owner = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = counts - (pieces - 1) * size                # ids of the first piece
            length = np.where(nth == 0, first[owner], size)
            start = np.where(nth == 0, 0, first[owner] + (nth - 1) * size)
            by_length = np.argsort(length, kind="stable")
            new = np.bincount(length, minlength=size + 1)
            rank = np.zeros(len(length), np.int64)
            rank[by_length] = np.arange(len(length)) - np.repeat(np.cumsum(new) - new, new) + seen[length[by_length]]
            seen += new
            raw, ends = memoryview(flat.astype("<u4").tobytes()), 4 * np.cumsum(length)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * length).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["key"].take(pa.array(owner)), pa.repeat(pa.scalar(part, pa.int32()), len(owner)), pa.array(nth.astype(np.int32)),
                 pa.array(start), pa.array(length), pa.array(counts[owner]), pa.array(rank), pa.array(crc, pa.int64()),
                 binary(flat.astype("<u4"), length).cast(pa.binary())],
                ["key", "part", "piece", "start", "length", "doc_tokens", "rank", "ids_crc32", "ids"])
        relieve()

    source = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    kind = dict(source.dtypes)["key"]
    pieces = stored(source.mapInArrow(cut, f"key {kind}, part int, piece int, start long, length long, doc_tokens long, rank long, "
                                           "ids_crc32 long, ids binary"), "fit-pieces")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "ranked_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "fit-counts")
    rounds = Rounds({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)

    @pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        sequence, offset = rounds.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = pieces.join(counts.select("length", "part", "ranked_before"), ["length", "part"])
    placed = ranked.withColumn("place", place("length", F.col("rank") + F.col("ranked_before")))
    return placed.select(F.col("key").alias(key), "piece", "start", "length", "doc_tokens", "place.sequence_id", "place.offset", "ids_crc32", "ids")
