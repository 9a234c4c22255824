"""Mix sources to target weights by Pfair scheduling.

The documents of a source are cut, in order, into blocks of about ``block`` characters. With target weight w, block
number i of a source may not start before slot floor(i / w) and must be placed by slot ceil((i + 1) / w); of the
blocks that may start, each slot takes the one with the earliest deadline. At any point every source then has less
than one block more or less than its weight asks for. When a source runs out, the weights of the others are scaled up and a new
phase begins, so every document is placed exactly once.

Whole-number shares make the schedule of a phase periodic, with as many slots as the shares add up to. Only that
period, a table of (phase, source, index in the period) bounded by sources times shares, is made on the driver; placing
documents is two joins with such tables. Running totals within a source are taken in two steps, inside range
partitions and over their sums, so a source that holds a third of all rows is spread like any other. All steps on data are
DataFrame operations.

Defined cases: rows with the same source and key move together and share a place; null sources are a source of their
own, null keys come first in it; a null text has length 0; an empty table gives an empty plan.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlab.llm.store import stored

#: Most rows of a schedule that is sent to every task; a larger one is joined like any table.
BROADCAST_ROWS = 100_000
PLAN = ("mix_source", "source_start", "block", "phase", "slot", "release", "deadline", "position")


@dataclass
class Phase:
    """``first`` and ``last``: block numbers, from and below, that each source places in this phase."""

    start: int
    period: int
    share: dict[str, int]
    first: dict[str, int]
    last: dict[str, int]
    slots: dict[tuple[str, int], int]


def earliest_deadline_first(share: dict[str, int]) -> list[tuple[str, int]]:
    """(source, index) per slot of one period, as many slots as the shares add up to."""
    period = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share)]            # by release
    ready: list[tuple[int, str, int]] = []                  # by deadline
    heapq.heapify(waiting)
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // share[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i))
        if i + 1 < share[s]:
            heapq.heappush(waiting, ((i + 1) * period // share[s], s, i + 1))
    return out


def schedule(blocks: dict[str, int], share: dict[str, int]) -> list[Phase]:
    """Phases from block counts and whole-number shares; a phase ends when a source has placed its last block."""
    done, start, phases = dict.fromkeys(blocks, 0), 0, []
    while left := {s: blocks[s] - done[s] for s in blocks if blocks[s] > done[s]}:
        shares = {s: share[s] for s in left}
        divisor = math.gcd(*shares.values())
        shares = {s: v // divisor for s, v in shares.items()}
        order = earliest_deadline_first(shares)
        period = len(order)
        slots = {x: slot for slot, x in enumerate(order)}
        # slots until each source has placed what it has left
        ends = {s: (n - 1) // shares[s] * period + slots[s, (n - 1) % shares[s]] + 1 for s, n in left.items()}
        length = min(ends.values())
        whole, part = divmod(length, period)
        placed = {s: whole * shares[s] for s in left}
        for s, _ in order[:part]:
            placed[s] += 1
        phases.append(Phase(start, period, shares, {s: done[s] for s in left},
                            {s: done[s] + placed[s] for s in left}, slots))
        for s, n in placed.items():
            done[s] += n
        start += length
    return phases


def balanced_shares(sizes: dict[str, int], power: float = 0.5, resolution: int = 1000) -> dict[str, int]:
    """Shares in proportion to a power of the sizes: 1 keeps the natural mix, 0 makes sources equal."""
    raw = {s: max(n, 1) ** power for s, n in sizes.items()}
    total = sum(raw.values()) or 1
    return {s: max(1, round(resolution * v / total)) for s, v in raw.items()}


def _source(by: str) -> Column:
    return F.concat(F.lit("="), F.col(f"`{by}`").cast("string"))


def named_source(by: str) -> Column:
    """The source as the plan names it (``mix_source``)."""
    return F.coalesce(_source(by), F.lit("null"))


def mix_plan(docs: DataFrame, shares: dict[str | None, int] | None = None, by: str = "source", key: str = "doc_id",
             text: str = "text", block: int = 1 << 20, power: float = 0.5) -> DataFrame:
    """Where each (source, key) goes: the columns of ``PLAN`` and ``key``.

    ``shares``: whole-number share per source (1 where a source isn't named); None: ``balanced_shares``.
    ``position`` orders the mixed corpus, about one unit per character; ``slot`` is the place of the block. The
    number of sources has to suit the driver, which gets one row for each.
    """
    spark = docs.sparkSession
    narrow = docs.select(named_source(by).alias("mix_source"), F.col(f"`{key}`").alias("key"),
                         F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("size"))
    keyed = narrow.groupBy("mix_source", "key").agg(F.sum("size").alias("size"))
    ranged = stored(keyed.repartitionByRange(spark.sparkContext.defaultParallelism * 4, "mix_source", "key")
                    .withColumn("part", F.spark_partition_id()), "mix-ranged")
    parts = ranged.groupBy("mix_source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("mix_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0))), "mix-parts")
    sizes = {r.mix_source: r.size for r in
             parts.groupBy("mix_source").agg(F.sum("part_size").alias("size")).collect()}

    if shares is None:
        share = balanced_shares(sizes, power)
    else:
        named = {"null" if s is None else f"={s}": v for s, v in shares.items()}
        share = {s: named.get(s, 1) for s in sizes}
    blocks = {s: max(1, -(-n // block)) for s, n in sizes.items()}
    phases = schedule(blocks, share)
    per_source = [(s, k, p.start, p.period, p.share[s], p.first[s], p.last[s], p.last[s] == blocks[s])
                  for k, p in enumerate(phases) for s in p.share if p.last[s] > p.first[s]]
    per_slot = [(s, k, i, slot) for k, p in enumerate(phases) for (s, i), slot in p.slots.items()]
    table = spark.createDataFrame(per_source, "mix_source string, phase int, start long, period long, share long, first long, last long, final boolean")
    slots = spark.createDataFrame(per_slot, "mix_source string, phase int, turn long, turn_slot long")
    if len(per_slot) <= BROADCAST_ROWS:
        table, slots = F.broadcast(table), F.broadcast(slots)

    inside = Window.partitionBy("part", "mix_source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("part_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = (
        ranged.join(parts.select("mix_source", "part", "part_start"), ["mix_source", "part"])
        .withColumn("source_start", start)
        .withColumn("at", F.floor(F.col("source_start") / F.lit(block))))
    # empty texts at the very end of a source stand behind its last character, in its last block
    in_phase = ((placed.mix_source == table.mix_source) & (placed["at"] >= table["first"])
                & ((placed["at"] < table["last"]) | ((placed["at"] == table["last"]) & table["final"])))
    placed = (
        placed.join(table, in_phase).drop(table.mix_source)
        .withColumn("block", F.least("at", F.col("last") - 1))
        .withColumn("turn", (F.col("block") - F.col("first")) % F.col("share"))
        .join(slots, ["mix_source", "phase", "turn"]))
    index = F.col("block") - F.col("first")
    slot = F.col("start") + F.floor(index / F.col("share")) * F.col("period") + F.col("turn_slot")
    return placed.select(
        "key", "mix_source", "source_start", "block", "phase", slot.alias("slot"),
        (F.col("start") + F.floor(index * F.col("period") / F.col("share"))).alias("release"),
        (F.col("start") + F.ceil((index + 1) * F.col("period") / F.col("share"))).alias("deadline"),
        (slot * block + F.col("source_start") - F.col("block") * block).alias("position"))


def mix(docs: DataFrame, shares: dict[str | None, int] | None = None, by: str = "source", key: str = "doc_id",
        text: str = "text", block: int = 1 << 20, power: float = 0.5) -> DataFrame:
    """All documents in mixed order, sorted across partitions by ``position``; the columns of ``PLAN`` are added."""
    plan = stored(mix_plan(docs, shares, by, key, text, block, power), "mix-plan").withColumnsRenamed(
        {"key": "__key", "mix_source": "__source"})
    keep = [f"`{c}`" for c in docs.columns if c not in PLAN]
    joined = docs.select(*keep).join(plan.hint("merge"), F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (named_source(by) == F.col("__source")))
    out = joined.select(*keep, F.col("__source").alias("mix_source"), *PLAN[1:])
    return out.repartitionByRange("position", f"`{key}`").sortWithinPartitions("position", f"`{key}`")
