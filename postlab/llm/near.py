"""Near-duplicate documents by HyperMinHash.

1. Each text becomes the set of its distinct 5-word shingles, as 64-bit hashes. Documents with equal sets form a
   class (pre-aggregated), and everything below works on one text per class.
2. A HyperMinHash sketch has 256 registers. The first 8 bits of a hash choose the register, which keeps the smallest
   rest in 16 bits: the number of its leading zeros and the 10 bits behind the first one.
3. Bands of registers are hashed; classes that agree in a band are candidates. The threshold gives the widest bands that
   miss a pair just at it with a probability below ``MISSED``: 32 bands of 8 for 0.85 (4e-5), 42 bands of 6 for 0.80 (3e-6).
4. Classes that bands connect are a cluster. A cluster's sketches and full sets meet in blocks of at most ``BLOCK`` bytes, together with
   its most central class: there, pairs whose estimate from the sketches, corrected for registers that agree by chance, isn't hopeless are
   verified on full sets, the likeliest first, and pairs that links already connect are skipped. So no pair is ever a row; a
   block gives one link less than it has members at most.
5. Only clusters of several blocks need more: their classes are dealt anew by the component they have so far, and blocks are compared two by two,
   but never blocks of one component. So a group of any size that its centre links costs one pass, and no link between
   components is lost.
6. Connected components of the verified links give the groups.

Memory per task: one batch of texts. A text that a third of the documents share is one class; a shingle that many
share only matters through whole bands.

Defined cases: null and empty texts, and texts without words, have an empty set and no link; a null key takes no part: its
component is null and it is kept; repeated keys share a component when their texts do; other columns are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlab.llm.components import components
from postlab.llm.encoded import slices
from postlab.llm.shingles import mixed, shingle_sets
from postlab.llm.store import stored

REGISTERS, MANTISSA = 256, 10
#: Bytes of the sets and sketches of a block.
BLOCK = 4 << 20
#: Probability that a pair just at the threshold agrees in no band.
MISSED = 1e-4
#: Values that fall on the registers of a small set in all passes, and the most passes.
FILL, PASSES = 2560, 200


def sketch(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set of hashes.

    A small set is hashed again with other seeds, pass after pass, until about ten of its values have fallen on each
    register; a register keeps the smallest of the first pass that reached it. So registers of small sets are
    as selective as those of large ones: two sets agree in one with the probability of their similarity. What is still
    empty takes the next full register.
    """
    passes = min(PASSES, max(1, -(-FILL // max(len(hashes), 1))))
    seeds = np.arange(passes, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    again = mixed(hashes[None, :] + seeds[:, None]) if passes > 1 else hashes[None, :]
    place = (again >> np.uint64(56)).astype(np.int64).ravel()
    keyed = (again & np.uint64((1 << 56) - 1)) | (np.arange(passes, dtype=np.uint64)[:, None] << np.uint64(56))
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    np.minimum.at(least, place, keyed.ravel())
    full = least != np.iinfo(np.uint64).max
    rest = (least << np.uint64(8)) | np.uint64(0x80)               # a first one is always found
    zeros = np.clip(52 - np.floor(np.log2((rest >> np.uint64(11)).astype(np.float64) + 0.5)).astype(np.int64), 0, 62 - MANTISSA)
    after = (rest << zeros.astype(np.uint64)) << np.uint64(1)
    out = (zeros << MANTISSA).astype(np.uint16) | (after >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    if not full.all():
        filled = np.flatnonzero(full)
        out = out[filled[np.searchsorted(filled, np.arange(REGISTERS)) % len(filled)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches (one pair per row), corrected for chance.

    Registers of unlike minima agree by chance with a share of about 0.1699 * 2 ** -MANTISSA * 4 r / (1 + r) ** 2, where r
    is the ratio of the set sizes: the published approximation of HyperMinHash's expected collisions.
    """
    agree = a == b
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = 0.1699 * 2.0 ** -MANTISSA * 4 * ratio / (1 + ratio) ** 2
    share = agree.mean(axis=1)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, class, set size and sketch."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array([_class(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["key", "node", "n", "sketch"])

    source = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    kind = dict(source.dtypes)["key"]
    return source.mapInArrow(made, f"key {kind}, node long, n long, sketch binary")


def _class(s: np.ndarray) -> int:
    """A hash of a whole set."""
    both = np.array([mixed(s).sum(), np.bitwise_xor.reduce(s), len(s)], np.uint64)
    return int(mixed(both * np.array([3, 5, 7], np.uint64)).sum().astype(np.int64))


def band_width(percent: int) -> int:
    """Registers per band: the most with which a pair at the threshold is missed with a probability below ``MISSED``."""
    agree = percent / 100
    return max((w for w in range(1, REGISTERS + 1) if (1 - agree ** w) ** (REGISTERS // w) < MISSED), default=1)


def _bands(classes: DataFrame, width: int) -> DataFrame:
    """``band``, ``node`` for every band of ``width`` registers."""
    bands = REGISTERS // width

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            registers = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            registers = registers[:, :bands * width].reshape(-1, bands, width)
            hashed = np.zeros(registers.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for k in range(registers.shape[2]):
                hashed = mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + registers[:, :, k].astype(np.uint64))
            nodes = batch["node"].take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
            yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64).ravel()), nodes], ["band", "node"])

    return classes.select("node", "sketch").mapInArrow(made, "band long, node long")


def _links_of_block(members: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among the members of a block, or between its two sides."""
    members = sorted(members, key=lambda r: len(r["hashes"]))
    sets = [np.frombuffer(r["hashes"], np.uint64) for r in members]
    n = np.array(list(map(len, sets)))
    side = np.array([r["side"] for r in members])
    if len(members) == 1:
        return []
    registers = np.array([sketch(x) for x in sets])
    names, group = np.unique([r["label"] for r in members], return_inverse=True)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found, floor, two = [], percent / 100, side.min() != side.max()
    for i in range(len(members)):
        # only sets that are large enough can be near; they are sorted by size
        other = np.arange(i + 1, np.searchsorted(n * percent, n[i] * 100, "right"))
        other = other[(group[other] != group[i]) & ((side[other] != side[i]) | (not two))]
        if not len(other):
            continue
        got = estimate(registers[i:i + 1], registers[other], n[i], n[other])
        # sets of few values fill several registers with one of them, so less can be told apart
        likely = got >= floor - 6 * np.sqrt(floor * (1 - floor) / np.minimum(REGISTERS, n[i]))
        for j in other[likely][np.argsort(-got[likely], kind="stable")].tolist():
            x, y = root(int(group[i])), root(int(group[j]))
            if x == y:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * 100 >= (len(sets[i]) + len(sets[j]) - both) * percent:
                parent[max(x, y)] = min(x, y)
                found.append((members[i]["node"], members[j]["node"]))
    return found


def _blocked(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found in blocks. ``dealt``: ``block``, ``node``, ``side``, ``label``; a node may be in many blocks."""

    def made(block: pa.Table) -> pa.Table:
        links = _links_of_block(block.to_pylist(), percent)
        return pa.table({c: pa.array([x[i] for x in links], pa.int64()) for i, c in enumerate("ab")})

    return dealt.join(sets, "node").groupBy("block").applyInArrow(made, "a long, b long")


def _links(active: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: links enough to connect all that is linked. ``active``: ``band``, ``node`` with bands of two and more."""
    sizes = active.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    central = active.join(sizes, "band").groupBy("node").agg(F.sum("size").alias("central"))
    ranked = stored(active.join(central, "node"), "near-ranked")
    leaders = ranked.groupBy("band").agg(F.max_by("node", F.struct("central", "node")).alias("leader"))
    star = stored(ranked.select("band", "node").join(leaders, "band").filter("node <> leader").select(
        F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "near-star")
    nodes = members.select("node")
    clusters = components(nodes, star).withColumnRenamed("label", "cluster")
    placed = stored(clusters.join(members.select("node", (F.col("n") * 8 + 1024).alias("bytes")), "node").join(central, "node"), "near-clusters")
    whole = stored(placed.groupBy("cluster").agg(
        F.max_by("node", F.struct("central", "node")).alias("centre"), F.ceil(F.sum("bytes") / BLOCK).alias("blocks")), "near-whole")

    part = lambda of, n: F.pmod(F.xxhash64(of), F.greatest(n, F.lit(1)))
    own = placed.join(whole, "cluster").select("cluster", "node", part("node", F.col("blocks")).alias("part"))
    centres = whole.select("cluster", F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    first = own.union(centres).distinct().select(F.xxhash64("cluster", "part").alias("block"), "node", F.lit(0).alias("side"), F.col("node").alias("label"))
    links = stored(_blocked(first, sets, percent), "near-links")

    large = whole.filter("blocks > 1").select("cluster")
    if large.isEmpty():
        return links
    # components of large clusters: a large one has blocks of its own, small ones share blocks
    open_nodes = placed.join(large, "cluster", "left_semi")
    labels = stored(open_nodes.join(components(open_nodes.select("node"), links.join(open_nodes.select(F.col("node").alias("a")), "a", "left_semi")), "node"),
                    "near-labels")
    sizes = labels.groupBy("cluster", "label").agg(F.sum("bytes").alias("bytes"))
    rest = sizes.filter(F.col("bytes") <= BLOCK / 2).groupBy("cluster").agg(F.ceil(F.sum("bytes") / BLOCK).alias("shared"))
    kinds = stored(sizes.join(rest, "cluster", "left").select(
        "cluster", "label", (F.col("bytes") > BLOCK / 2).alias("big"), F.ceil(F.col("bytes") / BLOCK).alias("parts"), "shared"), "near-kinds")
    dealt = stored(labels.join(kinds, ["cluster", "label"]).select(
        "cluster", "node", "label", F.when(F.col("big"), F.col("label")).alias("big"),
        F.when(F.col("big"), part("node", F.col("parts"))).otherwise(part("label", F.col("shared"))).alias("part")), "near-dealt")
    blocks = dealt.select("cluster", "big", "part").distinct()
    one, two = (blocks.select("cluster", F.struct("big", "part").alias(s)) for s in ("x", "y"))
    pairs = one.join(two, "cluster").filter((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("x.big") == F.col("y.big"), F.lit(False)))
    sides = pairs.select("cluster", "x", "y", F.explode(F.array(F.struct(F.col("x").alias("at"), F.lit(0).alias("side")),
                                                                F.struct(F.col("y").alias("at"), F.lit(1).alias("side")))).alias("s"))
    sides = sides.filter("s.side = 0 or x <> y").select(
        F.xxhash64("cluster", "x", "y").alias("block"), F.col("cluster").alias("of"), F.col("s.at").alias("at"), F.col("s.side").alias("side"))
    more = dealt.join(sides, (dealt.cluster == sides.of) & F.struct("big", "part").eqNullSafe(sides["at"])).select("block", "node", "side", "label")
    return links.union(stored(_blocked(more, sets, percent), "near-links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest key that links reach), ``kept`` (it is that key)."""
    rows = stored(_signatures(docs, key, text), "near-rows")
    known = rows.filter("node is not null and key is not null")
    classes = stored(known.groupBy("node").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-classes")

    bands = stored(_bands(classes, band_width(percent)), "near-bands")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    active = stored(bands.join(stored(shared, "near-shared"), "band").select("band", "node"), "near-active")
    members = stored(active.select("node").distinct().join(classes, "node"), "near-members")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "hashes"])

    texts = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text")).join(
        members.select("key").distinct().hint("merge"), "key", "left_semi")      # no bound is known for the members
    sets = stored(texts.select("text").mapInArrow(sets_of, "node long, hashes binary")
                  .groupBy("node").agg(F.first("hashes").alias("hashes")), "near-sets")

    links = _links(active, members, sets, percent)

    labels = components(members.select("node"), links)
    groups = labels.join(members.select("node", "key"), "node").groupBy("label").agg(F.min("key").alias("component"))
    groups = stored(labels.join(groups, "label").select("node", "component"), "near-groups")
    own = classes.select("node", F.col("key").alias("class_key")).join(groups, "node", "left").select(
        "node", F.coalesce("component", "class_key").alias("component"))
    own = stored(own, "near-own")
    out = rows.select("key", "node", "n").join(own, "node", "left")
    component = F.when(F.col("node").isNotNull(), F.when(F.col("key").isNotNull(), F.col("component"))).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
