"""Remove long byte strings that occur anywhere else, by suffix sorting where it can matter.

A byte goes when a string of ``length`` bytes (400) that covers it also starts at another place, in the same document
or another.

1. *Anchors.* Among the 64-byte grams of every 400-byte string the one with the smallest hash (the first of
   equals) is an anchor: it depends on the string alone, so equal strings have equal anchors at equal places. About one position
   in 170 is an anchor. The segment of an anchor spans the 400-byte strings that it is chosen for.
2. *Classes.* Anchors are grouped by (gram hash, segment hash), pre-aggregated. A segment that occurs twice is removed whole.
   A gram with one occurrence in all means no repetition.
3. *Suffix sorting.* What is left are segments that share a gram but differ as a whole: the edges of a
   repeated passage, or an edit inside a copy. One text per class goes to the bucket of its gram, where suffixes are sorted in two
   stages (``suffixes.py``) and runs of suffixes with a common prefix of 400 bytes at different places are marked.
4. A gram with more segments than fit a bucket (a passage in a third of all documents, each in other surroundings) is
   split by content instead: every 400-byte string of its segments goes by hash, counted before the shuffle.

Matches never cross documents. Strings are judged on the input.

Defined cases: null text is empty; equal texts repeat each other, so both go; null or equal keys are documents of their
own; documents under 400 bytes never change; an empty table gives an empty table; other columns are not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlab.llm.encoded import slices
from postlab.llm.shingles import mixed
from postlab.llm.store import stored
from postlab.llm.suffixes import equal_to_previous, prints_at, suffix_array, words_at

LENGTH, GRAM = 400, 64
#: Bytes of text that are hashed at once; a longer document is cut into overlapping parts.
TILE = 1 << 22
#: Bytes of segments that a bucket gets, and beyond which a single gram is split by content.
BUCKET = 1 << 22


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at each position, by doubling; the last ``gram - 1`` positions have none."""
    h = mixed(text.astype(np.uint64) + np.uint64(1))
    step = 1
    while step < gram:
        h = (h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step)) ^ (h[step:] + np.uint64(step))
        h ^= h >> np.uint64(29)
        step *= 2
    return mixed(h)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window, from running minima to both sides within blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-(len(values) + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    square = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Ascending positions of a document's anchors, the hashes of their grams, and the first and last start of the strings they stand for."""
    found = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
    for start in range(0, max(len(text) - length + 1, 0), TILE):
        part = text[start:start + TILE + length - 1]
        h = _gram_hashes(part, gram)
        low = np.uint64((1 << 23) - 1)
        keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        best = (_window_minima(keyed, length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        last = np.append(first[1:], len(best)) - 1
        found.append([best[first] + start, first + start, last + start, h[best[first]]])
    at, first, last, h = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    # an anchor at the border of two tiles stands for strings of both
    return at[new], h[new], first[new], last[np.append(new[1:], len(at))[:len(new)] - 1]


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TILE):
        rows = []
        for rid, value in zip(batch["rid"].to_pylist(), batch["text"]):
            text = _bytes(value)
            if len(text) < LENGTH:
                continue
            at, h, low, last = anchors(text)
            high = last + LENGTH
            raw = memoryview(text)
            for p, g, a, b in zip(at.tolist(), h.view(np.int64).tolist(), low.tolist(), high.tolist()):
                digest = hashlib.blake2b(raw[a:b], digest_size=8, salt=(p - a).to_bytes(8, "little"))
                rows.append((rid, p, g, int.from_bytes(digest.digest(), "little", signed=True), a, b))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["rid", "at", "gram", "segment", "low", "high"])


def _repeated_in_bucket(bucket: pa.Table) -> pa.Table:
    """Spans of 400-byte strings that start at two places or more among the segments of a bucket."""
    segments = [np.frombuffer(v.as_buffer(), np.uint8) for c in bucket["bytes"].chunks for v in c]
    rids, lows = (np.asarray(bucket[c].combine_chunks()) for c in ("rid", "low"))
    sizes = np.array([len(s) for s in segments], np.int64)
    # bytes of UTF-8 stay below 255, so 0 is free for the ends
    text = np.zeros(int(sizes.sum()) + len(segments), np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    for s, a in zip(segments, first.tolist()):
        text[a:a + len(s)] = s + 1
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    inside = np.arange(len(text)) - first[owner]
    prints = prints_at(text, LENGTH)
    order = suffix_array(text, inside + LENGTH <= sizes[owner], words_at(text), prints, LENGTH)
    if not len(order):
        return _spans(np.zeros(0, np.int64), np.zeros(0, np.int64))
    rid, start = rids[owner[order]], lows[owner[order]] + inside[order]
    run = np.flatnonzero(~equal_to_previous(order, prints))
    # the same place can come with several segments: only different places count
    _, rid_rank = np.unique(rid, return_inverse=True)
    place = rid_rank * (int(start.max()) + 1) + start
    several = np.minimum.reduceat(place, run) < np.maximum.reduceat(place, run)
    chosen = np.repeat(several, np.diff(np.append(run, len(order))))
    return _spans(rid[chosen], start[chosen])


def _spans(rid: np.ndarray, start: np.ndarray) -> pa.Table:
    """Runs of neighbouring starts as byte spans."""
    rank = np.lexsort((start, rid))
    rid, start = rid[rank], start[rank]
    new = np.flatnonzero(np.concatenate(([True], (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + 1)))) if len(rid) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(rid))[:len(new)] - 1
    return pa.table({"rid": pa.array(rid[new], pa.int64()), "low": pa.array(start[new], pa.int64()),
                     "high": pa.array(start[last] + LENGTH, pa.int64())})


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every 400-byte string of segments by hash."""
    for batch in batches:
        rows = []
        for rid, low, value in zip(batch["rid"].to_pylist(), batch["low"].to_pylist(), batch["bytes"]):
            raw = memoryview(value.as_buffer())
            for i in range(len(raw) - LENGTH + 1):
                digest = hashlib.blake2b(raw[i:i + LENGTH], digest_size=16).digest()
                rows.append((digest, rid, low + i))
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["string", "rid", "start"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (byte offsets) and ``kept`` (bytes that stay) of each document."""
    kept_rows = stored(docs.select(F.monotonically_increasing_id().alias("rid"), docs[f"`{key}`"].alias("key"),
                                   docs[f"`{text}`"].alias("text")), "repeat-docs")
    found = stored(kept_rows.select("rid", "text").mapInArrow(
        _anchor_rows, "rid long, at long, gram long, segment long, low long, high long"), "repeat-anchors")
    classes = stored(found.groupBy("gram", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "low", "high")).alias("one")), "repeat-classes")
    whole = found.join(stored(classes.filter("n > 1").select("gram", "segment"), "repeat-whole"), ["gram", "segment"]).select(
        "rid", "low", "high")

    length = F.col("one.high") - F.col("one.low")
    mixed_grams = stored(classes.groupBy("gram").agg(
        F.count(F.lit(1)).alias("classes"), F.sum((F.col("n") == 1).cast("int")).alias("singles"), F.sum(length).alias("size"))
        .filter("classes > 1 and singles > 0").select("gram", "size"), "repeat-grams")
    needed = stored(classes.join(mixed_grams, "gram").select("gram", "size", "one.rid", "one.low", "one.high"), "repeat-needed")
    total = needed.filter(F.col("size") <= BUCKET).agg(F.sum(F.col("high") - F.col("low"))).first()[0] or 0
    buckets = max(1, -(-int(total) * 2 // BUCKET))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, value, own in zip(batch["rid"].to_pylist(), batch["text"], batch["own"].to_pylist()):
                raw = memoryview(_bytes(value))
                rows += [(s["gram"], s["size"], rid, s["low"], bytes(raw[s["low"]:s["high"]])) for s in own]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())],
                ["gram", "size", "rid", "low", "bytes"])

    # neither spans nor segments have a bound, so both joins are merge joins at every size
    own = needed.groupBy("rid").agg(F.collect_list(F.struct("gram", "size", "low", "high")).alias("own")).hint("merge")
    segments = stored(kept_rows.select("rid", "text").join(own, "rid").mapInArrow(
        cut, "gram long, size long, rid long, low long, bytes binary"), "repeat-segments")
    edges = segments.filter(F.col("size") <= BUCKET).withColumn("bucket", F.pmod("gram", F.lit(buckets))).select(
        "bucket", "rid", "low", "bytes").groupBy("bucket").applyInArrow(_repeated_in_bucket, "rid long, low long, high long")

    strings = segments.filter(F.col("size") > BUCKET).select("rid", "low", "bytes").mapInArrow(
        _strings, "string binary, rid long, start long")
    strings = stored(strings, "repeat-strings")
    twice = strings.groupBy("string").agg(F.min(F.struct("rid", "start")).alias("a"), F.max(F.struct("rid", "start")).alias("b")).filter("a <> b")
    split = strings.join(stored(twice.select("string"), "repeat-twice"), "string").select(
        "rid", F.col("start").alias("low"), (F.col("start") + LENGTH).alias("high"))

    spans = whole.union(edges).union(split).groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"))
    merged = F.aggregate(
        "spans", F.array().cast("array<struct<low:bigint,high:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1).high >= s.low), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1).low.alias("low"), F.greatest(F.element_at(acc, -1).high, s.high).alias("high"))))).otherwise(
            F.concat(acc, F.array(s))))
    out = kept_rows.join(stored(spans.select("rid", merged.alias("spans")), "repeat-spans").hint("merge"), "rid", "left")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    out = out.select("key", data.alias("data"), F.coalesce("spans", none).alias("spans"))
    # what stays lies before, between and behind the spans
    n = F.size("spans")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s.high))
    ends = F.concat(F.transform("spans", lambda s: s.low), F.array(F.octet_length("data").cast("long")))
    parts = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("data"), (a + 1).cast("int"), (b - a).cast("int")))
    kept = F.when(n == 0, F.col("data")).otherwise(F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p)))
    return out.select(
        F.col("key").alias(key), F.octet_length("data").cast("long").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s.high - s.low).alias("n_removed"),
        n.cast("long").alias("n_spans"), "spans", kept.alias("kept"))
