"""Token ids as canonical, length-limited Huffman code with random access.

File format: two Parquet tables under one folder.

- ``codebook``: ``id``, ``bits``: the code length of each id that occurs. Codes are canonical: counted up in
  the order of (bits, id), so lengths are all that is stored.
- ``shards``: documents in ascending key order, about a million ids to a row: ``part``, ``seq`` (order of the rows),
  ``n_tokens``, ``keys``, ``doc_tokens`` (ids per document), ``checkpoints`` (bit offset of every block of
  ``BLOCK`` ids, little-endian unsigned 64 bits), ``payload`` (the code, first bit highest).

Each block can be decoded by itself from its checkpoint. Encoder and decoder run through all blocks of a row in step,
one id of every block at a time, with one table of ``2 ** max_bits`` entries.

Two passes over the text's ids: global counts (summed in each task first; the sum has at most one row per id of the
vocabulary and goes to the driver, where the code lengths are found), then range partitioning by key and encoding. A
hot source or a group of copies has no effect: rows are dealt by key, and only documents with the same key must share
a partition.

Defined cases: null text has the end id alone; null keys come first; equal keys are ordered by their ids; an empty table
gives empty tables; other columns are not kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlab.llm.encoded import id_width, ids_of, joined, token_ids
from postlab.llm.store import stored

BLOCK = 512
SHARD = 1 << 20
MAX_BITS = 18


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        levels.append(rank < n)
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        chosen = int(leaf[:take].sum())
        bits[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = bits
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes counted up in the order of (bits, id)."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    codes = np.zeros(len(bits), np.uint64)
    code, last = 0, 0
    for length in range(1, int(bits.max(initial=0)) + 1):
        own = order[bits[order] == length]
        code <<= length - last
        last = length
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code += len(own)
    return codes


def encode_blocks(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The code of ids, and the bit offset of each block.

    Blocks are written in step. Two blocks never write to one word in the same step: a whole block of at least 65
    ids of at least one bit each lies between their places.
    """
    if block < 65:
        raise ValueError("a block has 65 ids at least")
    n = -(-len(ids) // block)
    length = bits[ids].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(length)))
    checkpoints = at[:-1:block].copy() if n else np.zeros(0, np.int64)
    words = np.zeros(int(at[-1]) // 64 + 3, np.uint64)
    left = codes[ids] << (64 - length).astype(np.uint64)
    for j in range(min(block, len(ids))):
        pick = slice(j, None, block)
        word, shift = at[:-1][pick] >> 6, (at[:-1][pick] & 63).astype(np.uint64)
        words[word] |= left[pick] >> shift
        words[word + 1] |= (left[pick] << (np.uint64(63) - shift)) << np.uint64(1)
    return words.astype(">u8").tobytes()[:-(-int(at[-1]) // 8)], checkpoints


def decode_table(bits: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next ``limit`` bits: the id and the length of its code."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    spans = 1 << (limit - bits[order].astype(np.int64))
    ids, length = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    total = int(spans.sum())
    ids[:total] = np.repeat(order, spans)
    length[:total] = np.repeat(bits[order], spans)
    return ids, length


def decode_blocks(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray],
                  limit: int, block: int = BLOCK) -> np.ndarray:
    """Ids of all blocks. A reader that wants a few passes their checkpoints alone."""
    ids, length = table
    words = np.frombuffer(payload + bytes(24 - len(payload) % 8), ">u8").astype(np.uint64)
    at = checkpoints.astype(np.int64).copy()
    out = np.zeros((block, len(at)), np.uint32)
    for j in range(min(block, n)):
        live = len(at) if j < (n - 1) % block + 1 else len(at) - 1
        here = at[:live]
        word, shift = here >> 6, (here & 63).astype(np.uint64)
        window = (words[word] << shift) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - shift))
        window >>= np.uint64(64 - limit)
        out[j, :live] = ids[window]
        here += length[window]
    return out.T.reshape(-1)[:n]


def count_ids(encoded: DataFrame, width: int, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(ids_of(batch["ids"], width)[0], minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_encoded(docs: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text",
                  max_bits: int = MAX_BITS) -> None:
    """Encode whole texts and write the two tables of the format under ``path``."""
    from postlab.llm.tokens import encoder

    spark, width, vocabulary = docs.sparkSession, id_width(tokenizer), max(encoder(tokenizer).vocabulary, end + 1)
    encoded = stored(token_ids(docs, key, text, tokenizer, end, width), "token-ids")
    bits = code_lengths(count_ids(encoded, width, vocabulary), max_bits)
    book = [(int(i), int(bits[i])) for i in np.flatnonzero(bits)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, codes = TaskContext.get().partitionId(), canonical_codes(bits)
        seq = size = 0
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            rows = joined(held)
            ids, counts = ids_of(rows["ids"], width)
            payload, checkpoints = encode_blocks(ids, bits, codes)
            one = lambda kind, v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()),
                 one(rows["key"].type, rows["key"]), one(pa.int64(), pa.array(counts)),
                 pa.array([checkpoints.astype("<u8").tobytes()], pa.binary()), pa.array([payload], pa.binary())],
                ["part", "seq", "n_tokens", "keys", "doc_tokens", "checkpoints", "payload"])

        for batch in batches:
            start = 0
            for i, n in enumerate(batch["n_tokens"].to_pylist()):
                size += n
                if size >= SHARD:
                    held.append(batch.slice(start, i + 1 - start))
                    yield row()
                    held, size, start, seq = [], 0, i + 1, seq + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield row()

    kind = dict(encoded.dtypes)["key"]
    (encoded.repartitionByRange("key").sortWithinPartitions("key", "ids")
     .mapInArrow(shards, f"part int, seq int, n_tokens long, keys array<{kind}>, doc_tokens array<long>, "
                         "checkpoints binary, payload binary")
     .write.option("compression", "none").parquet(f"{path}/shards"))


def read_encoded(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Decode the files: ``key``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, ``ids``.

    ``start`` comes from running totals over the rows of ``shards``, of which there is one for a million ids.
    """
    files = spark.read.parquet(f"{path}/shards")
    book = spark.read.parquet(f"{path}/codebook").collect()         # one row per id of the vocabulary at most
    bits = np.zeros(max((r.id for r in book), default=0) + 1, np.uint8)
    for r in book:
        bits[r.id] = r.bits
    limit = max(int(bits.max(initial=0)), 1)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(bits, limit)
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                counts = np.asarray(row["doc_tokens"].flatten())
                points = np.frombuffer(row["checkpoints"][0].as_py(), "<u8")
                got = decode_blocks(row["payload"][0].as_py(), points, int(counts.sum()), table, limit).astype("<u4")
                ends = np.cumsum(counts)
                raw = memoryview(got.tobytes())
                cut = [raw[4 * a:4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(row["part"][0], n), pa.repeat(row["seq"][0], n), row["keys"].flatten(),
                     pa.array(ends - counts), pa.array(counts),
                     pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                     pa.array([bytes(c) for c in cut] if ids else [None] * n, pa.binary())],
                    ["part", "seq", "key", "inside", "n_tokens", "ids_crc32", "ids"])

    kind = dict(files.dtypes)["keys"][len("array<"):-1]
    rows = files.drop("n_tokens").mapInArrow(
        decoded, f"part int, seq int, key {kind}, inside long, n_tokens long, ids_crc32 long, ids binary")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))
    out = rows.join(starts, ["part", "seq"]).select(
        "key", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
    return out
