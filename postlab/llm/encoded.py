"""Tables of token ids made from texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from postlab.llm.tokens import encoder, relieve

#: Bytes of text that are worked on at once, and that are encoded at once; a longer text goes alone.
BATCH_BYTES, ENCODE_BYTES = 16 << 20, 4 << 20


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Parts of batches as one batch of its own: some string kernels misread columns that start inside a buffer."""
    whole = pa.Table.from_batches(parts)
    return whole.take(pa.array(np.arange(whole.num_rows))).combine_chunks().to_batches()[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut or join batches so that each holds about ``limit`` bytes of a text column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            size += n
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield joined(held)
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield joined(held)


def with_end(flat: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append one id to each text."""
    ends = np.cumsum(counts)
    return np.insert(flat, ends, end).astype(np.uint32), counts + 1


def binary(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of a numpy array as a column of little-endian binary values."""
    width = flat.dtype.itemsize
    offsets = np.concatenate(([0], np.cumsum(counts))) * width
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.tobytes())])


def ids_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of ids back as one array, and the number of ids per row."""
    kind = np.dtype("<u2") if width == 2 else np.dtype("<u4")
    counts = np.asarray(pc.binary_length(column)).astype(np.int64) // width
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.uint32), counts


def id_width(tokenizer: str) -> int:
    """Bytes that hold any id of a tokenizer."""
    return 2 if encoder(tokenizer).vocabulary <= 1 << 16 else 4


def token_ids(docs: DataFrame, key: str, text: str, tokenizer: str, end: int, width: int) -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` (``width`` bytes each) of each whole text with the end id; null is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype("<u2") if width == 2 else np.dtype("<u4")
        own = encoder(tokenizer)
        for batch in slices(batches, "text", ENCODE_BYTES):
            flat, counts = with_end(*own.encode(batch["text"]), end)
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(counts), binary(flat.astype(kind), counts).cast(pa.binary())],
                ["key", "n_tokens", "ids"])
        relieve()

    source = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    kind = dict(source.dtypes)["key"]
    return source.mapInArrow(encode, f"key {kind}, n_tokens long, ids binary")
