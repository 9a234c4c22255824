"""Language-model scores by deleted interpolation of bigrams.

p(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1), where b is the bucket of how often the context v was seen. The
weights of each bucket are learned by expectation-maximisation on held-out counts: a fold of the training documents is set
aside, the maximum-likelihood estimates come from the others, and each round shares every set-aside bigram among
the three estimates. The final estimates use all training documents. Contexts never seen have a bucket of their own, and a
word never seen gets the last term alone, the share of the one unknown word among V + 1; so probabilities add up to one.

Texts are tokenised once, in chunks of about 16 MB. A chunk sends its distinct n-grams with their counts to buckets by hash, packed as
sorted arrays; a bucket adds up what all chunks sent and returns to each chunk the global counts of just its own
n-grams. So a frequent n-gram costs one entry per chunk, not one per occurrence, and nothing is broadcast but the
weights. The number of buckets follows the number of entries, so that a bucket stays small. N-grams are told apart by
64-bit hashes.

Defined cases: null text is empty and has the end token alone; null keys count as training documents; repeated rows count each;
extra columns are not kept; with no training documents every probability is that of the unknown word; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlab.llm.encoded import BATCH_BYTES, slices
from postlab.llm.shingles import mixed, word_hashes
from postlab.llm.store import stored

#: Upper ends of the buckets of context counts; 0 is a bucket, and what is above the last one.
BUCKETS = (0, 1, 2, 4, 8, 16, 64, 256, 1024, 8192, 65536)
#: Entries that one bucket of the count exchange gets.
ENTRIES = 2_000_000
END = np.uint64(0x454E44)
TRAIN, DELETED, HELD_OUT = 0, 1, 2
_A = np.uint64(0x9E3779B97F4A7C15)


def _ngrams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the unigrams, and of the bigrams that end at each token; a text begins behind an end."""
    one = mixed(words)
    before = np.concatenate((mixed(np.array([END])), one[:-1]))
    return one, mixed(before * _A + one) | np.uint64(1)


def _planes(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as byte planes of their differences, which compress."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _chunks(docs: DataFrame, key: str, text: str, folds: int, held_out: int, deleted: int) -> DataFrame:
    """One row per chunk and role: its documents, its words as numbers in its own dictionary, the dictionary's hashes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", BATCH_BYTES):
            names = batch["key"].cast(pa.string()).to_pylist()
            fold = np.array([-1 if x is None else zlib.crc32(x.encode()) % folds for x in names])
            role = np.where(fold == held_out, HELD_OUT, np.where(fold == deleted, DELETED, TRAIN))
            for r in range(3):
                rows = pa.array(np.flatnonzero(role == r))
                if not len(rows):
                    continue
                words, counts = word_hashes(batch["text"].take(rows))
                words = np.insert(words, np.cumsum(counts), END)
                known, at = np.unique(words, return_inverse=True)
                keys = batch["key"].take(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 20 | seq << 2 | r], pa.int64()), pa.array([r], pa.int32()),
                     pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                     pa.array([(counts + 1).astype("<i4").tobytes()], pa.binary()),
                     pa.array([np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()], pa.binary()),
                     pa.array([_planes(known)], pa.binary())],
                    ["chunk", "role", "keys", "counts", "words", "known"])
            seq += 1

    source = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    kind = dict(source.dtypes)["key"]
    return source.mapInArrow(made, f"chunk long, role int, keys array<{kind}>, counts binary, words binary, known binary")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and tokens per document of a chunk."""
    known = _unplanes(row["known"])
    at = np.ascontiguousarray(np.frombuffer(row["words"], np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return known[at], np.frombuffer(row["counts"], "<i4").astype(np.int64)


def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """First entry of each bucket among ascending keys, and the end."""
    step = np.uint64((1 << 64) // buckets) if buckets > 1 else None
    cuts = np.arange(1, buckets, dtype=np.uint64) * step if buckets > 1 else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)]))


def _sent(chunks: DataFrame, buckets: int) -> DataFrame:
    """Distinct unigrams and bigrams of each chunk with their counts, cut into buckets."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, _ = _read(row)
                for order, keys in enumerate(_ngrams(words)):
                    keys, counts = np.unique(keys, return_counts=True)
                    cuts = _spread(keys, buckets).tolist()
                    span = [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
                    n = len(span)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b * 2 + order for b, _, _ in span], pa.int32()), pa.array([row["chunk"]] * n, pa.int64()),
                         pa.array([row["role"]] * n, pa.int32()), pa.array([_planes(keys[x:y]) for _, x, y in span], pa.binary()),
                         pa.array([counts[x:y].astype("<u4").tobytes() for _, x, y in span], pa.binary())],
                        ["bucket", "chunk", "role", "keys", "counts"])

    return chunks.select("chunk", "role", "counts", "words", "known").mapInArrow(
        made, "bucket int, chunk long, role int, keys binary, counts binary")


def _added(bucket: pa.Table) -> pa.Table:
    """Global counts of one bucket, returned to each chunk in the order of its keys.

    ``kept``: in training documents outside the deleted fold; ``all``: in all training documents.
    """
    rows = bucket.to_pylist()
    keys = [_unplanes(r["keys"]) for r in rows]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros((2, len(known)), np.int64)
    start = 0
    for r, k in zip(rows, keys):
        own = at[start:start + len(k)]
        start += len(k)
        if r["role"] != HELD_OUT:
            n = np.frombuffer(r["counts"], "<u4").astype(np.int64)
            totals[1, own] += n
            if r["role"] == TRAIN:
                totals[0, own] += n
    start, kept, full = 0, [], []
    for k in keys:
        own = at[start:start + len(k)]
        start += len(k)
        kept.append(totals[0, own].astype("<u4").tobytes())
        full.append(totals[1, own].astype("<u4").tobytes())
    seen = (totals > 0).sum(axis=1)
    tokens = totals.sum(axis=1)
    unigrams = rows[0]["bucket"] % 2 == 0
    first = np.arange(len(rows)) == 0
    one = lambda v: pa.array(np.where(first & unigrams, v, 0), pa.int64())  # noqa: E731  once per bucket
    return pa.table({
        "bucket": bucket["bucket"], "chunk": bucket["chunk"], "role": bucket["role"],
        "kept": pa.array(kept, pa.binary()), "all": pa.array(full, pa.binary()),
        "v_kept": one(seen[0]), "v_all": one(seen[1]), "n_kept": one(tokens[0]), "n_all": one(tokens[1])})


def _aligned(chunk: dict, counts: list[dict], which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token of a chunk: counts of its bigram, of its context, of itself; and tokens per document."""
    words, per_doc = _read(chunk)
    out = []
    for order, keys in enumerate(_ngrams(words)):
        _, at = np.unique(keys, return_inverse=True)
        got = sorted((r["bucket"], r[which]) for r in counts if r["bucket"] % 2 == order)
        out.append(np.frombuffer(b"".join(x for _, x in got), "<u4").astype(np.int64)[at])
    one, two = out
    ends = np.flatnonzero(words == END)
    of_end = one[ends[0]] if len(ends) else 0
    return two, np.concatenate(([of_end], one[:-1])), one, per_doc


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(BUCKETS), context, "left")


def _mixture(bi, context, one, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.where(context > 0, bi / np.maximum(context, 1), 0.0), one / max(total, 1),
            np.full(len(one), 1.0 / (distinct + 1)))


def learned_weights(held: DataFrame, total: int, distinct: int, rounds: int = 30, change: float = 1e-4) -> dict[int, tuple]:
    """Mixture weights (bigram, unigram, uniform) per bucket by expectation-maximisation.

    ``held``: ``b``, ``bi``, ``context``, ``one``, ``n``: set-aside bigrams by the counts they have elsewhere.
    Each round is one aggregation to a row per bucket.
    """
    p2 = F.when(F.col("context") > 0, F.col("bi") / F.col("context")).otherwise(0.0)
    held = stored(held.select("b", p2.alias("p2"), (F.col("one") / max(total, 1)).alias("p1"), "n"), "held-out")
    p0 = 1.0 / (distinct + 1)
    weights = {b: (0.3 if b else 0.0, 0.5 if b else 0.8, 0.2) for b in range(len(BUCKETS) + 1)}
    for _ in range(rounds):
        mine = lambda i: F.element_at(F.array(*(F.lit(float(weights[b][i])) for b in sorted(weights))), F.col("b") + 1)
        shares = held.select("b", "n", (mine(0) * F.col("p2")).alias("s2"), (mine(1) * F.col("p1")).alias("s1"), (mine(2) * p0).alias("s0"))
        whole = F.col("s2") + F.col("s1") + F.col("s0")
        rows = shares.groupBy("b").agg(*(F.sum(F.col("n") * F.col(s) / whole).alias(s) for s in ("s2", "s1", "s0")),
                                       F.sum("n").alias("n")).collect()
        after = dict(weights)
        for r in rows:      # a grain of each estimate stays, so that no text has probability 0
            raw = [(max(r.s2, 0) + (1e-3 if r.b else 0)), r.s1 + 1e-3, r.s0 + 1e-3]
            after[r.b] = tuple(x / sum(raw) for x in raw)
        moved = max(abs(x - y) for b in weights for x, y in zip(weights[b], after[b]))
        weights = after
        if moved < change:
            break
    return weights


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2,
                deleted: int = 3) -> DataFrame:
    """Scores of all whole texts, learned from those whose crc32(key as text) mod ``folds`` isn't ``held_out``."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    chunks = stored(_chunks(docs, key, text, folds, held_out, deleted), "lm-chunks")
    entries = chunks.agg(F.sum(F.length("words") / 4)).first()[0] or 0
    buckets = max(1, int(entries // ENTRIES))
    counted = stored(_sent(chunks, buckets).groupBy("bucket").applyInArrow(
        _added, "bucket int, chunk long, role int, kept binary, all binary, v_kept long, v_all long, n_kept long, n_all long"), "lm-counts")
    sums = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v_kept", "v_all", "n_kept", "n_all"))).first()

    def set_aside(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        rows, own = chunk.to_pylist(), counts.to_pylist()
        found = []
        for row in rows:
            bi, context, one, _ = _aligned(row, own, "kept")
            found.append(pd.DataFrame({"b": bucket_of(context), "bi": bi, "context": context, "one": one}))
        frame = pd.concat(found) if found else pd.DataFrame({"b": [], "bi": [], "context": [], "one": []})
        n = frame.groupby(["b", "bi", "context", "one"], as_index=False).size().rename(columns={"size": "n"}).astype("int64")
        return pa.Table.from_pandas(n.astype({"b": "int32"}), preserve_index=False)

    needed = lambda c: chunks.filter(c).select("chunk", "keys", "counts", "words", "known").groupBy("chunk")
    one_role = F.col("role") == DELETED
    held = needed(one_role).cogroup(counted.filter(one_role).select("bucket", "chunk", "kept").groupBy("chunk")).applyInArrow(
        set_aside, "b int, bi long, context long, one long, n long")
    held = held.groupBy("b", "bi", "context", "one").agg(F.sum("n").alias("n"))
    weights = learned_weights(held, sums.n_kept, sums.v_kept)
    table = np.array([weights[b] for b in sorted(weights)])
    total, distinct = int(sums.n_all), int(sums.v_all)

    def scored(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        out, own = [], counts.to_pylist()
        for row in chunk.to_pylist():
            bi, context, one, per_doc = _aligned(row, own, "all")
            parts = _mixture(bi, context, one, total, distinct)
            lam = table[bucket_of(context)]
            logs = np.log10(sum(lam[:, i] * p for i, p in enumerate(parts)))
            base = np.log10((one + 1) / (total + distinct + 1))
            first = np.concatenate(([0], np.cumsum(per_doc)))[:-1]
            add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
            n = len(per_doc)
            out.append(pa.table({
                "key": chunk["keys"].combine_chunks().flatten() if chunk.num_rows == 1 else pa.array(row["keys"]),
                "held_out": pa.array([row["chunk"] & 3 == HELD_OUT] * n), "n_tokens": pa.array(per_doc),
                "n_known": pa.array(add((one > 0).astype(np.int64)).astype(np.int64)),
                "train_tokens": pa.array([total] * n, pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(logs))}))
        return pa.concat_tables(out)

    return needed(F.lit(True)).cogroup(counted.select("bucket", "chunk", "all").groupBy("chunk")).applyInArrow(
        scored, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).withColumnRenamed("key", key)
