import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlab.llm.bestfit import Rounds, pack_best_fit
from postlab.llm.queries import bestfit as query

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, size):
    """One piece after the other, longest first, each to the fullest sequence that takes it."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda j: rooms[j])
            rooms[i] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


def filled(pieces, size):
    """Free room of each sequence; fails where pieces overlap or leave a gap."""
    by = {}
    for sequence, offset, length in pieces:
        by.setdefault(sequence, []).append((offset, length))
    rooms = []
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        rooms.append(size - at)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_rounds_are_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 37, 64])
    lengths = [rng.randint(1, size) if rng.random() < 0.6 else rng.choice([1, 3, size // 3 + 1]) for _ in range(rng.randint(0, 400))]
    rounds = Rounds(Counter(lengths), size)
    seen, ranks = Counter(), []
    for n in lengths:
        ranks.append(seen[n])
        seen[n] += 1
    sequence, offset = rounds.place(np.array(lengths, np.int64), np.array(ranks, np.int64))
    assert filled(zip(sequence.tolist(), offset.tolist(), lengths), size) == best_fit(lengths, size)
    assert rounds.sequences == len(best_fit(lengths, size))


def test_a_round_needs_few_runs():
    rounds = Rounds({n: 10 ** 9 + n * n for n in range(1, 1025)}, 1024)
    assert len(rounds.ranks) < 30_000
    tokens = sum(n * (10 ** 9 + n * n) for n in range(1, 1025))
    assert rounds.sequences <= 1.001 * tokens / 1024


def test_all_documents(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["spark", "Ünï", "a", "\n", "the end."]) for _ in range(rng.choice([0, 1, 5, 40, 300, 1500])))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "x " * 4096)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = query.query(spark, str(tmp_path)).collect()
    tokenizer, lengths = Tokenizer.from_file(PATH), []
    want = {}
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at, piece = 0, 0
        while at < len(ids):
            n = (len(ids) % 1024 or 1024) if piece == 0 else 1024
            want[i, piece] = (at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), len(ids))
            lengths.append(n)
            at, piece = at + n, piece + 1
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want
    assert len(got) == len(want)
    assert filled([(r.sequence_id, r.offset, r.length) for r in got], 1024) == best_fit(lengths, 1024)


def test_odd_rows(odd, none):
    got = pack_best_fit(odd, PATH, 2)
    assert got.columns[0] == "doc_id"
    rows = got.select("doc_id", "piece", "length", F.length("ids").alias("n"), F.crc32("ids").alias("crc"), "ids_crc32").collect()
    assert all(r.n == 4 * r.length and r.crc == r.ids_crc32 for r in rows)
    assert sum(1 for r in rows if r.piece == 0) == odd.count()
    assert pack_best_fit(none, PATH, 2).count() == 0


def test_one_hot_length(spark):
    rows = pack_best_fit(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text")), PATH, 2).collect()
    assert filled([(r.sequence_id, r.offset, r.length) for r in rows], 1024) == best_fit([5] * 4000, 1024)
