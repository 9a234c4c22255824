import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlab.llm import huffman, mixing, packing
from postlab.llm.tokens import Encoder
from postlab.session import work_path

WORDS, BYTES = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_pieces_encode_like_whole_texts(path):
    rng = random.Random(1)
    parts = ["a", "b", "'s", "é", "é", " ", "  ", "\n", " ", "\t", "!", "...", "42", "<|endoftext|>", "Σ", "İ", "中", "\x1c", "\x00", "😀", "Ñ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)] + ["", None, " ", "a "]
    own = Encoder(path)
    assert own.kind != "whole"
    ids, counts = own.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert own.tokenizer.encode(t or "", add_special_tokens=False).ids == ids[a:b].tolist(), t


@given(st.lists(st.integers(0, 40), min_size=0, max_size=900), st.integers(6, 12))
@settings(max_examples=40, deadline=None)
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, np.uint32)
    counts = np.bincount(ids, minlength=41)
    bits = huffman.code_lengths(counts, limit)
    assert bits.max(initial=0) <= limit and sum(2.0 ** -int(b) for b in bits if b) <= 1
    payload, points = huffman.encode_blocks(ids, bits, huffman.canonical_codes(bits), block=65)
    table = huffman.decode_table(bits, limit)
    assert huffman.decode_blocks(payload, points, len(ids), table, limit, block=65).tolist() == ids.tolist()
    if len(points) > 1:     # one block by itself
        assert huffman.decode_blocks(payload, points[:1], 65, table, limit, block=65).tolist() == ids[:65].tolist()


def test_code_lengths_are_optimal():
    assert sorted(huffman.code_lengths(np.array([1, 1, 2, 4, 8]), 10).tolist()) == [1, 2, 3, 4, 4]
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 8]), 3).max() == 3
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5), 2)


def test_huffman_files(spark, odd, none):
    path = work_path(spark, "test")
    huffman.write_encoded(odd, path, WORDS, end=2)
    got = huffman.read_encoded(spark, path).orderBy("start").collect()
    t = Tokenizer.from_file(WORDS)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
                   for r in odd.collect()), key=lambda x: x[:2])
    assert [r.key for r in got] == [w[1] if w[0] else None for w in want]
    assert Counter((r.key, r.ids) for r in got) == Counter((w[1] if w[0] else None, w[2]) for w in want)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids) // 4, zlib.crc32(r.ids))
        start += r.n_tokens
    empty = work_path(spark, "test")
    huffman.write_encoded(none, empty, WORDS, end=2)
    assert huffman.read_encoded(spark, empty).count() == 0


def whole(pieces, size):
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.key].append(p)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert sorted(sequences) == list(range(len(sequences)))
    return docs, padding


def test_packing(spark, odd, none):
    docs, padding = whole(packing.pack(odd, BYTES, end=0).collect(), 1024)
    t = Tokenizer.from_file(BYTES)
    want = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in odd.collect() if r.doc_id not in (1, None)}
    for k, ids in want.items():
        parts = sorted(docs[k], key=lambda p: p.start)
        assert b"".join(p.ids for p in parts) == ids.tobytes() and {p.doc_tokens for p in parts} == {len(ids)}
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
    assert sum(p.length for p in docs[1]) == 2 * docs[1][0].doc_tokens and padding == 0
    assert packing.pack(none, BYTES, end=0).count() == 0


@pytest.mark.parametrize("counts", [{}, {700: 3000}, {700: 3000, 324: 100}, {5: 1}, {k: 7 + k % 5 for k in range(1, 1024, 3)}])
def test_plan_places_every_remainder(counts):
    plan = packing.Plan(counts, 1024, 8, 0.002, 1)
    sequences = defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            parts = plan.pieces(length, rank)
            assert sum(p[1] for p in parts) == length
            for _, m, s, o in parts:
                sequences[s].append((o, m))
    for parts in sequences.values():
        at = 0
        for o, m in sorted(parts):
            assert o == at
            at += m
        assert at == 1024 or at & (at - 1) == 0 or at >= 1024 - 64


def test_earliest_deadline_keeps_every_source_within_a_block():
    rng = random.Random(4)
    for _ in range(20):
        share = {f"s{i}": rng.randint(1, 30) for i in range(rng.randint(1, 9))}
        period, done = sum(share.values()), Counter()
        for slot, (s, i) in enumerate(mixing.earliest_deadline_first(share)):
            assert i == done[s] and i * period // share[s] <= slot < -(-(i + 1) * period // share[s])
            done[s] += 1
            assert all(abs(done[x] - (slot + 1) * share[x] / period) < 1 for x in share)
        assert done == share


def test_mixing_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 90), rng.choice("aaab") if i % 9 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shares = {"a": 2, "b": 3, None: 1}
    got = {r.key: r for r in mixing.mix_plan(docs, shares, block=200).collect()}
    named = lambda s: "null" if s is None else f"={s}"
    start, blocks = defaultdict(dict), {}
    for s in shares:
        at = 0
        for i, t, own in rows:
            if own == s:
                start[s][i] = at
                at += len(t)
        blocks[named(s)] = max(1, -(-at // 200))
    slots = {}
    left, slot, done = dict(blocks), 0, Counter()
    for phase in mixing.schedule(blocks, {named(s): v for s, v in shares.items()}):
        order = mixing.earliest_deadline_first(phase.share)
        while any(done[s] < phase.last[s] for s in phase.share):
            s, _ = order[(slot - phase.start) % phase.period]
            slots[s, done[s]] = slot
            done[s] += 1
            slot += 1
    assert done == left
    for s in shares:
        for i, at in start[s].items():
            block = min(at // 200, blocks[named(s)] - 1)
            assert (got[i].source_start, got[i].block, got[i].slot) == (at, block, slots[named(s), block])
            assert got[i].release <= got[i].slot < got[i].deadline


def test_mixing_odd_rows(odd, none):
    rows = mixing.mix(odd, block=1000).collect()
    assert len(rows) == 9 and [r.position for r in rows] == sorted(r.position for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mix_plan(odd.filter(F.lit(False))).count() == 0
