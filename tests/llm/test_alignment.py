import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from postlab.llm import alignment
from postlab.llm.alignment import align
from postlab.llm.queries import alignment as query

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = alignment.byte_of()
    name = {i: t for t, i in a.get_vocab().items()}

    def of(text):
        if not text:
            return [], []
        left = [(i, bytes(byte[c] for c in name[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        same = b"".join(x for _, x in left) == want and b"".join(x for _, x in right) == want
        return (left, right) if same else ([], [])

    return of


def restated(rows):
    """Every document by loops over its tokens' byte ranges."""
    of, found, held = tokens(), [], defaultdict(int)
    for key, text in rows:
        sides = []
        for side in of(text):
            at, spans = 0, []
            for i, x in side:
                spans.append((at, at + len(x), i))
                at += len(x)
            sides.append(spans)
        left, right = sides
        cuts = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
        groups, start = [], 0
        for end in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in sides))
            start = end
        links, first = [], 0
        for s, e, i in left:
            while first < len(right) and right[first][1] <= s:
                first += 1
            k = first
            while k < len(right) and right[k][0] < e:
                links.append((i, right[k][2]))
                k += 1
        for p in set(links):
            held[p] += 1
        found.append((key, len(left), len(right), groups, links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return Counter((k, a, b, len(g), len(x), sum(held[p] == top[p[0]] for p in x), sum(held[p] for p in x),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for k, a, b, g, x in found), held


def texts(seed, n=60):
    rng = random.Random(seed)
    parts = ["the", "tokenizer", "Ünïcödé", "中文", "\U0001f600", "don't", "x\n\ny", "  ", "\t", "ﬁ", "1234.5", "<|endoftext|>", "a<|endoftext|>b", "<s>", "<0x0A>",
             "aaaaaaa", "é", "\r\n", "\xa0", "ththeor", "Straße,", "…", "==", " ", "été"]
    out = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["", None, "▁x", "a ▁ b", " lead", "trail ", "\n", " ", "a\x00b", "﻿x", "same text", "same text"]


@pytest.mark.parametrize("chunk,entries", [(8 << 20, 2_000_000), (300, 40)])
def test_query_is_the_restatement(spark, tmp_path, monkeypatch, chunk, entries):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "ENTRIES", entries)
    monkeypatch.setattr(alignment, "TOGETHER", 7)
    rows = [(i % 70 if i else None, t) for i, t in enumerate(texts(chunk))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, held = restated(rows)
    assert Counter(tuple(r) for r in query.query(spark, str(tmp_path)).collect()) == want
    found = align(spark.read.parquet(f"{tmp_path}/documents.parquet"), A, B, groups=True)
    assert {(r.a_id, r.b_id): r.documents for r in found.pairs().collect()} == held
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in found.documents.filter("n_a > 0").collect())


def test_same_bytes():
    own = alignment.aligner(A, B)
    assert all(own.a_bytes[i] == own.b_bytes[j] for i, j in enumerate(own.same.tolist()) if j >= 0) and (own.same >= 0).sum() > 10_000
    assert own.splits
    assert not np.isin(own.same, [0, 1, 2]).any()


def test_odd_rows(odd, none):
    got = align(odd, A, B).documents
    assert got.count() == odd.count() and got.filter("n_a > 0").count() == 6
    assert align(none, A, B).documents.count() == 0 and align(none, A, B).pairs().count() == 0


def test_a_file_holds_one_chunk(spark, monkeypatch):
    """Parquet buffers up to 100 rows and a scan up to 4,096, each of some MB, so a task's memory would grow with its share of the input."""
    from collections import Counter as Counted

    from pyspark.sql import functions as F

    rows = [(i, f"one word and don't {i % 7}  two {'naïve ' * (i % 5)}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted(tuple(r) for r in align(docs, A, B).documents.collect())
    written = []
    monkeypatch.setattr(alignment, "stored", lambda df, name, *rest, own=alignment.stored: written.append(own(df, name, *rest)) or written[-1])
    monkeypatch.setattr(alignment, "slices", lambda batches, column, limit, own=alignment.slices: own(batches, column, 200))
    monkeypatch.setattr(alignment, "TOGETHER", 3)
    assert sorted(tuple(r) for r in align(docs, A, B).documents.collect()) == whole
    files = Counted(r.file for r in written[0].select(F.input_file_name().alias("file")).collect())
    assert len(files) > 5 and set(files.values()) == {1}
