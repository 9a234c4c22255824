import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postlab.llm import interpolation, near, neighbours, repeats, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def copies(seed=1, n=30):
    """Texts with exact copies, near copies, a passage many share, and short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = " ".join(word() for _ in range(120))
    base = [" ".join(word() for _ in range(rng.randint(3, 150))) for _ in range(n)]
    out = list(base)
    for i in range(n):
        words = base[i].split()
        if i % 3 == 0:
            words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
        if i % 4 == 0:
            out.append(base[i])
        if i % 5 == 0:
            out.append(f"{base[i]} {passage} {word()}")
    big = " ".join(word() for _ in range(200)).split()
    for _ in range(30):
        own = list(big)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = word()
        out.append(" ".join(own))
    return list(enumerate(out))


def shingles(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sets, label


@pytest.mark.parametrize("block", [3_000, 30_000, near.BLOCK])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = copies()
    sets, label = groups(rows)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def near_copies(n, seed=8):
    """Copies of one text with so many changed words that most pairs lie just below the threshold."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 4, 5, 6])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [60_000, near.BLOCK])
def test_near_copies_around_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = near_copies(250)
    sets, label = groups(rows)
    assert 5 < len(set(label.values())) < 200
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def test_a_block_gives_few_links():
    sets = {i: near.shingle_sets(pa.array([t]))[0] for i, t in near_copies(400, 9)}
    members = [{"node": i, "label": i, "side": 0, "hashes": s.tobytes()} for i, s in sets.items()]
    links = near._links_of_block(members, 85)
    assert 50 < len(links) < len(members)
    halves = [m | {"side": m["node"] % 2} for m in members]
    assert all((a - b) % 2 for a, b in near._links_of_block(halves, 85))


def test_bands_miss_few_pairs_at_the_threshold():
    assert near.band_width(85) == 8
    for percent in range(50, 100):
        w = near.band_width(percent)
        assert (1 - (percent / 100) ** w) ** (near.REGISTERS // w) < 1e-4


def test_pipeline_drops_copies_from_080(spark):
    rng = random.Random(3)
    rows, near_ids = [], set()
    for i in range(40):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(104)]
        rows.append((i, " ".join(words)))
        # two or three changed words of 104 leave 90 or 85 of 100 shingles: 0.82 or 0.74
        changed = 2 if i % 2 else 3
        for k in range(changed):
            words[20 + 30 * k] = "new"
        rows.append((100 + i, " ".join(words)))
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        share = len(a & b) / len(a | b)
        assert 0.80 <= share < 0.85 if changed == 2 else share < 0.80
        near_ids |= {100 + i} if changed == 2 else set()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - near_ids


def test_near_odd_rows(odd, none):
    rows = near.near_duplicates(odd).collect()
    assert len(rows) == 9 and near.near_duplicates(none).count() == 0
    assert Counter((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in rows) == Counter(
        {(1, 1, True, 17): 2, (2, 2, True, 0): 1, (3, 3, True, 0): 1, (None, None, True, 1): 1, (None, None, True, 0): 1,
         (4, 4, True, 29_996): 1, (5, 5, True, 0): 1, (6, 6, True, 2): 1})


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for n in (3, 40, 3000):
        a = rng.permutation(np.unique(rng.integers(0, (1 << 64) - 1, n * 2, dtype=np.uint64)))
        x, y = np.sort(a[:int(n * 1.8)]), np.sort(a[int(n * 0.2):])
        want = len(np.intersect1d(x, y)) / len(a)
        got = near.estimate(near.sketch(x)[None], near.sketch(y)[None], np.array([len(x)]), np.array([len(y)]))[0]
        assert abs(got - want) < 0.15 if n > 3 else 0 <= got <= 1


def test_suffix_array():
    rng = random.Random(2)
    for k in range(60):
        text = bytes(rng.choice(b"\1\2\3" if k % 2 else b"\1") for _ in range(rng.randint(0, 300))) + b"\0"
        t = np.frombuffer(text, np.uint8)
        wanted = np.array([rng.random() < 0.6 for _ in t]) if k % 3 else np.ones(len(t), bool)
        got = suffixes.suffix_array(t, wanted, suffixes.words_at(t), suffixes.prints_at(t, len(t)), len(t) + 8).tolist()
        assert got == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i:])


def covered(rows, length):
    data = [(k, (t or "").encode()) for k, t in rows]
    counts = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for k, b in data:
        hit = [False] * len(b)
        for i in range(len(b) - length + 1):
            if counts[b[i:i + length]] > 1:
                hit[i:i + length] = [True] * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        runs = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        out.append((k, len(b), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bucket", [3000, repeats.BUCKET])
def test_repeats_against_all_strings(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    rows = copies(7, 20) + [(None, "é" * 700), (None, "ab" * 600), (900, None), (901, "")]
    got = repeats.remove_repeats(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rid string")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == covered(rows, 400)


def test_repeats_odd_rows(odd, none):
    assert repeats.remove_repeats(none).count() == 0
    assert sum(r.n_removed for r in repeats.remove_repeats(odd).collect()) == 0


def test_scores_against_a_loop(spark, odd, none):
    rows = copies(3, 20)
    got = {r.doc_id: r for r in interpolation.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens = {i: [*WORD.findall(t.lower()), 0] for i, t in rows}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, t in tokens.items() if i not in held for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (i in held, len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].score < 0
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    assert interpolation.score_texts(none).count() == 0 and interpolation.score_texts(odd).count() == 9


def test_mixture_adds_up_to_one():
    words = {"a": 5, "b": 3, "</s>": 2}
    total, after = sum(words.values()), {"a": 3, "b": 2}
    lam = (0.5, 0.3, 0.2)
    p = lambda w: sum(x * y for x, y in zip(lam, (m[0] for m in interpolation._mixture(
        np.array([after.get(w, 0)]), np.array([5]), np.array([words.get(w, 0)]), total, len(words)))))
    assert math.isclose(sum(map(p, [*words, "unknown"])), 1)


def test_weights_follow_held_out_counts(spark):
    held = spark.createDataFrame([(3, 3, 4, 5, 900), (3, 0, 4, 5, 10), (1, 0, 1, 50, 500)], "b int, bi long, context long, one long, n long")
    weights = interpolation.learned_weights(held, 1000, 200)
    assert weights[3][0] > 0.9 and weights[1][1] > 0.9 and all(math.isclose(sum(w), 1) for w in weights.values())


def test_neighbours_recall_ties_and_odd_vectors(spark, monkeypatch):
    for name, v in (("SAMPLE", 64), ("CELL", 100), ("QUERIES", 10), ("LEAF", 16)):
        monkeypatch.setattr(neighbours, name, v)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 12)) * rng.uniform(0.5, 2, 600)[:, None]
    x[100:180] = x[100]
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1020, [0.0] * 12, 1), (1040, [1.0, None] + [0.0] * 10, 1), (1060, [float("nan")] * 12, 1),
           (1080, [float("inf")] * 12, 1), (1100, [1.0], 1), (None, [1.0] * 12, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cell int")
    got = neighbours.neighbours(df, F.col("vec_id") % 20 == 0, k=10).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
        assert math.isclose(r.score, float(x[r.query_id] @ x[r.vec_id]), rel_tol=1e-12, abs_tol=1e-12)
    hits = 0
    for q in range(0, 600, 20):
        scores = x @ x[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[i], i))[:10]
        hits += len(set(want) & set(by[q]))
    assert set(by) == set(range(0, 600, 20)) and hits >= 0.9 * 10 * len(by)
    assert neighbours.neighbours(df.limit(0), F.lit(True)).count() == 0
    few = neighbours.neighbours(df.filter("vec_id < 3"), F.lit(True)).collect()
    assert Counter(r.query_id for r in few) == {0: 2, 1: 2, 2: 2}


def test_neighbours_copies_of_the_longest_and_large_ids(spark):
    """Copies of the longest vector make d_k 0, and ids beyond 2^53 differ by less than a double can tell."""
    x = np.array([[(7 * i + 3 * j) % 11 - 5 for j in range(8)] for i in range(60)], float)
    for first in (16, 2 ** 60):
        ids = [first + i for i in range(60)]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
        got = neighbours.neighbours(df, F.lit(True), k=3, confidence=0.999).collect()
        scores = x @ x.T
        want = {(ids[q], rank, ids[i], scores[q, i]) for q in range(60) for rank, i in enumerate(
            sorted((i for i in range(60) if i != q), key=lambda i: (-scores[q, i], i))[:3], 1)}
        assert {tuple(r) for r in got} == want


def test_neighbours_share_of_scored_vectors(monkeypatch):
    """In clustered data the stopping test leaves most vectors unverified and still finds the nearest."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 16)) * 4
    x = centres[rng.integers(0, 60, 12000)] + rng.standard_normal((12000, 16)) * 0.15
    x /= np.linalg.norm(x, axis=1)[:, None]
    p, asked = neighbours.Projection(16, 1.0, 8, 7), np.arange(0, 12000, 50)
    scored = []
    inner = neighbours.best
    monkeypatch.setattr(neighbours, "best", lambda s, places, k: (scored.append((s.shape[1] - k) * len(s)), inner(s, places, k))[1])
    got, ids = neighbours.search_block(x, np.arange(12000), x[asked], asked, np.full(len(asked), np.inf), p,
                                       neighbours.chi_square_quantile(0.97, 8), 10)
    exact = x[asked] @ x.T
    exact[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-exact, axis=1, kind="stable")[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, want)])
    assert recall >= 0.95 and sum(scored) < 0.5 * exact.size, (recall, sum(scored) / exact.size)


def test_chi_square():
    assert math.isclose(neighbours.chi_square_quantile(0.95, 8), 15.507, abs_tol=1e-3)
    assert math.isclose(neighbours.chi_square_quantile(0.5, 1), 0.4549, abs_tol=1e-3)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    good = [" ".join(f"w{k}x{i}" for k in range(40)) + "." for i in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [(100, good[0], "en", "s0", 1), (101, "a | b | c | d " * 20, "en", "s1", 1), (102, None, None, None, None),
             (103, "Write to jo.doe@mail.example.com or call +1 (599) 555-3756, " + good[5].replace("x5", "y"), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == {*range(30), 100, 103} and seen[1] == seen[2] == seen[3] == {*range(30), 103}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert "jo.doe" not in text[103] and "555-3756" not in text[103] and text[7] == good[7]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[3]


def test_pipeline_sequences_follow_the_mix(spark):
    """A source of long documents and one of short ones: every prefix of the sequences has the shares of the mix."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    rows = [(i, " ".join(word() for _ in range(6000)), "long") for i in range(60)]
    rows += [(1000 + i, " ".join(word() for _ in range(rng.randint(20, 700))), "short") for i in range(5000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.packing(spark, docs, "").collect()
    source = {i: s for i, _, s in rows}
    plan = {r.key: (r.position, r.phase) for r in corpus_pipeline.mix_plan(docs, block=corpus_pipeline.MIX_BLOCK).collect()}
    # what the order has up to each document against what the sequences have, as shares of all tokens
    tokens = {r.doc_id: r.doc_tokens for r in got}
    total, ordered, points = sum(tokens.values()), [], 0
    run = Counter()
    for i in sorted(plan, key=lambda i: (plan[i][0], i)):
        run[source[i]] += tokens[i]
        ordered.append((sum(run.values()), run["long"]))
    assert sum(r.length for r in got) == total and len({r.sequence_id for r in got}) == max(r.sequence_id for r in got) + 1
    done, long_done, k = 0, 0, 0
    for r in sorted(got, key=lambda r: r.sequence_id):
        done, long_done = done + r.length, long_done + r.length * (source[r.doc_id] == "long")
        while ordered[k][0] < done:
            k += 1
        assert abs(long_done - ordered[k][1]) < 0.1 * total
        points += 1
    assert points == len(got)
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert all(n <= 1024 for n in filled.values()) and 1 - total / (1024 * len(filled)) < 0.03


def test_pipeline_dedup_judges_rows_by_their_texts(spark):
    rng = random.Random(6)
    a, b, c, d, e = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(5))
    # id 5 has two unlike texts, one of them a copy of id 1; rows without id hold one copy pair and a copy of id 1
    rows = [(1, a), (5, a), (5, b), (6, c), (6, c), (None, d), (None, d), (None, a), (None, e), (7, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.dedup(spark, docs, "").collect())
    assert got == Counter([(1, a), (5, b), (6, c), (None, d), (None, e), (7, ""), (7, None)])
