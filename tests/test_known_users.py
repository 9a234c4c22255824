"""Known users over polls against the batch operator."""

import random

import pytest
from pyspark.sql import functions as F

from postlab.operators import windows
from postlab.session import work_path
from postlab.streaming import known_users, posts as streams
from tests.test_windows import collector_v3, frame, random_hits


@pytest.fixture
def poll(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), work_path(spark, "known-state")

    def run(hits, **options):
        df = frame(spark, hits).withColumn("created_at", F.timestamp_seconds(F.col("term_idx") * 86400 * 10 + F.col("pos") + 10 ** 9))
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = known_users.stream_known_users(streams.landing_stream(spark, folder, df.schema), **options)
        streams.start_to_parquet(stream, out, state).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    return run


def found(df):
    return sorted((r.term_idx, r.pos, r.post_id, r.username, r.user_post_count) for r in df.collect())


@pytest.mark.parametrize("cuts", [(3, 6)])
def test_polls_equal_the_batch(spark, poll, cuts):
    hits = [(t, p, f"{t}-{p}", u, m) for t, p, _, u, m in random_hits(len(cuts), terms=8, per_term=30)]
    rng = random.Random(1)
    edges = [0, *cuts, 8]
    for a, b in zip(edges, edges[1:]):
        part = [h for h in hits if a <= h[0] < b]
        rng.shuffle(part)
        out = poll(part)
    assert found(out) == found(windows.cap_after_first_accept(frame(spark, hits))) == sorted(collector_v3(hits))


def test_a_term_over_two_polls(poll):
    first = [(0, p, f"a{p}", "u", p == 2) for p in range(4)]
    assert [r[1] for r in found(poll(first))] == [2]
    assert [r[:2] for r in found(poll([(0, 4, "b", "u", True), (1, 0, "c", "u", True), (1, 1, "d", "u", True), (1, 2, "e", "u", True)]))] == [
        (0, 2), (1, 0), (1, 1)]


def test_late_hits_and_silent_users(poll):
    poll([(1, 0, "a", "u", True), (1, 1, "x", "v", True)], silent=86400)
    poll([(5, 0, "far", "z", True)], silent=86400)          # time passes, u and v are forgotten
    out = poll([(5, 5, "b", "z", True), (1, 8, "late", "u", True), (6, 0, "old", "u", False), (6, 1, "new", "u", True)], silent=86400)
    assert [(*r[:2], r[4]) for r in found(out)] == [(1, 0, 1), (1, 1, 1), (5, 0, 1), (5, 5, 2), (6, 1, 1)]


def test_state_is_two_numbers():
    import pandas as pd
    posts = pd.DataFrame({"t": [0] * 1000 + [1], "m": [False] * 10 + [True] * 991})
    numbers, known, last, spent = known_users.spend(posts, 2, False, -1, 0, "t", "m")
    assert [i for i, n in enumerate(numbers) if n] == [10, 11, 1000] and (known, last, spent) == (True, 1, 1)


def test_users_of_a_bucket_have_their_own_times(poll):
    """All users share one bucket: a call of Python for each bucket, not for each user, and each is forgotten by itself."""
    options = {"silent": 86400, "buckets": 1}
    poll([(1, 0, "a", "u", True), (1, 1, "b", "v", True), (1, 2, "n", None, True), (1, 3, "o", "w", False)], **options)
    poll([(2, 0, "c", "v", True), (2, 1, "far", "z", True)], **options)         # u and null fall silent
    poll([(3, 0, "farther", "z", True)], **options)
    out = poll([(4, 0, "d", "u", False), (4, 1, "e", "z", False), (4, 2, "f", "z", True), (4, 3, "g", "z", True), (4, 4, "h", None, False),
                (4, 5, "i", None, True), (4, 6, "j", "u", True), (4, 7, "k", "w", True)], **options)
    assert sorted((r.post_id, r.user_post_count) for r in out.collect()) == [
        ("a", 1), ("b", 1), ("c", 1), ("f", 2), ("far", 1), ("farther", 1), ("i", 1), ("j", 1), ("k", 1), ("n", 1)]
