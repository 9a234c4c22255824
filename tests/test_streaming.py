"""Streams over files that arrive in several polls, against the batch result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.session import work_path
from postlab.streaming import posts as streams

SCHEMA = T.StructType([T.StructField("post_id", T.LongType()), T.StructField("username", T.StringType()),
                       T.StructField("sentiment", T.StringType()), T.StructField("created_at", T.TimestampType())])


def rows(first, last, users=3):
    t0 = dt.datetime(2024, 1, 1)
    return [(i, f"u{i % users}", ["positive", "neutral"][i % 2], t0 + dt.timedelta(minutes=7 * i)) for i in range(first, last)]


@pytest.fixture
def poll(spark, tmp_path):
    """Land rows as one more file, run the stream over what is new."""
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), work_path(spark, "test-state")

    def run(new, build, complete=False):
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = build(streams.landing_stream(spark, folder, SCHEMA))
        start = streams.start_latest_to_parquet if complete else streams.start_to_parquet
        start(stream, out, state).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    return run


def test_dedupe_over_polls(poll):
    def build(s):
        return streams.stream_dedupe_posts(s, lateness="10 days")

    poll(rows(0, 20) + rows(5, 10), build)
    out = poll(rows(10, 30), build)
    assert sorted(r.post_id for r in out.collect()) == list(range(30))


def test_endless_copies_are_dropped_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "x")] * 5000 + [(None, "y")] * 50 + [(2, "z")], "post_id long, v string").coalesce(1)
    rows_left = streams.first_copies(df, "post_id").collect()
    assert {(r.post_id, r.v) for r in rows_left} == {(1, "x"), (None, "y"), (2, "z")} and len(rows_left) <= 6


@pytest.mark.parametrize("combine", [True, False])
def test_copies_in_one_poll(poll, combine):
    out = poll(rows(0, 5) * 40, lambda s: streams.stream_dedupe_posts(s, lateness="10 days", combine=combine))
    assert sorted(r.post_id for r in out.collect()) == list(range(5))


def test_user_cap_over_polls(poll):
    def build(s):
        return streams.stream_user_cap(s, k=3)

    first = poll(list(reversed(rows(0, 6))), build)
    assert sorted(r.post_id for r in first.collect()) == list(range(6))
    second = poll(list(reversed(rows(6, 40))), build)
    assert sorted(r.post_id for r in second.collect()) == list(range(9)), "one more each, the earliest ones"
    assert poll(rows(40, 60), build).count() == 9


def test_user_cap_with_a_heavy_user(poll):
    out = poll(rows(0, 3000, users=1) + rows(3000, 3010, users=10), lambda s: streams.stream_user_cap(s, k=2))
    assert out.where("username = 'u0'").agg(F.max("post_id")).first()[0] == 1
    assert out.count() == 2 + 9


def test_hourly_counts_equal_batch(spark, poll):
    def build(s):
        return streams.stream_sentiment_counts(s)

    poll(rows(0, 30), build, complete=True)
    out = poll(rows(30, 50), build, complete=True)
    batch = streams.sentiment_counts(spark.createDataFrame(rows(0, 50), SCHEMA))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
    sliding = streams.sentiment_counts(spark.createDataFrame(rows(0, 50), SCHEMA), slide="30 minutes")
    assert sliding.agg(F.sum("posts")).first()[0] == 100


def test_user_cap_calls_python_per_bucket_not_per_user(spark, poll):
    """Nameless posts are a user of their own, and users of a bucket have counters of their own in it."""
    def build(s):
        return streams.stream_user_cap(s, k=2, buckets=2)

    def named(first, last):
        return [(i, None if i % 5 == 0 else u, label, at) for i, u, label, at in rows(first, last, users=40)]

    poll(named(0, 60), build)
    out = poll(list(reversed(named(60, 400))), build)
    want, seen = set(), {}
    for i, u, *_ in named(0, 400):
        seen[u] = seen.get(u, 0) + 1
        if seen[u] <= 2:
            want.add((i, u))
    assert {(r.post_id, r.username) for r in out.collect()} == want and out.count() == len(want)
