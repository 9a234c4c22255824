"""Inputs of the registered queries: what is landed, and what of a text travels."""

import datetime as dt

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.landed import _ROUND_TRIP
from postlab.sources import readers, sinks
from tests.test_sources import SMALL


def test_landed_texts_are_compressed_and_read_back(spark, tmp_path):
    rows = [(i, f'line {i}\n"quoted", ' + "some words " * 200, "Paris") for i in range(300)]
    posts = spark.createDataFrame(rows, SMALL).select("post_id", "content", "location", F.lit("u").alias("username"),
                                                      F.lit("neutral").alias("sentiment"))
    path = str(tmp_path / "posts")
    sinks.sink_posts_csv(posts, path, compress=True)
    files = list((tmp_path / "posts").glob("part-*"))
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    assert sum(f.stat().st_size for f in files) * 4 < sum(len(r[1]) for r in rows)
    back = readers.scan_posts_csv(spark, path, _ROUND_TRIP)
    assert sorted((r.post_id, r.content) for r in back.collect()) == [(i, text) for i, text, _ in rows]


def test_profiles_are_first_texts_and_only_those_travel(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(0, "zero", "de"), (1, None, "fr"), (2, "two", None), (3, "three", "de"), (3, "three", "de")],
                          "doc_id long, text string, lang string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1), u, "view", 1.0) for i, u in
                           [(5, 1), (0, 1), (10, 1), (1, 1), (2, 2), (7, 3), (3, 4), (8, 4), (8, 4), (4, 1), (6, None), (None, 1)]],
                          "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{sf}/events.parquet")
    spark.createDataFrame([(k, f"N{k}") for k in range(25)], "n_nationkey long, n_name string").write.parquet(f"{sf}/nation.parquet")
    profiles = fx.profiles(spark, sf)
    want = fx.posts(spark, sf).groupBy(F.col("username").alias("handle")).agg(F.min_by("content", "post_id").alias("description"))
    got = sorted(profiles.collect(), key=str)
    assert got == sorted(want.collect(), key=str) and len(got) == 4
    # the text of a post is in no aggregate: only texts of first posts meet their authors
    plan = profiles._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("min(event_id") if "min(event_id" in plan else plan.index("min("):]
    assert "Aggregate" in plan and "min_by(text" in plan[:plan.index("min(")] and "min_by(" not in below
