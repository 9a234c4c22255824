"""Incremental forms of the collection and report operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from postlab import rules
from postlab.session import work_path


def landing_stream(spark: SparkSession, folder: str, schema: T.StructType,
                   files_per_trigger: int | None = None, file_format: str = "parquet",
                   glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def first_copies(posts: DataFrame, key: str) -> DataFrame:
    """Drop repeats of a key inside each Arrow batch; narrow and stateless."""

    def keep(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            codes = batch.column(key).dictionary_encode(null_encoding="encode").indices
            _, first = np.unique(codes.to_numpy(zero_copy_only=False), return_index=True)
            yield batch.take(pa.array(np.sort(first)))

    return posts.mapInArrow(keep, posts.schema)


def stream_dedupe_posts(posts: DataFrame, event_time: str = "created_at", key: str = "post_id",
                        lateness: str = "30 days", combine: bool = True) -> DataFrame:
    """Each post once; state for a post is dropped after ``lateness``.

    Streaming de-duplication has no map side of its own: all copies of a post
    travel to one task. ``combine`` drops the repeats of each Arrow batch first,
    so a post redelivered without end sends one row per batch. Turn it off where
    repeats are rare and rows are wide.
    """
    unique = first_copies(posts, key) if combine else posts
    return unique.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])


def stream_user_cap(posts: DataFrame, k: int = rules.ACCEPTED_USER_CAP, user: str = "username",
                    order: tuple[str, str] = ("created_at", "post_id"), buckets: int = 1024) -> DataFrame:
    """At most ``k`` posts per user over all polls; earlier polls go first and
    within one poll the order columns decide.

    Users meet in ``buckets`` groups by hash, since a call of Python for each user costs far more than the user's few rows. The
    state of a bucket is one counter per user of it: choose more buckets for more than some ten million users, and keep
    their number while a stream lives. Before the shuffle each Arrow batch already drops a user's surplus rows, so a heavy account
    sends at most k rows per batch to its task, and the task itself keeps only k rows of a user at a time.
    """
    columns = posts.columns
    order = list(order)

    def combine(batches):
        for pdf in batches:
            yield pdf.sort_values(order, kind="stable").groupby(user, sort=False, dropna=False).head(k)

    def names(pdf):
        return [None if name != name else name for name in pdf[user].tolist()]

    def spend(key, batches, state):
        import numpy as np
        import pandas as pd

        spent = dict(zip(*state.get)) if state.exists else {}
        best = None
        for pdf in batches:
            both = pdf if best is None else pd.concat([best, pdf], ignore_index=True)
            left = k - np.array([spent.get(name, 0) for name in names(both)], np.int64)
            both = both[left > 0].assign(_left=left[left > 0]).sort_values(order, kind="stable")
            place = both.groupby(user, sort=False, dropna=False).cumcount()
            best = both[place < both["_left"]][columns]
        if best is not None and len(best):
            for name in names(best):
                spent[name] = spent.get(name, 0) + 1
            state.update((list(spent), list(spent.values())))
            yield best

    kind = dict(posts.dtypes)[user]
    return (posts.mapInPandas(combine, posts.schema)
            .withColumn("_bucket", F.pmod(F.xxhash64(user), F.lit(buckets)))
            .groupBy("_bucket")
            .applyInPandasWithState(spend, posts.schema, f"users array<{kind}>, spent array<int>", "append",
                                    GroupStateTimeout.NoTimeout))


def sentiment_counts(posts: DataFrame, event_time: str = "created_at", label: str = "sentiment",
                     window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Posts per time window and label; works on batch and streaming frames."""
    span: Column = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return (posts.groupBy(span.alias("w"), label).agg(F.count(F.lit(1)).alias("posts"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    label, "posts"))


def stream_sentiment_counts(posts: DataFrame, event_time: str = "created_at",
                            lateness: str = "1 hour", **options) -> DataFrame:
    return sentiment_counts(posts.withWatermark(event_time, lateness), event_time, **options)


def start_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over everything landed so far, exactly once per input row, then stop."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def start_latest_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Complete mode: the whole result table replaces the stored one per batch."""

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (stream.writeStream.outputMode("complete").foreachBatch(replace)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def drain(spark: SparkSession, stream: DataFrame, name: str, complete: bool = False) -> DataFrame:
    """Run a stream over the landed files and read its output as a table."""
    path, checkpoint = work_path(spark, name), work_path(spark, f"{name}-state")
    start = start_latest_to_parquet if complete else start_to_parquet
    start(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
