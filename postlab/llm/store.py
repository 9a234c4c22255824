"""Stored intermediate tables: lineage is cut by writing Parquet to the folder all executors share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlab.session import work_path

#: The white space of all word rules here: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, rows_per_file: int | None = None) -> DataFrame:
    """Write a table once and read it back.

    Later jobs read files instead of running the plan again, a lost executor costs only its own
    tasks, and a join against it shuffles it afresh, so that adaptive execution can split hot keys.
    The files go when the session ends. ``rows_per_file`` is for rows of several MB: Parquet holds the rows of a file in memory until
    it has 100 of them, and a scan takes up to 4,096 at once, so without it a task's memory grows with its share of the input.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file or 0).parquet(path)
    _drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans nobody holds any more; it does so when their objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def words(text) -> "F.Column":
    """Words of a text: runs of anything but the white space above; none for null."""
    text = F.coalesce(text if not isinstance(text, str) else F.col(text), F.lit(""))
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
