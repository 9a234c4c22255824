"""Writers and stored intermediate results.

Every write is a Spark job that lands in a directory and commits as a whole, so
a lost executor costs a task, not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab import rules
from postlab.operators.evaluate import best_model
from postlab.operators.frame import (derive_strength_confidence, export_column_order,
                                     project_columns, reorder_required_first, require_columns,
                                     stamp_time)

_CSV_OUT = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


#: Texts land many times larger than the tables they come from; the fastest level already takes most of that off.
COMPRESSED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), compress: bool = False) -> None:
    writer = df.write.mode("overwrite").options(**_CSV_OUT)
    if compress:
        writer = writer.options(**COMPRESSED)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def sink_posts_csv(posts: DataFrame, path: str, batch_id: str | None = None, compress: bool = False) -> None:
    """Required columns first; a batch id becomes a partition instead of a file name. The readers take files with ``compress``, too."""
    out = reorder_required_first(require_columns(posts))
    if batch_id is None:
        _csv(out, path, compress=compress)
    else:
        _csv(out.withColumn("batch_id", F.lit(batch_id)), path, ["batch_id"], compress)


def sink_csv_bom(df: DataFrame, path: str, compress: bool = False) -> None:
    """CSV for spreadsheets: the byte-order mark leads the first header of each file."""
    first, *rest = df.columns
    _csv(df.select(F.col(first).alias("\ufeff" + first), *rest), path, compress=compress)


def checkpoint_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage result and go on from the stored table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored result, or None when the path holds none."""
    try:
        return spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def compute_if_absent(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                      columns: Sequence[str] = rules.STORED_COLUMNS) -> DataFrame:
    """Stored result when there is one, else compute, store the wanted columns, reread."""
    found = stored(spark, path)
    if found is not None:
        return found
    return checkpoint_stage(project_columns(compute(), columns), path)


def sink_metrics(metrics: DataFrame, folder: str, models: Sequence[str] = rules.MODELS) -> None:
    """``metrics.json``: one record with time, best model and all results;
    ``metrics.csv``: one row per model. One row per model: a handful."""
    record = metrics.agg(
        F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("timestamp"),
        F.map_from_entries(F.collect_list(F.struct(
            F.col("model"), F.struct(*rules.METRICS, "support")))).alias("results"))
    best = best_model(metrics, models).scalar()
    record.withColumn("best_model", best).write.mode("overwrite").json(f"{folder}/metrics.json")
    _csv(metrics, f"{folder}/metrics.csv")


def export_frame(df: DataFrame, include_original: bool = True, stamp: bool = True) -> DataFrame:
    """Scored rows with derived columns, in export order."""
    derived = derive_strength_confidence(df)
    if stamp:
        derived = stamp_time(derived, "analysis_timestamp")
    return export_column_order(derived, include_original)


def export_scored(df: DataFrame, path: str, include_original: bool = True) -> DataFrame:
    frame = export_frame(df, include_original)
    _csv(frame, path)
    return frame
