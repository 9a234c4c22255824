"""Scans of landed files. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab import rules, schemas
from postlab.functions.geo import geo_point
from postlab.functions.text import decode_with_fallback, na_to_null, valid_utf8
from postlab.operators.frame import post_id, post_link
from postlab.operators.joins import join_place

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def spread(scan: DataFrame, key: str, per_core: int = 1) -> DataFrame:
    """Give a scan with too few tasks one task per core, by hash of ``key``.

    A compressed or multi-line file, or a file with one row group, is read by
    one task, and per-row text work would then run on one core. Input of a size
    worth a cluster has more splits than cores and passes through unchanged. Only
    for frames that are plain scans: counting the splits of anything else would
    run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() > cores:
        return scan
    return scan.repartition(cores * per_core, key)


def _names(schema: T.StructType) -> list[str]:
    return [field.name for field in schema.fields]


def scan_single_csv(spark: SparkSession, path: str | Sequence[str],
                    schema: T.StructType = schemas.POSTS) -> DataFrame:
    """CSV with quotes, embedded line breaks and an optional byte-order mark."""
    return spark.read.options(**_CSV).schema(schema).csv(path)


def scan_posts_csv(spark: SparkSession, folder: str | Sequence[str],
                   schema: T.StructType = schemas.POSTS,
                   exclude: Sequence[str] = ("posts with location",)) -> DataFrame:
    """All ``*.csv`` and ``*.csv.gz`` files of a folder except result files, recognised by name.

    The name test uses file metadata, so excluded files are pruned from the
    listing and never opened; unreadable files are skipped.
    """
    df = (spark.read.options(**_CSV).option("ignoreCorruptFiles", "true")
          .option("pathGlobFilter", "{*.csv,*.csv.gz}").option("recursiveFileLookup", "true")
          .schema(schema).csv(folder))
    # names in the metadata are percent-encoded
    name = F.replace(F.lower(F.col("_metadata.file_name")), F.lit("%20"), F.lit(" "))
    for part in exclude:
        df = df.where(~F.contains(name, F.lit(part)))
    return df


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to declared types; NA spellings and misfits become null."""
    return df.select(*[
        na_to_null(field.name).try_cast(field.dataType).alias(field.name) for field in schema.fields])


def scan_skip_bad_rows(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV whose rows with too many fields are dropped; short rows are padded.

    DROPMALFORMED would drop short rows too. Reading with one column more than
    declared, a row of exactly that length is a bad one; every other row comes
    with its raw text, in which the separators outside quotes are counted.
    """
    names = [*_names(schema), "_surplus", "_raw"]
    wide = T.StructType([T.StructField(name, T.StringType()) for name in names])
    rows = (spark.read.options(**_CSV).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_raw").schema(wide).csv(path))
    unquoted = F.regexp_replace("_raw", r'"(?:[^"]|"")*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    return _typed(rows.where(F.col("_raw").isNotNull() & (fields <= len(schema.fields))), schema)


def scan_lenient_utf8(df: DataFrame, *columns: str) -> DataFrame:
    """Bytes or text with invalid sequences to valid text, U+FFFD where broken."""
    return df.withColumns({name: valid_utf8(name) for name in columns})


def scan_encoding_fallback(df: DataFrame, *columns: str) -> DataFrame:
    """Binary columns to text: UTF-8 when valid, else Latin-1."""
    return df.withColumns({name: decode_with_fallback(name) for name in columns})


def read_text_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Whole small files (path, text) of unknown encoding."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_with_fallback("content").alias("text"))


def read_search_hits(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(schemas.SEARCH_HIT).json(path)


def ingest_search_hits(hits: DataFrame) -> DataFrame:
    """Flatten nested search hits into post rows; absent attributes get defaults."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)

    order = [name for name in ("term_idx", "pos") if name in hits.columns]
    return hits.select(
        post_link("author.handle", "uri").alias("link"),
        text("record.text").alias("content"),
        F.lit("").alias("sentiment"),
        F.col("author.handle").alias("username"),
        text("author.display_name").alias("display_name"),
        text("record.created_at").alias("created_at"),
        count("like_count"), count("reply_count"), count("repost_count"),
        post_id("uri").alias("post_id"),
        "search_term", *order,
        F.current_timestamp().alias("collected_at"))


def read_tweets(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(schemas.TWEET).json(path)


def ingest_tweets(tweets: DataFrame, places: DataFrame) -> DataFrame:
    """Flatten nested tweets that carry a usable location."""
    joined = join_place(tweets.where(F.col("geo").isNotNull()), places)
    located = joined.withColumn("_geo", geo_point(
        "geo.coordinates.coordinates", "place_bbox", "place_full_name", "place_country_code"))
    metrics = [F.col(f"public_metrics.{name}").alias(name)
               for name in ("retweet_count", "like_count", "reply_count", "quote_count")]
    return located.where(F.col("_geo").isNotNull()).select(
        *[name for name in ("id",) if name in tweets.columns],
        "text", "created_at", "author_id", *metrics, "_geo.*")


def read_best_model(spark: SparkSession, path: str) -> DataFrame:
    """One row with the selected model, the default one when none is stored."""
    try:
        stored = (spark.read.option("multiLine", "true")
                  .schema("best_model string").json(path))
    except Exception as missing:     # no such path: same answer as an empty file
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = spark.createDataFrame([], "best_model string")
    return stored.agg(F.coalesce(F.max("best_model"), F.lit(rules.DEFAULT_MODEL)).alias("best_model"))
