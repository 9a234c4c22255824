"""Training-data pipeline: documents in, packed token sequences out.

Each stage is a function of (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
``documents``; the last returns pieces of sequences. ``run`` writes each stage as Parquet to the folder all executors share and
rereads it as the next one's documents.

1. ``quality``: drops failing lines, then documents that fail (the text is what stays, ``n_chars`` its length).
2. ``near_duplicates``: one document of each group stays, the one with the smallest id (ids come before none, then the first row). Texts decide, not ids.
3. ``private``: personal data become pseudonyms.
4. ``mixing``: documents in mixed order; each stays exactly once, the stored files follow the order.
5. ``packing``: ids of the byte-level tokenizer in sequences of 1024, whose ids follow the mixed order.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlab.llm.mixing import mix, mix_plan, named_source
from postlab.llm.near import near_duplicates
from postlab.llm.packing import pack
from postlab.llm.private import pseudonymise_column
from postlab.llm.quality import clean_lines
from postlab.llm.queries.private import key_of
from postlab.llm.store import release, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share this much of their five-word shingles, in hundredths (op9 by itself asks for 85).
NEAR_PERCENT = 80
#: Characters of a block of the mix.
MIX_BLOCK = 1 << 18
#: Packing depends on the library's tokenizer, so the result can't be said in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = clean_lines(docs).filter("kept")
    return judged.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays. Rows have stored numbers of their own: repeated and null ids are judged by their texts."""
    rows = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = near_duplicates(rows, key="row", percent=NEAR_PERCENT).select("row", "component_id")
    first = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    stays = stored(first.select("first.row"), "pipeline-stays")
    return rows.join(stays.hint("merge"), "row", "left_semi").select(*COLUMNS)        # no bound is known for what stays


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = pseudonymise_column(docs, key_of(spark))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, block=MIX_BLOCK).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stored documents don't tell their place, so it is computed again; the same documents have the same plan."""
    plan = stored(mix_plan(docs, block=MIX_BLOCK).select("key", "mix_source", "position"), "pipeline-order")
    placed = docs.withColumn("named", named_source("source")).join(
        plan.hint("merge"), F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("named") == F.col("mix_source"))).select("doc_id", "text", "position")
    pieces = pack(placed, public_tokenizers.path("byte_bpe_50k.json"), end=0, order="position")
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("near duplicates", dedup), ("personal data", private), ("source mixing", mixing),
    ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark)
    return docs
