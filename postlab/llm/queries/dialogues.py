"""op12: all conversations, damaged by a fixed rule, and repaired."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from postlab.llm.dialogues import repair
from postlab.llm.store import table

NAME = "op12_run_length_repair"


def damaged(rows: DataFrame) -> DataFrame:
    """The row's crc32 decides: 0 drops it, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(times).alias("time")).drop("time")


def query(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    repaired = repair(damaged(given))
    named = given.select("conv_id").distinct()
    audits, hashes = repaired.audits, repaired.hashes().withColumnRenamed("conv", "hashed")
    out = named.join(audits, named.conv_id.eqNullSafe(audits.conv), "left").drop("conv")
    out = out.join(hashes, out.conv_id.eqNullSafe(hashes.hashed), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
