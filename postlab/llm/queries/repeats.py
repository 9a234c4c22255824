"""op3: repeated 400-byte strings in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlab.llm.repeats import remove_repeats
from postlab.llm.store import table

NAME = "op3_two_stage_suffixes"


def query(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
