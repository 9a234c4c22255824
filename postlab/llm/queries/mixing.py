"""op7: all documents mixed to square-root weights of their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlab.llm.mixing import PLAN, mix_plan
from postlab.llm.store import table

NAME = "op7_pfair_mixing"


def query(spark, sf_dir):
    plan = mix_plan(table(spark, sf_dir, "documents"), block=1 << 18)
    source = F.when(F.col("mix_source") != "null", F.expr("substring(mix_source, 2)"))
    return plan.select(F.col("key").alias("doc_id"), source.alias("source"), *PLAN[1:])
