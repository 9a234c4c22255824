"""op8: the 20 nearest of every 20th vector among all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlab.llm.neighbours import neighbours
from postlab.llm.store import table

NAME = "op8_stable_projection_search"


def query(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
