"""op6: main text of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlab.llm.main_text import main_text
from postlab.llm.store import table

NAME = "op6_style_tree_text"


def query(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
