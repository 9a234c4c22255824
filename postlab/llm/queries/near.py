"""op9: near-duplicate groups of all documents."""

from __future__ import annotations

from postlab.llm.near import near_duplicates
from postlab.llm.store import table

NAME = "op9_hyperminhash_near"


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
