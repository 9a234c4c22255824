"""op2: deleted-interpolation scores of all documents."""

from __future__ import annotations

from postlab.llm.interpolation import score_texts
from postlab.llm.store import table

NAME = "op2_deleted_interpolation"


def query(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
