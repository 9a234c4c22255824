"""op5: pseudonyms in all documents."""

from __future__ import annotations

from postlab.llm.private import KINDS, pseudonymise_column
from postlab.llm.store import table

NAME = "op5_feistel_private"
#: A production run names its own key in the session; this one makes the registered query repeatable.
KEY_SETTING, KEY = "spark.postlab.pseudonym.key", "registered query"


def key_of(spark) -> bytes:
    return spark.conf.get(KEY_SETTING, KEY).encode()


def query(spark, sf_dir):
    made = pseudonymise_column(table(spark, sf_dir, "documents"), key_of(spark))
    return made.select("doc_id", "text", *(f"n_{k}" for k in KINDS), "n_private")
