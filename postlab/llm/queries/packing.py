"""op4: all documents packed into sequences of 1024 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from postlab.llm.packing import pack
from postlab.llm.store import table

NAME = "op4_cutting_stock_packing"


def query(spark, sf_dir, tokenizer: str | None = None):
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
