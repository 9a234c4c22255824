"""op13: all documents packed by best fit into sequences of 1024 tokens."""

from __future__ import annotations

import public_tokenizers

from postlab.llm.bestfit import pack_best_fit
from postlab.llm.store import table

NAME = "op13_bulk_best_fit"


def query(spark, sf_dir, tokenizer: str | None = None):
    pieces = pack_best_fit(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens")
