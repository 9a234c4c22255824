"""op1: all documents to Huffman-coded files and back."""

from __future__ import annotations

import public_tokenizers

from postlab.llm.huffman import read_encoded, write_encoded
from postlab.llm.store import table
from postlab.session import work_path

NAME = "op1_huffman_ids"


def query(spark, sf_dir, tokenizer: str | None = None):
    path = work_path(spark, "huffman")
    write_encoded(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_encoded(spark, path, ids=False).withColumnRenamed("key", "doc_id")
