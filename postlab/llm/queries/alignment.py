"""op11: byte-level and sentence-piece tokens of all documents aligned."""

from __future__ import annotations

import public_tokenizers

from postlab.llm.alignment import align
from postlab.llm.store import table

NAME = "op11_identity_alignment"


def query(spark, sf_dir, a: str | None = None, b: str | None = None):
    found = align(table(spark, sf_dir, "documents"), a or public_tokenizers.path("byte_bpe_50k.json"),
                  b or public_tokenizers.path("piece_bpe_32k.model"))
    return found.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
