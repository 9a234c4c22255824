"""Operators on the search-term list, a small ordered dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def skip_similar_terms(terms: Column) -> Column:
    """Ordered fold over an array of terms.

    A term of several words is skipped when its first word occurs inside a term
    kept before; single words always stay.
    """

    def step(kept: Column, term: Column) -> Column:
        first_word = F.substring_index(F.trim(term), " ", 1)
        similar = (F.trim(term) != first_word) & F.exists(kept, lambda t: F.contains(t, first_word))
        return F.when(similar, kept).otherwise(F.array_append(kept, term))

    return F.aggregate(terms, F.array().cast("array<string>"), step)


def term_array(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(term) for term in terms])
