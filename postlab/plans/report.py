"""Merge, repair, score and report on landed post files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from postlab.functions.geo import country_from_location
from postlab.functions.text import na_to_null, repair_mojibake_runs
from postlab.operators.aggregates import sentiment_by_location, sentiment_distribution, top_words
from postlab.operators.filters import country_counts, drop_blank, label_equals, valid_timestamp
from postlab.operators.frame import union_batches
from postlab.operators.sampling import top_ascending, top_counts
from postlab.sentiment.registry import Scorer, score_posts


def merge_batches(frames: Sequence[DataFrame]) -> DataFrame:
    """Batches of differing columns, without rows that have no location."""
    return drop_blank(union_batches(frames), "location")


def repair_and_score(posts: DataFrame, scorer: Scorer, text: str = "content",
                     key: str = "post_id") -> DataFrame:
    return score_posts(posts.withColumn(text, repair_mojibake_runs(text)), scorer, text, key)


def to_countries(posts: DataFrame, only_located: bool = False) -> DataFrame:
    """Location reduced to a country. NA spellings, the empty text among them, are missing before and
    after, as on a CSV round trip; a missing location is the country ``Unknown``."""
    kept = drop_blank(posts, "location") if only_located else posts
    return kept.withColumn("location", na_to_null(country_from_location(na_to_null("location"))))


def report_tables(scored: DataFrame, stop_words: Sequence[str],
                  verify: Sequence[str] = ("Japan", "Ukraine")) -> dict[str, DataFrame]:
    """Volume tables count every row; sentiment tables only dated ones."""
    posts = to_countries(scored)
    dated = valid_timestamp(posts)
    return {
        "verified": country_counts(posts, verify),
        "top_locations": top_counts(posts, "location", 10),
        "volume": top_ascending(posts, "location", 15),
        "by_location": sentiment_by_location(dated),
        "sentiment": sentiment_distribution(dated),
        "words": top_words(dated, stop_words),
        "positive": label_equals(dated, "positive"),
    }
