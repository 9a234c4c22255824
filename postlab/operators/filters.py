"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab import rules
from postlab.functions.geo import in_region
from postlab.functions.text import contains_any, is_blank, parse_timestamp


def drop_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows whose listed columns are null or whitespace only."""
    for name in columns or ("location",):
        df = df.where(~is_blank(name))
    return df


def keyword_any(df: DataFrame, column: str = "content",
                keywords: Sequence[str] = rules.TOPIC_KEYWORDS) -> DataFrame:
    return df.where(contains_any(column, keywords))


def gold_label_filter(df: DataFrame, text: str = "text", label: str = "airline_sentiment") -> DataFrame:
    """Labelled rows with a known label, which is copied to ``sentiment``."""
    return (df.select(text, label).dropna()
            .where(F.col(label).isin(*rules.LABELS))
            .withColumn("sentiment", F.col(label)))


def valid_coordinates(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["latitude", "longitude"])


def valid_timestamp(df: DataFrame, column: str = "created_at") -> DataFrame:
    """Parse a text column and drop the rows that do not parse."""
    return df.withColumn(column, parse_timestamp(column)).where(F.col(column).isNotNull())


def tweet_predicate(tweets: DataFrame, reference_time: str, keyword: str | None = None,
                    hours: int = 24, lang: str = "en") -> DataFrame:
    """Original posts with a location, in one language, of the last hours.

    ``reference_time`` is a parameter so that a run can be repeated.
    """
    ref = F.to_timestamp(F.lit(reference_time))
    recent = F.col("created_at").cast("timestamp") >= ref - F.make_dt_interval(hours=F.lit(hours))
    kept = tweets.where(~F.col("is_retweet") & F.col("geo").isNotNull()
                        & (F.col("lang") == lang) & recent)
    return keyword_any(kept, "text", [keyword.strip()]) if keyword and keyword.strip() else kept


def has_usable_geo(located: DataFrame) -> DataFrame:
    return located.where(F.col("latitude").isNotNull())


def location_not_empty(df: DataFrame, column: str = "location") -> DataFrame:
    return df.where(F.col(column) != "")


def label_equals(df: DataFrame, label: str, column: str = "sentiment") -> DataFrame:
    return df.where(F.col(column) == label)


def region_membership(df: DataFrame, region: str, profile: str = "v3", column: str = "location") -> DataFrame:
    return df.where(in_region(column, region, profile))


def country_counts(df: DataFrame, countries: Sequence[str], column: str = "location") -> DataFrame:
    """Row counts of the named countries."""
    return (df.where(F.col(column).isin(*countries))
            .groupBy(column).agg(F.count(F.lit(1)).alias("posts")))
