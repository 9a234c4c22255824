"""Keyword analysis over landed tweets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab import rules
from postlab.functions.labels import label_colour
from postlab.operators.aggregates import keyword_result
from postlab.operators.filters import tweet_predicate
from postlab.sentiment.registry import Scorer, analyze_sentiment
from postlab.sources.readers import ingest_tweets


def analyze_keyword(tweets: DataFrame, places: DataFrame, keyword: str, reference_time: str,
                    scorers: dict[str, Scorer], model: str | None = None,
                    max_results: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(one-row summary, scored tweets) for the tweets about a keyword: the newest ``max_results``, or all."""
    found = tweet_predicate(tweets, reference_time, keyword)
    located = ingest_tweets(_newest(found, max_results), places)
    scored = analyze_sentiment(located, scorers, model, "text", "id")
    detail = scored.withColumn("color", label_colour("sentiment"))
    used = model if model in scorers else rules.DEFAULT_MODEL
    return keyword_result(detail, keyword, used), detail


def _newest(tweets: DataFrame, max_results: int | None) -> DataFrame:
    if max_results is None:
        return tweets
    return tweets.orderBy(F.desc("created_at"), F.asc("id")).limit(max_results)
