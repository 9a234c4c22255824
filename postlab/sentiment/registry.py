"""Scorers by name, and the operators that apply them to a frame.

A scorer takes (frame, text column, key column) and returns the frame with
``label`` and ``score_error`` added. ``score_error`` tells a neutral label that
was predicted from one that stands in for a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab import rules
from postlab.functions.text import clean_text, is_blank
from postlab.sentiment.batch import label_batches
from postlab.sentiment.lexicon import Lexicon, lexicon_label
from postlab.sentiment.naive_bayes import NaiveBayesModel, predict_naive_bayes
from postlab.session import stored_table

Scorer = Callable[[DataFrame, str, str], DataFrame]


def lexicon_scorer(lexicon: Lexicon) -> Scorer:
    def annotate(df: DataFrame, text: str, key: str) -> DataFrame:
        return df.withColumns({"label": lexicon_label(text, lexicon),
                               "score_error": F.lit(None).cast("string")})

    return annotate


def naive_bayes_scorer(model: NaiveBayesModel) -> Scorer:
    def annotate(df: DataFrame, text: str, key: str) -> DataFrame:
        predicted = predict_naive_bayes(df, model, key, text).select(
            key, F.col("prediction").alias("label"))
        return df.join(predicted, key, "left").withColumn("score_error", F.lit(None).cast("string"))

    return annotate


def model_scorer(factory: Callable, batch_size: int = 64,
                 max_chars: int | None = None) -> Scorer:
    """A user's model; see ``label_batches``."""

    def annotate(df: DataFrame, text: str, key: str) -> DataFrame:
        scored = df.withColumn("_scored", label_batches(text, factory, batch_size, max_chars))
        return scored.select(*df.columns, "_scored.label", "_scored.score_error")

    return annotate


def score_posts(df: DataFrame, scorer: Scorer, text: str = "content", key: str = "post_id",
                into: str = "sentiment") -> DataFrame:
    """Set ``into`` to the scorer's label; null or blank text is neutral."""
    kept = [name for name in df.columns if name != into]
    scored = scorer(df.select(*kept), text, key)
    label = F.when(is_blank(text), "neutral").otherwise(F.col("label"))
    return scored.select(*kept, label.alias(into), "score_error")


def score_distinct(df: DataFrame, scorer: Scorer, text: str = "content",
                   into: str = "sentiment") -> DataFrame:
    """Score each distinct text once and map the labels back.

    Worth its shuffle for expensive models on data full of copies. The labels are stored, so the join
    shuffles them itself and AQE can split the rows of a text that many hold.
    """
    hashed = df.withColumn("_text_key", F.sha2(text, 256))
    unique = hashed.groupBy("_text_key").agg(F.any_value(text).alias(text))
    labels = score_posts(unique, scorer, text, "_text_key", into).select("_text_key", into, "score_error")
    labels = stored_table(labels, "labels")
    return (hashed.drop(into).join(labels, "_text_key", "left")
            .withColumn(into, F.coalesce(into, F.lit("neutral"))).drop("_text_key"))


def analyze_sentiment(df: DataFrame, scorers: dict[str, Scorer], model: str | None = None,
                      text: str = "text", key: str = "post_id", into: str = "sentiment") -> DataFrame:
    """Clean the text, then score it; under three characters it is neutral.

    An unknown model name falls back to the default one. The output has one row
    per input row, so this is also the batch form.
    """
    name = model if model in scorers else rules.DEFAULT_MODEL
    if name not in scorers:
        raise ValueError(f"no scorer named {name!r}; registered: {sorted(scorers)}")
    kept = [c for c in df.columns if c != into]
    cleaned = df.select(*kept, clean_text(F.coalesce(text, F.lit(""))).alias("_clean"))
    scored = scorers[name](cleaned, "_clean", key)
    label = F.when(F.length("_clean") < 3, "neutral").otherwise(F.col("label"))
    return scored.select(*kept, label.alias(into), "score_error")


def predictions_frame(test: DataFrame, scorers: dict[str, Scorer], text: str = "text",
                      label: str = "sentiment", key: str = "row_id") -> DataFrame:
    """Long frame (model, row_id, label, prediction) over all scorers."""
    frames: Iterable[DataFrame] = (
        scorer(test.select(key, text, F.col(label).alias("_actual")), text, key).select(
            F.lit(name).alias("model"), F.col(key).alias("row_id"),
            F.col("_actual").alias("label"), F.col("label").alias("prediction"))
        for name, scorer in scorers.items())
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out
