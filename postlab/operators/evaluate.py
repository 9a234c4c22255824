"""Classifier evaluation over a long predictions frame (model, row_id, label, prediction).

All metrics start from one grouped count over (model, label, prediction), at
most models x labels x labels rows, so the predictions are scanned once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab import rules


def prediction_counts(predictions: DataFrame) -> DataFrame:
    return (predictions.groupBy("model", "label", "prediction")
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(predictions: DataFrame, labels: Sequence[str] = rules.LABELS) -> DataFrame:
    """Rows per (model, actual, predicted) with zeros kept."""
    cells = [F.coalesce(F.sum(F.when((F.col("label") == a) & (F.col("prediction") == p), F.col("n"))),
                        F.lit(0)).alias(f"{a}|{p}") for a in labels for p in labels]
    wide = prediction_counts(predictions).groupBy("model").agg(*cells)
    tall = wide.unpivot(["model"], [f"{a}|{p}" for a in labels for p in labels], "cell", "n")
    return tall.select("model", F.substring_index("cell", "|", 1).alias("actual"),
                       F.substring_index("cell", "|", -1).alias("predicted"), "n")


def accuracy(predictions: DataFrame) -> DataFrame:
    return (predictions.groupBy("model")
            .agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy")))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_scores(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per (model, class); 0 on zero division.

    Each count cell speaks for its actual class and for its predicted class, so
    the two sides are exploded instead of joined.
    """
    n = F.col("n")
    sides = F.array(
        F.struct(F.col("label").alias("class"), n.alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), n).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 n.alias("predicted"), F.lit(0).cast("long").alias("tp")))
    per_class = (prediction_counts(predictions).select("model", F.inline(sides))
                 .groupBy("model", "class")
                 .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                      F.sum("tp").alias("tp")))
    scored = per_class.withColumns({
        "precision": _ratio(F.col("tp"), F.col("predicted")),
        "recall": _ratio(F.col("tp"), F.col("support")),
        # 2pr / (p + r) in counts, without the two divisions
        "f1_score": _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
    })
    return scored.select("model", "class", "precision", "recall", "f1_score", "support")


def class_f1(predictions: DataFrame, labels: Sequence[str] = rules.LABELS) -> DataFrame:
    return (class_scores(predictions).where(F.col("class").isin(*labels))
            .select("model", "class", "f1_score"))


def weighted_prf(predictions: DataFrame) -> DataFrame:
    """Support-weighted precision, recall, F1 and accuracy per model, 4 digits."""
    weight = F.col("support")

    def mean(name: str) -> Column:
        return F.round(F.sum(F.col(name) * weight) / F.sum(weight), 4)

    return class_scores(predictions).groupBy("model").agg(
        mean("recall").alias("accuracy"),      # weighted recall is the accuracy
        mean("f1_score").alias("f1_score"),
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
        F.sum(weight).alias("support"))


def _model_position(models: Sequence[str]) -> Column:
    names = F.array(*[F.lit(name) for name in models])
    return F.coalesce(F.nullif(F.array_position(names, F.col("model")), F.lit(0).cast("long")),
                      F.lit(len(models) + 1).cast("long"))


def best_model(metrics: DataFrame, models: Sequence[str] = rules.MODELS) -> DataFrame:
    """Model with the highest F1; the earlier listed one on a tie."""
    order = F.struct(F.col("f1_score"), (-_model_position(models)).alias("o"))
    return metrics.agg(F.max_by("model", order).alias("best_model"))


def model_report(metrics: DataFrame, models: Sequence[str] = rules.MODELS) -> DataFrame:
    """Metric table in model order, 3 digits, with the best model marked."""
    best = best_model(metrics, models).scalar()
    rounded = [F.round(name, 3).alias(name) for name in rules.METRICS]
    return metrics.select("model", *rounded, (F.col("model") == best).alias("is_best"))
