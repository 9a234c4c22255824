"""Model comparison on labelled posts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from postlab.operators.evaluate import best_model, class_f1, confusion_matrix, model_report, weighted_prf
from postlab.operators.sampling import head_tail_split
from postlab.sentiment.naive_bayes import NaiveBayesModel, train_naive_bayes
from postlab.sentiment.registry import Scorer, naive_bayes_scorer, predictions_frame
from postlab.sources.sinks import checkpoint_stage


@dataclass(frozen=True)
class Comparison:
    predictions: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    class_f1: DataFrame
    best: DataFrame
    report: DataFrame


def compare_models(gold: DataFrame, scorers: dict[str, Scorer], stop_words: Sequence[str],
                   key: str = "row_id", text: str = "text", label: str = "sentiment",
                   order: Sequence[str] = (), folder: str | None = None) -> Comparison:
    """Train Naive Bayes on the first 80 %, test all scorers on the last 20 %.

    ``key`` is numeric, unique and stands for the file order of the labelled set.
    With ``folder`` the model and the predictions are stored there as tables and
    all reports read those; without it each report runs the scorers again.
    """
    train, test = head_tail_split(gold, key)
    model = train_naive_bayes(train, key, text, label, stop_words)
    if folder:
        model.save(f"{folder}/model")
        model = NaiveBayesModel.load(gold.sparkSession, f"{folder}/model", stop_words)
    everyone = {**scorers, "naive_bayes": naive_bayes_scorer(model)}
    names = tuple(order) or tuple(everyone)
    predictions = predictions_frame(test, {n: everyone[n] for n in names}, text, label, key)
    if folder:
        predictions = checkpoint_stage(predictions, f"{folder}/predictions")
    metrics = weighted_prf(predictions)
    return Comparison(predictions, metrics, confusion_matrix(predictions), class_f1(predictions),
                      best_model(metrics, names), model_report(metrics, names))
