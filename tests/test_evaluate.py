import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator

from postlab import rules
from postlab.operators import evaluate
from postlab.operators.frame import tidy_metrics


@pytest.fixture(scope="module")
def predictions(spark):
    rnd = random.Random(2)
    rows = [(m, i, rnd.choice(rules.LABELS), rnd.choice(rules.LABELS[: 3 if m != "naive_bayes" else 2]))
            for m in rules.MODELS for i in range(200)]
    return spark.createDataFrame(rows, "model string, row_id long, label string, prediction string")


def test_against_spark_ml(spark, predictions):
    ours = {r.model: r for r in evaluate.weighted_prf(predictions).collect()}
    names = {label: float(i) for i, label in enumerate(rules.LABELS)}
    for model in rules.MODELS:
        rows = [(names[r.prediction], names[r.label]) for r in predictions.where(f"model = '{model}'").collect()]
        df = spark.createDataFrame(rows, "prediction double, label double")
        for metric, name in (("accuracy", "accuracy"), ("f1", "f1_score"), ("weightedPrecision", "precision"), ("weightedRecall", "recall")):
            want = MulticlassClassificationEvaluator(metricName=metric).evaluate(df)
            assert ours[model][name] == pytest.approx(want, abs=1e-4)
        assert ours[model].support == 200


def test_all_neutral_floor(spark):
    rows = [("m", i, "neutral" if i < 1646 else "negative", "neutral") for i in range(10_000)]
    df = spark.createDataFrame(rows, "model string, row_id long, label string, prediction string")
    r = evaluate.weighted_prf(df).first()
    assert (r.accuracy, r.precision, round(r.f1_score, 4)) == (0.1646, 0.0271, 0.0465)


def test_confusion_keeps_zeros(predictions):
    got = evaluate.confusion_matrix(predictions).collect()
    assert len(got) == 27 and sum(r.n for r in got) == 600
    assert all(r.n == 0 for r in got if r.model == "naive_bayes" and r.predicted == "positive")


def test_best_model_tie_and_report(spark):
    rows = [("naive_bayes", .5, .7, .5, .5), ("vader", .1, .7, .1234, .1), ("zz", .1, .7, .1, .1)]
    df = spark.createDataFrame(rows, "model string, accuracy double, f1_score double, precision double, recall double")
    assert evaluate.best_model(df).first()[0] == "vader"
    report = {r.model: r for r in evaluate.model_report(df).collect()}
    assert report["vader"].is_best and not report["naive_bayes"].is_best and report["vader"].precision == 0.123
    assert tidy_metrics(df).count() == 12
