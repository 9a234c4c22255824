import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlab import rules
from postlab.functions.labels import label_colour, label_score, softmax_label
from postlab.sentiment import batch, lexicon, naive_bayes, registry

LEX = lexicon.Lexicon(
    {"good": 1.9, "bad": -2.5, "great": 3.1, "so": 0.0}, boosters={"very": 0.293, "hardly": -0.293, "good": 0.5},
    negations=("not", "never", "don't"))


def restated(text, lex):
    """The published formula as a loop: lexicon, boosters with damping, negation."""
    words = re.findall(r"[\w']+", (text or "").lower())
    total = 0.0
    for i, word in enumerate(words):
        v = lex.valences.get(word, 0.0)
        if not v:
            continue
        for d, damping in enumerate(rules.VADER_DAMPING, start=1):
            before = words[i - d] if i - d >= 0 else None
            if before is None or before in lex.valences:
                continue
            boost = lex.boosters.get(before, 0.0) * damping
            v += -boost if v < 0 else boost
            if before in lex.negations:
                v *= rules.VADER_NEGATION
        total += v
    return round(total / math.sqrt(total * total + rules.VADER_ALPHA), 4)


def test_lexicon_matches_loop(one):
    rnd = random.Random(4)
    vocab = ["good", "bad", "great", "so", "very", "hardly", "not", "never", "don't", "cat", "É", "runs"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 12))) for _ in range(300)] + [None, "", "Not, VERY good!"]
    got = one(lambda c: lexicon.compound_score(c, LEX), texts)
    assert got == pytest.approx([restated(t, LEX) for t in texts], abs=1e-9)
    labels = one(lambda c: lexicon.lexicon_label(c, LEX), texts)
    assert labels == ["positive" if g >= 0.05 else "negative" if g <= -0.05 else "neutral" for g in got]


def test_lexicon_table_is_refused_not_cut(spark):
    table = spark.range(20).select(F.concat(F.lit("w"), "id").alias("token"), F.col("id").cast("double").alias("valence"))
    assert len(lexicon.Lexicon.from_table(table).valences) == 20
    with pytest.raises(ValueError):
        lexicon.Lexicon.from_table(table, max_entries=10)


@pytest.mark.parametrize("bound", [3, 10_000])
def test_long_lexicon_is_joined(spark, bound):
    rnd = random.Random(9)
    vocab = ["good", "bad", "great", "so", "very", "hardly", "not", "never", "cat", "runs"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 14))) for _ in range(150)] + [None, "", "Not, VERY good!"]
    for valences in (dict(LEX.valences), dict(LEX.valences) | {"very": 1.5, "not": 0.0}):
        table = spark.createDataFrame(list(valences.items()), "token string, valence double")
        df = spark.createDataFrame(list(enumerate(texts)), "post_id int, text string")
        got = {r.post_id: r.compound for r in lexicon.score_with_table(df, table, "post_id", max_entries=bound).collect()}
        own = lexicon.Lexicon(valences)
        assert [got[i] for i in range(len(texts))] == pytest.approx([restated(t, own) for t in texts], abs=1e-9)


def test_analyze_sentiment(spark):
    df = spark.createDataFrame([(1, "http://x.y GOOD"), (2, "#!"), (3, None), (4, "ok @good"), (5, "bad")], "post_id int, text string")
    scorers = {"vader": registry.lexicon_scorer(LEX)}
    got = dict(registry.analyze_sentiment(df, scorers, "vader").select("post_id", "sentiment").collect())
    assert got == {1: "positive", 2: "neutral", 3: "neutral", 4: "neutral", 5: "negative"}
    with pytest.raises(ValueError):
        registry.analyze_sentiment(df, scorers, "unknown")
    fallback = {"roberta_twitter": registry.lexicon_scorer(LEX)}
    assert registry.analyze_sentiment(df, fallback, "unknown").where("sentiment = 'negative'").count() == 1


def test_short_clean_text_is_neutral_whatever_the_model_says(spark):
    df = spark.createDataFrame([(1, "bad"), (2, "b!d")], "post_id int, text string")
    always = registry.model_scorer(lambda: lambda texts: ["Positive" for _ in texts])
    got = dict(registry.analyze_sentiment(df, {"m": always}, "m").select("post_id", "sentiment").collect())
    assert got == {1: "positive", 2: "neutral"}


def flaky():
    def model(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("no")
        return ["POSITIVE" if len(t) == 600 else "Negative" for t in texts]
    return model


def test_failures_are_visible_and_cost_only_their_row(spark):
    rows = [(i, "boom" if i == 7 else None if i == 8 else " " if i == 9 else "x" * 600) for i in range(40)]
    df = spark.createDataFrame(rows, "post_id int, content string").coalesce(1)
    got = {r.post_id: (r.sentiment, r.score_error) for r in registry.score_posts(df, registry.model_scorer(flaky)).collect()}
    assert got.pop(7) == ("neutral", "RuntimeError: no")
    assert got.pop(8) == got.pop(9) == ("neutral", None)
    assert set(got.values()) == {("positive", None)}, "the whole text reaches the model"


def test_distinct_scoring_gives_every_copy_a_label(spark):
    df = spark.createDataFrame([(i, ["bad", "good", None][i % 3]) for i in range(30)], "post_id int, content string")
    got = registry.score_distinct(df, registry.lexicon_scorer(LEX)).groupBy("sentiment").count().collect()
    assert dict(got) == {"negative": 10, "positive": 10, "neutral": 10}


def test_failed_batch_is_retried_row_by_row(spark):
    def build():
        def model(texts):
            if "boom" in texts:
                raise ValueError("bad")
            return [[0.0, 0.0, 5.0]] * len(texts)
        return model

    df = spark.createDataFrame([(i, "boom" if i == 0 else "x") for i in range(8)], "i int, text string").coalesce(1)
    rows = {r.i: r.s for r in df.select("i", batch.infer_batches("text", build, batch_size=4).alias("s")).collect()}
    assert tuple(rows[0]) == ("Neutral", 0.33, 0.34, 0.33, "ValueError: bad")
    assert rows[1].sentiment == "Positive" and rows[1].score_error is None
    assert rows[5].sentiment == "Positive" and rows[5].score_error is None and rows[5].pos_score > 0.98


def test_softmax_and_lookups(spark):
    df = spark.createDataFrame([([1000.0, 999.0, 0.0], "positive", "Positive"), ([0.0, 0.0, 0.0], "odd", "odd"), ([0.0, 1.0, 2.0], None, None)],
                               "l array<double>, a string, b string")
    rows = df.select(softmax_label("l").alias("s"), label_score("a").alias("v"), label_colour("a").alias("c"),
                     label_colour("b", "map").alias("m")).collect()
    assert [r.s.sentiment for r in rows] == ["Negative", "Negative", "Positive"]
    assert rows[0].s.neg_score == pytest.approx(1 / (1 + math.exp(-1)))
    assert [(r.v, r.c, r.m) for r in rows] == [(1, "#00FF00", "#2ecc71"), (0, None, "gray"), (0, None, "gray")]


@pytest.fixture(scope="module")
def gold(spark):
    rnd = random.Random(9)
    words = {"positive": ["love", "nice", "thanks"], "negative": ["late", "lost", "rude"], "neutral": ["gate", "flight", "when"]}
    rows = []
    for i in range(120):
        label = rnd.choice(list(words))
        text = [rnd.choice(words[label] if rnd.random() < 0.7 else ["plane", "the", "city", "a1"]) for _ in range(8)]
        rows.append((i, " ".join(text), label))
    return pd.DataFrame(rows, columns=["row_id", "text", "sentiment"])


def brute_tfidf(docs, stop, k):
    from collections import Counter
    terms = []
    for text in docs:
        ws = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stop]
        terms.append(Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]))
    corpus = sum(terms, Counter())
    vocab = sorted(corpus, key=lambda t: (-corpus[t], t))[:k]
    df = {t: sum(t in d for d in terms) for t in vocab}
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab}
    out = []
    for d in terms:
        raw = {t: d[t] * idf[t] for t in vocab if t in d}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append({t: v / norm for t, v in raw.items()})
    return out, vocab


def test_tfidf_matches_brute_force(spark, gold):
    df = spark.createDataFrame(gold)
    got = naive_bayes.tfidf_features(df, "row_id", "text", ["the"], max_features=15).toPandas()
    want, _ = brute_tfidf(gold.text, {"the"}, 15)
    have = {(r.row_id, r.term): r.weight for r in got.itertuples()}
    assert have == pytest.approx({(i, t): w for i, d in enumerate(want) for t, w in d.items()})


def test_naive_bayes_matches_spark_ml(spark, gold, tmp_path):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame(gold)
    model = naive_bayes.train_naive_bayes(df, "row_id", "text", "sentiment", ["the"], max_features=15)
    model.save(str(tmp_path / "nb"))
    model = naive_bayes.NaiveBayesModel.load(spark, str(tmp_path / "nb"), ["the"])
    unseen = spark.createDataFrame([(1000, "zzz qqq", ""), (1001, None, "")], "row_id int, text string, sentiment string")
    got = naive_bayes.predict_naive_bayes(df.unionByName(unseen), model, "row_id", "text").toPandas().set_index("row_id")

    weights, vocab = brute_tfidf(gold.text, {"the"}, 15)
    index = {t: i for i, t in enumerate(vocab)}
    rows = [(i, float(rules.LABELS.index(l)), Vectors.sparse(len(vocab), {index[t]: w for t, w in d.items()}))
            for i, (d, l) in enumerate(zip(weights, gold.sentiment))]
    ml = NaiveBayes(smoothing=0.1).fit(spark.createDataFrame(rows, ["row_id", "label", "features"]))
    # the ML prior is smoothed too; compare the terms, then our own prior
    theta = {(label, t): ml.theta.toArray()[rules.LABELS.index(label), index[t]] for label in rules.LABELS for t in vocab}
    ours = {(r.label, r.term): r.log_prob for r in model.tall().collect()}
    assert ours == pytest.approx(theta)
    share = gold.sentiment.value_counts(normalize=True)
    for label in rules.LABELS:
        assert got.loc[1000, label] == got.loc[1001, label] == pytest.approx(math.log(share[label]))
    assert (got.loc[gold.row_id, "prediction"].values == gold.sentiment.values).mean() > 0.9


def test_class_without_training_rows_cannot_win(spark):
    df = spark.createDataFrame([(1, "good day", "positive"), (2, "bad day", "negative")], "row_id int, text string, sentiment string")
    model = naive_bayes.train_naive_bayes(df, "row_id", "text", "sentiment", [])
    got = dict(naive_bayes.predict_naive_bayes(df, model, "row_id", "text").select("row_id", "prediction").collect())
    assert got == {1: "positive", 2: "negative"}


def test_the_value_of_a_word_takes_few_set_tests(one):
    table = {f"w{i}": i / 8 - 4 for i in range(65)}           # 64 values other than 0
    assert one(lambda c: lexicon._value_of(table, c), [*table, "other", None]) == [*table.values(), 0.0, 0.0]
    said, depth, deepest = str(lexicon._value_of(table, F.col("w"))), 0, 0
    for part in re.findall(r"CASE WHEN|\bEND\b", said):
        depth += 1 if part == "CASE WHEN" else -1
        deepest = max(deepest, depth)
    assert deepest == 7                                         # known or not, then six halvings
