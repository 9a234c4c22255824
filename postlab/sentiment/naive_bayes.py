"""TF-IDF features and multinomial Naive Bayes as grouped aggregates.

A document is one row (its key is unique), so its terms are counted inside the
row: sorted n-grams, run lengths. No token is shuffled to be counted. What is
shuffled are partial sums per term (vocabulary), the vocabulary terms of the
training documents (their norm), and one partial sum per document (prediction).

The vocabulary is limited to ``MAX_FEATURES`` terms, which bounds every table
that is looked up here (vocabulary: 5,000 rows; model: 5,000 rows with one
column per class). Those two are the only broadcasts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlab import rules
from postlab.functions.text import WORD_CHARS, _col, let, tokens

MAX_FEATURES = 5000
MAX_BROADCAST_ROWS = 100_000
ALPHA = 0.1


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def ngrams(text, stop_words: Sequence[str]) -> Column:
    """Words of two or more characters without stop words, and their pairs."""
    words = tokens(F.coalesce(_col(text), F.lit("")), f"[{WORD_CHARS}]{{2,}}")
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))

    def with_pairs(ws: Column) -> Column:
        # concat with the missing word after the last one is null
        pairs = F.transform(ws, lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1)))
        return F.concat(ws, F.array_compact(pairs))

    return let(words, with_pairs)


def counted_ngrams(text, stop_words: Sequence[str]) -> Column:
    """Array of (term, tf): each distinct n-gram of a text with its count."""

    def run_lengths(ordered: Column) -> Column:
        starts = F.array_compact(F.transform(
            ordered, lambda x, i: F.when(~x.eqNullSafe(F.get(ordered, i - 1)), i)))
        return let(starts, lambda at: F.transform(at, lambda s, j: F.struct(
            F.get(ordered, s).alias("term"),
            (F.coalesce(F.get(at, j + 1), F.size(ordered)) - s).cast("long").alias("tf"))))

    return let(F.sort_array(ngrams(text, stop_words)), run_lengths)


def term_counts(docs: DataFrame, key: str, text: str, stop_words: Sequence[str],
                carry: Sequence[str] = ()) -> DataFrame:
    """One row per (document, distinct term) with its count; a narrow operation."""
    return docs.select(key, *carry, F.inline(counted_ngrams(text, stop_words)))


def vocabulary(counts: DataFrame, n_docs: Column, max_features: int = MAX_FEATURES) -> DataFrame:
    """Most frequent terms of the corpus with idf = ln((1 + n) / (1 + df)) + 1."""
    per_term = counts.groupBy("term").agg(
        F.sum("tf").alias("corpus_tf"), F.count(F.lit(1)).alias("df"))
    top = per_term.orderBy(F.desc("corpus_tf"), F.asc("term")).limit(max_features)
    return top.select("term", "corpus_tf", "df", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def _lookup_side(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a vocabulary-sized table while its row bound allows it; a larger
    one is left to the measured size and a shuffle join."""
    return F.broadcast(table) if rows <= MAX_BROADCAST_ROWS else table


def _doc_count(docs: DataFrame) -> Column:
    return docs.agg(F.count(F.lit(1)).alias("n")).scalar()


def tfidf_features(docs: DataFrame, key: str, text: str, stop_words: Sequence[str],
                   carry: Sequence[str] = (), max_features: int = MAX_FEATURES) -> DataFrame:
    """(document, term, weight) with L2-normalised rows.

    The norm is a window per document, which holds at most ``max_features`` rows.
    """
    counts = term_counts(docs, key, text, stop_words, carry)
    vocab = vocabulary(counts, _doc_count(docs), max_features).select("term", "idf")
    raw = (counts.join(_lookup_side(vocab, max_features), "term")
           .select(key, *carry, "term", (F.col("tf") * F.col("idf")).alias("raw")))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, *carry, "term", (F.col("raw") / norm).alias("weight"))


@dataclass(frozen=True)
class NaiveBayesModel:
    """``terms``: one row per vocabulary term with idf and a log probability per
    class; ``priors``: one row with the log prior of each class."""

    terms: DataFrame
    priors: DataFrame
    labels: Sequence[str]
    stop_words: Sequence[str]
    max_features: int      # bound on the rows of ``terms``

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.priors.write.mode("overwrite").parquet(f"{path}/priors")

    @classmethod
    def load(cls, spark: SparkSession, path: str, stop_words: Sequence[str],
             labels: Sequence[str] = rules.LABELS) -> NaiveBayesModel:
        terms = spark.read.parquet(f"{path}/terms")
        # the row count comes from the file footers
        return cls(terms, spark.read.parquet(f"{path}/priors"), labels, stop_words, terms.count())

    def tall(self) -> DataFrame:
        """(term, label, log_prob)."""
        return self.terms.unpivot(["term"], list(self.labels), "label", "log_prob")


def train_naive_bayes(docs: DataFrame, key: str, text: str, label: str,
                      stop_words: Sequence[str], labels: Sequence[str] = rules.LABELS,
                      alpha: float = ALPHA, max_features: int = MAX_FEATURES) -> NaiveBayesModel:
    """Multinomial model with additive smoothing and fitted priors.

    Sums of all classes are columns of one grouped pass, so the term x class
    grid exists without a cross join.
    """
    counts = term_counts(docs, key, text, stop_words, [label])
    vocab = vocabulary(counts, _doc_count(docs), max_features).select("term", "idf")
    raw = (counts.join(_lookup_side(vocab, max_features), "term")
           .select(key, label, "term", "idf", (F.col("tf") * F.col("idf")).alias("raw")))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    weighted = raw.withColumn("weight", F.col("raw") / norm)

    def of_class(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(label) == name, F.col("weight"))), F.lit(0.0)).alias(name)

    mass = weighted.groupBy("term", "idf").agg(*[of_class(name) for name in labels])
    # at most max_features rows: totals as a window need no second pass
    everything = Window.partitionBy(F.lit(1))
    terms = mass.select("term", "idf", *[
        F.log((F.col(name) + alpha)
              / (F.sum(name).over(everything) + alpha * F.count(F.lit(1)).over(everything))).alias(name)
        for name in labels])
    priors = docs.agg(*[
        F.log(F.count_if(F.col(label) == name) / F.count(F.lit(1))).alias(name) for name in labels])
    return NaiveBayesModel(terms, priors, list(labels), list(stop_words), max_features)


def predict_naive_bayes(docs: DataFrame, model: NaiveBayesModel, key: str, text: str) -> DataFrame:
    """(document, prediction, one joint log likelihood per class).

    The dot products and the row norm come from one grouped pass, whose map side
    already folds a document into one row. A document without any known term
    keeps a row of nulls and gets the prior.
    """
    terms = docs.select(key, F.inline_outer(counted_ngrams(text, model.stop_words)))
    weighted = terms.join(_lookup_side(model.terms, model.max_features), "term", "left")
    raw = F.col("tf") * F.col("idf")
    sums = weighted.groupBy(key).agg(
        F.sqrt(F.sum(raw * raw)).alias("_norm"),
        *[F.sum(raw * F.col(name)).alias(name) for name in model.labels])
    prior = model.priors.select(F.struct(*model.labels).alias("p")).scalar()   # one row, one subquery
    scores = sums.select(key, *[
        (prior[name]
         + F.coalesce(F.col(name) / F.col("_norm"), F.lit(0.0))).alias(name)
        for name in model.labels])
    # a class without training rows has no prior and cannot win
    best = F.greatest(*[F.coalesce(name, F.lit(float("-inf"))) for name in model.labels])
    winner = F
    for name in model.labels:
        winner = winner.when(F.col(name) == best, name)
    return scores.withColumn("prediction", winner)
