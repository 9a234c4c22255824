"""Social-post analytics as Spark DataFrame operators."""

from postlab.plans.collect import collect_posts, collection_report, select_posts
from postlab.plans.compare import Comparison, compare_models
from postlab.plans.keyword import analyze_keyword
from postlab.plans.report import merge_batches, repair_and_score, report_tables, to_countries
from postlab.plans.spatial import map_tables, prepare_located
from postlab.sentiment.lexicon import Lexicon
from postlab.sentiment.naive_bayes import NaiveBayesModel, predict_naive_bayes, train_naive_bayes
from postlab.sentiment.registry import (analyze_sentiment, lexicon_scorer, model_scorer,
                                        naive_bayes_scorer, score_distinct, score_posts)

__all__ = [
    "Comparison", "Lexicon", "NaiveBayesModel", "analyze_keyword", "analyze_sentiment",
    "collect_posts", "collection_report", "compare_models", "lexicon_scorer", "map_tables",
    "merge_batches", "model_scorer", "naive_bayes_scorer", "predict_naive_bayes",
    "prepare_located", "repair_and_score", "report_tables", "score_distinct", "score_posts",
    "select_posts", "to_countries", "train_naive_bayes",
]
