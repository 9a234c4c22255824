import datetime as dt

import pytest
from pyspark.sql import functions as F

from postlab.operators import aggregates as agg
from postlab.operators import filters, frame


def test_first_alias_wins(spark):
    df = spark.createDataFrame([("a", "b", "c")], "tweet string, content string, user_location_str string")
    assert frame.standardise_columns(df).columns == ["text", "content", "location_str"]
    df = spark.createDataFrame([("a", "b", "c", "d")], "location string, user_location string, text string, tweet_content string")
    assert frame.standardise_columns(df).columns == ["location", "location_str", "text", "tweet_content"]


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="location_str"):
        frame.check_required(spark.createDataFrame([("a",)], "text string"))


def test_required_and_order(spark):
    df = frame.reorder_required_first(frame.require_columns(
        spark.createDataFrame([(1, "x")], "post_id int, content string")))
    assert df.columns == ["link", "content", "sentiment", "location", "post_id"]
    assert tuple(df.first()) == ("", "x", "", "", 1)


def test_export_order(spark):
    names = "x string, date string, user_id string, pos_score double, id string, text string, tweet_id string, created_at string"
    df = spark.createDataFrame([("x", "d", "u", 1.0, "i", "t", "w", "c")], names)
    assert frame.export_column_order(df).columns == [
        "user_id", "tweet_id", "id", "text", "pos_score", "created_at", "date", "x"]
    assert frame.export_column_order(df, include_original=False).columns == ["text", "pos_score"]


def test_scores_round_half_even(spark):
    df = spark.createDataFrame([(0.12345, 0.5, 0.00005)], "neg_score double, neu_score double, pos_score double")
    row = frame.derive_strength_confidence(df).first()
    assert (row.neg_score, row.pos_score, row.sentiment_strength, row.confidence) == (0.1234, 0.0, -0.1234, 0.5)


def test_popup(spark):
    df = spark.createDataFrame([("L" * 60, 'say "hi"\nyou' + "x" * 100, 0.75, 0.25)],
                               "location_str string, text string, pos_score double, neg_score double")
    row = frame.popup_fields(df).first()
    assert row.popup_location == "L" * 50 and row.radius == 6.5
    assert row.popup_text.startswith("say 'hi' you") and len(row.popup_text) == 100


def test_defaults_and_links(spark):
    df = spark.createDataFrame([(None, None, 5, "me.de", "at://did/app/abc")],
                               "content string, like_count long, reply_count long, h string, uri string")
    row = frame.default_attributes(df).select("*", frame.post_link("h", "uri").alias("link")).first()
    assert (row.content, row.like_count, row.reply_count) == ("", 0, 5)
    assert row.link.endswith("/profile/me.de/post/abc")


def test_union_of_different_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, id int")
    assert sorted(map(str, (r.asDict() for r in frame.union_batches([a, b]).collect()))) == sorted(map(str, [
        {"id": 1, "a": "x", "b": None}, {"id": 2, "a": None, "b": "y"}]))


def test_drop_blank(spark):
    df = spark.createDataFrame([("x",), (None,), ("",), (" \t",), (" ",)], "location string")
    assert filters.drop_blank(df).count() == 1


def test_gold_labels(spark):
    df = spark.createDataFrame([("a", "positive"), (None, "neutral"), ("b", None), ("c", "mixed")],
                               "text string, airline_sentiment string")
    assert [tuple(r) for r in filters.gold_label_filter(df).collect()] == [("a", "positive", "positive")]


def test_tweet_predicate(spark):
    rows = [("AI news", "2024-01-02 11:00:00", "en", False, (1,)), ("AI", "2024-01-01 11:59:59", "en", False, (1,)),
            ("AI", "2024-01-02 11:00:00", "en", True, (1,)), ("AI", "2024-01-02 11:00:00", "de", False, (1,)),
            ("AI", "2024-01-02 11:00:00", "en", False, None), ("cats", "2024-01-02 11:00:00", "en", False, (1,))]
    df = spark.createDataFrame(rows, "text string, created_at string, lang string, is_retweet boolean, geo struct<x:int>")
    assert filters.tweet_predicate(df, "2024-01-02 12:00:00").count() == 2
    assert filters.tweet_predicate(df, "2024-01-02 12:00:00", keyword="ai").count() == 1


def test_empty_frames(spark):
    posts = spark.createDataFrame([], "location string, username string, sentiment string")
    assert tuple(agg.collection_summary(posts).first()) == (0, 0, 0.0, 0)
    row = agg.keyword_result(posts, "AI", "vader").first()
    assert (row.total_tweets, row.positive_pct, row.model_used, row.keyword) == (0, 0.0, "none", "")
    assert agg.diversity_summary(posts).first().posts_per_user == 0.0


def test_location_distribution_counts_the_empty_one(spark):
    rows = [("",)] * 5 + [("A",)] * 3 + [(f"L{i:02}",) for i in range(12)] + [(None,)] * 20
    df = spark.createDataFrame(rows, "location string")
    got = agg.location_distribution(df).orderBy(F.desc("posts"), "location").collect()
    assert len(got) == 9 and got[0].location == "A" and abs(got[0].pct - 3 / 40 * 100) < 1e-9


def test_null_groups_are_left_out(spark):
    df = spark.createDataFrame([(None, "positive"), ("A", "positive"), ("A", "odd")], "location string, sentiment string")
    assert [tuple(r) for r in agg.sentiment_by_location(df).collect()] == [("A", 0.5, 2)]


def test_words(spark):
    df = spark.createDataFrame(
        [("positive", "the cat's cat CAT a"), ("positive", None), ("negative", "sad dog"), ("neutral", "long enough text")],
        "sentiment string, content string")
    got = {(r.sentiment, r.word): r.n for r in agg.word_frequency(df, ["the"]).collect()}
    assert got == {("positive", "cat's"): 1, ("positive", "cat"): 2}, "seven characters are not enough"
    assert {r.word: r["rank"] for r in agg.top_words(df, ["the"], 1).collect()} == {"cat": 1}


def test_words_are_counted_plain(spark):
    """No function over arrays, which is interpreted for each word; numbers and odd stop words don't meet the lengths."""
    rows = [("positive", "18 ' 18 'tis o' 'x x", "17")] * 2 + [("negative", "", "")]
    df = spark.createDataFrame(rows, "sentiment string, content string, more string")
    out = agg.word_frequency(df, [" 21", "tis"], min_text=0)
    assert {(r.sentiment, r.word): r.n for r in out.collect()} == {("positive", "18"): 4, ("positive", "o'"): 2}
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()


def test_latest_and_snapshot(spark):
    d = dt.date
    df = spark.createDataFrame([("Ohio", d(2020, 1, 1), 5.0), ("Ohio", d(2020, 1, 2), 7.0), ("Utah", d(2020, 1, 1), 2.0)],
                               "state string, date date, confirmed double")
    assert sorted((r.state, r.confirmed) for r in agg.latest_by_state(df).collect()) == [("OHIO", 7.0), ("UTAH", 2.0)]
    assert [(r.state, r.confirmed) for r in agg.snapshot_by_country(df, "state").collect()] == [("Ohio", 7.0)]
