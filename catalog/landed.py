"""Scans, sinks, stored results and streams.

Each query lands rows of the given tables as files in the shared folder, then
reads them back through the operator under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import fixtures as fx
from catalog.registry import query
from catalog.relations import _CLASS
from postlab import schemas
from postlab.operators.evaluate import weighted_prf
from postlab.session import work_path
from postlab.sources import readers, sinks
from postlab.streaming import posts as streams
from postlab.streaming.known_users import stream_known_users

TS = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "'%Y-%m-%d %H:%M:%S'"
_ROUND_TRIP = T.StructType([T.StructField(n, T.StringType()) for n in ("link", "content", "sentiment", "location")]
                           + [T.StructField("post_id", T.LongType()), T.StructField("username", T.StringType())])
_ROUND_TRIP_SQL = f"""WITH {fx.POSTS} SELECT CAST(NULL AS VARCHAR) AS link, content, sentiment,
  location_raw AS location, post_id, username FROM posts"""


def _post_rows(spark, sf):
    return fx.posts(spark, sf).select(
        "post_id", "username", "content", "sentiment", F.col("location_raw").alias("location"))


@query("scan_posts_csv", _ROUND_TRIP_SQL)
def _(spark, sf):
    path = work_path(spark, "posts-csv")
    sinks.sink_posts_csv(_post_rows(spark, sf), path, compress=True)
    return readers.scan_posts_csv(spark, path, _ROUND_TRIP)


@query("sink_posts_csv", _ROUND_TRIP_SQL.replace("username FROM", "username, 'b1' AS batch_id FROM"))
def _(spark, sf):
    path = work_path(spark, "posts-batch")
    sinks.sink_posts_csv(_post_rows(spark, sf), path, batch_id="b1", compress=True)
    schema = T.StructType([*_ROUND_TRIP.fields, T.StructField("batch_id", T.StringType())])
    return readers.scan_single_csv(spark, path, schema)


@query("sink_csv_bom", f"WITH {fx.POSTS} SELECT post_id, username, content FROM posts")
def _(spark, sf):
    path = work_path(spark, "posts-bom")
    df = fx.posts(spark, sf).select("post_id", "username", "content")
    sinks.sink_csv_bom(df, path, compress=True)
    return readers.scan_single_csv(spark, path, df.schema)


@query("scan_single_csv", "SELECT event_id, user_id, event_type, value, props FROM events")
def _(spark, sf):
    path = work_path(spark, "events-csv")
    df = fx.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    sinks._csv(df, path)
    return readers.scan_single_csv(spark, path, df.schema)


@query("scan_skip_bad_rows", """SELECT event_id, event_type,
  CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events WHERE event_type <> 'error'""")
def _(spark, sf):
    # rows of type "error" get one field too many, rows of type "view" one too few
    path = work_path(spark, "events-lines")
    e = fx.table(spark, sf, "events")
    kind = F.col("event_type")
    fields = (F.when(kind == "view", F.array(F.col("event_id").cast("string"), kind))
              .when(kind == "error", F.array(F.col("event_id").cast("string"), kind,
                                             F.col("value").cast("string"), F.lit("extra")))
              .otherwise(F.array(F.col("event_id").cast("string"), kind, F.col("value").cast("string"))))
    e.select(F.concat_ws(",", fields).alias("event_id,event_type,value")).write.options(
        header="true", quote="\u0000", sep="\u0001").csv(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
                           T.StructField("value", T.DoubleType())])
    return readers.scan_skip_bad_rows(spark, path, schema)


@query("ingest_search_hits", f"""WITH {fx.HITS} SELECT
  'https://bsky.app/profile/' || username || '/post/' || CAST(post_id AS VARCHAR) AS link,
  content, '' AS sentiment, username, CASE WHEN value < 5 THEN '' ELSE username END AS display_name,
  strftime(created_at, {SQL_TS}) AS created_at, CASE WHEN value > 20 THEN 0 ELSE user_id END AS like_count,
  0::BIGINT AS reply_count, user_id AS repost_count, CAST(post_id AS VARCHAR) AS post_id,
  search_term, term_idx, pos FROM hits""")
def _(spark, sf):
    path = work_path(spark, "hits-json")
    h = fx.hits(spark, sf)
    h.select(
        F.concat(F.lit("at://x/"), F.col("post_id").cast("string")).alias("uri"),
        F.struct(F.col("username").alias("handle"),
                 F.when(F.col("value") >= 5, F.col("username")).alias("display_name")).alias("author"),
        F.struct(F.col("content").alias("text"), F.date_format("created_at", TS).alias("created_at")).alias("record"),
        F.when(~(F.col("value") > 20), F.col("user_id")).alias("like_count"),
        F.col("user_id").alias("repost_count"), "search_term", "term_idx", "pos").write.options(**sinks.COMPRESSED).json(path)
    return readers.ingest_search_hits(readers.read_search_hits(spark, path)).drop("collected_at")


@query("ingest_tweets", f"""WITH {fx.TWEETS}, {fx.PLACES} SELECT t.id, text, created_at, author_id, retweet_count,
  like_count, reply_count, quote_count,
  CASE WHEN lon IS NOT NULL THEN lat ELSE (b1 + b3) / 2 END AS latitude,
  CASE WHEN lon IS NOT NULL THEN lon ELSE (b0 + b2) / 2 END AS longitude,
  CASE WHEN lon IS NOT NULL THEN 'coordinates' ELSE 'place_center' END AS location_type,
  CASE WHEN lon IS NOT NULL THEN '' ELSE full_name END AS place_name,
  CASE WHEN lon IS NOT NULL THEN '' ELSE country_code END AS country
  FROM tweets t LEFT JOIN places p ON p.id = t.place_id WHERE lon IS NOT NULL OR has_box""")
def _(spark, sf):
    path = work_path(spark, "tweets-json")
    fx.tweets(spark, sf).write.options(**sinks.COMPRESSED).json(path)
    return readers.ingest_tweets(readers.read_tweets(spark, path), fx.places(spark, sf))


@query("checkpoint_stage", f"WITH {fx.POSTS} SELECT post_id, username, content FROM posts")
def _(spark, sf):
    df = fx.posts(spark, sf).select("post_id", "username", "content")
    return sinks.checkpoint_stage(df, work_path(spark, "stage"))


@query("compute_if_absent", f"""WITH {fx.SCORED} SELECT text, location_str, sentiment, round(neg_score, 6) AS neg_score,
  round(neu_score, 6) AS neu_score, round(pos_score, 6) AS pos_score FROM scored""")
def _(spark, sf):
    path = work_path(spark, "processed")
    first = sinks.compute_if_absent(spark, path, lambda: fx.scored(spark, sf))

    def never():
        raise AssertionError("the stored result must be reused")

    again = sinks.compute_if_absent(spark, path, never)
    assert again.columns == first.columns
    return again.withColumns({c: F.round(c, 6) for c in ("neg_score", "neu_score", "pos_score")})


def _metrics(spark, sf):
    return weighted_prf(fx.predictions(spark, sf))


@query("sink_metrics", f"WITH {_CLASS} SELECT * FROM metrics")
def _(spark, sf):
    folder = work_path(spark, "metrics")
    sinks.sink_metrics(_metrics(spark, sf), folder)
    return readers.scan_single_csv(spark, f"{folder}/metrics.csv", schemas.METRICS)

@query("read_best_model", f"""WITH {_CLASS} SELECT model AS best_model FROM metrics ORDER BY f1_score DESC,
  CASE model WHEN 'roberta_twitter' THEN 0 WHEN 'vader' THEN 1 ELSE 2 END LIMIT 1""")
def _(spark, sf):
    folder = work_path(spark, "metrics")
    sinks.sink_metrics(_metrics(spark, sf), folder)
    return readers.read_best_model(spark, f"{folder}/metrics.json")


# --- streams -----------------------------------------------------------------------------

_STREAM = T.StructType([
    T.StructField("post_id", T.LongType()), T.StructField("username", T.StringType()),
    T.StructField("sentiment", T.StringType()), T.StructField("created_at", T.TimestampType())])


def _land(spark, sf, redeliver: bool) -> str:
    """Posts as landed files; a redelivery lands the purchases a second time."""
    path = work_path(spark, "landing")
    df = fx.posts(spark, sf).select(
        "post_id", "username", "sentiment", F.col("created_at").cast("timestamp").alias("created_at"))
    df.write.mode("append").parquet(path)
    if redeliver:
        df.where(F.col("sentiment") == "positive").write.mode("append").parquet(path)
    return path


def _printable(df, *columns):
    return df.withColumns({c: F.date_format(c, TS) for c in columns})


@query("stream_dedupe_posts", f"""WITH {fx.POSTS} SELECT post_id, username, sentiment,
  strftime(created_at, {SQL_TS}) AS created_at FROM posts""")
def _(spark, sf):
    landed = streams.landing_stream(spark, _land(spark, sf, redeliver=True), _STREAM)
    out = streams.drain(spark, streams.stream_dedupe_posts(landed, lateness="3650 days"), "deduped")
    return _printable(out, "created_at")


@query("stream_user_cap", f"""WITH {fx.POSTS}, r AS (SELECT post_id, username, sentiment,
  strftime(created_at, {SQL_TS}) AS created_at,
  row_number() OVER (PARTITION BY username ORDER BY created_at, post_id) AS rn FROM posts)
  SELECT post_id, username, sentiment, created_at FROM r WHERE rn <= 2""")
def _(spark, sf):
    landed = streams.landing_stream(spark, _land(spark, sf, redeliver=False), _STREAM)
    out = streams.drain(spark, streams.stream_user_cap(landed, 2), "capped")
    return _printable(out, "created_at")


@query("stream_known_users", f"""WITH {fx.HITS}, a AS (SELECT post_id, username, term_idx, pos, match,
    min(CASE WHEN match THEN {{'t': term_idx, 'p': pos}} END) OVER (PARTITION BY username) AS f FROM hits), b AS (
  SELECT *, row_number() OVER (PARTITION BY username, term_idx ORDER BY pos) AS n FROM a
  WHERE f IS NOT NULL AND {{'t': term_idx, 'p': pos}} >= f)
  SELECT post_id, username, term_idx, pos, CAST(n AS INTEGER) AS user_post_count FROM b WHERE match AND n <= 2""")
def _(spark, sf):
    hits = fx.hits(spark, sf).select("post_id", "username", "term_idx", "pos", "match",
                                      F.col("created_at").cast("timestamp").alias("created_at"))
    folder = work_path(spark, "hit-polls")
    hits.where("term_idx < 2").write.parquet(folder)        # the first poll
    path, state = work_path(spark, "known-users"), work_path(spark, "known-users-state")
    # the events' times do not follow the terms, so no hit may count as late
    for late in (None, hits.where("term_idx >= 2")):
        if late is not None:
            late.write.mode("append").parquet(folder)
        out = stream_known_users(streams.landing_stream(spark, folder, hits.schema), lateness="10000 days")
        streams.start_to_parquet(out, path, state).awaitTermination()
    return spark.read.schema(out.schema).parquet(path).select("post_id", "username", "term_idx", "pos", "user_post_count")


@query("stream_sentiment_counts", f"""WITH {fx.POSTS} SELECT
  strftime(date_trunc('hour', created_at), {SQL_TS}) AS window_start,
  strftime(date_trunc('hour', created_at) + INTERVAL 1 HOUR, {SQL_TS}) AS window_end,
  sentiment, count(*) AS posts FROM posts GROUP BY 1, 2, 3""")
def _(spark, sf):
    landed = streams.landing_stream(spark, _land(spark, sf, redeliver=False), _STREAM)
    out = streams.drain(spark, streams.stream_sentiment_counts(landed), "hourly", complete=True)
    return _printable(out, "window_start", "window_end")
