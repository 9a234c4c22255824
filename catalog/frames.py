"""Projections, filters, sorts, samples and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from postlab import rules
from postlab.functions.geo import country_from_location
from postlab.functions.labels import label_colour, label_score
from postlab.operators import filters, frame, sampling
from postlab.sources.sinks import export_frame

TS = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "'%Y-%m-%d %H:%M:%S'"


@query("require_columns", f"WITH {fx.POSTS} SELECT post_id, content, sentiment, '' AS link, "
                          "'' AS location FROM posts")
def _(spark, sf):
    return frame.require_columns(fx.posts(spark, sf).select("post_id", "content", "sentiment"))


@query("reorder_required_first", f"WITH {fx.POSTS} SELECT '' AS link, content, sentiment, "
                                 "'' AS location, post_id, username FROM posts")
def _(spark, sf):
    df = frame.require_columns(fx.posts(spark, sf).select("post_id", "username", "content", "sentiment"))
    return frame.reorder_required_first(df)


@query("standardise_columns", f"""WITH {fx.POSTS}
  SELECT post_id, content AS text, location_raw AS location_str, username AS tweet FROM posts""")
def _(spark, sf):
    # "tweet_content" comes before "tweet" in the alias list, so "tweet" stays
    df = fx.posts(spark, sf).select(
        "post_id", F.col("username").alias("tweet"), F.col("content").alias("tweet_content"),
        F.col("location_raw").alias("location"))
    return frame.standardise_columns(df)


@query("check_required", f"WITH {fx.LOCATED} SELECT text, location_str FROM located")
def _(spark, sf):
    return frame.check_required(fx.located(spark, sf)).select("text", "location_str")


@query("project_columns", f"WITH {fx.SCORED} SELECT text, location_str, sentiment, "
       "round(neg_score, 6) AS neg_score, round(neu_score, 6) AS neu_score, "
       "round(pos_score, 6) AS pos_score FROM scored")
def _(spark, sf):
    df = frame.project_columns(fx.scored(spark, sf))
    return df.withColumns({c: F.round(c, 6) for c in ("neg_score", "neu_score", "pos_score")})


_EXPORT = f"""WITH {fx.SCORED}, r AS (
  SELECT *, round_even(neg_score, 4) AS n4, round_even(neu_score, 4) AS u4,
         round_even(pos_score, 4) AS p4 FROM scored)
SELECT post_id AS id, text, location_str, sentiment,
       round_even(p4 - n4, 4) AS sentiment_strength,
       greatest(n4, u4, p4) AS confidence, n4 AS neg_score, u4 AS neu_score, p4 AS pos_score,
       strftime(created_at, {SQL_TS}) AS created_at, user_id FROM r"""


def _export_input(spark, sf):
    return (fx.scored(spark, sf).withColumnRenamed("post_id", "id")
            .withColumn("created_at", F.date_format("created_at", TS)))


@query("export_column_order", _EXPORT)
def _(spark, sf):
    return frame.export_column_order(frame.derive_strength_confidence(_export_input(spark, sf)))


@query("export_scored", _EXPORT)
def _(spark, sf):
    return export_frame(_export_input(spark, sf), stamp=False)


@query("derive_strength_confidence", f"""WITH {fx.SCORED}, r AS (
  SELECT post_id, round_even(neg_score, 4) AS neg_score, round_even(neu_score, 4) AS neu_score,
         round_even(pos_score, 4) AS pos_score FROM scored)
SELECT *, round_even(pos_score - neg_score, 4) AS sentiment_strength,
       greatest(neg_score, neu_score, pos_score) AS confidence FROM r""")
def _(spark, sf):
    df = fx.scored(spark, sf).select("post_id", "neg_score", "neu_score", "pos_score")
    return frame.derive_strength_confidence(df)


@query("post_link", f"""WITH {fx.POSTS} SELECT
  'https://bsky.app/profile/' || username || '/post/' || CAST(post_id AS VARCHAR) AS link,
  CAST(post_id AS VARCHAR) AS post_id FROM posts""")
def _(spark, sf):
    uri = F.concat(F.lit("at://"), "search_term", F.lit("/"), F.col("post_id").cast("string"))
    df = fx.posts(spark, sf).withColumn("uri", uri)
    return df.select(frame.post_link("username", "uri").alias("link"),
                     frame.post_id("uri").alias("post_id"))


@query("default_attributes", f"""WITH {fx.POSTS} SELECT post_id,
  CASE WHEN value < 5 THEN '' ELSE content END AS content,
  CASE WHEN user_id % 3 = 0 THEN '' ELSE username END AS display_name,
  CASE WHEN value > 20 THEN 0 ELSE user_id END AS like_count FROM posts""")
def _(spark, sf):
    df = fx.posts(spark, sf).select(
        "post_id", F.when(~(F.col("value") < 5), F.col("content")).alias("content"),
        F.when(F.col("user_id") % 3 != 0, F.col("username")).alias("display_name"),
        F.when(~(F.col("value") > 20), F.col("user_id")).alias("like_count"))
    return frame.default_attributes(df)


@query("stamp_time")
def _(spark, sf):
    return frame.stamp_time(fx.posts(spark, sf).select("post_id"))


@query("init_score_columns", f"""WITH {fx.LOCATED} SELECT post_id, CAST(NULL AS VARCHAR) AS sentiment,
  0.0::DOUBLE AS neg_score, 0.0::DOUBLE AS neu_score, value AS pos_score FROM located""")
def _(spark, sf):
    return frame.init_score_columns(
        fx.located(spark, sf).select("post_id", F.col("value").alias("pos_score")))


@query("popup_fields", f"""WITH {fx.SCORED} SELECT post_id, left(location_str, 50) AS popup_location,
  translate(left(text, 100), '"' || chr(10), ''' ') AS popup_text,
  round(5.0 + (pos_score - neg_score) * 3, 6) AS radius FROM scored""")
def _(spark, sf):
    df = frame.popup_fields(fx.scored(spark, sf))
    return df.select("post_id", "popup_location", "popup_text", F.round("radius", 6).alias("radius"))


# --- filters -----------------------------------------------------------------

_BLANK = "location_str IS NOT NULL AND regexp_matches(location_str, '[^\\s]')"


@query("drop_blank", f"WITH {fx.LOCATED} SELECT post_id, location_str FROM located "
       f"WHERE {_BLANK} AND text IS NOT NULL AND regexp_matches(text, '[^\\s]')")
def _(spark, sf):
    return filters.drop_blank(fx.located(spark, sf), "location_str", "text").select(
        "post_id", "location_str")


_TOPIC = " OR ".join(f"contains(lower(content), '{k.lower()}')" for k in rules.TOPIC_KEYWORDS)


@query("keyword_any", f"WITH {fx.POSTS} SELECT post_id, username FROM posts WHERE {_TOPIC}")
def _(spark, sf):
    return filters.keyword_any(fx.posts(spark, sf, text_work=True)).select("post_id", "username")


@query("gold_label_filter", f"""WITH {fx.POSTS}
  SELECT content AS text, sentiment AS airline_sentiment, sentiment FROM posts
  WHERE search_term IN ('purchase', 'error', 'click')""")
def _(spark, sf):
    raw = fx.posts(spark, sf).select(
        F.col("content").alias("text"),
        F.when(F.col("search_term") == "view", None)
        .when(F.col("search_term") == "signup", "mixed")
        .otherwise(F.col("sentiment")).alias("airline_sentiment"))
    return filters.gold_label_filter(raw)


@query("valid_coordinates", f"""WITH {fx.LOCATED}, {fx.GAZETTEER}
  SELECT post_id, latitude, longitude FROM located
  JOIN gazetteer ON location_key = lower(trim(location_str))""")
def _(spark, sf):
    from postlab.operators.joins import geocode_join
    df = geocode_join(fx.located(spark, sf), fx.gazetteer(spark, sf))
    return filters.valid_coordinates(df).select("post_id", "latitude", "longitude")


@query("valid_timestamp", f"""WITH {fx.POSTS}
  SELECT post_id, strftime(created_at, {SQL_TS}) AS created_at FROM posts WHERE value >= 5""")
def _(spark, sf):
    # two spellings that parse, and one that does not
    text = (F.when(F.col("value") < 5, F.concat(F.lit("on "), F.date_format("created_at", "yyyy MM")))
            .when(F.col("value") < 20, F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss'+00:00'")))
    df = filters.valid_timestamp(fx.posts(spark, sf).withColumn("created_at", text))
    utc = F.to_utc_timestamp("created_at", F.current_timezone())
    return df.select("post_id", F.date_format(utc, TS).alias("created_at"))


REFERENCE_TIME = "2024-01-02 12:00:00"


@query("tweet_predicate", f"""WITH {fx.TWEETS} SELECT id, created_at FROM tweets
  WHERE NOT is_retweet AND (lon IS NOT NULL OR place_id IS NOT NULL) AND lang = 'en'
    AND created_at >= '2024-01-01 12:00:00'""")
def _(spark, sf):
    return filters.tweet_predicate(fx.tweets(spark, sf), REFERENCE_TIME).select("id", "created_at")


@query("location_not_empty", f"""WITH {fx.POSTS}
  SELECT post_id, location_raw AS location FROM posts WHERE search_term <> 'view'""")
def _(spark, sf):
    df = fx.posts(spark, sf).select("post_id", F.when(
        F.col("search_term") == "view", "").otherwise(F.col("location_raw")).alias("location"))
    return filters.location_not_empty(df)


@query("label_equals", f"WITH {fx.POSTS} SELECT post_id, sentiment FROM posts WHERE sentiment = 'positive'")
def _(spark, sf):
    return filters.label_equals(fx.posts(spark, sf).select("post_id", "sentiment"), "positive")


def _region_sql(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_PLACES = {"fr": "Lyon, FRANCE", "de": "germany", "es": "Madrid, spain", "en": "NYC, us"}
_COUNTRY_CTE = f"""{fx.POSTS}, c AS (SELECT post_id, CASE lang_gold WHEN 'fr' THEN 'France'
  WHEN 'de' THEN 'Germany' WHEN 'es' THEN 'Spain' ELSE 'United States' END AS location FROM posts)"""


def _countries(spark, sf):
    raw = F.lit(None).cast("string")
    for lang, place in _PLACES.items():
        raw = F.when(F.col("lang_gold") == lang, place).otherwise(raw)
    return fx.posts(spark, sf).select("post_id", country_from_location(raw).alias("location"))


@query("region_membership", f"""WITH {_COUNTRY_CTE}
  SELECT post_id, location, 'europe' AS region FROM c
    WHERE location IN {_region_sql(rules.EUROPEAN_LOCATIONS['v3'])}
  UNION ALL SELECT post_id, location, 'us' FROM c
    WHERE location IN {_region_sql(rules.US_LOCATIONS['v3'])}""")
def _(spark, sf):
    df = _countries(spark, sf)
    return (filters.region_membership(df, "europe").withColumn("region", F.lit("europe"))
            .unionByName(filters.region_membership(df, "us").withColumn("region", F.lit("us"))))


@query("country_equals", f"""WITH {_COUNTRY_CTE}
  SELECT location, count(*) AS posts FROM c WHERE location IN ('Germany', 'Spain') GROUP BY 1""")
def _(spark, sf):
    return filters.country_counts(_countries(spark, sf), ["Germany", "Spain"])


@query("label_lookup", f"""WITH {fx.POSTS} SELECT post_id, sentiment,
  CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS score,
  CASE sentiment WHEN 'positive' THEN '#00FF00' WHEN 'negative' THEN '#FF0000'
       WHEN 'neutral' THEN '#FFFF00' END AS colour,
  CASE search_term WHEN 'purchase' THEN '#2ecc71' WHEN 'error' THEN '#e74c3c' ELSE 'gray' END AS map_colour
  FROM posts""")
def _(spark, sf):
    title = (F.when(F.col("search_term") == "purchase", "Positive")
             .when(F.col("search_term") == "error", "Negative").otherwise("?"))
    return fx.posts(spark, sf).select(
        "post_id", "sentiment", label_score("sentiment").alias("score"),
        label_colour("sentiment").alias("colour"), label_colour(title, "map").alias("map_colour"))


# --- sorts, limits, samples, set operations ------------------------------------

@query("top_locations", f"""WITH {fx.POSTS} SELECT location_raw, count(*) AS posts FROM posts
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return sampling.top_counts(fx.posts(spark, sf), "location_raw", 10)


@query("top15_ascending", f"""WITH {fx.POSTS} SELECT * FROM (
  SELECT location_raw, count(*) AS posts FROM posts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
  ORDER BY 2, 1 DESC""")
def _(spark, sf):
    return sampling.top_ascending(fx.posts(spark, sf), "location_raw", 15)


@query("preview", f"WITH {fx.POSTS} SELECT post_id, username, sentiment FROM posts ORDER BY post_id LIMIT 3")
def _(spark, sf):
    return sampling.preview(fx.posts(spark, sf).select("post_id", "username", "sentiment"), "post_id")


@query("sample_n", """SELECT event_id, user_id, value FROM events
  ORDER BY CAST('0x' || left(md5('42:' || CAST(event_id AS VARCHAR)), 15) AS BIGINT), event_id LIMIT 5000""")
def _(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "user_id", "value")
    return sampling.sample_n(events, 5000, "event_id", portable=True)


@query("trim_total", f"WITH {fx.HITS} SELECT post_id, term_idx, pos FROM hits ORDER BY term_idx, pos LIMIT 500")
def _(spark, sf):
    return sampling.trim_total(fx.hits(spark, sf).select("post_id", "term_idx", "pos"), 500)


_SPLIT = f"""WITH {fx.GOLD}, n AS (
  SELECT *, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS total FROM gold)"""


@query("head_tail_split", _SPLIT + """
  SELECT row_id, sentiment, 'train' AS part FROM n WHERE rn <= CAST(floor(0.8 * total) AS BIGINT)
  UNION ALL SELECT row_id, sentiment, 'test' FROM n WHERE rn > total - total // 5""")
def _(spark, sf):
    df = fx.gold(spark, sf).select("row_id", "sentiment")
    train, test = sampling.head_tail_split(df, "row_id")
    return (train.withColumn("part", F.lit("train"))
            .unionByName(test.withColumn("part", F.lit("test"))))


@query("tail_n", """SELECT event_id, value FROM (
  SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS total FROM events)
  WHERE rn > total - total // 5""")
def _(spark, sf):
    return sampling.tail_n(fx.table(spark, sf, "events").select("event_id", "value"), "event_id")


@query("union_batches", f"""WITH {fx.POSTS}
  SELECT post_id, username, CAST(NULL AS VARCHAR) AS language, CAST(NULL AS DOUBLE) AS value FROM posts
  UNION ALL SELECT post_id, NULL, lang_gold, value FROM posts
  UNION ALL SELECT post_id, username, lang_gold, NULL FROM posts""")
def _(spark, sf):
    df = fx.posts(spark, sf)
    return frame.union_batches([
        df.select("post_id", "username"),
        df.select("post_id", F.col("lang_gold").alias("language"), "value"),
        df.select(F.col("lang_gold").alias("language"), "username", "post_id")])


@query("seen_sets", f"""WITH {fx.POSTS} SELECT username FROM posts WHERE sentiment = 'positive'
  UNION SELECT username FROM posts WHERE value > 20""")
def _(spark, sf):
    df = fx.posts(spark, sf)
    return sampling.seen_keys(df.where(F.col("sentiment") == "positive"), df.where(F.col("value") > 20))


@query("set_difference_columns", f"WITH {fx.POSTS} SELECT post_id, username, search_term FROM posts")
def _(spark, sf):
    df = fx.posts(spark, sf).select("post_id", "username", "content", "search_term", "sentiment")
    return df.select(*frame.unlisted_columns(df, rules.REQUIRED_COLUMNS))
