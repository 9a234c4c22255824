"""Joins, aggregates, evaluation and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from postlab import rules
from postlab.operators import aggregates as agg
from postlab.operators import evaluate, joins, windows
from postlab.operators.frame import tidy_metrics

# --- joins -----------------------------------------------------------------------


@query("join_place", f"""WITH {fx.TWEETS}, {fx.PLACES}
  SELECT t.id, p.full_name AS place_full_name, p.country_code AS place_country_code
  FROM tweets t LEFT JOIN places p ON p.id = t.place_id""")
def _(spark, sf):
    return (joins.join_place(fx.tweets(spark, sf), fx.places(spark, sf))
            .select("id", "place_full_name", "place_country_code"))


@query("join_user_location", f"""WITH {fx.TWEETS}, users AS (
  SELECT CAST(user_id AS VARCHAR) AS author_id, nullif(arg_min(
    CASE WHEN search_term = 'view' THEN '' ELSE location_raw END, post_id), '') AS user_location
  FROM posts WHERE search_term <> 'signup' GROUP BY 1)
  SELECT id, author_id, user_location FROM tweets LEFT JOIN users USING (author_id)""")
def _(spark, sf):
    # profiles are known for users with any post but a signup
    users = fx.posts(spark, sf).where(F.col("search_term") != "signup").select(
        F.col("user_id").cast("string").alias("id"),
        F.when(F.col("search_term") == "view", "").otherwise(F.col("location_raw")).alias("location"),
        F.col("post_id").alias("ord"))
    tweets = fx.tweets(spark, sf).select("id", "author_id")
    return joins.join_user_location(tweets, users).select("id", "author_id", "user_location")


@query("join_profile", f"""WITH {fx.PROFILES} SELECT post_id, username, coalesce(
    CASE WHEN username LIKE '%.de' THEN NULL ELSE description END, '') AS description
  FROM posts JOIN profiles ON handle = username""")
def _(spark, sf):
    known = fx.profiles(spark, sf).where(~F.col("handle").endswith(".de"))
    return joins.join_profile(fx.posts(spark, sf).select("post_id", "username"), known)


_GEOCODED = f"""WITH {fx.LOCATED}, {fx.GAZETTEER}, geo AS (
  SELECT located.*, latitude, longitude FROM located
  LEFT JOIN gazetteer ON location_key = lower(regexp_replace(location_str, '^\\s+|\\s+$', '', 'g')))"""


def _geocoded(spark, sf):
    return joins.geocode_join(fx.located(spark, sf), fx.gazetteer(spark, sf))


@query("geocode_join", _GEOCODED + " SELECT post_id, location_str, latitude, longitude FROM geo")
def _(spark, sf):
    return _geocoded(spark, sf).select("post_id", "location_str", "latitude", "longitude")


_J7 = ("nicht", "que", "ing", "eau", "AI", "machine learning")


@query("term_match_join", f"""WITH {fx.POSTS}, terms(term_idx, search_term) AS (VALUES
  {', '.join(f"({i}, '{t}')" for i, t in enumerate(_J7))}), m AS (
  SELECT p.post_id, t.term_idx, t.search_term
  FROM posts p JOIN terms t ON contains(lower(p.content), lower(t.search_term)))
  SELECT post_id, CAST(term_idx AS INTEGER) AS term_idx, search_term FROM m""")
def _(spark, sf):
    posts = fx.posts(spark, sf, text_work=True).select("post_id", "content", F.col("post_id").alias("pos"))
    found = joins.term_matches(posts, _J7).drop("content")
    return found.select("post_id", "term_idx", "search_term")


@query("anti_seen_posts", f"""WITH {fx.POSTS} SELECT post_id, username FROM posts
  WHERE post_id NOT IN (SELECT post_id FROM posts WHERE value > 15)""")
def _(spark, sf):
    posts = fx.posts(spark, sf)
    return joins.anti_seen_posts(posts.select("post_id", "username"), posts.where(F.col("value") > 15))


# --- aggregates --------------------------------------------------------------------

_LOC = fx.POSTS + """, loc AS (SELECT *, CASE WHEN search_term = 'view' THEN ''
  WHEN lang_gold = 'fr' THEN 'France' WHEN lang_gold = 'de' THEN 'Germany'
  WHEN lang_gold = 'es' THEN 'Spain' ELSE 'USA' END AS location FROM posts)"""


def _with_location(spark, sf):
    lang = F.col("lang_gold")
    return fx.posts(spark, sf).withColumn("location", F.when(F.col("search_term") == "view", "")
        .when(lang == "fr", "France").when(lang == "de", "Germany").when(lang == "es", "Spain")
        .otherwise("USA"))


@query("collection_summary", f"""WITH {_LOC} SELECT count(*) AS total_posts,
  count(*) FILTER (location <> '') AS with_location,
  round(count(*) FILTER (location <> '') / count(*) * 100, 6) AS location_pct,
  count(*) FILTER (location = '') AS blank_locations FROM loc""")
def _(spark, sf):
    return agg.collection_summary(_with_location(spark, sf)).withColumn(
        "location_pct", F.round("location_pct", 6))


_EU = "('" + "', '".join(rules.EUROPEAN_LOCATIONS["v3"]) + "')"
_US = "('" + "', '".join(rules.US_LOCATIONS["v3"]) + "')"


@query("diversity_summary", f"""WITH {_LOC} SELECT count(*) AS total_posts,
  count(DISTINCT username) AS unique_users,
  round(count(*) / count(DISTINCT username), 6) AS posts_per_user,
  count(*) FILTER (location <> '') AS with_location,
  round(count(*) FILTER (location <> '') / count(*) * 100, 6) AS location_pct,
  count(*) FILTER (location IN {_EU}) AS european_posts,
  round(count(*) FILTER (location IN {_EU}) / count(*) * 100, 6) AS european_pct,
  count(*) FILTER (location IN {_US}) AS us_posts,
  round(count(*) FILTER (location IN {_US}) / count(*) * 100, 6) AS us_pct FROM loc""")
def _(spark, sf):
    df = agg.diversity_summary(_with_location(spark, sf))
    return df.withColumns({c: F.round(c, 6) for c in
                           ("posts_per_user", "location_pct", "european_pct", "us_pct")})


@query("location_distribution", f"""WITH {_LOC}, t AS (
  SELECT location, count(*) AS posts FROM loc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
  SELECT location, posts, round(posts / (SELECT count(*) FROM loc) * 100, 6) AS pct
  FROM t WHERE location <> ''""")
def _(spark, sf):
    return agg.location_distribution(_with_location(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("language_distribution", """SELECT upper(left(lang, 1)) || substr(lang, 2) AS language,
  count(*) AS posts, round(count(*) / (SELECT count(*) FROM documents) * 100, 6) AS pct
  FROM documents GROUP BY 1""")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("lang").alias("language"))
    return agg.language_distribution(docs).withColumn("pct", F.round("pct", 6))


@query("sentiment_distribution", f"""WITH {fx.POSTS} SELECT sentiment, count(*) AS posts,
  round(count(*) / (SELECT count(*) FROM posts) * 100, 6) AS pct FROM posts GROUP BY 1""")
def _(spark, sf):
    return agg.sentiment_distribution(fx.posts(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("sentiment_by_location", f"""WITH {fx.POSTS} SELECT location_raw AS location,
  round(avg(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END), 6) AS avg_sentiment,
  count(*) AS total_samples FROM posts GROUP BY 1""")
def _(spark, sf):
    df = fx.posts(spark, sf).withColumnRenamed("location_raw", "location")
    return agg.sentiment_by_location(df).withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query("keyword_result", f"""WITH {fx.POSTS}, k AS (SELECT * FROM posts WHERE contains(lower(content), 'ai'))
  SELECT count(*) AS total_tweets, count(*) FILTER (sentiment = 'positive') AS positive_count,
  count(*) FILTER (sentiment = 'negative') AS negative_count,
  count(*) FILTER (sentiment = 'neutral') AS neutral_count,
  round(count(*) FILTER (sentiment = 'positive') / count(*) * 100, 6) AS positive_pct,
  round(count(*) FILTER (sentiment = 'negative') / count(*) * 100, 6) AS negative_pct,
  round(count(*) FILTER (sentiment = 'neutral') / count(*) * 100, 6) AS neutral_pct,
  'vader' AS model_used, 'AI' AS keyword FROM k""")
def _(spark, sf):
    from postlab.operators.filters import keyword_any
    df = agg.keyword_result(keyword_any(fx.posts(spark, sf, text_work=True), "content", ["AI"]), "AI", "vader")
    return df.withColumns({c: F.round(c, 6) for c in ("positive_pct", "negative_pct", "neutral_pct")})


@query("mean_scores", f"""WITH {fx.SCORED} SELECT round(avg(pos_score), 6) AS mean_pos_score,
  round(avg(neg_score), 6) AS mean_neg_score, round(avg(neu_score), 6) AS mean_neu_score FROM scored""")
def _(spark, sf):
    df = agg.mean_scores(fx.scored(spark, sf))
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("map_center", _GEOCODED + """ SELECT median(latitude) AS center_lat,
  median(longitude) AS center_lon FROM geo""")
def _(spark, sf):
    return agg.map_center(_geocoded(spark, sf))


@query("geocode_stats", _GEOCODED + """, k AS (
  SELECT location_str, lower(regexp_replace(location_str, '^\\s+|\\s+$', '', 'g')) AS key, latitude FROM geo
  WHERE regexp_matches(location_str, '[^\\s]'))
  SELECT count(DISTINCT location_str) AS unique_locations, count(DISTINCT key) AS unique_keys,
         count(DISTINCT CASE WHEN latitude IS NOT NULL THEN key END) AS geocoded_locations,
         count(latitude) AS final_rows, count(*) - count(latitude) AS removed_rows FROM k""")
def _(spark, sf):
    from postlab.operators.filters import drop_blank
    df = drop_blank(fx.located(spark, sf), "location_str")
    return agg.geocode_stats(joins.geocode_join(df, fx.gazetteer(spark, sf)))


_STOP = "('" + "', '".join(fx.STOP_WORDS) + "')"
_WORDS = fx.POSTS + rf""", enough AS (
  SELECT sentiment FROM posts WHERE sentiment IN ('positive', 'negative')
  GROUP BY 1 HAVING sum(length(content) + 1) - 1 > 10), w AS (
  SELECT sentiment, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']+')) AS word
  FROM posts WHERE sentiment IN (SELECT sentiment FROM enough)), freq AS (
  SELECT sentiment, word, count(*) AS n FROM w WHERE word NOT IN {_STOP} GROUP BY 1, 2)"""


@query("word_frequency", f"WITH {_WORDS} SELECT * FROM freq")
def _(spark, sf):
    return agg.word_frequency(fx.posts(spark, sf, text_work=True), fx.STOP_WORDS)


@query("top_k_per_group", f"""WITH {_WORDS}, r AS (SELECT *, CAST(row_number() OVER (
  PARTITION BY sentiment ORDER BY n DESC, word) AS INTEGER) AS rank FROM freq) SELECT * FROM r WHERE rank <= 25""")
def _(spark, sf):
    return agg.top_words(fx.posts(spark, sf, text_work=True), fx.STOP_WORDS, 25)


def _printable(cases):
    return cases.withColumns({"confirmed": F.round("confirmed", 2),
                              "date": F.date_format("date", "yyyy-MM-dd")})


@query("snapshot_by_country", f"""WITH {fx.CASES} SELECT state, date, round(sum(confirmed), 2) AS confirmed
  FROM cases WHERE date = (SELECT max(date) FROM cases) GROUP BY 1, 2""")
def _(spark, sf):
    return _printable(agg.snapshot_by_country(fx.cases(spark, sf), "state"))


@query("latest_by_state", f"""WITH {fx.CASES} SELECT upper(state) AS state,
  round(arg_max(confirmed, date), 2) AS confirmed, max(date) AS date FROM cases GROUP BY 1""")
def _(spark, sf):
    return _printable(agg.latest_by_state(fx.cases(spark, sf)))


@query("top_languages", """SELECT lang AS language, count(*) AS posts FROM documents
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return agg.top_languages(fx.table(spark, sf, "documents").select(F.col("lang").alias("language")))


@query("distinct_locations", f"WITH {fx.LOCATED} SELECT DISTINCT location_str FROM located")
def _(spark, sf):
    return agg.distinct_locations(fx.located(spark, sf))


@query("users_in_term", f"""WITH {fx.POSTS} SELECT search_term, count(*) AS posts,
  count(DISTINCT username) AS users FROM posts GROUP BY 1""")
def _(spark, sf):
    return agg.users_in_term(fx.posts(spark, sf))


@query("term_progress", f"""WITH {fx.HITS}, n AS (
  SELECT term_idx, count(*) AS new_posts FROM hits GROUP BY 1)
  SELECT term_idx, new_posts, CAST(sum(new_posts) OVER (ORDER BY term_idx) AS BIGINT) AS total_posts FROM n""")
def _(spark, sf):
    return agg.term_progress(fx.hits(spark, sf))


# --- evaluation ----------------------------------------------------------------------

_CLASS = fx.PREDICTIONS + """, cell AS (
  SELECT model, label, prediction, count(*) AS n FROM predictions GROUP BY ALL), side AS (
  SELECT model, label AS class, n AS support, 0 AS predicted,
         CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM cell
  UNION ALL SELECT model, prediction, 0, n, 0 FROM cell), class AS (
  SELECT model, class, sum(tp) AS tp, sum(predicted) AS predicted, sum(support) AS support
  FROM side GROUP BY 1, 2), prf AS (
  SELECT model, class, CAST(support AS BIGINT) AS support,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0::DOUBLE END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0::DOUBLE END AS recall,
         CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0.0::DOUBLE END AS f1_score
  FROM class), metrics AS (
  SELECT model, round(sum(recall * support) / sum(support), 4) AS accuracy,
         round(sum(f1_score * support) / sum(support), 4) AS f1_score,
         round(sum(precision * support) / sum(support), 4) AS precision,
         round(sum(recall * support) / sum(support), 4) AS recall,
         CAST(sum(support) AS BIGINT) AS support FROM prf GROUP BY 1)"""


@query("confusion_matrix", f"""WITH {fx.PREDICTIONS}, l(l) AS (
  VALUES ('negative'), ('neutral'), ('positive')), grid AS (
  SELECT DISTINCT model, a.l AS actual, p.l AS predicted FROM predictions, l a, l p)
  SELECT g.model, g.actual, g.predicted, count(p.row_id) AS n FROM grid g LEFT JOIN predictions p
    ON p.model = g.model AND p.label = g.actual AND p.prediction = g.predicted GROUP BY 1, 2, 3""")
def _(spark, sf):
    return evaluate.confusion_matrix(fx.predictions(spark, sf))


@query("accuracy", f"""WITH {fx.PREDICTIONS} SELECT model,
  round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM predictions GROUP BY 1""")
def _(spark, sf):
    return evaluate.accuracy(fx.predictions(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query("weighted_prf", f"WITH {_CLASS} SELECT * FROM metrics")
def _(spark, sf):
    return evaluate.weighted_prf(fx.predictions(spark, sf))


@query("class_f1", f"WITH {_CLASS} SELECT model, class, round(f1_score, 6) AS f1_score FROM prf")
def _(spark, sf):
    return evaluate.class_f1(fx.predictions(spark, sf)).withColumn("f1_score", F.round("f1_score", 6))


@query("best_model", f"""WITH {_CLASS} SELECT model AS best_model FROM metrics ORDER BY f1_score DESC,
  CASE model WHEN 'roberta_twitter' THEN 0 WHEN 'vader' THEN 1 ELSE 2 END LIMIT 1""")
def _(spark, sf):
    return evaluate.best_model(evaluate.weighted_prf(fx.predictions(spark, sf)))


@query("tidy_metrics", f"""WITH {_CLASS} SELECT model, variable, value FROM (
  UNPIVOT (SELECT model, accuracy, f1_score, precision, recall FROM metrics)
  ON accuracy, f1_score, precision, recall INTO NAME variable VALUE value)""")
def _(spark, sf):
    return tidy_metrics(evaluate.weighted_prf(fx.predictions(spark, sf)))


@query("model_report", f"""WITH {_CLASS} SELECT model, round(accuracy, 3) AS accuracy,
  round(f1_score, 3) AS f1_score, round(precision, 3) AS precision, round(recall, 3) AS recall,
  model = (SELECT model FROM metrics ORDER BY f1_score DESC,
    CASE model WHEN 'roberta_twitter' THEN 0 WHEN 'vader' THEN 1 ELSE 2 END LIMIT 1) AS is_best
  FROM metrics""")
def _(spark, sf):
    return evaluate.model_report(evaluate.weighted_prf(fx.predictions(spark, sf)))


# --- windows -----------------------------------------------------------------------

_HIT_COLUMNS = "term_idx, pos, post_id, user_id"


def _narrow_hits(spark, sf):
    return fx.hits(spark, sf).select("term_idx", "pos", "post_id", "user_id", "match")


@query("cap_per_search", f"""WITH {fx.HITS}, r AS (SELECT {_HIT_COLUMNS}, match, CAST(row_number() OVER (
  PARTITION BY term_idx, user_id ORDER BY pos) AS INTEGER) AS user_post_number FROM hits)
  SELECT * FROM r WHERE user_post_number <= 2""")
def _(spark, sf):
    return windows.cap_per_search(_narrow_hits(spark, sf), user="user_id")


@query("one_post_per_user", f"""WITH {fx.HITS}, r AS (SELECT {_HIT_COLUMNS}, match, row_number() OVER (
  PARTITION BY user_id ORDER BY term_idx, pos) AS rn FROM hits) SELECT {_HIT_COLUMNS}, match FROM r WHERE rn = 1""")
def _(spark, sf):
    return windows.one_post_per_user(_narrow_hits(spark, sf), user="user_id")


_W3 = fx.HITS + """, a AS (
  SELECT term_idx, pos, post_id, user_id, match,
         min(CASE WHEN match THEN {'t': term_idx, 'p': pos} END) OVER (PARTITION BY user_id) AS f,
         row_number() OVER (PARTITION BY term_idx, user_id ORDER BY pos) AS rn FROM hits), b AS (
  SELECT *, min(CASE WHEN term_idx = f.t AND pos = f.p THEN rn END)
              OVER (PARTITION BY term_idx, user_id) AS frn FROM a), c AS (
  SELECT *, CAST(CASE WHEN f IS NULL OR {'t': term_idx, 'p': pos} < f THEN 1
              WHEN term_idx = f.t THEN rn - frn + 1 ELSE rn END AS INTEGER) AS user_post_count FROM b), w3 AS (
  SELECT term_idx, pos, post_id, user_id, match, user_post_count FROM c WHERE match AND user_post_count <= 2)"""


@query("cap_after_first_accept", f"WITH {_W3} SELECT * FROM w3")
def _(spark, sf):
    return windows.cap_after_first_accept(_narrow_hits(spark, sf), user="user_id")


def _budget_sql(total: int, terms: int = 5) -> str:
    """The collector's loop over terms, one step per term."""
    steps = [fx.HITS, "n AS (SELECT *, row_number() OVER (PARTITION BY term_idx ORDER BY pos) AS place FROM hits)"]
    for t in range(terms):
        kept = " UNION ALL ".join(f"SELECT post_id FROM new{i}" for i in range(t)) or "SELECT post_id FROM hits WHERE false"
        known = " UNION ALL ".join(f"SELECT user_id FROM ok{i}" for i in range(t)) or "SELECT user_id FROM hits WHERE false"
        steps += [
            f"left{t} AS MATERIALIZED (SELECT greatest(0, least(100, 120, {total} - (SELECT count(*) FROM ({kept})))) AS n)",
            f"f{t} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM n "
            f"WHERE term_idx = {t} AND place <= (SELECT n FROM left{t}))",
            f"a{t} AS MATERIALIZED (SELECT user_id, min(rn) AS first FROM f{t} WHERE match GROUP BY 1)",
            f"ok{t} AS MATERIALIZED (SELECT f{t}.*, CASE WHEN user_id IN ({known}) THEN rn ELSE rn - first + 1 END AS user_post_count "
            f"FROM f{t} JOIN a{t} USING (user_id) WHERE match AND CASE WHEN user_id IN ({known}) THEN rn ELSE rn - first + 1 END <= {rules.ACCEPTED_USER_CAP})",
            f"new{t} AS MATERIALIZED (SELECT * FROM ok{t} WHERE post_id NOT IN ({kept}))"]
    every = " UNION ALL ".join(f"SELECT term_idx, pos, post_id, user_id, user_post_count FROM new{t}" for t in range(terms))
    return f"WITH {', '.join(steps)} {every}"


#: Posts a collection asks for: fewer than the terms would give, so that the later ones get what is missing.
BUDGET = 300


@query("select_within_budget", _budget_sql(BUDGET))
def _(spark, sf):
    kept = windows.select_within_budget(_narrow_hits(spark, sf), BUDGET, user="user_id")
    return kept.select("term_idx", "pos", "post_id", "user_id", F.col("user_post_count").cast("long").alias("user_post_count"))


# Copies of a post under several terms: every term whose name sorts at or after
# the post's own term lists it again.
_COPIES = fx.HITS + """, copies AS (
  SELECT post_id, user_id, pos, CAST(t AS INTEGER) AS term_idx FROM hits, range(0, 5) r(t) WHERE t >= term_idx)"""


@query("dedupe_across_terms", f"""WITH {_COPIES} SELECT post_id, term_idx, user_id, pos FROM (
  SELECT *, min(term_idx) OVER (PARTITION BY post_id) AS first FROM copies) WHERE term_idx = first""")
def _(spark, sf):
    hits = fx.hits(spark, sf).select(
        "post_id", "user_id", "pos", F.explode(F.sequence("term_idx", F.lit(4))).alias("term_idx"))
    return windows.dedupe_across_terms(hits)


@query("limit_per_term", f"""WITH {fx.HITS}, r AS (SELECT {_HIT_COLUMNS}, match, row_number() OVER (
  PARTITION BY term_idx ORDER BY pos) AS rn FROM hits) SELECT {_HIT_COLUMNS}, match FROM r WHERE rn <= 100""")
def _(spark, sf):
    return windows.limit_per_term(_narrow_hits(spark, sf), 100)


@query("percent_of_total", f"""WITH {fx.POSTS}, c AS (SELECT location_raw, count(*) AS posts FROM posts GROUP BY 1)
  SELECT location_raw, posts, round(posts / (SELECT sum(posts) FROM c) * 100, 6) AS pct FROM c""")
def _(spark, sf):
    counts = fx.posts(spark, sf).groupBy("location_raw").agg(F.count(F.lit(1)).alias("posts"))
    return windows.percent_of_total(counts).withColumn("pct", F.round("pct", 6))


@query("collect_v3", f"""WITH {fx.HITS}, k AS (SELECT post_id, term_idx, pos, username,
    {' OR '.join(f"contains(lower(content), '{k.lower()}')" for k in rules.TOPIC_KEYWORDS)} AS m FROM hits), a AS (
  SELECT *, min(CASE WHEN m THEN {{'t': term_idx, 'p': pos}} END) OVER (PARTITION BY username) AS f
  FROM k), b AS (
  SELECT *, row_number() OVER (PARTITION BY term_idx, username ORDER BY pos) AS cnt FROM a
  WHERE {{'t': term_idx, 'p': pos}} >= f)
  SELECT post_id, term_idx, username, CAST(cnt AS INTEGER) AS user_post_count FROM b WHERE m AND cnt <= 2""")
def _(spark, sf):
    from postlab.plans.collect import collect_posts
    kept = collect_posts(fx.hits(spark, sf).drop("match"), fx.profiles(spark, sf), "v3")
    return kept.select("post_id", "term_idx", "username", "user_post_count")

