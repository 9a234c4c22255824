"""Scoring, features, Naive Bayes, model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from catalog.text_geo import _CLEAN, _COUNTRY
from postlab import rules
from postlab.functions.geo import country_from_location
from postlab.functions.labels import softmax_label
from postlab.operators.aggregates import sentiment_by_location
from postlab.operators.filters import valid_timestamp
from postlab.operators.sampling import head_tail_split
from postlab.sentiment import batch, lexicon, naive_bayes, registry, rule_layer
from postlab.session import work_path


def _values(table) -> str:
    return ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in table.items())


def lexicon_sql(source: str, key: str, text: str) -> str:
    """CTEs ending in ``lex(key, compound, label)`` for a text column."""
    neg = "('" + "', '".join(fx.LEXICON.negations) + "')"
    value, steps = "v", []
    for d, damping in enumerate(rules.VADER_DAMPING, start=1):
        steps.append(f"""s{d} AS (SELECT *, CASE WHEN p{d} IS NULL OR p{d} IN (SELECT token FROM lx) THEN {value}
  ELSE ({value} + CASE WHEN {value} < 0 THEN -1 ELSE 1 END
        * coalesce((SELECT b FROM boost WHERE boost.token = p{d}), 0) * {damping})
       * CASE WHEN p{d} IN {neg} THEN {rules.VADER_NEGATION} ELSE 1 END END AS v{d}
  FROM {'hit' if d == 1 else f's{d - 1}'})""")
        value = f"v{d}"
    return rf"""lx(token, v) AS (VALUES {_values(fx.LEXICON.valences)}),
boost(token, b) AS (VALUES {_values(fx.LEXICON.boosters)}),
tok AS (SELECT {key} AS key, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_'']+') AS ws FROM {source}),
flat AS (SELECT key, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM tok),
ctx AS (SELECT *, lag(w, 1) OVER o AS p1, lag(w, 2) OVER o AS p2, lag(w, 3) OVER o AS p3
        FROM flat WINDOW o AS (PARTITION BY key ORDER BY i)),
hit AS (SELECT ctx.*, lx.v FROM ctx JOIN lx ON lx.token = ctx.w),
{', '.join(steps)},
sums AS (SELECT key, sum(v3) AS s FROM s3 GROUP BY 1),
comp AS (SELECT tok.key, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 4) AS compound
         FROM tok LEFT JOIN sums USING (key)),
lex AS (SELECT key, compound, CASE WHEN compound >= 0.05 THEN 'positive'
               WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM comp)"""


@query("lexicon_score", f"WITH {lexicon_sql('documents', 'doc_id', 'text')} "
                        "SELECT key AS doc_id, compound, label FROM lex")
def _(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text")
    scored = docs.select("doc_id", lexicon.compound_score("text", fx.LEXICON).alias("compound"))
    return scored.withColumn("label", lexicon.label_of(F.col("compound")))


# the corpus lacks the words of some rules: frequent words stand in for them, in every second or third document
_IDIOMS = {"of the": 1.4, "is the": -0.9, "de la": -1.7, "in der": 0.6, "that it was": 2.2}
_RULED = lexicon.Lexicon(fx.LEXICON.valences, fx.LEXICON.boosters, (*fx.LEXICON.negations, "never", "without"))
_RULED_TEXT = """CASE WHEN doc_id % 2 = 0 THEN replace(replace(said, ' is ', ' IS '), ' the ', ' THE ') ELSE said END
  || CASE doc_id % 4 WHEN 0 THEN '!!' WHEN 1 THEN ' ???' ELSE '' END"""
_SAID = """CASE WHEN doc_id % 3 = 0 THEN text ELSE replace(replace(replace(replace(replace(text, ' and ', ' but '),
  ' for ', ' never '), ' from ', ' so '), ' on ', ' least '), ' are ', ' without doubt ') END"""


def _rule_layer_sql() -> str:
    neg = "('" + "', '".join(_RULED.negations) + "')"
    line = "' ' || array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}_'']+'), '  ') || ' '"
    for phrase in sorted((p.split() for p in _IDIOMS), key=lambda ws: (-len(ws), ws)):
        found = "(?i) " + "  ".join(f"({w})" for w in phrase) + " "
        put = " " + "-".join(f"\\{i}" for i in range(1, len(phrase) + 1)) + " "
        line = f"regexp_replace({line}, '{found}', '{put}', 'g')"
    steps, value = [], "v0"
    for d, damping in enumerate(rules.VADER_DAMPING, start=1):
        near = [f"p{e}" for e in range(1, d)]
        so = " OR ".join(f"coalesce({p} IN ('so', 'this'), false)" for p in near) or "false"
        doubt = " OR ".join(f"coalesce({p} = 'doubt', false)" for p in near) or "false"
        steps.append(f"""a{d} AS (SELECT t.*, {value} + CASE WHEN b IS NULL OR lx.token IS NOT NULL THEN 0 ELSE sign({value}) * {damping}
    * (b + CASE WHEN t.c{d} THEN sign(b) * {rules.VADER_CAPITALS} ELSE 0 END) END AS u{d},
    lx.token IS NULL AND p{d} IN {neg} AS n{d}
  FROM {'hit' if d == 1 else f'v{d - 1}'} t LEFT JOIN boost ON boost.token = p{d} LEFT JOIN lx ON lx.token = p{d}),
v{d} AS (SELECT *, u{d} * CASE WHEN n{d} IS NOT TRUE THEN 1 WHEN p{d} = 'never' AND ({so}) THEN {rules.VADER_NEVER_SO}
    WHEN p{d} = 'without' AND ({doubt}) THEN 1 ELSE {rules.VADER_NEGATION} END AS w{d} FROM a{d})""")
        value = f"w{d}"
    return f"""WITH given AS (SELECT doc_id, {_RULED_TEXT} AS text FROM (SELECT doc_id, {_SAID} AS said FROM documents)),
lx(token, v) AS (VALUES {_values({**_RULED.valences, **rule_layer.joined_idioms(_IDIOMS)})}),
boost(token, b) AS (VALUES {_values(_RULED.boosters)}),
tok AS (SELECT doc_id, text, string_split_regex(trim({line}), ' +') AS ws FROM given),
flat AS (SELECT doc_id, unnest(ws) AS o, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM tok),
loud AS (SELECT *, lower(o) AS w, o = upper(o) AND o <> lower(o) AS cap FROM flat),
mixed AS (SELECT *, cap AND count(*) FILTER (cap) OVER (PARTITION BY doc_id) < n AS c,
  coalesce(min(i) FILTER (w = 'but') OVER (PARTITION BY doc_id), 0) AS but FROM loud),
ctx AS (SELECT *, {', '.join(f'lag(w, {d}) OVER o AS p{d}, coalesce(lag(c, {d}) OVER o, false) AS c{d}' for d in (1, 2, 3))}
        FROM mixed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT ctx.*, v + CASE WHEN c THEN sign(v) * {rules.VADER_CAPITALS} ELSE 0 END AS v0 FROM ctx JOIN lx ON lx.token = ctx.w),
{', '.join(steps)},
sums AS (SELECT doc_id, sum(w3
    * CASE WHEN p1 = 'least' AND coalesce(p2 NOT IN ('at', 'very'), true) THEN {rules.VADER_NEGATION} ELSE 1 END
    * CASE WHEN but = 0 OR i = but THEN 1 WHEN i < but THEN {rules.VADER_BEFORE_BUT} ELSE {rules.VADER_AFTER_BUT} END) AS s FROM v3 GROUP BY 1),
marks AS (SELECT doc_id, coalesce(s, 0) AS s, length(text) - length(replace(text, '!', '')) AS e, length(text) - length(replace(text, '?', '')) AS q
          FROM tok LEFT JOIN sums USING (doc_id)),
total AS (SELECT doc_id, s + sign(s) * (least(e, 4) * {rules.VADER_EXCLAMATION}
          + CASE WHEN q < 2 THEN 0 WHEN q < 4 THEN q * {rules.VADER_QUESTION} ELSE {rules.VADER_QUESTIONS} END)::DOUBLE AS s FROM marks),
comp AS (SELECT doc_id, round(s / sqrt(s * s + {rules.VADER_ALPHA}), 4) AS compound FROM total)
SELECT doc_id, compound, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM comp"""


def _ruled_texts(spark, sf):
    said = fx.documents(spark, sf).select("doc_id", F.expr(_SAID).alias("said"))
    return said.select("doc_id", F.expr(_RULED_TEXT).alias("text"))


@query("lexicon_rule_layer", _rule_layer_sql())
def _(spark, sf):
    scored = _ruled_texts(spark, sf).select("doc_id", rule_layer.rule_score("text", _RULED, _IDIOMS).alias("compound"))
    return scored.withColumn("label", lexicon.label_of(F.col("compound")))


_CLEANED = (f"{fx.POSTS}, cleaned AS (SELECT post_id, "
            f"regexp_replace({_CLEAN.replace('(t,', '(content,')}, '^$', '') AS c FROM posts)")
_ANALYZED = f"""WITH {_CLEANED}, {lexicon_sql('cleaned', 'post_id', 'c')}
  SELECT post_id, CASE WHEN length(c) < 3 THEN 'neutral' ELSE label END AS sentiment
  FROM cleaned JOIN lex ON lex.key = post_id"""


def _scorers():
    return {"vader": registry.lexicon_scorer(fx.LEXICON)}


@query("analyze_sentiment", _ANALYZED)
def _(spark, sf):
    df = fx.posts(spark, sf, text_work=True).select("post_id", F.col("content").alias("text"))
    return registry.analyze_sentiment(df, _scorers(), "vader").select("post_id", "sentiment")


@query("batch_analyze", _ANALYZED + " UNION ALL SELECT post_id, 'neutral' FROM posts")
def _(spark, sf):
    df = fx.posts(spark, sf, text_work=True).select("post_id", F.col("content").alias("text"))
    both = df.unionByName(df.withColumn("text", F.lit("#!")))
    return registry.analyze_sentiment(both, _scorers(), "vader").select("post_id", "sentiment")


def _stub_labels():
    """A stand-in for a user's model: label by length of the text it is given.

    Built inside a function, so it travels to the workers by value.
    """
    def factory():
        return lambda texts: [["Negative", "Neutral", "Positive"][len(t) % 3] for t in texts]

    return factory


@query("score_posts", f"""WITH {fx.POSTS} SELECT post_id,
  CASE WHEN value < 2 THEN 'neutral' ELSE list_extract(['negative', 'neutral', 'positive'],
       CAST(length(content) % 3 + 1 AS INTEGER)) END AS sentiment,
  CAST(NULL AS VARCHAR) AS score_error FROM posts""")
def _(spark, sf):
    text = F.when(F.col("value") < 1, None).when(F.col("value") < 2, " \n").otherwise(F.col("content"))
    df = fx.posts(spark, sf, text_work=True).select("post_id", text.alias("content"))
    scored = registry.score_posts(df, registry.model_scorer(_stub_labels()))
    return scored.select("post_id", "sentiment", "score_error")


@query("score_distinct", f"""WITH {fx.POSTS} SELECT post_id,
  list_extract(['negative', 'neutral', 'positive'], CAST(length(content) % 3 + 1 AS INTEGER))
  AS sentiment FROM posts""")
def _(spark, sf):
    df = fx.posts(spark, sf, text_work=True).select("post_id", "content")
    return registry.score_distinct(df, registry.model_scorer(_stub_labels())).select("post_id", "sentiment")


_SOFT = """SELECT event_id AS row_id, sentiment, round(e0 / t, 6) AS neg_score, round(e1 / t, 6) AS neu_score,
  round(e2 / t, 6) AS pos_score FROM (
  SELECT *, e0 + e1 + e2 AS t FROM (
    SELECT event_id, exp(l0 - m) AS e0, exp(l1 - m) AS e1, exp(l2 - m) AS e2,
      CASE WHEN l0 = m THEN 'Negative' WHEN l1 = m THEN 'Neutral' ELSE 'Positive' END AS sentiment FROM (
      SELECT *, greatest(l0, l1, l2) AS m FROM (
        SELECT event_id, value / 10 AS l0, CAST(user_id % 7 AS DOUBLE) AS l1, -value / 20 AS l2 FROM events))))"""


@query("softmax_argmax", _SOFT)
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    s = e.select(F.col("event_id").alias("row_id"), softmax_label(fx.logits()).alias("s"))
    return s.select("row_id", "s.sentiment", *[
        F.round(f"s.{c}", 6).alias(c) for c in ("neg_score", "neu_score", "pos_score")])


def _stub_logits():
    def factory():
        return lambda texts: [[len(t) % 5, len(t) % 7, len(t) % 3] for t in texts]

    return factory


@query("batch_inference", r"""SELECT doc_id, round(e0 / t, 6) AS neg_score, round(e1 / t, 6) AS neu_score,
  round(e2 / t, 6) AS pos_score, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 'Negative' WHEN e1 >= e2
  THEN 'Neutral' ELSE 'Positive' END AS sentiment FROM (
  SELECT doc_id, exp(n % 5) AS e0, exp(n % 7) AS e1, exp(n % 3) AS e2,
         exp(n % 5) + exp(n % 7) + exp(n % 3) AS t FROM (
    SELECT doc_id, length(regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g')) AS n FROM documents))""")
def _(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text")
    s = docs.select("doc_id", batch.infer_batches("text", _stub_logits()).alias("s"))
    return s.select("doc_id", "s.sentiment", *[
        F.round(f"s.{c}", 6).alias(c) for c in ("neg_score", "neu_score", "pos_score")])


# --- TF-IDF and Naive Bayes ---------------------------------------------------------

_STOP = "(" + ", ".join(f"'{w}'" for w in fx.STOP_WORDS) + ")"


def _terms_sql(source: str, name: str) -> str:
    """CTE ``name(row_id, sentiment, term)``: words and pairs of a labelled source."""
    return rf"""{name}_w AS (SELECT row_id, sentiment,
  list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN {_STOP}) AS ws
  FROM {source}), {name} AS (
  SELECT row_id, sentiment, unnest(list_concat(ws, list_transform(range(1, len(ws)),
    lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM {name}_w)"""


_TFIDF = f"""{_terms_sql('train', 'tt')}, tf AS (
  SELECT row_id, sentiment, term, count(*) AS tf FROM tt GROUP BY ALL), vocab AS (
  SELECT term, ln((1 + (SELECT count(*) FROM train)) / (1 + count(*))) + 1 AS idf FROM tf
  GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000), raw AS (
  SELECT row_id, sentiment, term, idf, tf * idf AS raw FROM tf JOIN vocab USING (term)), feat AS (
  SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)) AS weight FROM raw)"""


@query("tfidf_features", f"""WITH {fx.GOLD}, train AS (SELECT * FROM gold), {_TFIDF}
  SELECT row_id, term, round(weight, 6) AS weight FROM feat""")
def _(spark, sf):
    f = naive_bayes.tfidf_features(fx.gold(spark, sf), "row_id", "text", fx.STOP_WORDS)
    return f.withColumn("weight", F.round("weight", 6))


_NB = f"""{fx.GOLD}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS total FROM gold), train AS (
  SELECT row_id, text, sentiment FROM numbered WHERE rn <= CAST(floor(0.8 * total) AS BIGINT)), test AS (
  SELECT row_id, text, sentiment FROM numbered WHERE rn > total - total // 5), {_TFIDF}, mass AS (
  SELECT term, idf, sum(CASE WHEN sentiment = 'negative' THEN weight ELSE 0 END) AS negative,
         sum(CASE WHEN sentiment = 'neutral' THEN weight ELSE 0 END) AS neutral,
         sum(CASE WHEN sentiment = 'positive' THEN weight ELSE 0 END) AS positive
  FROM feat GROUP BY 1, 2), model AS (
  SELECT term, idf, {', '.join(f'''ln(({c} + 0.1) / (sum({c}) OVER () + 0.1 * count(*) OVER ())) AS {c}'''
                               for c in rules.LABELS)} FROM mass), prior AS (
  SELECT {', '.join(f'''ln(count(*) FILTER (sentiment = '{c}') / count(*)) AS {c}''' for c in rules.LABELS)}
  FROM train)"""
_NB_PREDICT = f"""{_NB}, {_terms_sql('test', 'te')}, etf AS (
  SELECT row_id, term, count(*) AS tf FROM te GROUP BY 1, 2), dot AS (
  SELECT row_id, sqrt(sum(tf * idf * tf * idf)) AS norm,
         {', '.join(f'sum(tf * idf * {c}) AS {c}' for c in rules.LABELS)}
  FROM etf JOIN model USING (term) GROUP BY 1), joint AS (
  SELECT test.row_id, test.sentiment AS label,
         {', '.join(f'(SELECT {c} FROM prior) + coalesce(dot.{c} / norm, 0) AS {c}' for c in rules.LABELS)}
  FROM test LEFT JOIN dot USING (row_id)), nb AS (
  SELECT *, CASE WHEN negative = greatest(negative, neutral, positive) THEN 'negative'
                 WHEN neutral = greatest(negative, neutral, positive) THEN 'neutral'
                 ELSE 'positive' END AS prediction FROM joint)"""


def _trained(spark, sf):
    train, test = head_tail_split(fx.gold(spark, sf), "row_id")
    return naive_bayes.train_naive_bayes(train, "row_id", "text", "sentiment", fx.STOP_WORDS), test


@query("train_naive_bayes", f"""WITH {_NB} SELECT term, label, round(log_prob, 6) AS log_prob FROM (
  UNPIVOT (SELECT term, negative, neutral, positive FROM model) ON negative, neutral, positive
  INTO NAME label VALUE log_prob)""")
def _(spark, sf):
    model, _test = _trained(spark, sf)
    return model.tall().withColumn("log_prob", F.round("log_prob", 6))


@query("predict_naive_bayes", f"""WITH {_NB_PREDICT} SELECT row_id, round(negative, 6) AS negative,
  round(neutral, 6) AS neutral, round(positive, 6) AS positive, prediction FROM nb""")
def _(spark, sf):
    model, test = _trained(spark, sf)
    p = naive_bayes.predict_naive_bayes(test, model, "row_id", "text")
    return p.withColumns({c: F.round(c, 6) for c in rules.LABELS})


_COMPARE = f"""{_NB_PREDICT}, {lexicon_sql('test', 'row_id', 'text')}, pred AS (
  SELECT 'vader' AS model, row_id, sentiment AS label, lex.label AS prediction
  FROM test JOIN lex ON lex.key = row_id
  UNION ALL SELECT 'naive_bayes', row_id, label, prediction FROM nb), cls AS (
  SELECT model, c AS class, count(*) FILTER (label = c AND prediction = c) AS tp,
         count(*) FILTER (prediction = c) AS pp, count(*) FILTER (label = c) AS support
  FROM pred, (VALUES ('negative'), ('neutral'), ('positive')) t(c) GROUP BY 1, 2), met AS (
  SELECT model, round(sum(tp) / sum(support), 4) AS accuracy,
         round(sum(CASE WHEN pp + support > 0 THEN 2 * tp / (pp + support) ELSE 0 END * support) / sum(support), 4) AS f1_score,
         round(sum(CASE WHEN pp > 0 THEN tp / pp ELSE 0 END * support) / sum(support), 4) AS precision,
         round(sum(tp) / sum(support), 4) AS recall, CAST(sum(support) AS BIGINT) AS support
  FROM cls GROUP BY 1)"""


@query("compare_models", f"WITH {_COMPARE} SELECT * FROM met")
def _(spark, sf):
    from postlab.plans.compare import compare_models
    return compare_models(fx.gold(spark, sf), _scorers(), fx.STOP_WORDS,
                          folder=work_path(spark, "comparison")).metrics


# --- the flagship: how does each country feel? ------------------------------------------

FLAGSHIP = f"""WITH {fx.POSTS}, {lexicon_sql('posts', 'post_id', 'content')}, c AS (
  SELECT post_id, location_raw AS place FROM posts)
  SELECT {_COUNTRY} AS location,
    round(avg(CASE label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END), 6) AS avg_sentiment,
    count(*) AS total_samples FROM c JOIN lex ON lex.key = post_id GROUP BY 1"""


@query("sentiment_by_country", FLAGSHIP)
def sentiment_by_country(spark, sf):
    posts = fx.posts(spark, sf, text_work=True).select(
        "post_id", "content", country_from_location("location_raw").alias("location"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    scored = registry.score_posts(posts, registry.lexicon_scorer(fx.LEXICON))
    return sentiment_by_location(valid_timestamp(scored)).withColumn(
        "avg_sentiment", F.round("avg_sentiment", 6))
