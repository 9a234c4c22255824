"""Text, location and rule operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from postlab import rules
from postlab.functions import geo, text
from postlab.operators.joins import join_place
from postlab.operators.terms import skip_similar_terms


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def _cue_sql(profile: str, column: str = "description") -> str:
    parts = []
    for cue in rules.LOCATION_CUES[profile]:
        value = _strip(f"split_part({_strip(f'''regexp_extract({column}, '(?i){cue}\\s*([^\\n]+)', 1)''')}, ',', 1)")
        ok = f"length({value}) > 1"
        if profile == "v3":
            for bad in rules.LOCATION_FALSE_POSITIVES:
                ok += f" AND NOT contains(lower({value}), '{bad}')"
        parts.append(f"CASE WHEN {ok} THEN left({value}, 50) END")
    return "coalesce(" + ", ".join(parts) + ")"


def _tld_sql(profile: str, column: str = "handle") -> str:
    whens = " ".join(f"WHEN '{tld}' THEN '{name}'" for tld, name in rules.TLD_COUNTRY[profile].items())
    return f"CASE split_part(lower({column}), '.', -1) {whens} END"


def _mention_sql(column: str = "description") -> str:
    whens = " ".join(f"WHEN contains(lower({column}), '{n.lower()}') THEN '{n}'"
                     for n in rules.MENTIONED_COUNTRIES + rules.MENTIONED_CITIES)
    return f"CASE {whens} END"


@query("extract_location_patterns", f"WITH {fx.PROFILES} SELECT handle, {_cue_sql('v1')} AS v1, "
       f"{_cue_sql('v2')} AS v2, {_cue_sql('v3')} AS v3 FROM profiles")
def _(spark, sf):
    return fx.profiles(spark, sf).select("handle", *[
        geo.extract_location_patterns("description", p).alias(p) for p in ("v1", "v2", "v3")])


@query("location_from_handle", f"WITH {fx.PROFILES} SELECT handle, {_tld_sql('v1')} AS v1, "
       f"{_tld_sql('v2')} AS v2, {_tld_sql('v3')} AS v3 FROM profiles")
def _(spark, sf):
    return fx.profiles(spark, sf).select("handle", *[
        geo.location_from_handle("handle", p).alias(p) for p in ("v1", "v2", "v3")])


@query("tld_join", f"""WITH {fx.POSTS}, tld(tld, country) AS (VALUES
  {', '.join(f"('{k}', '{v}')" for k, v in rules.TLD_COUNTRY['v3'].items())})
  SELECT post_id, username, country FROM posts
  LEFT JOIN tld ON tld.tld = split_part(lower(username), '.', -1)""")
def _(spark, sf):
    return fx.posts(spark, sf).select(
        "post_id", "username", geo.location_from_handle("username", "v3").alias("country"))


@query("location_from_mentions", f"WITH {fx.PROFILES} SELECT handle, {_mention_sql()} AS place FROM profiles")
def _(spark, sf):
    return fx.profiles(spark, sf).select("handle", geo.location_from_mentions("description").alias("place"))


@query("resolve_location", f"""WITH {fx.PROFILES} SELECT handle,
  coalesce({_cue_sql('v1')}, {_tld_sql('v1')}, {_mention_sql()}, '') AS v1,
  coalesce({_cue_sql('v2')}, {_tld_sql('v2')}, '') AS v2,
  coalesce({_cue_sql('v3')}, {_tld_sql('v3')}, '') AS v3 FROM profiles""")
def _(spark, sf):
    return fx.profiles(spark, sf).select("handle", *[
        geo.resolve_location("description", "handle", p).alias(p) for p in ("v1", "v2", "v3")])


def _title_sql(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({expr}), ' '), "
            "lambda w: upper(w[1:1]) || w[2:]), ' ')")


_LAST = _strip("split_part(place, ',', -1)")
_ALIAS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.COUNTRY_ALIASES.items())


def _messy_place(df):
    """Locations with and without a comma, alias spellings and nulls."""
    t = F.col("search_term")
    return df.select("post_id", F.when(t == "view", None).when(t == "click", F.lit("London, uk "))
                     .when(t == "error", F.lit("São Paulo,brasil"))
                     .when(t == "signup", F.substring_index("location_raw", ", ", -1))
                     .otherwise(F.col("location_raw")).alias("place"))


_MESSY = fx.POSTS + """, messy AS (SELECT post_id, CASE search_term WHEN 'view' THEN NULL
  WHEN 'click' THEN 'London, uk ' WHEN 'error' THEN 'São Paulo,brasil'
  WHEN 'signup' THEN split_part(location_raw, ', ', 2) ELSE location_raw END AS place FROM posts)"""
_COUNTRY = (f"CASE WHEN place IS NULL THEN 'Unknown' ELSE coalesce(CASE upper({_LAST}) {_ALIAS} END, "
            f"{_title_sql(_LAST)}) END")


@query("country_from_location", f"WITH {_MESSY} SELECT post_id, place, {_COUNTRY} AS country FROM messy")
def _(spark, sf):
    df = _messy_place(fx.posts(spark, sf))
    return df.withColumn("country", geo.country_from_location("place"))


@query("country_alias_join", f"WITH {_MESSY} SELECT {_COUNTRY} AS country, count(*) AS posts FROM messy GROUP BY 1")
def _(spark, sf):
    df = _messy_place(fx.posts(spark, sf))
    return (df.groupBy(geo.country_from_location("place").alias("country"))
            .agg(F.count(F.lit(1)).alias("posts")))


@query("normalise_location_key", f"WITH {fx.LOCATED} SELECT post_id, lower({_strip('location_str')}) AS key FROM located")
def _(spark, sf):
    return fx.located(spark, sf).select("post_id", geo.location_key("location_str").alias("key"))


_GEO_COLUMNS = """CASE WHEN lon IS NOT NULL THEN lat WHEN has_box THEN (b1 + b3) / 2 END AS latitude,
  CASE WHEN lon IS NOT NULL THEN lon WHEN has_box THEN (b0 + b2) / 2 END AS longitude,
  CASE WHEN lon IS NOT NULL THEN 'coordinates' WHEN has_box THEN 'place_center' END AS location_type,
  CASE WHEN lon IS NOT NULL THEN '' WHEN has_box THEN full_name END AS place_name,
  CASE WHEN lon IS NOT NULL THEN '' WHEN has_box THEN country_code END AS country"""


def _with_geo(spark, sf):
    joined = join_place(fx.tweets(spark, sf), fx.places(spark, sf))
    return joined.withColumn("g", geo.geo_point(
        "geo.coordinates.coordinates", "place_bbox", "place_full_name", "place_country_code"))


@query("extract_geo", f"""WITH {fx.TWEETS}, {fx.PLACES} SELECT t.id, {_GEO_COLUMNS}
  FROM tweets t LEFT JOIN places p ON p.id = t.place_id""")
def _(spark, sf):
    return _with_geo(spark, sf).select("id", "g.*")


@query("has_usable_geo", f"""WITH {fx.TWEETS}, {fx.PLACES}, g AS (SELECT t.id, {_GEO_COLUMNS}
  FROM tweets t LEFT JOIN places p ON p.id = t.place_id)
  SELECT id, latitude, longitude FROM g WHERE latitude IS NOT NULL""")
def _(spark, sf):
    from postlab.operators.filters import has_usable_geo
    return has_usable_geo(_with_geo(spark, sf).select("id", "g.latitude", "g.longitude"))


def _language_sql(column: str) -> str:
    low = f"(' ' || lower({column}) || ' ')"
    scores = {}
    for language, words in rules.LANGUAGE_INDICATORS.items():
        parts = [f"CAST(contains({low}, '{w}') AS INTEGER)" for w in words]
        letters, bonus = rules.LANGUAGE_LETTERS.get(language, ("", 0))
        if letters:
            hit = " OR ".join(f"contains({low}, '{c}')" for c in letters)
            parts.append(f"CASE WHEN {hit} THEN {bonus} ELSE 0 END")
        scores[language] = " + ".join(parts)
    return ", ".join(f"{s} AS {name}" for name, s in scores.items())


_NAMES = list(rules.LANGUAGE_INDICATORS)
_PICK = "CASE " + " ".join(
    f"WHEN {n} = greatest({', '.join(_NAMES)}) THEN '{n}'" for n in _NAMES) + " END"


@query("detect_language", f"""WITH s AS (
  SELECT doc_id, text, {_language_sql('text')} FROM documents)
  SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 20 THEN 'unknown'
    WHEN greatest({', '.join(_NAMES)}) > 2 THEN {_PICK} ELSE 'english' END AS language FROM s""")
def _(spark, sf):
    docs = fx.documents(spark, sf)
    return docs.select("doc_id", text.detect_language("text").alias("language"))


_W = r"\p{L}\p{N}_"
_CLEAN = _strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'http[^\\s]+', '', 'g'), "
                f"'@[{_W}]+', '', 'g'), '[^{_W}\\s]', '', 'g'), '\\s+', ' ', 'g')")


@query("clean_text", f"""WITH {fx.POSTS}, d AS (
  SELECT post_id, '  @' || username || ' #tag http://a.b/' || CAST(post_id AS VARCHAR) || chr(10) || content
         AS t FROM posts)
  SELECT post_id, {_CLEAN} AS cleaned FROM d""")
def _(spark, sf):
    raw = F.concat(F.lit("  @"), "username", F.lit(" #tag http://a.b/"),
                   F.col("post_id").cast("string"), F.lit("\n"), "content")
    return fx.posts(spark, sf, text_work=True).select("post_id", text.clean_text(raw).alias("cleaned"))


@query("repair_mojibake", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return fx.documents(spark, sf).select("doc_id", text.repair_mojibake(garbled).alias("text"))


@query("repair_mojibake_runs", "SELECT doc_id, text || ' | ' || text || ' | ' || lang || ' | ' || text AS text FROM documents")
def _(spark, sf):
    def latin(value):
        return F.decode(F.encode(value, "UTF-8"), "ISO-8859-1")

    def windows(value):
        low, high = "".join(map(chr, rules.CP1252_HIGH)), "".join(rules.CP1252_HIGH.values())
        return F.translate(latin(value), low, high)

    # a clean, a once garbled and a twice garbled part in each text
    bar = F.lit(" | ")
    mixed = F.concat("text", bar, latin("text"), bar, "lang", bar, windows(windows("text")))
    docs = fx.documents(spark, sf).select("doc_id", mixed.alias("mixed"))
    return docs.select("doc_id", text.repair_mojibake_runs("mixed").alias("text"))


@query("scan_lenient_utf8", "SELECT doc_id, text || chr(65533) || '(' || lang AS text FROM documents")
def _(spark, sf):
    from postlab.sources.readers import scan_lenient_utf8
    data = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C328")), F.encode("lang", "UTF-8"))
    docs = fx.table(spark, sf, "documents").select("doc_id", data.alias("text"))
    return scan_lenient_utf8(docs, "text")


@query("scan_encoding_fallback", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    from postlab.sources.readers import scan_encoding_fallback
    latin = F.col("text").rlike(r"^[\x{00}-\x{FF}]*$") & (F.col("lang") == "fr")
    data = (F.when(latin, F.encode(F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1"))
            .otherwise(F.encode("text", "UTF-8")))
    docs = fx.table(spark, sf, "documents").select("doc_id", data.alias("text"))
    return scan_encoding_fallback(docs, "text")


@query("truncate", "SELECT doc_id, left(text, 512) AS model_text, left(text, 10000) AS stored_text FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.truncate("text").alias("model_text"),
        text.truncate("text", rules.CONTENT_LIMIT).alias("stored_text"))


@query("flatten_newlines", f"SELECT doc_id, {_strip('''replace(text, chr(10), ' ')''')} AS text FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.flatten_newlines("text").alias("text"))


@query("normalise_handle", f"WITH {fx.POSTS} SELECT post_id, username AS handle FROM posts")
def _(spark, sf):
    raw = F.concat(F.lit(" @"), "username", F.lit("\t"))
    return fx.posts(spark, sf).select("post_id", text.normalise_handle(raw).alias("handle"))


@query("normalise_hashtag", f"WITH {fx.POSTS} SELECT post_id, '#' || search_term AS tag FROM posts")
def _(spark, sf):
    raw = F.concat(F.lit(" #"), "search_term", F.lit("\n"))
    return fx.posts(spark, sf).select("post_id", text.normalise_hashtag(raw).alias("tag"))


_RULE_TERMS = ["AI", "artificial intelligence", "AI assistant", "artificial general intelligence",
               "machine learning", "GPT", "GPT"]


@query("skip_similar_terms", f"""WITH {fx.POSTS}, t AS (SELECT post_id,
  list_concat([search_term, search_term || ' news', lang_gold || ' ' || search_term, lang_gold],
              {_RULE_TERMS}) AS terms FROM posts)
  SELECT post_id, array_to_string(list_reduce(list_transform(terms, lambda t: [t]), lambda acc, x:
    CASE WHEN contains(x[1], ' ')
          AND len(list_filter(acc, lambda k: contains(k, split_part(x[1], ' ', 1)))) > 0
         THEN acc ELSE list_concat(acc, x) END), '|') AS kept FROM t""")
def _(spark, sf):
    terms = F.array("search_term", F.concat("search_term", F.lit(" news")),
                    F.concat("lang_gold", F.lit(" "), "search_term"), "lang_gold",
                    *[F.lit(t) for t in _RULE_TERMS])
    return fx.posts(spark, sf).select(
        "post_id", F.array_join(skip_similar_terms(terms), "|").alias("kept"))


@query("parse_timestamp", f"""WITH {fx.POSTS} SELECT post_id,
  CASE WHEN value >= 3 THEN epoch(date_trunc('second', created_at))::BIGINT
       - CASE WHEN value >= 15 THEN 7200 ELSE 0 END END AS epoch FROM posts""")
def _(spark, sf):
    raw = (F.when(F.col("value") < 3, "soon")
           .when(F.col("value") < 15, F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
           .otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss'+02:00'")))
    return fx.posts(spark, sf).select("post_id", F.unix_timestamp(text.parse_timestamp(raw)).alias("epoch"))


@query("label_case", f"""WITH {fx.POSTS} SELECT post_id, lower(sentiment) AS lowered,
  upper(left(sentiment, 1)) || lower(substr(sentiment, 2)) AS titled FROM posts""")
def _(spark, sf):
    return fx.posts(spark, sf).select(
        "post_id", F.lower(F.upper("sentiment")).alias("lowered"),
        text.label_title(F.upper("sentiment")).alias("titled"))
