"""Declared schemas. Reads never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _TS = (T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(),
                       T.TimestampType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


POSTS = _struct(
    link=_S, content=_S, sentiment=_S, location=_S, username=_S, display_name=_S,
    created_at=_TS, like_count=_L, reply_count=_L, repost_count=_L,
    post_id=_S, search_term=_S, collected_at=_TS)
POSTS_V2 = T.StructType([*POSTS.fields, T.StructField("user_post_number", _I)])
POSTS_V3 = T.StructType([*POSTS.fields, T.StructField("language", _S),
                         T.StructField("user_post_count", _I)])

SEARCH_HIT = _struct(
    uri=_S,
    author=_struct(handle=_S, display_name=_S),
    record=_struct(text=_S, created_at=_S),
    like_count=_L, reply_count=_L, repost_count=_L,
    search_term=_S, term_idx=_I, pos=_L)

PROFILE = _struct(handle=_S, description=_S)

TWEET = _struct(
    id=_S, text=_S, created_at=_S, author_id=_S, lang=_S, is_retweet=T.BooleanType(),
    geo=_struct(coordinates=_struct(coordinates=T.ArrayType(_D)), place_id=_S),
    public_metrics=_struct(retweet_count=_L, like_count=_L, reply_count=_L, quote_count=_L))

PLACE = _struct(id=_S, full_name=_S, country_code=_S, geo=_struct(bbox=T.ArrayType(_D)), ord=_L)
USER = _struct(id=_S, location=_S, name=_S, username=_S, ord=_L)

GEO_TWEETS = _struct(
    text=_S, created_at=_TS, author_id=_S, retweet_count=_L, like_count=_L, reply_count=_L,
    quote_count=_L, latitude=_D, longitude=_D, location_type=_S, place_name=_S, country=_S)
LOCATED_TWEETS = _struct(
    text=_S, location_str=_S, latitude=_D, longitude=_D, sentiment=_S,
    neg_score=_D, neu_score=_D, pos_score=_D)
GAZETTEER = _struct(location_key=_S, latitude=_D, longitude=_D)
GOLD = _struct(text=_S, airline_sentiment=_S)
PREDICTIONS = _struct(model=_S, row_id=_L, label=_S, prediction=_S)
METRICS = _struct(model=_S, accuracy=_D, f1_score=_D, precision=_D, recall=_D, support=_L)
