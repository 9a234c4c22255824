"""Lookup joins and anti joins.

All lookups are equi joins from a fact frame (left) to a table with one row per
key. No broadcast is forced: Catalyst broadcasts a side only when its measured
size is below ``spark.sql.autoBroadcastJoinThreshold``, and otherwise runs a
sort-merge join. Right sides with one row per key are stored first: a join would
reuse the partitions of their aggregate, and AQE could not split a heavy key then. The constant
rule tables (at most 29 entries) are map literals and need no join at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.functions.geo import location_key
from postlab.functions.text import let
from postlab.session import stored_table


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by ``order``; aggregated before the shuffle."""
    rest = [name for name in df.columns if name not in (key, order)]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{name}").alias(name) for name in rest])


def join_place(tweets: DataFrame, places: DataFrame) -> DataFrame:
    """Add name, country code and box of the tweet's place; first place per id."""
    dim = first_per_key(places, "id", "ord").select(
        F.col("id").alias("_place_id"),
        F.col("full_name").alias("place_full_name"),
        F.col("country_code").alias("place_country_code"),
        F.col("geo.bbox").alias("place_bbox"))
    dim = stored_table(dim, "places")
    return (tweets.join(dim, F.col("geo.place_id") == F.col("_place_id"), "left")
            .drop("_place_id"))


def join_user_location(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """Add the author's profile location; null when absent or empty."""
    dim = first_per_key(users, "id", "ord").select(
        F.col("id").alias("author_id"),
        F.nullif(F.col("location"), F.lit("")).alias("user_location"))
    return tweets.join(stored_table(dim, "user-locations"), "author_id", "left")


def join_profile(posts: DataFrame, profiles: DataFrame, handle: str = "username") -> DataFrame:
    """Add the profile text of the author; ``''`` when there is no profile."""
    dim = (profiles.groupBy("handle").agg(F.min("description").alias("description"))
           .withColumnRenamed("handle", handle))
    return (posts.join(stored_table(dim, "profiles"), handle, "left")
            .withColumn("description", F.coalesce("description", F.lit(""))))


def geocode_join(df: DataFrame, gazetteer: DataFrame, column: str = "location_str") -> DataFrame:
    """Add latitude and longitude by normalised location; misses stay null."""
    dim = gazetteer.groupBy(F.col("location_key").alias("_key")).agg(
        F.min(F.struct("latitude", "longitude")).alias("_at"))
    dim = stored_table(dim.select("_key", "_at.latitude", "_at.longitude"), "gazetteer")
    return (df.withColumn("_key", location_key(column))
            .join(dim, "_key", "left").drop("_key"))


def new_locations(df: DataFrame, gazetteer: DataFrame, column: str = "location_str") -> DataFrame:
    """Distinct location keys the gazetteer does not hold yet."""
    keys = df.select(location_key(column).alias("location_key")).distinct()
    return keys.join(gazetteer, "location_key", "left_anti")


def term_matches(posts: DataFrame, terms: Sequence[str], column: str = "content") -> DataFrame:
    """One row per post and search term found in it, ignoring case.

    The terms are a rule list, so the theta join becomes an expression: each
    post yields the array of its matching terms and explodes it in place. No
    pairs of non-matching rows are ever made and nothing is shuffled.
    """

    def matching(low: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(F.contains(low, F.lit(term.lower())),
                   F.struct(F.lit(i).alias("term_idx"), F.lit(term).alias("search_term")))
            for i, term in enumerate(terms)]))

    kept = [name for name in posts.columns if name not in ("term_idx", "search_term")]
    return posts.select(*kept, F.inline(let(F.lower(column), matching)))


def anti_seen_posts(posts: DataFrame, seen: DataFrame, key: str = "post_id") -> DataFrame:
    """Posts whose id was not collected before."""
    return posts.join(seen.select(key), key, "left_anti")
