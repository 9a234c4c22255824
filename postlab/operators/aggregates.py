"""Report aggregates. Every one is a grouped hash aggregate with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlab.functions.geo import in_region, location_key
from postlab.functions.labels import label_score
from postlab.functions.text import WORD_CHARS, label_title, tokens
from postlab.operators.ranks import exact_medians
from postlab.operators.sampling import top_counts
from postlab.operators.windows import percent_of_total, top_k_per_group

def _rows() -> Column:
    return F.count(F.lit(1))


def _pct(part: Column, whole: Column) -> Column:
    """Percentage, 0 when the whole is empty."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def collection_summary(posts: DataFrame) -> DataFrame:
    located = F.count_if(F.col("location") != "")
    return posts.agg(
        _rows().alias("total_posts"),
        located.alias("with_location"),
        _pct(located, _rows()).alias("location_pct"),
        (_rows() - located).alias("blank_locations"))


def diversity_summary(posts: DataFrame, profile: str = "v3") -> DataFrame:
    users = F.countDistinct("username")
    located = F.count_if(F.col("location") != "")
    europe = F.count_if(in_region("location", "europe", profile))
    us = F.count_if(in_region("location", "us", profile))
    return posts.agg(
        _rows().alias("total_posts"),
        users.alias("unique_users"),
        F.when(users > 0, _rows() / users).otherwise(F.lit(0.0)).alias("posts_per_user"),
        located.alias("with_location"), _pct(located, _rows()).alias("location_pct"),
        europe.alias("european_posts"), _pct(europe, _rows()).alias("european_pct"),
        us.alias("us_posts"), _pct(us, _rows()).alias("us_pct"))


def location_distribution(posts: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` locations with their share of all posts; the empty one is cut afterwards.

    Total and top list read the same grouped counts, so the posts are scanned
    once. A null group may take one place, hence ``n + 1`` before it is dropped.
    """
    counts = posts.groupBy("location").agg(_rows().alias("posts"))
    total = counts.agg(F.sum("posts").alias("total")).scalar()
    order = [F.desc("posts"), F.asc("location")]
    top = counts.orderBy(*order).limit(n + 1).where(F.col("location").isNotNull())
    return (top.orderBy(*order).limit(n).where(F.col("location") != "")
            .withColumn("pct", F.col("posts") / total * 100))


def language_distribution(posts: DataFrame) -> DataFrame:
    counts = posts.where(F.col("language").isNotNull()).groupBy("language").agg(_rows().alias("posts"))
    return percent_of_total(counts).withColumn("language", label_title("language"))


def sentiment_distribution(posts: DataFrame, label: str = "sentiment") -> DataFrame:
    counts = posts.where(F.col(label).isNotNull()).groupBy(label).agg(_rows().alias("posts"))
    return percent_of_total(counts)


def sentiment_by_location(posts: DataFrame, location: str = "location",
                          label: str = "sentiment") -> DataFrame:
    """Mean score and row count per location; rows without a location do not group."""
    return (posts.where(F.col(location).isNotNull())
            .groupBy(location)
            .agg(F.avg(label_score(label)).alias("avg_sentiment"),
                 _rows().alias("total_samples")))


def keyword_result(tweets: DataFrame, keyword: str, model: str, label: str = "sentiment") -> DataFrame:
    """One summary row; zero counts and percentages for an empty frame.

    An empty frame reports no keyword and the model ``none``.
    """
    counts = {name: F.count_if(F.col(label) == name) for name in ("positive", "negative", "neutral")}
    full = _rows() > 0
    return tweets.agg(
        _rows().alias("total_tweets"),
        *[n.alias(f"{name}_count") for name, n in counts.items()],
        *[_pct(n, _rows()).alias(f"{name}_pct") for name, n in counts.items()],
        F.when(full, model).otherwise("none").alias("model_used"),
        F.when(full, keyword).otherwise("").alias("keyword"))


def mean_scores(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(name).alias(f"mean_{name}") for name in ("pos_score", "neg_score", "neu_score")])


def map_center(df: DataFrame) -> DataFrame:
    """Median latitude and longitude, exact at any size.

    ``median`` keeps every distinct value in one task; the rank search counts
    values in buckets instead.
    """
    medians = exact_medians(df, ["latitude", "longitude"])
    return df.sparkSession.createDataFrame(
        [(medians["latitude"], medians["longitude"])], "center_lat double, center_lon double")


def geocode_stats(df: DataFrame, column: str = "location_str") -> DataFrame:
    """Distinct locations as written and as keys, distinct keys found, rows removed for want of coordinates."""
    found = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    per_text = df.groupBy(F.col(column), location_key(column).alias("k")).agg(
        _rows().alias("n"), F.count_if(found).alias("hits"))
    return per_text.agg(
        _rows().alias("unique_locations"),
        F.count_distinct("k").alias("unique_keys"),
        F.count_distinct(F.when(F.col("hits") > 0, F.col("k"))).alias("geocoded_locations"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("final_rows"),
        F.coalesce(F.sum(F.col("n") - F.col("hits")), F.lit(0)).alias("removed_rows"))


def word_frequency(posts: DataFrame, stop_words: Sequence[str], labels=("positive", "negative"),
                   text: str = "content", label: str = "sentiment", min_text: int = 10) -> DataFrame:
    """Word counts per label, for labels with more than ``min_text`` characters of joined text.

    Each post adds one word that starts with a space and names its length (plus the joining
    space), so counts and text sizes come from the same pass over the text. Words are exploded plain and
    tested afterwards: functions over the array are interpreted word by word, and structs of
    words cost as much again. The two uses below filter on aggregated columns only; a filter on ``word``
    would be pushed under the aggregate and split it into two.
    """
    wanted = posts.where(F.col(label).isin(*labels) & F.col(text).isNotNull()).select(label, text)
    found = tokens(text, f"[{WORD_CHARS}][{WORD_CHARS}']+")
    length = F.concat(F.lit(" "), (F.length(text) + 1).cast("string"))
    words = wanted.select(label, F.explode(F.array_append(found, length)).alias("word"))
    is_length = F.startswith("word", F.lit(" "))
    words = words.where(is_length | ~F.col("word").isin(*stop_words))
    size = F.when(is_length, F.substring("word", 2, 20).cast("long")).otherwise(F.lit(0))
    counts = words.groupBy(label, "word").agg(_rows().alias("n"), F.sum(size).alias("size"))
    sizes = counts.where((F.col("size") > 0) & (F.col("n") > 0)).groupBy(label).agg(F.sum("size").alias("size"))
    enough = sizes.where(F.col("size") - 1 > min_text).select(label)
    # at most one row per wanted label: joining by shuffle would put all words of
    # a label into one task
    return counts.where(F.col("size") == 0).drop("size").join(F.broadcast(enough), label, "left_semi")


def top_words(posts: DataFrame, stop_words: Sequence[str], k: int = 10, **options) -> DataFrame:
    label = options.get("label", "sentiment")
    return top_k_per_group(word_frequency(posts, stop_words, **options), label, "word", "n", k)


def snapshot_by_country(cases: DataFrame, country: str = "country") -> DataFrame:
    """Total per country at the latest date of the table."""
    latest = cases.agg(F.max("date")).scalar()
    return (cases.where(F.col("date") == latest)
            .groupBy(country, "date").agg(F.sum("confirmed").alias("confirmed")))


def latest_by_state(cases: DataFrame, state: str = "state") -> DataFrame:
    """Last cumulative value of each state, upper-case names."""
    return (cases.groupBy(F.upper(state).alias("state"))
            .agg(F.max_by("confirmed", "date").alias("confirmed"), F.max("date").alias("date")))


def top_languages(posts: DataFrame, column: str = "language", n: int = 10) -> DataFrame:
    return top_counts(posts, column, n)


def distinct_locations(df: DataFrame, column: str = "location_str") -> DataFrame:
    return df.select(column).distinct()


def users_in_term(posts: DataFrame) -> DataFrame:
    return posts.groupBy("search_term").agg(
        _rows().alias("posts"), F.countDistinct("username").alias("users"))


def term_progress(new_posts: DataFrame) -> DataFrame:
    """New and cumulative posts after each term.

    The window runs over one row per search term, a fixed rule list.
    """
    per_term = new_posts.groupBy("term_idx").agg(_rows().alias("new_posts"))
    upto = Window.orderBy("term_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_term.withColumn("total_posts", F.sum("new_posts").over(upto))
