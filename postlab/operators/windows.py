"""Per-user and per-term caps.

``row_number() <= k`` is planned by Spark as a group limit in front of the
shuffle: every task forwards at most k rows per group, so an account or a term
holding a large share of the rows does not arrive whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab import rules
from postlab.session import stored_table

SALTS = 16


def cap_per_search(hits: DataFrame, k: int = rules.PER_SEARCH_USER_CAP, user: str = "username") -> DataFrame:
    """First ``k`` posts of each user within each search term."""
    order = Window.partitionBy("term_idx", user).orderBy("pos")
    return (hits.withColumn("user_post_number", F.row_number().over(order))
            .where(F.col("user_post_number") <= k))


def one_post_per_user(hits: DataFrame, user: str = "username") -> DataFrame:
    """First post of each user over all terms."""
    order = Window.partitionBy(user).orderBy("term_idx", "pos")
    return (hits.withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") == 1).drop("_rank"))


def cap_after_first_accept(hits: DataFrame, k: int = rules.ACCEPTED_USER_CAP,
                           user: str = "username", match: str = "match",
                           salts: int = SALTS) -> DataFrame:
    """Budget of ``k`` posts per term, spent from a user's first accepted post on.

    A user becomes known with the first matching post. From that post on every
    post of the user counts, matching or not; only matching ones are kept.
    Dropping what lies before the first accepted post makes the running count a
    plain row number per (term, user).

    The first accepted post is joined back under a salted key: a heavy account
    is spread over ``salts`` tasks, and since the output is not clustered by
    user, the row number below gets its own shuffle with a group limit in front.
    """
    per_term = (hits.where(F.col(match)).groupBy(user, "term_idx")
                .agg(F.min("pos").alias("pos")))
    first = per_term.groupBy(user).agg(
        F.min("term_idx").alias("_term"), F.min_by("pos", "term_idx").alias("_pos"))
    spread = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = hits.withColumn(
        "_salt", F.pmod(F.xxhash64("term_idx", "pos"), F.lit(salts)).cast("int"))
    counted = salted.join(spread, [user, "_salt"]).where(
        (F.col("term_idx") > F.col("_term"))
        | ((F.col("term_idx") == F.col("_term")) & (F.col("pos") >= F.col("_pos"))))
    order = Window.partitionBy("term_idx", user).orderBy("pos")
    return (counted.withColumn("user_post_count", F.row_number().over(order))
            .where(F.col("user_post_count") <= k).where(F.col(match))
            .select(*hits.columns, "user_post_count"))


def dedupe_across_terms(posts: DataFrame, key: str = "post_id") -> DataFrame:
    """Keep a post only in the first term that has it; repeats there stay.

    The first term per post is aggregated before the shuffle, stored, and joined back on
    (post, term). The join shuffles the stored side itself, so AQE can split a heavy
    post there, which it cannot do for a window partition or an aggregate's own partitions.
    """
    first = stored_table(posts.groupBy(key).agg(F.min("term_idx").alias("term_idx")), "first-terms")
    return posts.join(first, [key, "term_idx"], "left_semi")


def limit_per_term(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """First ``limit`` posts of each term; all of them by default."""
    if limit is None:
        return hits
    order = Window.partitionBy("term_idx").orderBy("pos")
    return (hits.withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= limit).drop("_rank"))


def top_k_per_group(counts: DataFrame, group: str, value: str, count: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each group, with their rank."""
    order = Window.partitionBy(group).orderBy(F.desc(count), F.asc(value))
    return (counts.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k))


def percent_of_total(counts: DataFrame, count: str = "posts") -> DataFrame:
    """Share of each count in the sum of all counts, in percent.

    The total is a scalar subquery: an un-partitioned window would move every
    group into one task.
    """
    total = counts.agg(F.sum(count).alias("total")).scalar()
    return counts.withColumn("pct", F.col(count) / total * 100)


def select_within_budget(hits: DataFrame, total: int, per_term: int | None = rules.FETCH_LIMIT, asked: int | None = rules.ASKED_LIMIT,
                         k: int = rules.ACCEPTED_USER_CAP, user: str = "username", match: str = "match") -> DataFrame:
    """Collect at most ``total`` posts, each term asking for no more than is still missing.

    A term's first ``min(per_term, asked, missing)`` hits are fetched, then capped per user and de-duplicated against the terms
    before it; what they add is no longer missing for the terms behind. Terms nobody needs any more fetch nothing.

    Ranks per term are taken once. A pass selects with the sizes known so far and counts what each term adds; the fold over
    terms finds the first whose size was wrong, and all before it are settled. As long as enough is missing every size is the
    limit, so one pass settles those terms together. The driver sees one count per term.
    """
    bound = min(x for x in (per_term, asked, total) if x is not None)
    order = Window.partitionBy("term_idx").orderBy("pos")
    ranked = stored_table(hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= bound), "fetched")
    terms = sorted(r.term_idx for r in ranked.select("term_idx").distinct().collect())
    sizes = dict.fromkeys(terms, bound)
    while True:
        size = F.coalesce(*(F.when(F.col("term_idx") == t, F.lit(n)) for t, n in sizes.items()), F.lit(0))
        fetched = ranked.where(F.col("_rank") <= size).drop("_rank")
        kept = stored_table(dedupe_across_terms(cap_after_first_accept(fetched, k, user, match)), "within-budget")
        added = {r.term_idx: r["count"] for r in kept.groupBy("term_idx").count().collect()}
        missing, wrong = total, None
        for i, t in enumerate(terms):
            if sizes[t] != max(0, min(bound, missing)):
                wrong = i
                break
            missing -= added.get(t, 0)
        if wrong is None:
            return kept
        sizes.update(dict.fromkeys(terms[wrong:], max(0, min(bound, missing))))
