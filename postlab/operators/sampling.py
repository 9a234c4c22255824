"""Sorts with limits, exact-size samples, head/tail splits, set unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.operators.ranks import RankSearch, head_tail_bounds


def top_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values; ties go to the smaller value."""
    counts = (df.where(F.col(column).isNotNull())
              .groupBy(column).agg(F.count(F.lit(1)).alias("posts")))
    return counts.orderBy(F.desc("posts"), F.asc(column)).limit(n)


def top_ascending(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """Top ``n`` values, smallest first, as a horizontal bar chart wants them."""
    return top_counts(df, column, n).orderBy(F.asc("posts"), F.desc(column))


def preview(df: DataFrame, *order: str, n: int = 3) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_order(key: str, seed: int = 42, portable: bool = False) -> Column:
    """Random-looking but repeatable 64-bit order of the rows.

    ``portable`` takes 60 bits of md5(seed:key), which any SQL engine can
    repeat; the default hash is several times faster.
    """
    if not portable:
        return F.xxhash64(F.lit(seed), F.col(key))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, portable: bool = False) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones in every run.

    A plain ``orderBy(hash).limit(n)`` sends n rows of every input task to one
    reducer. Finding the hash value near rank n first lets each task drop all
    other rows, so about n rows are sorted in total.
    """
    hashed = df.withColumn("_order", sample_order(key, seed, portable))
    low, high = (0, 2**60 - 1) if portable else (-2**63, 2**63 - 1)
    bound = RankSearch(hashed, "_order", low, high).value_at(n, slack=max(n, 1000))
    if bound is None:               # fewer than n rows: the sample is everything
        return df
    near = hashed.where(F.col("_order") <= F.lit(bound))
    return near.orderBy("_order", key).limit(n).drop("_order")


def trim_total(df: DataFrame, n: int, order: tuple[str, ...] = ("term_idx", "pos")) -> DataFrame:
    """First ``n`` rows in collection order."""
    return df.orderBy(*order).limit(n)


def head_tail_split(df: DataFrame, order_key: str, head: float = 0.8,
                    tail_parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """First ``int(head * n)`` and last ``n // tail_parts`` rows by a unique key.

    Both parts are plain range filters, so no row is shuffled and the filter
    reaches the scan.
    """
    last_head, first_tail = head_tail_bounds(df, order_key, head, tail_parts)
    key = F.col(order_key)
    first = df.where(key <= F.lit(last_head)) if last_head is not None else df.where(F.lit(False))
    last = df.where(key >= F.lit(first_tail)) if first_tail is not None else df.where(F.lit(False))
    return first, last


def tail_n(df: DataFrame, order_key: str, parts: int = 5) -> DataFrame:
    return head_tail_split(df, order_key, tail_parts=parts)[1]


def seen_keys(*frames: DataFrame, key: str = "username") -> DataFrame:
    """Distinct keys over all frames."""
    return reduce(DataFrame.union, [frame.select(key) for frame in frames]).distinct()
