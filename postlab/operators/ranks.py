"""Exact order statistics without sorting rows into one task.

The rows are counted per value bucket, then the search zooms into the bucket
that holds the wanted rank. Each pass is one aggregation whose result has at
most ``BUCKETS + 1`` rows; the rows themselves never leave their tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


class RankSearch:
    """Finds values by rank in one numeric column; nulls do not count.

    ``low`` and ``high`` must enclose all values; ``measure()`` finds them.
    """

    def __init__(self, df: DataFrame, column: str, low=None, high=None):
        self.values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
        self.low, self.high = low, high
        self._passes = {}

    def measure(self) -> int:
        """Number of rows; also fixes the range of the search."""
        n, self.low, self.high = self.values.agg(
            F.count("v"), F.min("v"), F.max("v")).first()
        return n

    def _bucket(self, low, high) -> Column:
        width = float(high) / 2 - float(low) / 2        # halves: the range of two doubles may not be a double
        if not width > 0:                               # neighbours that a double cannot part
            return F.when(F.col("v") == F.lit(low), 0).otherwise(1)
        return F.floor((F.col("v").cast("double") / 2 - F.lit(float(low) / 2)) / width * BUCKETS)

    def _counts(self, low, high) -> list:
        """(n, lo, hi) per bucket between two values, in order.

        Bucket edges only steer the search; the next range uses the real least
        and greatest value of a bucket, so rounding cannot lose a row.
        """
        if (low, high) not in self._passes:
            inside = self.values.where(F.col("v").between(F.lit(low), F.lit(high)))
            self._passes[low, high] = (
                inside.groupBy(self._bucket(low, high).alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .orderBy("lo").collect())
        return self._passes[low, high]

    def value_at(self, rank: int, slack: int = 0):
        """Value of the ``rank``-th smallest row (1-based), None beyond the last.

        With ``slack`` the search may stop early at a value with at least
        ``rank`` and at most ``rank + slack`` rows at or below it.
        """
        low, high, below = self.low, self.high, 0
        while low is not None and low != high:
            for row in self._counts(low, high):
                if below + row["n"] >= rank:
                    break
                below += row["n"]
            else:
                return None
            if below + row["n"] <= rank + slack:
                return row["hi"]
            # after one pass both ends are real values and lie in different
            # buckets, so the range shrinks every time
            low, high = row["lo"], row["hi"]
        return low


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Interpolated medians of several columns, equal to Spark's ``median``.

    Each column is first reduced to counts per bucket of its finite values; NaN counts as the largest value and
    infinities as the outermost ones, so the search itself only meets finite numbers.
    """
    finite = lambda name: F.abs(F.col(name).cast("double")) < F.lit(float("inf"))
    stats = df.agg(*[f.alias(f"{tag}_{name}") for name in columns for tag, f in (
        ("below", F.count_if(F.col(name).cast("double") == F.lit(float("-inf")))),
        ("above", F.count_if(F.col(name).cast("double") == F.lit(float("inf")))),
        ("nan", F.count_if(F.isnan(F.col(name).cast("double")))),
        ("n", F.count_if(finite(name))), ("lo", F.min(F.when(finite(name), F.col(name)))),
        ("hi", F.max(F.when(finite(name), F.col(name)))))]).first()
    medians = {}
    for name in columns:
        below, above, n = (stats[f"{tag}_{name}"] for tag in ("below", "above", "n"))
        total = below + n + above + stats[f"nan_{name}"]
        search = RankSearch(df.where(finite(name)), name, stats[f"lo_{name}"], stats[f"hi_{name}"])

        def value_at(rank: int):
            if rank <= below:
                return float("-inf")
            if rank <= below + n:
                return search.value_at(rank - below)
            return float("inf") if rank <= below + n + above else float("nan")

        middle = [value_at(r) for r in sorted({(total + 1) // 2, total // 2 + 1})] if total else []
        medians[name] = sum(middle) / len(middle) if total else None
    return medians


def head_tail_bounds(df: DataFrame, order_key: str, head: float = 0.8, tail_parts: int = 5):
    """Key values ending the first ``int(head * n)`` rows and starting the last ``n // tail_parts``.

    The key must be numeric and unique: it stands for the row order.
    """
    search = RankSearch(df, order_key)
    n = search.measure()
    head_n, tail_n = int(head * n), n // tail_parts
    last_head = search.value_at(head_n) if head_n else None
    first_tail = search.value_at(n - tail_n + 1) if tail_n else None
    return last_head, first_tail
