import random
import statistics

import pytest
from pyspark.sql import functions as F

from postlab.operators import ranks, sampling


@pytest.mark.parametrize("kind,values", [
    ("long", [random.Random(1).randrange(-10**18, 10**18) for _ in range(500)]),
    ("long", [2**60 + i for i in range(300)]),
    ("double", [random.Random(2).gauss(0, 1e6) for _ in range(500)] + [1e-300, 1e300]),
    ("double", [0.1] * 400 + [0.1 + 1e-17, 0.10000000000000002]),
    ("int", [5]),
])
def test_every_kind_of_value(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"v {kind}")
    ordered = sorted(values)
    search = ranks.RankSearch(df, "v")
    assert search.measure() == len(values)
    for rank in {1, len(values), (len(values) + 1) // 2, max(1, len(values) // 5)}:
        assert search.value_at(rank) == ordered[rank - 1]
    assert search.value_at(len(values) + 1) in (None, ordered[-1]) and ranks.RankSearch(df.limit(0), "v").measure() == 0


def test_medians(spark):
    rows = [(float(i % 7), float(i * i % 31)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert ranks.exact_medians(df, ["a", "b"]) == {
        "a": statistics.median(r[0] for r in rows), "b": statistics.median(r[1] for r in rows)}
    assert ranks.exact_medians(df.limit(0), ["a"]) == {"a": None}


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(50_000)
    a = {r[0] for r in sampling.sample_n(df, 1234, "id").collect()}
    b = {r[0] for r in sampling.sample_n(df.repartition(13), 1234, "id").collect()}
    plain = df.orderBy(sampling.sample_order("id"), "id").limit(1234)
    assert len(a) == 1234 and a == b == {r[0] for r in plain.collect()}
    assert a != {r[0] for r in sampling.sample_n(df, 1234, "id", seed=7).collect()}
    assert sampling.sample_n(df, 10**9, "id").count() == 50_000
    c = {r[0] for r in sampling.sample_n(df, 1234, "id", portable=True).collect()}
    assert len(c) == 1234 and c != a
    assert sampling.sample_n(df.limit(0), 5, "id").count() == 0 == sampling.sample_n(df, 0, "id").count()


def test_sample_of_copies(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"))
    assert sampling.sample_n(df, 10, "k").count() == 10


@pytest.mark.parametrize("n", [1, 4, 5, 99, 100])
def test_head_tail(spark, n):
    df = spark.range(n).select((F.col("id") * 3 - 50).alias("k"))
    head, tail = sampling.head_tail_split(df, "k")
    keys = [i * 3 - 50 for i in range(n)]
    assert sorted(r[0] for r in head.collect()) == keys[:int(0.8 * n)]
    assert sorted(r[0] for r in tail.collect()) == (keys[-(n // 5):] if n // 5 else [])


def test_ties_in_counts(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "c", None, None, None]], "v string")
    assert [tuple(r) for r in sampling.top_counts(df, "v", 2).collect()] == [("c", 2), ("a", 1)]
    assert [tuple(r) for r in sampling.top_ascending(df, "v", 3).collect()] == [("b", 1), ("a", 1), ("c", 2)]


def test_median_with_nan_and_infinities(spark):
    inf, nan = float("inf"), float("nan")
    for values in ([1.0, 2.0, nan, nan, nan, nan, nan], [inf] + [float(i) for i in range(200)], [-inf, inf, 3.0],
                   [-1.7e308, 1.7e308, 5.0, 1e308], [nan], [-inf, -inf, 1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got, want = ranks.exact_medians(df, ["v"])["v"], df.agg(F.median("v")).first()[0]
        assert got == want or (got != got and want != want), values
