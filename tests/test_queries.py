"""Every registered query runs and agrees with its check SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, kinds, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = db.execute(sql)
    names, types = [d[0] for d in want.description], [d[1] for d in want.description]
    assert rows_of(df.columns, got) == rows_of(names, want.fetchall())
    assert dict(df.dtypes) == dict(zip(names, kinds(types)))


def test_entry(spark):
    assert entry.entry(spark).columns == ["location", "avg_sentiment", "total_samples"]


def test_no_cross_join_and_no_python_in_hot_paths(spark):
    """With broadcasts off, as at scale, no plan pairs rows without a key."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("sentiment_by_country", "term_match_join", "percent_of_total", "location_distribution",
                     "confusion_matrix", "cap_after_first_accept", "tfidf_features", "detect_language", "clean_text"):
            plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            for bad in ("CartesianProduct", "NestedLoopJoin", "EvalPython"):
                assert bad not in plan, (name, bad)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
