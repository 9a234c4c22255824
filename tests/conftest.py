import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from postlab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "postlab-tests", shuffle=4)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column function on a list of values."""
    def run(fn, values, kind="string"):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r["out"] for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]
    return run
