from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from riskspark.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", "tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Values of one column expression, or of a function of column x, over rows of tuples."""

    def run(expression, rows, schema):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        value = expression(F.col("x")) if callable(expression) else expression
        return [r[0] for r in df.select(value).collect()]

    return run
