"""Keep one row per key under a total order.

``row_number() = 1`` lets Catalyst drop losers before the shuffle (a partial group limit), so
even a key holding a third of all rows sends one row per task over the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key, with their position in ``rank``."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def dedupe_latest(df: DataFrame, keys: list[str], latest: list[str]) -> DataFrame:
    """Newest row per key; remaining ties are broken by all other columns, so it is repeatable."""
    used = {*keys, *latest}
    order = [F.col(c).desc_nulls_last() for c in latest]
    order += [F.col(c).asc_nulls_last() for c in df.columns if c not in used]
    return keep_first(df, keys, order)


def dedupe_keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    return keep_first(df, keys, [F.col(sequence).desc_nulls_last()])
