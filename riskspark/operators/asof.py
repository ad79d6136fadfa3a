"""As-of attachment of the newest earlier record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.operators.ordered import join_null_safe

RATING_FIELDS = ["rating_year", "rating_status", "rating_grade", "rating_factor"]


def asof_attach(left: DataFrame, right: DataFrame, by: str, at: str, payload: list[str]) -> DataFrame:
    """Give each left row the payload of the last right row with ``right.at <= left.at``.

    Union plus a running ``last``: one shuffle, linear in the input, no range join. All rows of a key meet in
    one task, so this is for keys with few rows, as one per year; ``asof_attach_sliced`` serves others. Of
    several records at one time the largest counts.
    """
    record = F.struct(*[F.col(c) for c in payload])
    records = right.select(by, at, record.alias("_record"), F.lit(0).alias("_is_left"))
    stacked = left.withColumn("_is_left", F.lit(1)).unionByName(records, allowMissingColumns=True)
    running = Window.partitionBy(by).orderBy(at, "_is_left", "_record").rowsBetween(Window.unboundedPreceding, 0)
    attached = stacked.withColumn("_last", F.last("_record", ignorenulls=True).over(running))
    return attached.filter(F.col("_is_left") == 1).select(
        *left.columns, *[F.col(f"_last.{c}").alias(c) for c in payload]
    )


def asof_attach_sliced(
    left: DataFrame, right: DataFrame, by: list[str], at: str, payload: list[str], time_slice: Callable[[Column], Column]
) -> DataFrame:
    """``asof_attach`` for histories of any length, repeated points in time and hot keys.

    Both sides are first reduced to one row per (key, time) with the largest record, which a task does
    before any shuffle. ``time_slice`` must not fall as the time rises; a running ``last`` works inside each
    (key, slice), and the last record of each slice is carried into the slices after it by a window over one
    row per slice. So a key's history lies in as many tasks as it has slices. NULL is a key like any
    other, and a NULL time comes before all others.
    """
    record = F.struct(*[F.col(c) for c in payload])
    points = left.select(*by, at).unionByName(right.select(*by, at, record.alias("_record")), allowMissingColumns=True)
    points = points.groupBy(*by, at).agg(F.max("_record").alias("_record")).withColumn("_slice", time_slice(F.col(at)))
    known = F.when(F.col("_record").isNotNull(), F.struct(at))
    ends = points.groupBy(*by, "_slice").agg(F.max_by("_record", known).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*by, "_slice").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = points.withColumn("_record", F.last("_record", ignorenulls=True).over(inside))
    found = join_null_safe(local, carried, [*by, "_slice"])
    found = found.select(*by, at, F.coalesce("_record", "_carry").alias("_last"))
    attached = join_null_safe(left, found, [*by, at])
    return attached.select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in payload])


def rating_flags(year: Column) -> dict[str, Column]:
    """Defaults and flags of a resolved rating; call after asof_attach."""
    return {
        "rating_missing": F.col("rating_year").isNull(),
        "rating_stale": F.coalesce(F.col("rating_year") < year, F.lit(False)),
        "rating_preliminary": F.coalesce(F.col("rating_status") == P.STATUS_PRELIMINARY, F.lit(False)),
        "rating_status": F.coalesce("rating_status", F.lit(P.NO_RATING)),
        "rating_grade": F.coalesce("rating_grade", F.lit(P.NO_RATING)),
        "rating_factor": F.coalesce("rating_factor", F.lit(P.NO_RATING_FACTOR)),
    }


def rating_records(ratings: DataFrame) -> DataFrame:
    return ratings.select(
        "entity_id",
        "year",
        F.col("year").alias("rating_year"),
        F.col("status").alias("rating_status"),
        F.col("grade").alias("rating_grade"),
        F.col("factor").alias("rating_factor"),
    )


def attach_rating(targets: DataFrame, ratings: DataFrame) -> DataFrame:
    """Targets at (entity, year) with the resolved rating columns."""
    joined = asof_attach(targets, rating_records(ratings), "entity_id", "year", RATING_FIELDS)
    return joined.withColumns(rating_flags(F.col("year")))
