"""Wide yearly base: every measure of an entity-year in one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.operators import accounts as ACC
from riskspark.operators.asof import RATING_FIELDS, rating_flags, rating_records
from riskspark.plans import staging
from riskspark.session import written

KEY = ["entity_id", "year"]
PRESENCE = ["in_grid", "has_budget", "has_fiscal"]
ATTRIBUTES = ["entity_id", "state", "name", "population"]


def entity_year_union(dim: DataFrame, budget_lines: DataFrame, fiscal_lines: DataFrame) -> DataFrame:
    """Key set of the base with provenance flags and entity attributes."""
    return base_annual(dim, budget_lines, fiscal_lines).select(
        *KEY, *PRESENCE, "state", "name", "population"
    )


def _merged(
    dim: DataFrame, budget_lines: DataFrame, fiscal_lines: DataFrame, ratings: DataFrame | None, repeated: bool = False
) -> DataFrame:
    """Grid, budget, fiscal and rating rows as one row per (entity, year), laid out by entity.

    The line tables are read once and reduced before any shuffle. Everything after that is one union, dealt
    by entity, so that windows, aggregates and joins by entity need no further shuffle. ``repeated``: the lines are
    typed but not staged.
    """
    if repeated:
        periods = staging.staged_budget_periods(budget_lines)
        records = staging.staged_fiscal_records(fiscal_lines)
    else:
        periods = written(ACC.budget_periods(budget_lines), "budget-periods")
        records = ACC.fiscal_records(fiscal_lines)
    parts = [
        ACC.grid_of_periods(dim, periods).withColumn("in_grid", F.lit(True)),
        periods.filter("period IS NOT NULL").drop("_states").withColumn("has_budget", F.lit(True)),
        records.withColumn("has_fiscal", F.lit(True)),
    ]
    if ratings is not None:
        record = F.struct(*RATING_FIELDS)
        parts.append(rating_records(ratings).select(*KEY, record.alias("_rating")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rating = [F.max("_rating").alias("_rating")] if ratings is not None else []
    merged = stacked.repartition("entity_id").groupBy(*KEY).agg(
        *[F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag) for flag in PRESENCE],
        *ACC.budget_measures(),
        F.max_by("_record", "_choice").alias("_r"),
        *rating,
    )
    kept = [*KEY, *PRESENCE, "budget_period", *P.BUDGET_RULES]
    fiscal = [c.alias(n) for n, c in ACC.fiscal_columns(F.col("_r")).items()]
    return merged.select(*kept, *fiscal, *(["_rating"] if rating else []))


def base_annual(dim: DataFrame, budget_lines: DataFrame, fiscal_lines: DataFrame) -> DataFrame:
    """Grid, budget and fiscal measures merged on (entity, year)."""
    merged = _merged(dim, budget_lines, fiscal_lines, None)
    return merged.join(dim.select(*ATTRIBUTES), "entity_id", "left")


def rated_annual(
    dim: DataFrame, budget_lines: DataFrame, fiscal_lines: DataFrame, ratings: DataFrame, repeated: bool = False
) -> DataFrame:
    """The yearly base with the newest rating up to each year.

    A row per (entity, year) is certain here, so the window of an entity has one row per year.
    """
    merged = _merged(dim, budget_lines, fiscal_lines, ratings, repeated)
    so_far = Window.partitionBy("entity_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    rated = merged.withColumn("_rating", F.last("_rating", ignorenulls=True).over(so_far))
    rated = rated.filter(" OR ".join(PRESENCE))
    rated = rated.withColumns({name: F.col("_rating")[name] for name in RATING_FIELDS}).drop("_rating")
    rated = rated.withColumns(rating_flags(F.col("year")))
    return rated.join(dim.select(*ATTRIBUTES), "entity_id", "left")
