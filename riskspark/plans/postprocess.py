"""Per-entity indicator tables built from the yearly base in a single aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.numbers import guarded_ratio, half_away
from riskspark.operators import annual as A
from riskspark.operators.asof import attach_rating
from riskspark.operators.lookup import state_params
from riskspark.plans.base import rated_annual
from riskspark.session import written


@dataclass(frozen=True)
class Window:
    """Reference date and first fiscal year of a run; the last year is the reference year."""

    as_of: date
    start_year: int

    @property
    def end_year(self) -> int:
        return self.as_of.year

    @property
    def n_years(self) -> int:
        return self.end_year - self.start_year + 1

    @property
    def last_closed_year(self) -> int:
        return self.as_of.year - 1


def with_ratios(rated: DataFrame) -> DataFrame:
    """The two raw ratios the aggregates need."""
    exec_pct = guarded_ratio(F.col("revenue_realized"), F.col("revenue_planned"), 100.0)
    return rated.withColumns({"budget_exec": half_away(exec_pct, 6), "arrears_pct": half_away(A.arrears_ratio(), 2)})


def rated_base(base: DataFrame, ratings: DataFrame) -> DataFrame:
    """Yearly base with resolved ratings and the two raw ratios the aggregates need."""
    return with_ratios(attach_rating(base, ratings))


def entity_profile(rated: DataFrame, window: Window) -> DataFrame:
    """Coverage, chronic years, recency mean, rating means and liquidity pick: one shuffle.

    ``rated`` is laid out by entity_id, so this groupBy reuses its partitioning.
    """
    in_years = F.col("year").between(window.start_year, window.end_year)
    with_budget = F.col("has_budget") & in_years
    with_fiscal = F.col("has_fiscal") & in_years
    weight = F.when(
        with_budget & A.delivered(), A.recency_weight(F.col("year"), window.last_closed_year, window.start_year)
    )
    grouped = rated.groupBy("entity_id").agg(
        F.max("state").alias("_state"),
        F.max("population").alias("population"),
        *A.coverage_aggs(with_budget),
        *A.chronic_aggs(with_budget),
        *A.weighted_recency_aggs(F.col("budget_exec"), weight, "budget_exec"),
        *A.arrears_rating_aggs(),
        *A.liquidity_pick_aggs(window.as_of, with_fiscal),
        F.bool_or(with_fiscal).alias("_has_fiscal"),
        F.bool_or("in_grid").alias("_in_grid"),
        F.bool_or(A.arrears_used()).alias("_valid"),
        F.bool_or(weight.isNotNull() | with_fiscal).alias("processed"),
    )
    rows = default_arrears(grouped)
    rows = rows.withColumn("processed", F.col("processed") | F.col("arrears_factor").isNotNull())
    return A.expand_liquidity_pick(rows)


MAX_STATES = 1000


def default_arrears(grouped: DataFrame) -> DataFrame:
    """Default ratings for all grid entities of a state in which none has a valid arrears year.

    Works on one row per entity, written once; which states those are is one small aggregate, and no more than
    ``MAX_STATES`` names reach the driver. Needs _state, _in_grid and _valid, which leave.
    """
    marked = written(grouped, "entity-profile")
    by_state = marked.groupBy("_state").agg(F.bool_or("_valid").alias("_any"))
    bare = [r[0] for r in by_state.filter(~F.coalesce("_any", F.lit(False))).limit(MAX_STATES + 1).collect()]
    if len(bare) > MAX_STATES:
        raise ValueError(f"more than {MAX_STATES} states without a valid arrears year")
    named = F.col("_state").isin([s for s in bare if s is not None])
    unrated = F.col("_in_grid") & (F.coalesce(named, F.lit(False)) | (F.col("_state").isNull() & F.lit(None in bare)))
    defaults = {
        "arrears_factor": P.NO_RATING_FACTOR,
        "arrears_preliminary": False,
        "arrears_stale": False,
        "arrears_missing": True,
    }
    filled = {c: F.when(unrated, F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()}
    return marked.withColumns(filled).drop("_state", "_in_grid", "_valid")


def autonomy_means(accounts: DataFrame, ratings: DataFrame, as_of: date) -> DataFrame:
    """Mean autonomy and rating per entity."""
    rated = attach_rating(A.autonomy_base(accounts, as_of), ratings)
    return rated.groupBy("entity_id").agg(*A.autonomy_aggs())


def critical_autonomy(rows: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Add the regional critical flag; needs ``state`` and ``autonomy_mean``."""
    limits = state_params(rows.sparkSession, overrides).select("state", "critical_autonomy")
    limited = rows.join(F.broadcast(limits), "state", "left")
    critical = F.coalesce(F.col("autonomy_mean") < F.col("critical_autonomy"), F.lit(False))
    return limited.withColumn("autonomy_critical", critical).drop("critical_autonomy")


def autonomy_profile(
    accounts: DataFrame, ratings: DataFrame, dim: DataFrame, as_of: date, overrides: dict | None = None
) -> DataFrame:
    """Mean autonomy and rating per entity, with the regional critical flag."""
    means = autonomy_means(accounts, ratings, as_of)
    of_state = critical_autonomy(means.join(dim.select("entity_id", "state"), "entity_id"), overrides)
    return of_state.select(*means.columns, "autonomy_critical")


def postprocess(
    dim: DataFrame, budget_lines: DataFrame, fiscal_lines: DataFrame, ratings: DataFrame, window: Window
) -> DataFrame:
    """The post-processed table: entities that have any of the three indicator groups."""
    rated = with_ratios(rated_annual(dim, budget_lines, fiscal_lines, ratings))
    profile = entity_profile(rated, window)
    return profile.filter("processed").drop("processed", "population")


def arrears_rating(rated: DataFrame) -> DataFrame:
    """Mean rating over grid years with a valid arrears ratio, per entity.

    Entities without such a year are absent, unless their whole state has none: then all its grid
    entities get the defaults.
    """
    means = rated.groupBy("entity_id").agg(
        *A.arrears_rating_aggs(),
        F.max("state").alias("_state"),
        F.bool_or("in_grid").alias("_in_grid"),
        F.bool_or(A.arrears_used()).alias("_valid"),
    )
    return default_arrears(means).filter(F.col("arrears_factor").isNotNull())
