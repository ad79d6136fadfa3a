"""Report-delivery rules: which statement, regime and period of an entity-year to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.numbers import exact_mean, half_even, parse_decimal_comma, row_mean
from riskspark.functions.ratings import grade_factor, grade_from_percent
from riskspark.functions.text import keyword_kind
from riskspark.operators.ranks import group_median


def deliverable_kinds(items: DataFrame, name: str = "deliverable") -> DataFrame:
    """Budget and fiscal statement kind named by a delivery record, NULL where none is."""
    return items.withColumns(
        {
            "budget_kind": keyword_kind(F.col(name), P.BUDGET_REPORT_KEYWORDS),
            "fiscal_kind": keyword_kind(F.col(name), P.FISCAL_REPORT_KEYWORDS),
        }
    )


def plan_rank(kind: Column, regime: Column, population: Column) -> Column:
    """Position of (kind, regime) in the preference of the entity's size; unlisted plans last."""

    def position(plans: list[tuple[str, str]]) -> Column:
        steps = [F.when((kind == k) & (regime == r), i) for i, (k, r) in enumerate(plans)]
        return F.coalesce(*steps, F.lit(len(plans)))

    small = F.coalesce(population <= P.LARGE_ENTITY_POPULATION, F.lit(False))
    return F.when(small, position(P.FISCAL_PLANS_SMALL)).otherwise(position(P.FISCAL_PLANS_LARGE))


def prefer_plan(lines: DataFrame) -> DataFrame:
    """Per (entity, year): the preferred landed plan and its last period, with its row count.

    Lines shrink to one row per plan and period before the choice.
    """
    landed = lines.groupBy("entity_id", "year", "kind", "regime", "period").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("population").alias("population")
    )
    rank = plan_rank(F.col("kind"), F.col("regime"), F.col("population"))
    choice = F.struct("kind", "regime", "period", "n_lines")
    best = landed.groupBy("entity_id", "year").agg(F.min_by(choice, F.struct(rank, -F.col("period"), "kind", "regime")).alias("_c"))
    return best.select("entity_id", "year", "_c.*")


def preliminary_rating(checks: DataFrame, columns: list[str]) -> DataFrame:
    """Row mean of the check columns (decimal-comma text) -> percent, grade, factor."""
    percent = half_even(row_mean([parse_decimal_comma(F.col(c)) for c in columns]), 6)
    rows = checks.withColumn("percent", percent).withColumn("grade", grade_from_percent(F.col("percent")))
    return rows.withColumns({"factor": grade_factor(F.col("grade")), "status": F.lit(P.STATUS_PRELIMINARY)})


def newest_year(df: DataFrame) -> DataFrame:
    return df.filter(F.col("year") == df.agg(F.max("year")).scalar())


def level_aggs(column: str, digits: int, prefix: str = "") -> list[Column]:
    """Mean, standard deviation, extremes and quartiles (interpolated) of a column.

    The quartiles hold one counter per distinct value; meant for rounded values.
    """
    quartiles = F.percentile(F.col(column), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        half_even(exact_mean(F.col(column), 6), digits).alias(f"{prefix}mean"),
        half_even(F.stddev_samp(column), digits).alias(f"{prefix}std"),
        F.min(column).alias(f"{prefix}min"),
        *[half_even(quartiles[i], digits).alias(f"{prefix}{name}") for i, name in enumerate(("q25", "median", "q75"))],
        F.max(column).alias(f"{prefix}max"),
    ]


def latest_year_profile(ratings: DataFrame) -> DataFrame:
    """Grades of the newest year: rows and levels of the hit percentage, absent grades included."""
    rows = newest_year(ratings).groupBy("year", "grade")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *level_aggs("percent", 4, "percent_"))


def describe(df: DataFrame, column: str, digits: int) -> DataFrame:
    """Count and levels of one column in one row."""
    return df.agg(F.count(column).alias("n_values"), *level_aggs(column, digits))


def extreme_rows(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """n largest and n smallest rows by a column; each side is a distributed top-n."""
    known = df.filter(F.col(column).isNotNull())
    top = known.orderBy(F.desc(column), "entity_id").limit(n).withColumn("side", F.lit("top"))
    bottom = known.orderBy(F.asc(column), "entity_id").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)
