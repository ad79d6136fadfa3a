"""Benchmark of a rival official credit grade on the same outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.numbers import half_even
from riskspark.functions.ratings import grade_risk
from riskspark.operators.ranks import auc

GRADE_MAPS = {
    "graded": P.GRADE_RISK,
    "with_d": P.GRADE_RISK_WITH_D,
    "ungraded_high": P.GRADE_RISK_UNGRADED_HIGH,
}


def grade_pairs(grades: DataFrame, annual: DataFrame) -> DataFrame:
    """Grades of year T0 joined to the arrears outcome of T0 + 1; both sides unique per key."""
    outcomes = annual.select(
        "entity_id", (F.col("year") - 1).alias("year"), F.col("year").alias("year_t1"),
        F.col("arrears_pct").alias("outcome"),
    )
    joined = grades.join(outcomes, ["entity_id", "year"])
    return joined.withColumn("event", F.col("outcome") > P.CHRONIC_ARREARS_PCT)


def sheet_counts(grades: DataFrame) -> DataFrame:
    """Rows taken from each source sheet per year."""
    return grades.groupBy("year", "sheet").agg(F.count(F.lit(1)).alias("n_rows"))


def valid_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("outcome").isNotNull() & F.col("grade").isin(list(P.GRADE_RISK)))


def auc_by_grade_map(pairs: DataFrame, maps: dict[str, dict[str, int]] = GRADE_MAPS) -> DataFrame:
    """AUC of the grade as risk score under each treatment of weak and missing grades.

    One aggregation to (grade, event) counts serves all maps.
    """
    counts = pairs.filter(F.col("outcome").isNotNull()).groupBy("grade", "event").agg(F.count(F.lit(1)).alias("n"))
    options = [F.struct(F.lit(name).alias("grade_map"), grade_risk(F.col("grade"), m).alias("risk")) for name, m in maps.items()]
    rows = counts.select("event", "n", F.inline(F.array(*options))).filter(F.col("risk").isNotNull())
    table = auc(rows, ["grade_map"], "risk", F.col("event"), low_is_risky=False)
    share = half_even(F.col("n_positives") * 100.0 / F.col("n_pairs"), 1)
    return table.withColumn("event_pct", share)


def grade_benchmark(pairs: DataFrame) -> DataFrame:
    """Event rates by state, year and grade plus the ungraded rest, as one long report.

    The pairs are read once, into counts per (state, year, grade); each count then goes to its sections.
    """
    rated = pairs.filter(F.col("outcome").isNotNull() & F.col("grade").isNotNull())
    counts = rated.groupBy("state", "year", "grade").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("event").alias("e")
    )
    graded = F.col("grade").isin(list(P.GRADE_RISK))

    def section(name: str, key: str) -> Column:
        return F.struct(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"))

    sections = F.when(graded, F.array(*[section(k, k) for k in ("state", "year", "grade")])).otherwise(
        F.array(section("ungraded", "grade"))
    )
    totals = counts.select("n", "e", F.inline(sections)).groupBy("section", "key")
    report = totals.agg(F.sum("n").alias("n_pairs"), F.sum("e").alias("events"))
    return report.withColumn("event_pct", half_even(F.col("events") * 100.0 / F.col("n_pairs"), 1))
