"""Data-quality checks. Each is one aggregation pass; the result lists violations per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.text import blank_or_null


def count_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, violations): how many rows break each condition."""
    names = list(checks)
    wide = df.agg(*[F.count_if(F.coalesce(checks[n], F.lit(False))).alias(n) for n in names])
    return wide.unpivot([], names, "check_name", "violations")


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return count_violations(df, {f"not_null_{c}": F.col(c).isNull() for c in columns})


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def accepted_values(df: DataFrame, column: str, accepted: list) -> DataFrame:
    """Values outside the accepted list, with their row count."""
    foreign = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(accepted))
    return foreign.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


def key_conditions(keys: list[str], state: str | None = None) -> dict[str, Column]:
    checks = {f"blank_{k}": blank_or_null(F.col(k).cast("string")) for k in keys}
    if state is not None:
        checks["foreign_state"] = F.upper("state") != state.upper()
    return checks


def key_checks(df: DataFrame, keys: list[str], state: str | None = None) -> DataFrame:
    """Blank keys, and rows of another state where one is expected."""
    return count_violations(df, key_conditions(keys, state))


class Watch:
    """Checks counted while rows are written, so that they cost no pass of their own.

    ``rows`` is the frame to write (or to derive the written rows from); after the write,
    ``raise_on_violations`` reports what was seen.
    """

    ROWS = "rows_seen"

    def __init__(self, df: DataFrame, checks: dict[str, Column]):
        self.checks = list(checks)
        self._seen = Observation()
        counts = [F.count_if(F.coalesce(checks[n], F.lit(False))).alias(n) for n in self.checks]
        self.rows = df.observe(self._seen, F.count(F.lit(1)).alias(self.ROWS), *counts)

    def counts(self, written: DataFrame) -> dict[str, int]:
        """What was counted. Spark drops the counters of a plan that it finds to be empty."""
        try:
            found = self._seen.get
        except Exception:
            if not written.isEmpty():
                raise
            found = {}
        return {name: found.get(name) or 0 for name in (self.ROWS, *self.checks)}

    def raise_on_violations(self, written: DataFrame) -> int:
        """Stop with the failing checks; else the number of rows seen. ``written`` is the result read back."""
        counts = self.counts(written)
        bad = [f"{name}={counts[name]}" for name in self.checks if counts[name]]
        if bad:
            raise ValueError("; ".join(bad))
        return counts[self.ROWS]


def grid_checks(lines: DataFrame) -> DataFrame:
    """Lines with data that put no year into the entity grid: their state is unknown or their year is out of range."""
    with_data = F.col("account_code").isNotNull() & F.col("value").isNotNull()
    known = F.coalesce(F.col("state").isin(list(P.STATE_REGION)), F.lit(False))
    sane = F.coalesce(F.col("year").between(*P.GRID_YEARS), F.lit(False))
    return count_violations(lines, {"unknown_state": with_data & ~known, "year_out_of_range": with_data & ~sane})


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def snapshot_conditions(classes: list[str]) -> dict[str, Column]:
    return {
        "null_entity": F.col("entity_id").isNull(),
        "unknown_class": F.col("risk_class").isNotNull() & ~F.col("risk_class").isin(classes),
        "score_out_of_range": ~F.col("score").between(0, 100),
        "bad_state": F.coalesce(F.length(F.trim("state")) != 2, F.lit(True)),
    }


def repeated_entities(df: DataFrame) -> DataFrame:
    return unique(df.filter("entity_id IS NOT NULL"), ["entity_id"]).agg(
        F.lit("duplicate_entity").alias("check_name"), F.count(F.lit(1)).alias("violations")
    )


def snapshot_checks(df: DataFrame, classes: list[str]) -> DataFrame:
    """Everything a snapshot must satisfy before it is published."""
    rows = count_violations(df, snapshot_conditions(classes))
    repeated = repeated_entities(df)
    empty = df.limit(1).agg(
        F.lit("empty_snapshot").alias("check_name"), (1 - F.count(F.lit(1))).alias("violations")
    )
    return reduce(DataFrame.unionByName, [rows, repeated, empty])


def dimension_batch(df: DataFrame, state: str, level: str = "M") -> DataFrame:
    """Checks of an entity-dimension batch for one state: kept rows, foreign state, blank code."""
    wanted = df.filter(F.col("level") == level)
    return count_violations(
        wanted,
        {
            "rows_of_state": F.upper(F.trim("state")) == state,
            "foreign_state": F.upper(F.trim("state")) != state,
            "blank_code": blank_or_null(F.col("entity_code")),
        },
    )


def raise_on_violations(report: DataFrame) -> None:
    """Stop a job with the failing checks (a report has a handful of rows)."""
    bad = report.filter(F.col("violations") > 0).collect()
    if bad:
        raise ValueError("; ".join(f"{r.check_name}={r.violations}" for r in bad))
