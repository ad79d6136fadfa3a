"""Date column expressions. The reference date is always a parameter, never the clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.numbers import half_even


def parse_date_multi(text: Column) -> Column:
    """ISO, then day/month/year, from the first ten characters."""
    head = F.substring(text, 1, 10)
    return F.coalesce(F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(head, "dd/MM/yyyy"))


def months_back(as_of: date | Column, months: int) -> Column:
    base = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.add_months(base, -months)


def report_delay_days(year: Column, period: Column, regime: Column, as_of: date) -> Column:
    """Days since a report was due: first day of the second month after its period ends."""
    end_month = F.coalesce(
        *[
            F.when((regime == code) & (period == number), F.lit(month))
            for (code, number), month in P.PERIOD_END_MONTH.items()
        ]
    )
    due = F.add_months(F.make_date(year.cast("int"), end_month, F.lit(1)), 2)
    days = F.greatest(F.datediff(F.lit(as_of), due), F.lit(0))  # greatest skips NULL, hence the test
    return F.when(due.isNotNull(), days).otherwise(P.UNKNOWN_DELAY_DAYS).cast("bigint")


def delay_window(population: Column) -> Column:
    """Tolerated delay in days; an entity of unknown population counts as small."""
    return F.when(population > P.LARGE_ENTITY_POPULATION, P.DELAY_WINDOW_LARGE).otherwise(P.DELAY_WINDOW_SMALL)


def delay_decay(days: Column, population: Column) -> Column:
    """1 inside the tolerated window, then linear to 0 over a year."""
    late = (days - delay_window(population)).cast("double")
    fading = half_even(F.greatest(1.0 - late / 365.0, F.lit(0.0)), 4)
    return F.when(late <= 0, F.lit(1.0)).when(late > 0, fading)


def month_spine(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per calendar month touched by [start, end], clipped at both ends."""
    first_days = F.sequence(F.trunc(F.col(start), "month"), F.col(end), F.expr("interval 1 month"))
    spine = df.filter(F.col(start) <= F.col(end)).withColumn("month_first", F.explode(first_days))
    return spine.select(
        *df.columns,
        F.greatest(F.col("month_first"), F.col(start)).alias("month_start"),
        F.least(F.last_day("month_first"), F.col(end)).alias("month_end"),
    )
