"""Numeric column expressions: rounding, guarded ratios, locale-aware parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark import params as P


def half_even(x: Column, digits: int) -> Column:
    """Round on the binary value, ties to even; never yields negative zero."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def half_away(x: Column, digits: int) -> Column:
    """Round ties away from zero, as SQL ROUND does; never yields negative zero."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)


def exact_sum(x: Column, scale: int = 6) -> Column:
    """Sum in decimal, so the result does not depend on how rows are partitioned."""
    return F.sum(x.cast(f"decimal(38,{scale})")).cast("double")


def exact_mean(x: Column, scale: int = 6) -> Column:
    return F.try_divide(exact_sum(x, scale), F.count(x).cast("double"))


def guarded_ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    """NULL unless both sides are present and the denominator is positive."""
    return F.when(bottom > 0, top / bottom * F.lit(float(scale)))


def all_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])


def cast_via_float(text: Column) -> Column:
    """'6.0' -> 6 and '6.7' -> 7, ties away from zero. Text that is no number becomes NULL."""
    return half_away(text.try_cast("double"), 0).try_cast("bigint")


def parse_int(text: Column) -> Column:
    """Whole number from text; anything else NULL."""
    return text.try_cast("double").try_cast("bigint")


def parse_decimal9(text: Column) -> Column:
    """Decimal with point or comma, 9 digits kept with ties away from zero.

    Blank is NULL. Any other unparsable text raises: a money field must not vanish silently.
    """
    clean = F.trim(text)
    return F.when(clean != "", F.round(F.regexp_replace(clean, ",", ".").cast("decimal(38,18)"), 9)).cast(
        "decimal(38,9)"
    )


def parse_decimal_comma(text: Column) -> Column:
    """'1.234,5' -> 1234.5 and '0.5' -> 0.5; placeholders for "no number" are NULL."""
    clean = F.trim(text)
    point = F.when(clean.contains(","), F.replace(F.replace(clean, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    return F.when(~clean.isin(P.NO_NUMBER_TOKENS), F.coalesce(point, clean).try_cast("double"))


def percent_to_unit(x: Column) -> Column:
    """Percentages above 1.5 are on the 0-100 scale."""
    return F.when(x > 1.5, x / 100.0).otherwise(x)


def parse_bool(text: Column) -> Column:
    """Boolean from text in several languages; other non-empty text counts as true."""
    token = F.lower(F.trim(text))
    return (
        F.when(text.isNull(), F.lit(None).cast("boolean"))
        .when(token.isin(P.TRUE_TOKENS), True)
        .when(token.isin(P.FALSE_TOKENS), False)
        .otherwise(F.length(text) > 0)
    )


def row_mean(columns: list[Column]) -> Column:
    """Mean of the non-null values of one row."""
    present = F.filter(F.array(*columns), lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(present) > 0, total / F.size(present))
