"""Scoring curves: indicator value -> points in [0, 1], all plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.numbers import half_even


def liquidity_curve(x: Column) -> Column:
    """Three linear stretches: -0.5 -> 0, 0 -> 0.35, 0.10 -> 0.60, 0.35 and above -> 1."""
    capped = F.greatest(x, F.lit(P.SUSPECT_LIQUIDITY))
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(capped >= 0.35, F.lit(1.0))
        .when(capped >= 0.10, half_even(0.60 + (capped - 0.10) / 0.25 * 0.40, 4))
        .when(capped >= 0.0, half_even(0.35 + capped / 0.10 * 0.25, 4))
        .otherwise(half_even((capped + 0.50) / 0.50 * 0.35, 4))
    )


def liquidity_suspect(x: Column) -> Column:
    return F.coalesce(x < P.SUSPECT_LIQUIDITY, F.lit(False))


def budget_curve(x: Column, digits: int | None = 4) -> Column:
    """Best between 90 and 105 percent; falls on both sides; 0.5 beyond 120."""
    above, below = 1.0 - (x - 105.0) / 30.0, (x - 70.0) / 20.0
    if digits is not None:
        above, below = half_even(above, digits), half_even(below, digits)
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(x > 120.0, F.lit(0.5))
        .when(x > 105.0, above)
        .when(x >= 90.0, F.lit(1.0))
        .when(x >= 70.0, below)
        .otherwise(F.lit(0.0))
    )


def arrears_curve(chronic_years: Column) -> Column:
    steps = [F.when(chronic_years == n, F.lit(points)) for n, points in enumerate(P.ARREARS_CURVE)]
    return F.when(chronic_years.isNotNull(), F.coalesce(*steps, F.lit(0.0)))


def size_tier(population: Column) -> Column:
    ladder = F
    for tier, below in P.SIZE_TIERS:
        ladder = ladder.when(population < below, tier) if below else ladder.otherwise(tier)
    return F.when(population.isNotNull(), ladder)


def sigmoid_parameter(kind: str, population: Column) -> Column:
    """Pick the ``mu_<tier>`` or ``k_<tier>`` column of the joined state parameters."""
    tier = size_tier(population)
    return F.coalesce(*[F.when(tier == name, F.col(f"{kind}_{name}")) for name, _ in P.SIZE_TIERS])


def autonomy_sigmoid(x: Column, population: Column) -> Column:
    """Logistic in x; needs the state-parameter columns (see operators.params_join)."""
    mu, k = sigmoid_parameter("mu", population), sigmoid_parameter("k", population)
    return F.when(x.isNotNull() & population.isNotNull(), half_even(1.0 / (1.0 + F.exp(-k * (x - mu))), 4))


def coverage_ratio(years: Column, window: int | Column) -> Column:
    size = window.cast("double") if isinstance(window, Column) else F.lit(float(window))
    return F.when(years.isNotNull(), F.least(years / size, F.lit(1.0)))
