"""Quality-rating, risk-class and reading-label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark import params as P


def grade_from_percent(percent: Column) -> Column:
    ladder = F.when(percent.isNull(), P.NO_RATING)
    for grade, cut in P.RATING_CUTS:
        ladder = ladder.when(percent >= cut, grade)
    return ladder.otherwise(P.RATING_FLOOR)


def grade_from_text(text: Column, percent: Column) -> Column:
    """The letter the text starts with wins over the percentage."""
    letter = F.substring(F.upper(F.trim(F.coalesce(text, F.lit("")))), 1, 1)
    return F.when(letter.isin(list(P.RATING_FACTORS)), letter).otherwise(grade_from_percent(percent))


def grade_factor(grade: Column) -> Column:
    clean = F.upper(F.trim(grade))
    steps = [F.when(clean == letter, F.lit(factor)) for letter, factor in P.RATING_FACTORS.items()]
    return F.coalesce(*steps, F.lit(P.NO_RATING_FACTOR))


def clip_factor(factor: Column) -> Column:
    return F.least(F.greatest(F.coalesce(factor, F.lit(P.NO_RATING_FACTOR)), F.lit(P.NO_RATING_FACTOR)), F.lit(1.0))


def status_rank(status: Column) -> Column:
    return F.when(status == P.STATUS_FINAL, 1).when(status == P.STATUS_PRELIMINARY, 2).otherwise(9)


def class_rank(
    score: Column,
    years: Column,
    chronic: Column,
    cuts: tuple[float, float, float] = P.SCORE_CUTS,
    chronic_cap: int = P.CHRONIC_YEARS_CAP,
) -> Column:
    """0 = safest … 3 = critical, 4 = no data. Caps only ever make the class worse."""
    low, medium, high = cuts
    base = F.when(score >= low, 0).when(score >= medium, 1).when(score >= high, 2).otherwise(3)
    chronic_floor = F.when(chronic >= chronic_cap, 1).otherwise(0)
    coverage_floor = F.when(years <= 2, 2).when(years == 3, 1).otherwise(0)
    no_data = score.isNull() | F.coalesce(years == 0, F.lit(True))
    return F.when(no_data, 4).otherwise(F.greatest(base, chronic_floor, coverage_floor))


def class_label(rank: Column, labels: list[str] = P.RISK_CLASSES, no_data: str = P.NO_DATA_CLASS) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in [*labels, no_data]]), rank.cast("int") + 1)


def class_order(label: Column) -> Column:
    """Sort position of a risk-class label."""
    names = [*P.RISK_CLASSES, P.NO_DATA_CLASS]
    return F.coalesce(*[F.when(label == name, F.lit(i)) for i, name in enumerate(names)])


def grade_risk(grade: Column, risk: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(grade == name, F.lit(value)) for name, value in risk.items()])


def correlation_strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= 0.30, P.STRONG).when(size >= 0.10, P.MODERATE).when(size.isNotNull(), P.WEAK)


def auc_strength(auc: Column) -> Column:
    return (
        F.when(auc >= 0.80, P.STRONG)
        .when(auc >= 0.70, P.MODERATE)
        .when(auc >= 0.60, P.WEAK)
        .when(auc.isNotNull(), P.POOR)
    )


def executive_reading(r: Column, auc: Column) -> Column:
    size = F.abs(r)
    return (
        F.when(r.isNull() & auc.isNull(), P.READ_TOO_SMALL)
        .when(r.isNull(), P.READ_AUC_ONLY)
        .when(auc.isNull(), P.READ_CORRELATION_ONLY)
        .when((size >= 0.30) & (auc >= 0.70), P.READ_CONSISTENT)
        .when((size >= 0.20) & (auc >= 0.65), P.READ_CLEAR)
        .when((size >= 0.10) & (auc >= 0.60), P.READ_LIMITED)
        .otherwise(P.READ_UNSTABLE)
    )
