"""Yearly indicators, and the per-entity aggregates built on them.

Each ``*_aggs`` function returns aggregate columns rather than a DataFrame, so a job can put
any of them in the same ``groupBy(entity)`` and pay for one shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.curves import coverage_ratio, liquidity_suspect
from riskspark.functions.dates import delay_decay, delay_window, report_delay_days
from riskspark.functions.numbers import all_null, exact_mean, exact_sum, guarded_ratio, half_away, half_even

GHOST_MEASURES = [
    "revenue_planned",
    "revenue_realized",
    "expense_settled",
    "unprocessed_arrears",
    "processed_arrears",
    "cash_after_total",
    "cash_before_total",
]


def year_window(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.filter(F.col("year").between(start, end))


def delivered() -> Column:
    return F.col("revenue_planned").isNotNull()


def net_cash() -> Column:
    """Cash after arrears, else before arrears, net of the pension fund."""
    after = F.col("cash_after_total") - F.coalesce("cash_after_pension", F.lit(0.0))
    before = F.col("cash_before_total") - F.coalesce("cash_before_pension", F.lit(0.0))
    return F.coalesce(after, before)


def has_revenue() -> Column:
    return F.coalesce(F.col("revenue_realized") > 0, F.lit(False))


def is_partial() -> Column:
    """True where only the figure before arrears exists."""
    return has_revenue() & F.col("cash_after_total").isNull() & F.col("cash_before_total").isNotNull()


def annual_indicators(base: DataFrame) -> DataFrame:
    """Rounded yearly indicators of grid rows that carry any data at all."""
    revenue = F.col("revenue_realized")

    def percent_of_revenue(top: Column) -> Column:
        return half_away(guarded_ratio(top, revenue, 100.0), 2)

    rows = base.filter("in_grid").filter(~all_null(GHOST_MEASURES))
    return rows.withColumns(
        {
            "delivered": delivered(),
            "budget_exec": half_away(guarded_ratio(revenue, F.col("revenue_planned"), 100.0), 2),
            "unprocessed_pct": percent_of_revenue(F.col("unprocessed_arrears")),
            "arrears_pct": percent_of_revenue(F.col("processed_arrears")),
            "deficit_pct": percent_of_revenue(F.col("expense_settled") - revenue),
            "liquidity": half_away(F.when(has_revenue(), net_cash() / revenue), 6),
            "liquidity_gross": half_away(F.when(has_revenue(), net_cash()), 2),
            "liquidity_partial": is_partial(),
        }
    )


def drop_ghost_rows(df: DataFrame, measures: list[str]) -> DataFrame:
    return df.dropna(how="all", subset=measures)


def coverage_aggs(in_window: Column) -> list[Column]:
    return [F.count_if(in_window & delivered()).alias("years_delivered")]


def arrears_ratio() -> Column:
    return guarded_ratio(F.col("processed_arrears"), F.col("revenue_realized"), 100.0)


def chronic_aggs(in_window: Column) -> list[Column]:
    """Years above the arrears threshold, the newest ratio and the ordered history.

    The history holds at most one entry per fiscal year.
    """
    ratio = arrears_ratio()
    valid = in_window & delivered() & ratio.isNotNull()
    entry = F.struct(
        F.col("year").cast("bigint").alias("year"),
        half_away(ratio, 2).alias("arrears_pct"),
        half_away(F.col("processed_arrears"), 2).alias("processed_arrears"),
        half_away(F.col("revenue_realized"), 2).alias("revenue_realized"),
        (ratio > P.CHRONIC_ARREARS_PCT).alias("chronic"),
    )
    return [
        F.count_if(valid & (ratio > P.CHRONIC_ARREARS_PCT)).alias("chronic_years"),
        half_away(F.max_by(ratio, F.when(valid, F.col("year"))), 2).alias("arrears_pct_latest"),
        F.sort_array(F.collect_list(F.when(valid, entry))).alias("arrears_history"),
    ]


def recency_weight(year: Column, last_closed_year: int, first_year: int) -> Column:
    steps = [
        F.when(year == last_closed_year - back, F.lit(weight))
        for back, weight in enumerate(P.RECENCY_WEIGHTS)
        if last_closed_year - back >= first_year
    ]
    return F.coalesce(*steps)


def weighted_recency_aggs(
    measure: Column,
    weight: Column,
    name: str,
    digits: int = 6,
    skip_null_weights: bool = False,
    with_rating: bool = True,
) -> list[Column]:
    """Recency-weighted mean over the closed years present, with rating and any-flags.

    By default a present year with a NULL measure keeps its weight in the denominator, as the
    warehouse post-processing does; ``skip_null_weights`` leaves such years out.
    """
    used = F.when(measure.isNotNull(), weight) if skip_null_weights else weight
    total = exact_sum(used, 10)
    mean = F.coalesce(exact_sum(used * measure, 10), F.lit(0.0)) / F.when(total > 0, total)
    aggs = [half_even(mean, digits).alias(name)]
    if with_rating:
        factor = exact_sum(used * F.col("rating_factor"), 10) / F.when(total > 0, total)
        aggs.append(half_even(factor, 6).alias("budget_factor"))
        aggs += any_flags("budget", weight.isNotNull())
    return aggs


def any_flags(prefix: str, used: Column) -> list[Column]:
    return [
        F.bool_or(F.when(used, F.col(f"rating_{flag}"))).alias(f"{prefix}_{flag}")
        for flag in ("preliminary", "stale", "missing")
    ]


def arrears_used() -> Column:
    """Grid years with a valid arrears ratio."""
    return F.col("in_grid") & delivered() & F.col("arrears_pct").isNotNull()


def arrears_rating_aggs() -> list[Column]:
    """Mean rating over the grid years with a valid arrears ratio."""
    used = arrears_used()
    mean = exact_mean(F.when(used, F.col("rating_factor")), 10)
    return [mean.alias("arrears_factor"), *any_flags("arrears", used)]


def record_recency() -> Column:
    """Order of fiscal records: year, then period, then regime Q before others."""
    is_q = F.coalesce(F.col("fiscal_regime") == "Q", F.lit(False))
    return F.struct("year", F.coalesce("fiscal_period", F.lit(0)), is_q)


def liquidity_pick_aggs(as_of: date, in_window: Column) -> list[Column]:
    """The newest whole record that yields a liquidity ratio, as one struct (NULL if none).

    Newest year, then newest period, then regime Q.
    """
    ratio = half_even(F.when(has_revenue(), net_cash() / F.col("revenue_realized")), 6)
    valid = in_window & ratio.isNotNull()
    record = F.struct(
        F.col("year").cast("bigint").alias("liquidity_year"),
        ratio.alias("liquidity"),
        is_partial().alias("liquidity_partial"),
        report_delay_days(F.col("year"), F.col("fiscal_period"), F.col("fiscal_regime"), as_of).alias("delay_days"),
        liquidity_suspect(ratio).alias("liquidity_suspect"),
        *[F.col(c) for c in RATING_COLUMNS],
    )
    return [F.max_by(record, F.when(valid, record_recency())).alias("_pick")]


RATING_COLUMNS = [
    "rating_year",
    "rating_status",
    "rating_grade",
    "rating_factor",
    "rating_preliminary",
    "rating_stale",
    "rating_missing",
]


def expand_liquidity_pick(df: DataFrame) -> DataFrame:
    """Columns of the picked record plus decay and staleness; defaults where nothing was picked.

    Needs ``population`` (an entity without one is judged by the small-entity window) and
    ``_has_fiscal``: only an entity that has fiscal records can have an unrated one.
    """
    population = F.coalesce(F.col("population"), F.lit(0))
    pick = F.col("_pick")
    days = pick["delay_days"]
    return df.withColumns(
        {
            "liquidity_year": pick["liquidity_year"],
            "liquidity": pick["liquidity"],
            "liquidity_partial": F.coalesce(pick["liquidity_partial"], F.lit(False)),
            "liquidity_suspect": F.coalesce(pick["liquidity_suspect"], F.lit(False)),
            "delay_days": days,
            "decay": F.when(days.isNotNull(), delay_decay(days, population)),
            "liquidity_stale": F.coalesce(days > delay_window(population), F.lit(False)),
            "liquidity_rating_year": pick["rating_year"].cast("bigint"),
            "liquidity_rating_status": F.coalesce(pick["rating_status"], F.lit(P.NO_RATING)),
            "liquidity_rating_grade": F.coalesce(pick["rating_grade"], F.lit(P.NO_RATING)),
            "liquidity_factor": F.coalesce(pick["rating_factor"], F.lit(P.NO_RATING_FACTOR)),
            "liquidity_rating_preliminary": F.coalesce(pick["rating_preliminary"], F.lit(False)),
            "liquidity_rating_stale": F.coalesce(pick["rating_stale"], F.lit(False)),
            "liquidity_rating_missing": F.when(
                F.col("_has_fiscal"), F.coalesce(pick["rating_missing"], F.lit(True))
            ),
        }
    ).drop("_pick", "_has_fiscal")


def autonomy_base(accounts: DataFrame, as_of: date) -> DataFrame:
    """Tax share of current revenue over the last five uniformly released years."""
    newest = F.least(F.coalesce(F.max("year"), F.lit(as_of.year - 2)), F.lit(as_of.year - 2))
    limit = accounts.agg(newest.cast("int")).first()[0]  # one year; as a literal it reaches the scan's filters
    rows = accounts.filter(F.col("year").between(limit - 4, limit))
    ratio = half_away(guarded_ratio(F.col("tax_revenue"), F.col("current_revenue")), 6)
    return rows.select("entity_id", "year", "population", "tax_revenue", "current_revenue", ratio.alias("autonomy"))


def autonomy_aggs() -> list[Column]:
    """Plain means; flags are true when any year has them. Needs resolved rating columns."""
    return [
        exact_mean(F.col("autonomy"), 10).alias("autonomy_mean"),
        half_even(exact_mean(F.col("rating_factor"), 10), 6).alias("autonomy_factor"),
        *any_flags("autonomy", F.lit(True)),
    ]


def fallback_ratios(accounts: DataFrame, other_revenue: DataFrame) -> DataFrame:
    """Cash and autonomy ratios with a second source's mean as fallback denominator.

    ``accounts`` is per (entity, year); ``other_revenue`` per (entity, year) with
    ``revenue_realized``.
    """
    fallback = other_revenue.groupBy("entity_id").agg(exact_mean(F.col("revenue_realized")).alias("fallback_revenue"))
    joined = accounts.join(fallback, "entity_id", "left")
    base = F.coalesce("current_revenue", "fallback_revenue")
    cash = F.when(base > 0, (F.col("financial_assets") - F.col("financial_liabilities")) / base)
    tax = F.when(base > 0, F.col("tax_revenue") / base)
    return (
        joined.withColumns({"cash_ratio": cash, "autonomy": tax})
        .groupBy("entity_id")
        .agg(
            exact_mean(F.col("cash_ratio"), 10).alias("cash_ratio_mean"),
            exact_mean(F.col("autonomy"), 10).alias("autonomy_mean"),
            F.count_if("balance_available").alias("balance_years"),
            F.count_if("revenue_available").alias("revenue_years"),
        )
    )


def spine_counts(spine: DataFrame, base: DataFrame, start: int, end: int) -> DataFrame:
    """Delivered years per spine entity, 0 where there is nothing, with the coverage ratio."""
    rows = year_window(base.filter("has_budget"), start, end)
    counts = rows.groupBy("entity_id").agg(*coverage_aggs(F.lit(True)))
    joined = spine.join(counts, "entity_id", "left").fillna(0, ["years_delivered"])
    return joined.withColumn("coverage", coverage_ratio(F.col("years_delivered"), end - start + 1))
