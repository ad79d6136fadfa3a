"""Walk-forward back-test: score with what was known in T0, outcome one year later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions import curves as C
from riskspark.functions.numbers import half_even
from riskspark.functions.ratings import class_label, class_rank
from riskspark.operators.lookup import with_state_params

ERA_COMPLETE, ERA_PARTIAL = "completa", "parcial"
RATED = {"liquidity", "budget_exec", "autonomy", "arrears"}


def by_entity() -> Window:
    """Years of one entity in order. Rows are unique per (entity, year), so a key stays small."""
    return Window.partitionBy("entity_id").orderBy("year")


def next_year(column: str) -> Column:
    """Value of the directly following year, NULL if that year is absent."""
    following = F.lead("year").over(by_entity()) == F.col("year") + 1
    return F.when(following, F.lead(column).over(by_entity()))


def walk_forward_pairs(annual: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of T0 that have a T1 row, with ``next_<column>`` values of T1. No self join."""
    followed = F.lead("year").over(by_entity()) == F.col("year") + 1
    ahead = {f"next_{c}": F.lead(c).over(by_entity()) for c in columns}
    return annual.withColumns({"_followed": followed, **ahead}).filter("_followed").drop("_followed")


def history_to_date(annual: DataFrame, first_year: int) -> DataFrame:
    """Running counts per entity-year, all from one window sort.

    ``years_delivered``: delivered years from ``first_year`` up to the row's year.
    ``chronic_before`` and ``arrears_factor_before``: over earlier years only.
    """
    to_date = by_entity().rangeBetween(Window.unboundedPreceding, 0)
    before = by_entity().rangeBetween(Window.unboundedPreceding, -1)
    valid = F.col("arrears_pct").isNotNull()
    factor = F.when(valid, F.col("rating_factor"))
    factor_sum = F.sum(factor.cast("decimal(38,10)")).over(before).cast("double")
    return annual.withColumns(
        {
            "years_delivered": F.count_if(F.col("delivered") & (F.col("year") >= first_year)).over(to_date),
            "chronic_before": F.count_if(valid & (F.col("arrears_pct") > P.CHRONIC_ARREARS_PCT)).over(before),
            "arrears_factor_before": F.try_divide(factor_sum, F.count(factor).over(before).cast("double")),
        }
    )


def top_years_weighted(annual: DataFrame) -> DataFrame:
    """Weighted mean of the last five available years up to each year, with its rating.

    Positional weights 40/25/20/10/5. The list per row is bounded by the fiscal years on file.
    """
    to_date = by_entity().rangeBetween(Window.unboundedPreceding, 0)
    entry = F.struct(F.col("year"), F.col("budget_exec").alias("x"), F.col("rating_factor").alias("f"))
    seen = F.collect_list(F.when(F.col("budget_exec").isNotNull(), entry)).over(to_date)
    newest = F.slice(F.sort_array("_seen", asc=False), 1, len(P.BACKTEST_RECENCY_WEIGHTS))
    weights = F.array(*[F.lit(w) for w in P.BACKTEST_RECENCY_WEIGHTS])
    weighted = F.transform(
        "_newest",
        lambda e, i: F.struct(
            F.get(weights, i).alias("w"), (F.get(weights, i) * e["x"]).alias("wx"), (F.get(weights, i) * e["f"]).alias("wf")
        ),
    )

    def total(part: str) -> Column:
        return F.aggregate("_weighted", F.lit(0.0), lambda acc, e: acc + e[part])

    rows = annual.withColumn("_seen", seen).withColumn("_newest", newest).withColumn("_weighted", weighted)
    has_any = F.size("_newest") > 0
    return rows.withColumns(
        {
            "budget_weighted": F.when(has_any, total("wx") / total("w")),
            "budget_factor": F.when(has_any, total("wf") / total("w")).otherwise(P.NO_RATING_FACTOR),
        }
    ).drop("_seen", "_newest", "_weighted")


def score_redistributed(
    rows: DataFrame,
    parts: dict[str, tuple[Column, Column]],
    missing: dict[str, Column],
) -> DataFrame:
    """Weighted score in which missing components leave and the other weights grow.

    ``parts``: name -> (norm, rating factor); ``missing``: name -> condition to leave it out.
    A norm that is NULL for another reason counts 0.5. Needs the state-weight columns.
    """
    order = ["liquidity", "compliance", "budget_exec", "coverage", "autonomy", "arrears"]

    def total(value) -> Column:
        terms = []
        for name in order:
            gone = missing.get(name, F.lit(False))
            terms.append(F.when(gone, 0.0).otherwise(value(name)))
        return sum(terms[1:], terms[0])

    def norm(name: str) -> Column:
        return F.coalesce(parts[name][0], F.lit(0.5))

    def weight(name: str) -> Column:
        return F.col(f"w_{name}")

    weights = total(weight)
    rated_weights = total(lambda n: weight(n) if n in RATED else F.lit(0.0))
    rated = total(lambda n: weight(n) * parts[n][1] if n in RATED else F.lit(0.0))
    return rows.withColumns(
        {
            "score": half_even(total(lambda n: norm(n) * weight(n) * parts[n][1]) / weights * 100.0, 2),
            "score_unrated": half_even(total(lambda n: norm(n) * weight(n)) / weights * 100.0, 2),
            "mean_factor": F.when(rated_weights > 0, half_even(rated / rated_weights, 6)).otherwise(1.0),
            "era": F.when(missing["liquidity"], ERA_PARTIAL).otherwise(ERA_COMPLETE),
        }
    )


def backtest_pairs(
    annual: DataFrame,
    first_year: int,
    last_year: int,
    with_arrears: bool = True,
    exclude_t0: tuple[int, ...] = (),
    era: str | None = None,
) -> DataFrame:
    """One row per (entity, T0): score and class from data up to T0, outcome in T1 = T0 + 1.

    ``annual``: entity_id, state, name, population, year, delivered, budget_exec, arrears_pct,
    liquidity, fiscal_period and resolved rating_factor; unique per (entity, year). Every window
    shares one partitioning and order, so the history is shuffled and sorted once.
    """
    rows = top_years_weighted(history_to_date(annual, first_year))
    rows = walk_forward_pairs(rows, ["year", "arrears_pct", "fiscal_period"])
    rows = rows.filter(F.col("year").between(first_year, last_year - 1) & F.col("next_arrears_pct").isNotNull())
    # The newest year counts only where its fiscal report exists.
    rows = rows.filter((F.col("next_year") < last_year) | F.col("next_fiscal_period").isNotNull())
    if exclude_t0:
        rows = rows.filter(~F.col("year").isin(list(exclude_t0)))
    rows = with_state_params(rows)
    one = F.lit(1.0)
    norms = {
        "liquidity_norm": C.liquidity_curve(F.col("liquidity")),
        "budget_norm": C.budget_curve(F.col("budget_weighted"), digits=None),
        "coverage": C.coverage_ratio(F.col("years_delivered"), F.col("year") - first_year + 1),
        "arrears_norm": C.arrears_curve(F.col("chronic_before")),
        "liquidity_factor": F.coalesce("rating_factor", F.lit(P.NO_RATING_FACTOR)),
        "arrears_factor": F.coalesce("arrears_factor_before", F.lit(P.NO_RATING_FACTOR)),
    }
    rows = rows.withColumns(norms)
    parts = {
        "liquidity": (F.col("liquidity_norm"), F.col("liquidity_factor")),
        "compliance": (one, one),
        "budget_exec": (F.col("budget_norm"), F.col("budget_factor")),
        "coverage": (F.col("coverage"), one),
        "autonomy": (F.lit(0.5), F.col("liquidity_factor")),
        "arrears": (F.col("arrears_norm"), F.col("arrears_factor")),
    }
    missing = {"liquidity": F.col("liquidity").isNull(), "arrears": F.lit(not with_arrears)}
    scored = score_redistributed(rows, parts, missing)
    rank = class_rank(F.col("score"), F.col("years_delivered"), F.col("chronic_before"), P.BACKTEST_CUTS)
    pairs = scored.select(
        "state",
        "region",
        "entity_id",
        "name",
        "population",
        F.col("year").alias("year_t0"),
        F.col("next_year").alias("year_t1"),
        "era",
        "score",
        "score_unrated",
        "mean_factor",
        class_label(rank, P.BACKTEST_CLASSES, P.BACKTEST_NO_DATA).alias("risk_class"),
        "liquidity",
        "liquidity_norm",
        half_even(F.col("liquidity_factor"), 6).alias("liquidity_factor"),
        half_even(F.col("budget_weighted"), 2).alias("budget_weighted"),
        half_even(F.col("budget_norm"), 4).alias("budget_norm"),
        half_even(F.col("budget_factor"), 6).alias("budget_factor"),
        half_even(F.col("coverage"), 4).alias("coverage"),
        "years_delivered",
        F.col("chronic_before").alias("chronic_years"),
        half_even(F.col("arrears_norm"), 4).alias("arrears_norm"),
        half_even(F.col("arrears_factor"), 6).alias("arrears_factor"),
        F.col("arrears_pct").alias("arrears_t0"),
        F.col("next_arrears_pct").alias("outcome"),
        C.liquidity_suspect(F.col("liquidity")).alias("suspect"),
    )
    return pairs.filter(F.col("era") == era) if era else pairs


def extreme_errors(pairs: DataFrame, n: int = 8) -> DataFrame:
    """Most wrong pairs of the complete era: n false positives and n false negatives."""
    complete = pairs.filter(F.col("era") == ERA_COMPLETE)
    fields = ["state", "name", "entity_id", "year_t0", "score", "outcome"]
    high = complete.filter(F.col("risk_class").isin(P.BACKTEST_CLASSES[2:]) & (F.col("outcome") < 1.0))
    low = complete.filter(F.col("risk_class").isin(P.BACKTEST_CLASSES[:2]) & (F.col("outcome") > 5.0))
    tie = ["entity_id", "year_t0"]
    false_positives = high.orderBy(F.desc("score"), F.asc("outcome"), *tie).limit(n)
    false_negatives = low.orderBy(F.desc("outcome"), F.desc("score"), *tie).limit(n)
    return false_positives.select(F.lit("false_positive").alias("kind"), *fields).unionByName(
        false_negatives.select(F.lit("false_negative").alias("kind"), *fields)
    )
