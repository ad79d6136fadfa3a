"""Long account lines -> wide yearly measures.

MAX ignores repeated lines, so the pivots need no prior de-duplication: staging keeps the
largest value of a repeated line, which is the one MAX would take anyway. That saves a shuffle
of the whole line table. Both pivots are hash aggregates with map-side combine on primitives;
only entity-year-period rows leave a task, however many lines one entity has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.text import label_matches

GRID_YEARS = P.GRID_YEARS
GRID_STATES = sorted(P.STATE_REGION)
Rule = tuple[str, list[str], str | None, str | None]


def rule_condition(rule: Rule) -> Column:
    """Cheap equality tests first, patterns last."""
    annex, codes, column_pattern, name_pattern = rule
    parts = [F.col("account_code").isin(codes), F.col("annex").startswith(annex)]
    if column_pattern:
        parts.append(label_matches(F.col("column_label"), column_pattern))
    if name_pattern:
        parts.append(label_matches(F.col("account_name"), name_pattern))
    return reduce(lambda a, b: a & b, parts)


def pivot_lines(lines: DataFrame, keys: list[str], rules: dict[str, Rule], *extra: Column) -> DataFrame:
    measures = [F.max(F.when(rule_condition(rule), F.col("value"))).alias(name) for name, rule in rules.items()]
    return lines.groupBy(*keys).agg(*measures, *extra)


def latest_period_rows(lines: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """All rows of each key's last period.

    Aggregate-then-join rather than a window: the period table has one row per key, and
    adaptive execution can split a hot key of the line side.
    """
    last = lines.groupBy(*keys).agg(F.max(period).alias("_last"))
    return lines.join(last, keys).filter(F.col(period) == F.col("_last")).drop("_last")


def regime_rank(regime: Column) -> Column:
    return F.when(regime == "Q", 1).when(regime == "S", 2).otherwise(3)


def priority_regime(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: preferred regime among exact-annex lines, and its last period."""
    exact = lines.filter(F.col("annex") == P.FISCAL_ANNEX)
    periods = exact.groupBy(*keys, "regime").agg(F.max("period").alias("period"))
    return periods.groupBy(*keys).agg(
        F.min_by("regime", regime_rank(F.col("regime"))).alias("regime"),
        F.min_by("period", regime_rank(F.col("regime"))).alias("period"),
    )


def has_data() -> Column:
    return F.col("account_code").isNotNull() & F.col("value").isNotNull()


def in_grid_range() -> Column:
    """Lines that may put a year into the grid: of a known state and a year within ``GRID_YEARS``."""
    return F.col("state").isin(GRID_STATES) & F.col("year").between(*GRID_YEARS)


def reporting_states() -> Column:
    """The states whose lines have data, as one bit each: 27 states fit a number, so the sum stays a hash aggregate."""
    position = F.array_position(F.array(*[F.lit(s) for s in GRID_STATES]), F.col("state")) - 1
    return F.bit_or(F.when(has_data() & in_grid_range(), F.pow(F.lit(2.0), position).cast("bigint")))


def line_states() -> Column:
    """The states that lines with data of a grid year name, as one bit each, and one for any other or none."""
    position = F.array_position(F.array(*[F.lit(s) for s in GRID_STATES]), F.col("state"))
    bit = F.pow(F.lit(2.0), F.coalesce(position, F.lit(0))).cast("bigint")
    return F.bit_or(F.when(has_data() & F.col("year").between(*GRID_YEARS), bit))


def budget_periods(lines: DataFrame) -> DataFrame:
    """(entity, year, period): measures, and the states that report data in ``_states``."""
    return pivot_lines(lines, ["entity_id", "year", "period"], P.BUDGET_RULES, reporting_states().alias("_states"))


def budget_measures() -> list[Column]:
    """Aggregates that take the measures of the last reported period."""
    return [F.max("period").alias("budget_period"), *[F.max_by(name, "period").alias(name) for name in P.BUDGET_RULES]]


def budget_pivot(lines: DataFrame) -> DataFrame:
    """(entity, year): measures of the last reported period."""
    return budget_periods(lines).filter("period IS NOT NULL").groupBy("entity_id", "year").agg(*budget_measures())


def fiscal_records(lines: DataFrame, *extra: Column) -> DataFrame:
    """(entity, year, regime, period) with an exact-annex line: the record, its order of preference, and ``extra`` aggregates.

    The period is chosen from exact-annex lines, the data from every line whose annex starts with that name.
    """
    has_exact = F.bool_or(F.col("annex") == P.FISCAL_ANNEX).alias("_exact")
    by_period = pivot_lines(lines, ["entity_id", "year", "regime", "period"], P.FISCAL_RULES, has_exact, *extra)
    # one struct per record, so that all columns come from the same one; regime settles equal ranks
    record = F.struct("regime", "period", *P.FISCAL_RULES)
    choice = F.struct(-regime_rank(F.col("regime")), F.col("period"), F.col("regime"))
    chosen = by_period.filter(F.col("_exact") & F.col("period").isNotNull())
    added = by_period.columns[len(by_period.columns) - len(extra) :]
    return chosen.select("entity_id", "year", record.alias("_record"), choice.alias("_choice"), *added)


def fiscal_columns(record: Column) -> dict[str, Column]:
    """Cash measures of a fiscal record."""
    return {
        "fiscal_regime": record["regime"],
        "fiscal_period": record["period"],
        "cash_after_total": F.coalesce(record["cash_after_iv"], record["cash_after_iii"]),
        "cash_after_pension": record["cash_after_pension"],
        "cash_before_total": F.coalesce(record["cash_before_iv"], record["cash_before_iii"]),
        "cash_before_pension": record["cash_before_pension"],
    }


def fiscal_pivot(lines: DataFrame) -> DataFrame:
    """(entity, year): cash measures of the preferred regime's last period."""
    best = fiscal_records(lines).groupBy("entity_id", "year").agg(F.max_by("_record", "_choice").alias("_r"))
    return best.select("entity_id", "year", *[c.alias(n) for n, c in fiscal_columns(F.col("_r")).items()])


def entity_year_grid(dim: DataFrame, lines: DataFrame, by_state: bool = True) -> DataFrame:
    """Every entity times every year for which its state (or any state) has data.

    The broadcast side is bounded by the known states times a range of years, whatever the lines hold;
    without the hint the whole dimension would be shuffled onto 27 keys. What falls outside is counted by
    ``quality.grid_checks``.
    """
    if not by_state:
        all_years = lines.filter(has_data()).agg(F.collect_set("year")).scalar()
        return dim.select("entity_id", F.explode(all_years).alias("year"))
    years = lines.filter(has_data() & in_grid_range()).select("state", "year").distinct()
    return dim.join(F.broadcast(years), "state").select("entity_id", "year")


def grid_of_periods(dim: DataFrame, periods: DataFrame) -> DataFrame:
    """The grid by state from the ``_states`` of pivoted lines, without another scan of the lines."""
    by_year = periods.filter("_states IS NOT NULL").groupBy("year").agg(F.bit_or("_states").alias("_states"))
    known = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(1 << k).alias("bit")) for k, s in enumerate(GRID_STATES)])
    years = by_year.select("year", "_states", F.inline(known)).filter(F.col("_states").bitwiseAND(F.col("bit")) != 0)
    return dim.join(F.broadcast(years.select("state", "year")), "state").select("entity_id", "year")


def merge_on_key(keys: list[str], parts: list[DataFrame], combine: Callable[[str], Column]) -> DataFrame:
    """Full outer merge of frames with one row per key: one union and one shuffle, no joins."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[combine(c).alias(c) for c in values])


def first_match(lines: DataFrame, keys: list[str], preferred: str) -> DataFrame:
    """Revenue per account: the first value under the preferred column label, whether it parses or
    not; without such a line the first value that parses.

    Balance accounts keep the last one met. Blank values count as 0, unparsable ones are NULL.
    Needs ``seq`` (reading order), ``account_name``, ``column_label`` and text ``value``.
    """
    amount = F.when(F.trim("value") == "", F.lit(0.0)).otherwise(F.trim("value").try_cast("double"))
    amount = F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(amount)
    rows = lines.withColumns(
        {
            "_amount": amount,
            "_name": F.lower(F.trim("account_name")),
            "_other": F.coalesce(F.trim("column_label") != preferred, F.lit(True)),
        }
    )
    order = F.struct("_other", F.col("_other") & F.col("_amount").isNull(), "seq")
    return rows.groupBy(*keys, "_name").agg(
        F.min_by("_amount", order).alias("first_value"),
        F.max_by("_amount", "seq").alias("last_value"),
    ).withColumnRenamed("_name", "account")
