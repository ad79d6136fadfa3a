"""Exact order statistics without ever sorting a whole group in one task.

Rows are first reduced to (group, value, count). Values are then cut into slices of equal relative
width, whatever their unit; positions come from a window inside each (group, slice) plus the running
total of the slices before it. A group holding a third of all rows is spread over its slices, and a
value shared by a third of all rows is a single counted row. NULL is a group like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.numbers import exact_mean, half_even
from riskspark.functions.ratings import auc_strength, correlation_strength, executive_reading
from riskspark.operators.ordered import join_null_safe
from riskspark.session import written

SLICES_PER_DOUBLING = 1024
SMALLEST_EXPONENT = -40  # magnitudes below 2**-40 share the slice of zero


def value_slice(value: Column) -> Column:
    """Slice number that never falls as the value rises; about 0.1 % of the magnitude wide.

    A broken-line logarithm: the exponent plus the mantissa's linear part, so rounding of the exponent
    cannot break the order. Doubles give at most some two million slices, real data a few thousand.
    """
    size = F.abs(value.cast("double"))
    exponent = F.greatest(F.floor(F.log2(size)), F.lit(SMALLEST_EXPONENT))
    line = F.coalesce(exponent + size / F.pow(F.lit(2.0), exponent) - 1 - (SMALLEST_EXPONENT - 1), F.lit(0.0))
    return (F.signum(value) * F.floor(line * SLICES_PER_DOUBLING)).cast("long")


def running_totals(counts: DataFrame, groups: list[str], value: str, columns: list[str]) -> DataFrame:
    """Add ``before_<c>`` (sum over smaller values) and ``all_<c>`` (sum over the group).

    ``counts`` has one row per (group, value).
    """
    sliced = counts.withColumn("_slice", value_slice(F.col(value)))
    totals = sliced.groupBy(*groups, "_slice").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = totals.select(
        *groups,
        "_slice",
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_skip_{c}") for c in columns],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"all_{c}") for c in columns],
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    joined = join_null_safe(local, offsets, [*groups, "_slice"])
    joined = joined.withColumns({f"before_{c}": F.col(f"_skip_{c}") + F.col(f"_in_{c}") for c in columns})
    return joined.drop("_slice", *[f"_skip_{c}" for c in columns], *[f"_in_{c}" for c in columns])


def average_ranks(counts: DataFrame, groups: list[str], value: str, rank: str) -> DataFrame:
    """(groups, value) -> mean rank of its ties, centred on the group's mean rank."""
    per_value = counts.groupBy(*groups, value).agg(F.sum("n").alias("n"))
    totals = running_totals(per_value, groups, value, ["n"])
    mean_rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    return totals.select(*groups, value, (mean_rank - (F.col("all_n") + 1) / 2.0).alias(rank))


def group_median(counts: DataFrame, groups: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group of counted values (column ``n``)."""
    per_value = counts.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.sum("n").alias("n"))
    rows = running_totals(per_value, groups, value, ["n"])

    def at(position: Column) -> Column:
        inside = (F.col("before_n") <= position) & (position < F.col("before_n") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    low = F.floor((F.col("all_n") - 1) / 2.0)
    high = F.ceil((F.col("all_n") - 1) / 2.0)
    return rows.groupBy(*groups).agg(((at(low) + at(high)) / 2.0).alias(name))


def spearman(counts: DataFrame, groups: list[str], x: str, y: str, digits: int = 4) -> DataFrame:
    """Rank correlation per group from counted (x, y) combinations (column ``n``)."""
    rows = counts.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = join_null_safe(rows, average_ranks(rows, groups, x, "_rx"), [*groups, x])
    ranked = join_null_safe(ranked, average_ranks(rows, groups, y, "_ry"), [*groups, y])
    cross = F.sum(F.col("n") * F.col("_rx") * F.col("_ry"))
    spread_x = F.sum(F.col("n") * F.col("_rx") * F.col("_rx"))
    spread_y = F.sum(F.col("n") * F.col("_ry") * F.col("_ry"))
    spread = F.sqrt(spread_x * spread_y)
    return ranked.groupBy(*groups).agg(
        F.sum("n").alias("n_pairs"),
        half_even(cross / F.when(spread > 0, spread), digits).alias("spearman"),
    )


TAIL_STEPS = 400
TAIL_REACH = 9.0  # beyond that many standard deviations nothing is left at 12 digits


def _cosine_area(low: Column, high: Column, power: Column) -> Column:
    """Simpson's rule for the integral of cos(x) ** power over [low, high]."""

    def term(total: Column, i: Column) -> Column:
        weight = F.when((i == 0) | (i == TAIL_STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * F.pow(F.cos(low + (high - low) * i / TAIL_STEPS), power)

    steps = F.sequence(F.lit(0), F.lit(TAIL_STEPS))
    return F.aggregate(steps, F.lit(0.0), term) * (high - low) / (3.0 * TAIL_STEPS)


def student_tail(t: Column, degrees: Column) -> Column:
    """Two-sided tail of Student's t.

    With t = tan(x) * sqrt(degrees) the density becomes cos(x) ** (degrees - 1); the tail is the share
    of its area beyond |t|.
    """
    end = F.least(F.lit(math.pi / 2), F.lit(TAIL_REACH) / F.sqrt(degrees))
    at = F.least(F.atan(F.abs(t) / F.sqrt(degrees)), end)
    power = degrees - 1.0
    return _cosine_area(at, end, power) / _cosine_area(F.lit(0.0), end, power)


def with_p_value(correlations: DataFrame, digits: int = 4) -> DataFrame:
    """Two-sided p-value of each rank correlation, NULL below three pairs."""
    r, degrees = F.col("spearman"), (F.col("n_pairs") - 2).cast("double")
    tail = student_tail(r * F.sqrt(degrees / (1.0 - r * r)), degrees)
    p = F.when(r.isNull() | (F.col("n_pairs") < 3), None).when(F.abs(r) >= 1.0, 0.0).otherwise(half_even(tail, digits))
    return correlations.withColumn("p_value", p)


def auc(
    counts: DataFrame,
    groups: list[str],
    score: str,
    positive: Column,
    low_is_risky: bool = True,
    min_positives: int = 1,
    digits: int = 4,
) -> DataFrame:
    """Area under the ROC curve per group by the Mann-Whitney count.

    NULL when a class is absent or there are fewer than ``min_positives`` positives.
    """
    per_score = counts.groupBy(*groups, score).agg(
        F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(F.col("n"))).alias("neg"),
    )
    rows = running_totals(per_score, groups, score, ["pos", "neg"])
    doubled = F.col("pos").cast("decimal(19,0)") * (F.col("before_neg") * 2 + F.col("neg")).cast("decimal(19,0)")
    sums = rows.groupBy(*groups).agg(
        F.sum("pos").alias("n_positives"),
        F.sum("neg").alias("n_negatives"),
        F.sum(doubled).cast("double").alias("_wins"),
    )
    possible = F.col("n_positives").cast("double") * F.col("n_negatives") * 2.0
    share = F.col("_wins") / F.when(possible > 0, possible)
    area = F.lit(1.0) - share if low_is_risky else share
    enough = F.col("n_positives") >= min_positives
    return sums.select(
        *groups,
        (F.col("n_positives") + F.col("n_negatives")).alias("n_pairs"),
        "n_positives",
        F.when(enough, half_even(area, digits)).alias("auc"),
    )


def pair_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def metrics_by_group(pairs: DataFrame, group: str, min_pairs: int = 30) -> DataFrame:
    """Rank correlation, AUC and levels per group.

    The complete era is the base where it has enough pairs, otherwise all pairs. ``pairs``: entity_id,
    era, score, outcome and the group column. Pairs are shuffled once, to counts per (base, score,
    outcome). The scores and the outcomes of all bases are stacked as rows (group, base, measure, value,
    counts), and one pass gives each value the totals of the smaller ones; ranks, medians, AUC and levels
    all come from these. Counts and totals are written once, since three branches read them.
    """
    rows = pairs.filter(F.col(group).isNotNull())
    bases = F.when(F.col("era") == "completa", F.array(F.lit(P.BASE_COMPLETE), F.lit(P.BASE_TOTAL))).otherwise(
        F.array(F.lit(P.BASE_TOTAL))
    )
    counts = written(pair_counts(rows, [group, "era", "score", "outcome"]), "metric-counts")
    counts = counts.withColumn("base", F.explode(bases))
    keys = [group, "base"]
    paired = F.col("score").isNotNull() & F.col("outcome").isNotNull()
    event = F.col("outcome") > P.CHRONIC_ARREARS_PCT

    def of(condition: Column) -> Column:
        return F.when(condition, F.col("n")).otherwise(0)

    measures = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("value"))
            for name in ("score", "outcome")
        ]
    )
    sums = {"n": F.col("n"), "ranked": of(paired), "pos": of(event), "neg": F.when(event, 0).otherwise(F.col("n"))}
    stacked = counts.select(*keys, *[c.alias(k) for k, c in sums.items()], F.inline(measures))
    per_value = stacked.groupBy(*keys, "measure", "value").agg(*[F.sum(c).alias(c) for c in sums])
    # the median leaves missing values out, so they must not be counted below the others
    per_value = per_value.withColumn("known", F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    totals = written(running_totals(per_value, [*keys, "measure"], "value", ["known", "ranked", "pos", "neg"]), "metric-totals")

    mean_rank = F.col("before_ranked") + (F.col("ranked") + 1) / 2.0 - (F.col("all_ranked") + 1) / 2.0
    ranks = totals.filter("ranked > 0").select(*keys, "measure", "value", mean_rank.alias("rank"))
    crossed = counts.filter(paired)
    for name in ("score", "outcome"):
        of_measure = ranks.filter(F.col("measure") == name)
        of_measure = of_measure.select(*keys, F.col("value").alias(name), F.col("rank").alias(f"rank_{name}"))
        crossed = join_null_safe(crossed.withColumn(name, F.col(name).cast("double")), of_measure, [*keys, name])
    crossed = crossed.select(*keys, (F.col("n") * F.col("rank_score") * F.col("rank_outcome")).alias("cross"))

    is_score, is_outcome = F.col("measure") == "score", F.col("measure") == "outcome"
    wins = F.col("pos").cast("decimal(19,0)") * (F.col("before_neg") * 2 + F.col("neg")).cast("decimal(19,0)")

    def middle(position: Column) -> Column:
        inside = (F.col("before_known") <= position) & (position < F.col("before_known") + F.col("known"))
        return F.max(F.when(is_outcome & inside, F.col("value")))

    table = totals.withColumn("rank", mean_rank).unionByName(crossed, allowMissingColumns=True).groupBy(*keys).agg(
        F.sum(F.when(is_score, F.col("n"))).alias("n_pairs"),
        F.sum(F.when(is_score, F.col("pos"))).alias("positives"),
        F.sum(F.when(is_score, F.col("neg"))).alias("_neg"),
        F.sum(F.when(is_score, (F.col("n") * F.col("value")).cast("decimal(38,4)"))).cast("double").alias("_total"),
        F.sum(F.when(is_score, wins)).cast("double").alias("_wins"),
        F.sum("cross").alias("_cross"),
        F.sum(F.when(is_score, F.col("ranked") * F.col("rank") * F.col("rank"))).alias("_spread_x"),
        F.sum(F.when(is_outcome, F.col("ranked") * F.col("rank") * F.col("rank"))).alias("_spread_y"),
        middle(F.floor((F.col("all_known") - 1) / 2.0)).alias("_low"),
        middle(F.ceil((F.col("all_known") - 1) / 2.0)).alias("_high"),
    )
    entities = rows.groupBy(group).agg(
        F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("n_total")
    )
    usable = (F.col("base") == P.BASE_TOTAL) | (F.col("n_pairs") >= min_pairs)
    best = table.filter(usable).groupBy(group).agg(
        F.min_by(F.struct(*table.columns), F.when(F.col("base") == P.BASE_COMPLETE, 0).otherwise(1)).alias("_row")
    )
    chosen = best.select(group, *[F.col(f"_row.{c}").alias(c) for c in table.columns if c != group])
    large = F.col("n_pairs") >= 3
    spread = F.sqrt(F.col("_spread_x") * F.col("_spread_y"))
    possible = F.col("positives").cast("double") * F.col("_neg") * 2.0
    area = F.lit(1.0) - F.col("_wins") / F.when(possible > 0, possible)
    result = chosen.join(entities, group).withColumns(
        {
            "pct_positives": half_even(F.col("positives") * 100.0 / F.col("n_pairs"), 1),
            "spearman": F.when(large, half_even(F.col("_cross") / F.when(spread > 0, spread), 4)),
            "auc": F.when(large & (F.col("positives") >= 3), half_even(area, 4)),
            "score_mean": half_even(F.col("_total") / F.col("n_pairs"), 2),
            "outcome_median": half_even((F.col("_low") + F.col("_high")) / 2.0, 2),
        }
    )
    return (
        result.withColumns(
            {
                "spearman_strength": correlation_strength(F.col("spearman")),
                "auc_strength": auc_strength(F.col("auc")),
                "reading": executive_reading(F.col("spearman"), F.col("auc")),
            }
        )
        .select(
            group, "base", "n_pairs", "positives", "auc", "spearman", "entities", "n_total", "pct_positives",
            "score_mean", "outcome_median", "spearman_strength", "auc_strength", "reading",
        )
        .orderBy(F.col("n_pairs").desc(), F.col(group))
    )


def outcome_by_class(pairs: DataFrame, threshold: float = P.CHRONIC_ARREARS_PCT) -> DataFrame:
    counts = pair_counts(pairs, ["risk_class", "outcome"])
    event = F.sum(F.when(F.col("outcome") > threshold, F.col("n")).otherwise(0))
    shares = counts.groupBy("risk_class").agg(
        F.sum("n").alias("n_pairs"), half_even(event * 100.0 / F.sum("n"), 1).alias("pct_chronic")
    )
    medians = group_median(counts, ["risk_class"], "outcome", "_median")
    return shares.join(medians, "risk_class").select(
        "risk_class", "n_pairs", half_even(F.col("_median"), 2).alias("median_outcome"), "pct_chronic"
    )


def coverage_by_group(pairs: DataFrame, group: str) -> DataFrame:
    """Pairs, entities, mean score and median outcome per group."""
    levels = pairs.groupBy(group).agg(
        F.count("score").alias("n_pairs"),
        F.count_distinct("entity_id").alias("entities"),
        exact_mean(F.col("score"), 4).alias("score_mean"),
    )
    medians = group_median(pair_counts(pairs, [group, "outcome"]), [group], "outcome", "outcome_median")
    return levels.join(medians, group, "left")


def event_rate(pairs: DataFrame, group: str) -> DataFrame:
    """Pairs, events and event percentage per group; ``event`` is boolean."""
    return pairs.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if("event").alias("events"),
        half_even(F.count_if("event") * 100.0 / F.count(F.lit(1)), 1).alias("event_pct"),
    )
