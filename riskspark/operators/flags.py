"""Compliance flags: 28 wide columns -> counts, text, JSON and a severity score.

One staged row per entity already holds all its flags, so everything is computed inside the
row: no unpivot, no shuffle, no join with the requirement table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.numbers import half_even

REGULAR = "REGULAR"


def pending_items(requirements: list[tuple[str, str, str, str]]) -> Column:
    """Array of the pending requirements in the given order; '!' and a blank flag are pending."""
    items = ", ".join(
        f"CASE WHEN trim(coalesce({column}, '')) IN ('!', '') "
        f"THEN named_struct('code', '{code}', 'text', '{text}', 'severity', '{severity}') END"
        for column, code, text, severity in requirements
    )
    return F.expr(f"filter(array({items}), item -> item IS NOT NULL)")


def by_severity() -> list[tuple[str, str, str, str]]:
    return sorted(P.REQUIREMENTS, key=lambda r: (P.SEVERITY_RANK[r[3]], r[2]))


def severity_score(severe: Column, moderate: Column, light: Column) -> Column:
    """0 regular, 1 with any severe item, otherwise up to 0.5."""
    weighted = (moderate * 2.0 + light) / 20.0
    return F.when(severe > 0, F.lit(1.0)).otherwise(F.least(weighted, F.lit(0.5)))


def flags_severity(flags: DataFrame) -> DataFrame:
    def count(level: str) -> Column:
        return F.size(F.filter("_items", lambda item: item["severity"] == level)).cast("bigint")

    rows = flags.withColumn("_items", pending_items(by_severity()))
    rows = rows.withColumns(
        {"n_severe": count("GRAVE"), "n_moderate": count("MODERADA"), "n_light": count("LEVE")}
    )
    text = F.array_join(F.transform("_items", lambda item: item["text"]), " | ")
    return rows.select(
        "entity_id",
        "n_severe",
        "n_moderate",
        "n_light",
        F.when(F.size("_items") > 0, text).otherwise(REGULAR).alias("pending_text"),
        F.to_json("_items").alias("pending_json"),
        severity_score(F.col("n_severe"), F.col("n_moderate"), F.col("n_light")).alias("compliance_risk"),
    )


def pending_flags_row(flags: DataFrame) -> DataFrame:
    """Blocked flag, count and text in column order."""
    rows = flags.withColumn("_items", pending_items(P.REQUIREMENTS))
    text = F.array_join(F.transform("_items", lambda item: item["text"]), " | ")
    return rows.select(
        "entity_id",
        (F.size("_items") > 0).alias("blocked"),
        F.size("_items").cast("bigint").alias("n_pending"),
        F.when(F.size("_items") > 0, text).otherwise(REGULAR).alias("pending_text"),
    )


def text_severity(text: Column) -> Column:
    """Severity score from the ' | ' separated text; absent text is the worst case."""
    severe = F.array(*[F.lit(r[2]) for r in P.REQUIREMENTS if r[3] == "GRAVE"])
    moderate = F.array(*[F.lit(r[2]) for r in P.REQUIREMENTS if r[3] == "MODERADA"])
    items = F.transform(F.split(text, r"\|"), lambda item: F.trim(item))
    n_moderate = F.size(F.filter(items, lambda item: F.array_contains(moderate, item)))
    n_light = F.size(items) - n_moderate
    return (
        F.when(text.isNull(), F.lit(1.0))
        .when(F.trim(text) == REGULAR, F.lit(0.0))
        .when(F.arrays_overlap(items, severe), F.lit(1.0))
        .otherwise(half_even(severity_score(F.lit(0), n_moderate, n_light), 4))
    )
