"""Procurement mart and the enrichment of scores with it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.numbers import exact_sum
from riskspark.operators.contracts import contracts_agg, contracts_agg_12m, direct_award_alert


def contracts_mart(contracts: DataFrame, dim: DataFrame, as_of: date) -> DataFrame:
    """Aggregates with entity attributes. Contracts are reduced before the join."""
    market = contracts_agg(contracts, as_of)
    attributes = dim.select("entity_id", "state", "name", "population").distinct()
    joined = market.join(attributes, "entity_id", "left")
    return joined.withColumn("award_alert", direct_award_alert(F.col("pct_waiver")))


def score_enrich(scored: DataFrame, contracts: DataFrame, as_of: date) -> DataFrame:
    """Scores with the 12-month procurement aggregates."""
    return scored.join(contracts_agg_12m(contracts, as_of), "entity_id", "left")


def enrich_report(enriched: DataFrame) -> DataFrame:
    """Cross counts of risk and market exposure, one pass."""
    safe = F.col("risk_class") == P.RISK_CLASSES[0]
    risky = F.col("risk_class").isin(P.RISK_CLASSES[2:])
    groups = {
        "low_risk": safe,
        "negative_liquidity": F.coalesce("liquidity", F.lit(0.0)) < 0,
        "no_data_with_contracts": (F.col("risk_class") == P.NO_DATA_CLASS) & F.col("n_contracts").isNotNull(),
        "high_risk_with_alert": risky & F.coalesce("award_alert", F.lit(False)),
    }
    rows = enriched.withColumn(
        "_groups", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]), lambda g: g.isNotNull())
    )
    exploded = rows.withColumn("report_group", F.explode("_groups"))
    return exploded.groupBy("report_group").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.coalesce(F.sum("n_contracts"), F.lit(0)).alias("n_contracts"),
        F.coalesce(exact_sum(F.col("value_total")), F.lit(0.0)).alias("value_total"),
    )
