"""Procurement contracts: staging, windowed aggregates, alert."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.dates import months_back
from riskspark.functions.numbers import exact_sum, half_away, half_even

WAIVER, NO_CONTEST = 8, 9  # modality codes without a tender
AGG_COLUMNS = ["entity_id", "purchase_year", "modality", "awarded_value", "published"]  # what contracts_agg reads


def within_months(df: DataFrame, column: str, as_of: date, months: int) -> DataFrame:
    return df.filter(F.col(column) >= months_back(as_of, months))


def cap_outlier(value: Column, cap: float = P.CONTRACT_VALUE_CAP) -> Column:
    return F.when(value <= cap, value)


def contracts_agg(contracts: DataFrame, as_of: date, months: int = 6) -> DataFrame:
    """Counts, sums and shares per entity over the rolling window; one hash aggregate."""
    rows = within_months(contracts, "published", as_of, months).filter(F.col("entity_id").isNotNull())
    rows = rows.withColumn("_value", cap_outlier(F.col("awarded_value")))
    waiver = F.col("modality") == WAIVER
    no_contest = F.col("modality") == NO_CONTEST
    direct = waiver | no_contest

    def total(condition: Column) -> Column:
        return exact_sum(F.when(condition, F.col("_value")))

    sums = rows.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_contracts"),
        F.count("_value").alias("n_with_value"),
        F.count_if(F.col("_value").isNull()).alias("n_without_value"),
        F.count_if(F.col("awarded_value") > P.CONTRACT_VALUE_CAP).alias("n_outliers"),
        exact_sum(F.col("_value")).alias("value_total"),
        F.count_if(waiver).alias("n_waiver"),
        total(waiver).alias("value_waiver"),
        F.count_if(no_contest).alias("n_no_contest"),
        total(no_contest).alias("value_no_contest"),
        F.count_if(direct).alias("n_direct"),
        total(direct).alias("value_direct"),
        F.max("purchase_year").alias("last_year"),
    )

    def share(name: str) -> Column:
        return half_away(F.try_divide(F.col(name), F.col("value_total")), 6)

    return sums.withColumns(
        {
            "pct_waiver": share("value_waiver"),
            "pct_no_contest": share("value_no_contest"),
            "pct_direct": share("value_direct"),
        }
    )


def direct_award_alert(share: Column) -> Column:
    return F.coalesce(share > P.DIRECT_AWARD_ALERT, F.lit(False))


def contracts_agg_12m(contracts: DataFrame, as_of: date) -> DataFrame:
    """Older 12-month variant: missing values count as 0, waiver covers both modalities."""
    rows = within_months(contracts, "published", as_of, 12).filter(F.col("entity_id").isNotNull())
    direct = F.coalesce(F.col("modality").isin(WAIVER, NO_CONTEST), F.lit(False))
    value = F.coalesce(F.col("awarded_value"), F.lit(0.0))
    sums = rows.groupBy("entity_id").agg(
        F.count("contract_id").alias("n_contracts"),
        exact_sum(value).alias("value_total"),
        F.count_if(direct).alias("n_waiver"),
        exact_sum(F.when(direct, value).otherwise(0.0)).alias("value_waiver"),
        F.max("purchase_year").alias("last_year"),
    )
    share = half_even(F.try_divide(F.col("value_waiver"), F.col("value_total")), 4)
    return sums.withColumn("pct_waiver", share).withColumn("award_alert", direct_award_alert(F.col("pct_waiver")))


def block_key(modality: Column, day: Column) -> Column:
    """Work-unit key of one modality and month."""
    return F.concat_ws("_", modality.cast("string"), F.date_format(day, "yyyy-MM"))


def pending_blocks(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned blocks that have no landed rows (nor an empty-block marker) yet."""
    return planned.join(done.select("block_key").distinct(), "block_key", "left_anti")
