"""Daily score snapshots: publishing, run log and the analytic views on the history."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.numbers import exact_mean
from riskspark.functions.text import zero_pad
from riskspark.operators.dedupe import keep_first, top_rows
from riskspark.operators.ordered import number_rows, trailing
from riskspark.operators.quality import Watch, missing_columns, raise_on_violations, repeated_entities, snapshot_conditions
from riskspark.session import work_path
from riskspark.sinks.storage import remove, swap_partitions
from riskspark.sinks.tables import append_rows, replace_partitions, typed

ENTITY = ["state", "entity_id"]
RATED_PARTS = ("budget", "liquidity_rating", "arrears", "autonomy")
# fixed values: the published columns and their types
SNAPSHOT_TYPES = {
    "run_id": "string",
    "snapshot_date": "date",
    "snapshot_ts": "timestamp",
    "state": "string",
    "entity_id": "string",
    "name": "string",
    "population": "bigint",
    "methodology": "string",
    "score": "double",
    "risk_class": "string",
    "score_base": "double",
    "score_base_unrated": "double",
    "score_raw": "double",
    "years_delivered": "bigint",
    "chronic_years": "bigint",
    "arrears_pct_latest": "double",
    "liquidity": "double",
    "budget_exec": "double",
    "coverage": "double",
    "compliance_risk": "double",
    "autonomy_mean": "double",
    "mean_factor": "double",
    "budget_factor": "double",
    "liquidity_factor": "double",
    "arrears_factor": "double",
    "autonomy_factor": "double",
    "liquidity_rating_year": "bigint",
    "liquidity_rating_status": "string",
    "liquidity_rating_grade": "string",
    **{f"{part}_{flag}": "boolean" for part in RATED_PARTS for flag in ("preliminary", "stale", "missing")},
    "budget_norm": "double",
    "liquidity_norm": "double",
    "arrears_norm": "double",
    "autonomy_norm": "double",
    "points_budget_exec": "double",
    "points_liquidity": "double",
    "points_coverage": "double",
    "points_compliance": "double",
    "points_autonomy": "double",
    "points_arrears": "double",
    "base_budget_exec": "double",
    "base_liquidity": "double",
    "base_autonomy": "double",
    "base_arrears": "double",
    "penalty_partial": "double",
    "penalty": "double",
    "delay_days": "bigint",
    "decay": "double",
    "liquidity_suspect": "boolean",
    "liquidity_stale": "boolean",
    "liquidity_partial": "boolean",
    "autonomy_critical": "boolean",
    "n_severe": "bigint",
    "n_moderate": "bigint",
    "n_light": "bigint",
    "pending_text": "string",
    "pending_json": "string",
    "n_contracts": "bigint",
    "value_total": "double",
    "n_waiver": "bigint",
    "value_waiver": "double",
    "pct_waiver": "double",
    "last_year": "bigint",
    "award_alert": "boolean",
}
REQUIRED = [
    "entity_id",
    "name",
    "score",
    "risk_class",
    "score_base",
    "score_raw",
    "years_delivered",
    "chronic_years",
]


def run_summary(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run. Scores have one decimal, so the exact median holds at most 1,001 values."""
    return snapshot.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_written"),
        F.count("score").alias("rows_scored"),
        F.count_if(F.col("risk_class") == P.NO_DATA_CLASS).alias("rows_no_data"),
        exact_mean(F.col("score"), 4).alias("score_avg"),
        F.median("score").alias("score_median"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
    )


def class_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_class").agg(F.count(F.lit(1)).alias("n_entities"))


def snapshot_rows(scored: DataFrame, run_id: str, day: date, ts: datetime, methodology: str) -> DataFrame:
    """Scored entities in the snapshot's columns and types; missing columns become NULL."""
    rows = scored.withColumns(
        {
            "run_id": F.lit(run_id),
            "snapshot_date": F.lit(day),
            "snapshot_ts": F.lit(ts),
            "methodology": F.lit(methodology),
            "entity_id": zero_pad(F.col("entity_id").cast("string")),
        }
    )
    return typed(rows, SNAPSHOT_TYPES)


@dataclass(frozen=True)
class Run:
    """What identifies and describes a published run; the optional parts only go to the run log."""

    run_id: str
    day: date
    ts: datetime
    methodology: str
    run_type: str = "pipeline"
    pipeline_mode: str | None = None
    source_mode: str | None = None
    pipeline_version: str | None = None
    fiscal_ref: str | None = None
    accounts_ref: str | None = None
    compliance_ref: str | None = None
    contracts_ref: str | None = None
    notes: str | None = None


def run_log(rows: DataFrame, run: Run) -> DataFrame:
    """One row per state of a published snapshot."""
    summary = run_summary(rows, ["run_id", "snapshot_date", "snapshot_ts", "state", "methodology"])
    described = [f.name for f in fields(run) if f.name not in ("run_id", "day", "ts", "methodology")]
    texts = {name: F.lit(getattr(run, name)).cast("string") for name in described}
    return summary.withColumns({**texts, "status": F.lit("SUCCESS")})


def publish_snapshot(scored: DataFrame, path: str, run_log_path: str, run: Run) -> None:
    """Write the rows once beside the table, check and summarise them, swap them in, then log.

    The score is evaluated once, success is logged only when the rows are in place, and any failure
    before that raises and leaves the table as it was.
    """
    missing = missing_columns(scored, REQUIRED)
    if missing:
        raise ValueError(f"snapshot lacks columns: {', '.join(missing)}")
    spark = scored.sparkSession
    staged = work_path(spark, "snapshot")
    rows = snapshot_rows(scored, run.run_id, run.day, run.ts, run.methodology)
    classes = [*P.RISK_CLASSES, P.NO_DATA_CLASS]
    watch = Watch(rows, snapshot_conditions(classes))
    replace_daily_snapshot(watch.rows, staged)
    # the type of a partition column is not in the files
    written = spark.read.schema(rows.schema).parquet(staged)
    try:
        if not watch.raise_on_violations(written):
            raise ValueError("empty_snapshot=1")
        raise_on_violations(repeated_entities(written))
        log = run_log(written, run)
        log_rows = log.collect()  # one row per state
    except Exception:
        remove(spark, staged)
        raise
    swap_partitions(spark, staged, path, depth=2)
    append_rows(spark.createDataFrame(log_rows, log.schema), run_log_path)


def replace_daily_snapshot(rows: DataFrame, path: str) -> None:
    """Replace the (day, state) partitions the rows belong to."""
    replace_partitions(rows, path, ["snapshot_date", "state"], ["entity_id"])


def latest(history: DataFrame) -> DataFrame:
    """Newest snapshot of each entity; the higher run id wins at the same instant."""
    return keep_first(history, ENTITY, [F.col("snapshot_ts").desc(), F.col("run_id").desc()])


# fixed values: the published columns of the trajectory view
TRAJECTORY = [
    "run_id", "snapshot_date", "snapshot_ts", "state", "entity_id", "name", "score", "risk_class", "score_base",
    "score_raw", "liquidity", "budget_exec", "arrears_pct_latest", "coverage", "compliance_risk", "autonomy_mean",
    "chronic_years", "years_delivered", "n_severe", "n_moderate", "n_light", "liquidity_stale", "autonomy_critical",
    "award_alert",
]


def trajectory(history: DataFrame) -> DataFrame:
    return history.select(*[c for c in TRAJECTORY if c in history.columns])


def diff_last_run(history: DataFrame) -> DataFrame:
    """Newest against previous snapshot per entity.

    Only the two newest rows of a key survive the map side, so long histories cost nothing.
    """
    newest = [F.col("snapshot_ts").desc(), F.col("run_id").desc()]
    two = top_rows(history, ENTITY, newest, 2)
    values = ["run_id", "snapshot_date", "score", "risk_class", "n_severe", "compliance_risk"]

    def pick(rank: int, name: str):
        return F.max(F.when(F.col("rank") == rank, F.col(name)))

    wide = two.groupBy(*ENTITY).agg(
        *[pick(1, c).alias(c) for c in values], *[pick(2, c).alias(f"previous_{c}") for c in values]
    )
    return wide.withColumns(
        {
            "delta_score": F.col("score") - F.col("previous_score"),
            "class_changed": F.col("risk_class") != F.col("previous_risk_class"),
        }
    )


def flag_persistence(history: DataFrame, spans: tuple[int, ...] = (6, 12), block_rows: int = 100_000) -> DataFrame:
    """Is the severe flag set in each of the last n snapshots?

    A frame that is not full yet never counts as persistent.
    """
    severe = F.when(F.coalesce("n_severe", F.lit(0)) > 0, 1).otherwise(0)
    rows = history.withColumn("has_severe", severe)
    numbered = number_rows(rows, ENTITY, ["snapshot_ts", "run_id"], F.date_trunc("hour", "snapshot_ts"))
    frames = {f"n_severe_last_{n}": (n, F.sum("has_severe")) for n in spans}
    counted = trailing(numbered, ENTITY, frames, block_rows)
    full = {
        f"persistent_{n}": (F.col("position") >= n - 1) & (F.col(f"n_severe_last_{n}") == n) for n in spans
    }
    return counted.withColumns(full).withColumn("has_severe", F.col("has_severe") == 1).drop("position")


def create_views(history: DataFrame, prefix: str = "risk") -> None:
    """Temp views over the snapshot history for SQL users."""
    history.createOrReplaceTempView(f"{prefix}_history")
    latest(history).createOrReplaceTempView(f"{prefix}_latest")
    trajectory(history).createOrReplaceTempView(f"{prefix}_trajectory")
    diff_last_run(history).createOrReplaceTempView(f"{prefix}_diff_last_run")
    flag_persistence(history).createOrReplaceTempView(f"{prefix}_flag_persistence")


def plain_window_persistence(history: DataFrame, n: int) -> DataFrame:
    """Same counts with one ordinary window; the reference point for tests on small data."""
    frame = Window.partitionBy(*ENTITY).orderBy("snapshot_ts", "run_id").rowsBetween(1 - n, 0)
    severe = F.when(F.coalesce("n_severe", F.lit(0)) > 0, 1).otherwise(0)
    return history.withColumn(f"n_severe_last_{n}", F.sum(severe).over(frame))
