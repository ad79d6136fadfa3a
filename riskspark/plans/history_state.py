"""The newest snapshots of each entity as a table of their own, for views whose cost does not grow with the history.

The state has one row per entity: an array of its newest ``DEPTH`` snapshots, newest first. A publication
touches only the states it has rows for: their part of the table is read, merged with the new rows and swapped. A
snapshot that is published again replaces the (day, state) it belongs to, as in the history itself; an entity
that loses an entry that way, so that older ones must come back, is read from the history again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators.dedupe import top_rows
from riskspark.plans.history import ENTITY
from riskspark.session import path_exists, work_path
from riskspark.sinks.storage import recover_partitions, remove, swap_partitions

DEPTH = 12
# the order of the array: by time, then by run
FIELDS = ["snapshot_ts", "run_id", "snapshot_date", "score", "risk_class", "n_severe", "compliance_risk"]
TYPES = {
    "snapshot_ts": "timestamp", "run_id": "string", "snapshot_date": "date", "score": "double", "risk_class": "string",
    "n_severe": "bigint", "compliance_risk": "double",
}
_ENTRY = "struct<" + ",".join(f"{name}:{TYPES[name]}" for name in FIELDS) + ">"
SCHEMA = f"entity_id string, newest array<{_ENTRY}>, state string"


def _entries(rows: DataFrame) -> DataFrame:
    entry = F.struct(*[F.col(name).cast(TYPES[name]).alias(name) for name in FIELDS])
    return rows.select(F.col("state"), F.col("entity_id").cast("string").alias("entity_id"), entry.alias("entry"))


def _newest(entries: DataFrame) -> DataFrame:
    """At most ``DEPTH`` entries per entity leave a task."""
    order = [F.col("entry.snapshot_ts").desc(), F.col("entry.run_id").desc()]
    kept = top_rows(entries, ENTITY, order, DEPTH)
    return kept.groupBy(*ENTITY).agg(F.sort_array(F.collect_list("entry"), asc=False).alias("newest"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def update_state(published: DataFrame, history: DataFrame, path: str) -> None:
    """Bring the state up to date with newly published rows.

    ``published`` holds every row of the (day, state) partitions it touches; ``history`` is the whole history,
    which is read only for entities that lost an entry, and only in their states.
    """
    spark = published.sparkSession
    staged, work = work_path(spark, "history-state"), work_path(spark, "history-short")
    new = _entries(published)
    states = [r[0] for r in new.select("state").distinct().collect()]  # as many as there are states
    entries = new
    if path_exists(spark, path):
        recover_partitions(spark, path)
        held = read_state(spark, path).filter(F.col("state").isin(states))
        old = held.select(*ENTITY, F.size("newest").alias("n"), F.explode("newest").alias("entry"))
        days = new.select("state", F.col("entry.snapshot_date").alias("day")).distinct()
        replaced = (old["state"] == days["state"]) & (old["entry.snapshot_date"] == days["day"])
        stays = old.join(days, replaced, "left_anti")
        entries = new.unionByName(stays.select(*ENTITY, "entry"))
        # a full array that shrank hides older snapshots
        counts = entries.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("now"))
        full = held.filter(F.size("newest") == DEPTH).select(*ENTITY)
        short = full.join(counts, ENTITY, "left").filter(F.coalesce("now", F.lit(0)) < DEPTH).select(*ENTITY)
        short.write.parquet(work)
        short = spark.read.schema(short.schema).parquet(work)
        if not short.isEmpty():
            again = _entries(history.filter(F.col("state").isin(states))).join(short, ENTITY, "left_semi")
            entries = entries.join(short, ENTITY, "left_anti").unionByName(again)
    _newest(entries).hint("rebalance", "state").write.partitionBy("state").parquet(staged)
    swap_partitions(spark, staged, path)
    remove(spark, work)


def latest_from_state(state: DataFrame) -> DataFrame:
    """The newest snapshot of each entity."""
    return state.select(*ENTITY, F.inline(F.slice("newest", 1, 1)))


def diff_from_state(state: DataFrame) -> DataFrame:
    """Newest against previous snapshot per entity, as ``history.diff_last_run`` gives it."""
    now, before = F.get("newest", F.lit(0)), F.get("newest", F.lit(1))
    values = ["run_id", "snapshot_date", "score", "risk_class", "n_severe", "compliance_risk"]
    wide = state.select(
        *ENTITY, *[now[c].alias(c) for c in values], *[before[c].alias(f"previous_{c}") for c in values]
    )
    return wide.withColumns(
        {
            "delta_score": F.col("score") - F.col("previous_score"),
            "class_changed": F.col("risk_class") != F.col("previous_risk_class"),
        }
    )


def persistence_from_state(state: DataFrame, spans: tuple[int, ...] = (6, 12)) -> DataFrame:
    """The newest rows of ``history.flag_persistence``: is the severe flag set in each of the last n snapshots?"""
    if max(spans) > DEPTH:
        raise ValueError(f"the state holds {DEPTH} snapshots")

    def severe(entry: Column) -> Column:
        return F.coalesce(entry["n_severe"], F.lit(0)) > 0

    def count(n: int) -> Column:
        return F.size(F.filter(F.slice("newest", 1, n), severe)).cast("bigint")

    rows = state.select(*ENTITY, "newest", F.inline(F.slice("newest", 1, 1)))
    rows = rows.withColumns({f"n_severe_last_{n}": count(n) for n in spans})
    full = {f"persistent_{n}": (F.size("newest") >= n) & (F.col(f"n_severe_last_{n}") == n) for n in spans}
    return rows.withColumns({**full, "has_severe": F.coalesce("n_severe", F.lit(0)) > 0}).drop("newest")
