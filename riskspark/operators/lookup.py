"""Joins against small reference tables and entity dimensions.

Only tables with a size fixed by this library (27 states, 28 requirements) carry a broadcast
hint. Entity dimensions grow with the data, so the planner chooses for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import params as P


def constant_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Small literal table. As a VALUES relation it needs no job and no Python data transfer."""

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("'", "\\'") + "'"
        return f"{value!r}D" if isinstance(value, float) else str(value)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(f'`{c}`' for c in columns)})")


def state_params(spark: SparkSession, overrides: dict[str, P.StateOverride] | None = None) -> DataFrame:
    rows = P.state_rows(overrides)
    return constant_table(spark, list(rows[0]), [tuple(r.values()) for r in rows])


def with_state_params(df: DataFrame, overrides: dict[str, P.StateOverride] | None = None) -> DataFrame:
    """Add region, weights, limits and sigmoid columns by state (27 broadcast rows)."""
    table = state_params(df.sparkSession, overrides)
    return df.drop("region").join(F.broadcast(table), "state", "left")


def region_lookup(df: DataFrame) -> DataFrame:
    table = constant_table(df.sparkSession, ["_state", "region"], list(P.STATE_REGION.items()))
    key = F.upper(F.trim("state"))
    return df.join(F.broadcast(table), key == F.col("_state"), "left").drop("_state")


def unknown_states(df: DataFrame) -> DataFrame:
    """States without a region; a load should stop when this has rows."""
    return region_lookup(df).filter(F.col("region").isNull()).select("state").distinct()


def state_from_code(df: DataFrame, code: str) -> DataFrame:
    table = constant_table(df.sparkSession, ["_prefix", "code_state"], list(P.CODE_PREFIX_STATE.items()))
    prefix = F.substring(F.lpad(F.col(code), 7, "0"), 1, 2)
    return df.join(F.broadcast(table), prefix == F.col("_prefix"), "left").drop("_prefix")


def of_state(facts: DataFrame, dim: DataFrame, states: list[str]) -> DataFrame:
    """Facts whose entity lies in the given states."""
    return facts.join(dim.filter(F.col("state").isin(states)), "entity_id", "left_semi")


def coverage_gap(expected: DataFrame, found: DataFrame, key: str = "entity_id") -> DataFrame:
    """Expected keys that were not found. The found keys are pre-reduced before the anti join."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def override_entity(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rewrite key and population of entities queried under another id.

    ``overrides``: query_id, output_id, institution_only, output_population; one row per special
    entity. Where an institution is named, only its rows stay.
    """
    joined = lines.join(overrides, F.col("entity_id") == F.col("query_id"), "left")
    keep = F.col("institution_only").isNull() | (F.trim("institution") == F.col("institution_only"))
    return (
        joined.filter(keep)
        .withColumn("entity_id", F.coalesce("output_id", "entity_id"))
        .withColumn("population", F.coalesce("output_population", "population"))
        .drop(*overrides.columns)
    )


def hub_join(spine: DataFrame, parts: list[DataFrame], key: str, defaults: dict[str, object]) -> DataFrame:
    """Spine LEFT JOIN each part on one key, then default values.

    All parts have one row per key and share the partitioning of the spine, so a chain of n
    joins shuffles each input once.
    """
    hub = spine
    for part in parts:
        clash = [c for c in part.columns if c in hub.columns and c != key]
        hub = hub.join(part.drop(*clash), key, "left")
    filled = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
    return hub.withColumns(filled) if filled else hub
