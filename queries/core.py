"""Registry of query / SQL pairs.

A query is a Spark builder plus a declared column list; its SQL is a named common table
expression. The same column list shapes both results, so names and types agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import prepare, size_shuffles, work_path

KINDS = {
    "l": ("bigint", "BIGINT"),
    "d": ("double", "DOUBLE"),
    "s": ("string", "VARCHAR"),
    "b": ("boolean", "BOOLEAN"),
    "dt": ("date", "DATE"),
}
CTES: dict[str, str] = {}
REGISTRY: dict[str, Query] = {}


class Tables:
    """Lazy scans of the input folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")
        size_shuffles(spark, self.folder)
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def shared(self, name: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
        """One DataFrame per shape, so equal subplans can reuse their exchange."""
        if name not in self._cache:
            self._cache[name] = build(self)
        return self._cache[name]

    def path(self, name: str) -> str:
        return work_path(self.spark, name)

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders")

    @cached_property
    def customer(self) -> DataFrame:
        return self.raw("customer")


@dataclass(frozen=True)
class Query:
    name: str
    columns: list[tuple[str, str]]
    build: Callable[[Tables], DataFrame]
    cte: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.select(*[F.col(name).cast(KINDS[kind][0]).alias(name) for name, kind in self.columns])

    def sql(self) -> str | None:
        if self.cte is None:
            return None
        columns = ", ".join(f"CAST({name} AS {KINDS[kind][1]}) AS {name}" for name, kind in self.columns)
        return f"{with_clause(self.cte)}\nSELECT {columns} FROM {self.cte}"


def cte(name: str, sql: str) -> None:
    if name in CTES:
        raise ValueError(f"SQL {name} defined twice")
    CTES[name] = sql.strip()


def _needed(name: str, seen: list[str]) -> list[str]:
    for other in dict.fromkeys(re.findall(r"\bx_\w+", CTES[name])):
        if other in CTES and other != name and other not in seen:
            _needed(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def with_clause(name: str) -> str:
    parts = [f"{part} AS (\n{CTES[part]}\n)" for part in _needed(name, [])]
    return "WITH " + ",\n".join(parts)


def query(name: str, columns: str, sql: str | None = None, source: str | None = None):
    """Register a builder. ``sql`` is the body of its CTE; ``source`` names an existing one."""
    spec = [tuple(part.split(":")) for part in columns.split()]

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        target = source
        if sql is not None:
            target = f"x_{name}"
            cte(target, sql)
        REGISTRY[name] = Query(name, spec, build, target)
        return build

    return register


# --- SQL twins of the rounding rules -----------------------------------------------------


def sql_half_even(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits} + 0e0)"


def sql_half_away(x: str, digits: int) -> str:
    return f"(sign({x}) * floor(abs({x}) * 1e{digits} + 0.5e0) / 1e{digits} + 0e0)"


def sql_exact_sum(x: str, scale: int = 6) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(38,{scale}))) AS DOUBLE)"


def sql_exact_mean(x: str, scale: int = 6) -> str:
    return f"({sql_exact_sum(x, scale)} / NULLIF(COUNT({x}), 0)::DOUBLE)"


def sql_case(value: str, mapping: dict, default: str = "NULL") -> str:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else repr(x) + ("e0" if isinstance(x, float) else "")

    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {value} {whens} ELSE {default} END"


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)
