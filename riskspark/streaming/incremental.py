"""Incremental loads with file-source streams: every new file is taken once.

Late or repeated records need no watermark: the newest update of a key wins, whatever order the files
arrive in, and replaying a micro-batch changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.text import blank_or_null
from riskspark.operators.dedupe import dedupe_latest, keep_first
from riskspark.session import list_dirs, path_exists, work_path
from riskspark.sinks.storage import claim, read_note, remove, write_note
from riskspark.sinks.tables import replace_partitions, replace_slice, upsert

FAIL, SKIP = "FAILFAST", "DROPMALFORMED"  # skipping bad lines is the rule for procurement files only


def load_new_files(
    spark: SparkSession, source: str, schema: str, checkpoint: str, load: Callable[[DataFrame, int], None],
    files_per_batch: int | None = None, bad_lines: str = FAIL,
) -> None:
    """Run ``load`` on micro-batches of unseen JSON files until none is left.

    All unseen files form one micro-batch unless ``files_per_batch`` splits them.
    """
    reader = spark.readStream.schema(schema).option("mode", bad_lines)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = reader.json(source).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def incremental_upsert(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    keys: list[str],
    sequence: str,
    newest: list[Column],
    files_per_batch: int | None = None,
    buckets: int | None = None,
    bad_lines: str = FAIL,
) -> None:
    """Keep the newest version of each key in ``target``, which remembers the micro-batches it holds."""

    def load(batch: DataFrame, number: int) -> None:
        upsert(batch, target, keys, sequence, newest=newest, buckets=buckets, batch_id=(checkpoint, number))

    load_new_files(spark, source, schema, checkpoint, load, files_per_batch, bad_lines)


# --- slices that arrive in loads ----------------------------------------------------------

STATE_OF_LOADS = "_landed bigint, _expected bigint, _clashing boolean, _blank bigint, _batches array<bigint>, _rows bigint, _digest decimal(38,0)"


def _digest(columns: list[str]) -> Column:
    """An order-free digest of rows."""
    return F.sum(F.xxhash64(*sorted(columns)).cast("decimal(38,0)"))


def _batch_numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in list_dirs(spark, folder) if "=" in n) if path_exists(spark, folder) else []


class SliceLoads:
    """What has landed of each (state, slice, load), what is expected, and what was published.

    The ledger is a small table beside the checkpoint with one row per slice and load: landed rows and the
    batches that hold them, the rows that the load's marker announces, and, once published, the rows
    and digest of the slice. Each settlement writes the next version, which a numbered note names together with the
    batches it has seen, so a settlement that died is repeated from the version before. Loads at or below
    the published one of their slice are left out.
    """

    def __init__(self, spark: SparkSession, checkpoint: str, slice_fields: dict[str, str], load: str):
        base = checkpoint.rstrip("/")
        self.spark, self.load, self.parts = spark, load, list(slice_fields)
        self.landing, self.arrivals = f"{base}-landing", f"{base}-arrivals"
        self.markers, self.ledger = f"{base}-markers", f"{base}-ledger"
        self.key = [*self.parts, load]
        self.key_types = ", ".join(f"{name} {kind}" for name, kind in {**slice_fields, load: "bigint"}.items())

    # landing

    def land(self, batch: DataFrame, number: int, keys: list[str]) -> None:
        """Write a batch and count its rows by slice and load; a replayed batch lands in its own place."""
        replace_partitions(batch.withColumn("_batch", F.lit(number)), self.landing, ["_batch"])
        landed = self.spark.read.schema(batch.schema).parquet(f"{self.landing}/_batch={number}")
        blank = F.count_if(reduce(lambda a, b: a | b, [blank_or_null(F.col(c).cast("string")) for c in keys]))
        counted = landed.groupBy(*self.key).agg(F.count(F.lit(1)).alias("_landed"), blank.alias("_blank"))
        counted.coalesce(1).write.mode("overwrite").parquet(f"{self.arrivals}/_batch={number}")

    def announce(self, markers: DataFrame, number: int) -> None:
        rows = markers.select(*self.key, F.col("expected_rows").alias("_expected"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.markers}/_batch={number}")

    # settlement

    def news(self) -> tuple[int, dict, list[int], list[int]]:
        """Number and content of the ledger's note, and the batches of rows and markers it has not seen."""
        number, note = read_note(self.spark, self.ledger)
        note = note or {"version": None, "arrivals": -1, "markers": -1}
        arrivals = [n for n in _batch_numbers(self.spark, self.arrivals) if n > note["arrivals"]]
        markers = [n for n in _batch_numbers(self.spark, self.markers) if n > note["markers"]]
        return number, note, arrivals, markers

    def _read(self, folder: str, numbers: list[int], schema: str) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], f"{schema}, _batch bigint")
        paths = [f"{folder}/_batch={n}" for n in numbers]
        return self.spark.read.option("basePath", folder).schema(f"{schema}, _batch bigint").parquet(*paths)

    def held(self, note: dict) -> DataFrame:
        schema = f"{self.key_types}, {STATE_OF_LOADS}"
        if note["version"] is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.ledger}/{note['version']}")

    def merged(self, note: dict, arrivals: list[int], markers: list[int]) -> DataFrame:
        """The ledger with the unseen batches added, one row per slice and load."""
        new = self._read(self.arrivals, arrivals, f"{self.key_types}, _landed bigint, _blank bigint")
        told = self._read(self.markers, markers, f"{self.key_types}, _expected bigint")
        rows = self.held(note).withColumn("_least", F.col("_expected"))
        rows = rows.unionByName(new.withColumn("_batches", F.array("_batch")).drop("_batch"), allowMissingColumns=True)
        rows = rows.unionByName(told.drop("_batch").withColumn("_least", F.col("_expected")), allowMissingColumns=True)
        return rows.groupBy(*self.key).agg(
            F.coalesce(F.sum("_landed"), F.lit(0)).alias("_landed"),
            F.max("_expected").alias("_expected"),
            (F.min("_least") < F.max("_expected")).alias("_clashing"),
            F.coalesce(F.sum("_blank"), F.lit(0)).alias("_blank"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_batches")))).alias("_batches"),
            F.max("_rows").alias("_rows"),
            F.max("_digest").alias("_digest"),
        )

    def refuse(self, rows: DataFrame) -> None:
        """Stop on rows that belong to no slice or load, and on markers that contradict themselves."""
        checks = {f"blank_{c}": F.when(blank_or_null(F.col(c).cast("string")), F.col("_landed")) for c in self.key}
        checks |= {"blank_key": F.col("_blank"), "clashing_markers": F.col("_clashing").cast("bigint")}
        checks["expected_rows_below_1"] = (F.col("_expected") < 1).cast("bigint")
        found = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in checks.items()]).first().asDict()
        bad = [f"{name}={n}" for name, n in found.items() if n]
        if bad:
            raise ValueError("; ".join(bad))

    def open_loads(self, rows: DataFrame) -> DataFrame:
        """Loads newer than the published one of their slice."""
        last = F.max(F.when(F.col("_rows").isNotNull(), F.col(self.load))).over(Window.partitionBy(*self.parts))
        return rows.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col(self.load) > F.col("_last"))).drop("_last")

    def settle(self, schema: str, target: str, keys: list[str], sequence: str) -> None:
        """Publish the newest complete load of every slice that has a new one."""
        number, note, arrivals, markers = self.news()
        if not arrivals and not markers:
            return
        spark, work = self.spark, work_path(self.spark, "slice-loads")
        self.merged(note, arrivals, markers).write.parquet(f"{work}/rows")
        rows = spark.read.schema(f"{self.key_types}, {STATE_OF_LOADS}").parquet(f"{work}/rows")
        self.refuse(rows)
        ready = self.open_loads(rows).filter("_landed >= _expected")
        # landed files of these loads; at most one number per batch reaches the driver
        numbers = sorted(r[0] for r in ready.select(F.explode("_batches")).distinct().collect())
        published = rows.filter("_rows IS NOT NULL")
        if numbers:
            landed = self._read(self.landing, numbers, schema).drop("_batch")
            wanted = landed.join(ready.select(*self.key, "_expected"), self.key)
            rows_of = dedupe_latest(wanted, [*keys, *[c for c in self.key if c not in keys]], [sequence])
            rows_of.write.parquet(f"{work}/complete")
            staged = spark.read.schema(rows_of.schema).parquet(f"{work}/complete")
            counted = staged.groupBy(*self.key).agg(
                F.max("_expected").alias("_expected"),
                F.count(F.lit(1)).alias("_rows"),
                _digest([c for c in staged.columns if c != "_expected"]).alias("_digest"),
            )
            counted.write.parquet(f"{work}/counted")
            counted = spark.read.schema(counted.schema).parquet(f"{work}/counted")
            over = counted.filter("_rows > _expected").select(*self.key, "_expected", "_rows").take(3)
            if over:
                raise ValueError(f"more rows landed than the markers announce: {[tuple(r) for r in over]}")
            newest = [F.col(self.load).desc()]
            chosen = keep_first(counted.filter("_rows = _expected"), self.parts, newest)
            chosen.write.parquet(f"{work}/chosen")
            chosen = spark.read.schema(chosen.schema).parquet(f"{work}/chosen")
            if not chosen.isEmpty():
                new_rows = staged.join(chosen.select(*self.key), self.key, "left_semi").drop("_expected")
                replace_slice(new_rows, target, keys, self.parts, sequence)
                done = rows.drop("_rows", "_digest").join(chosen.select(*self.key, "_rows", "_digest"), self.key)
                published = published.unionByName(done)
        open_rows = self.open_loads(rows.filter("_rows IS NULL").unionByName(published)).filter("_rows IS NULL")
        newest = keep_first(published, self.parts, [F.col(self.load).desc()])
        version = f"version-{number + 1:010d}-{uuid.uuid4().hex[:8]}"
        claim(spark, self.ledger)
        both = open_rows.unionByName(newest)
        both.select(*self.key, *[f.split()[0] for f in STATE_OF_LOADS.split(", ")]).coalesce(1).write.parquet(f"{self.ledger}/{version}")
        changed = {"version": version, "arrivals": max([note["arrivals"], *arrivals]), "markers": max([note["markers"], *markers])}
        write_note(spark, self.ledger, number + 1, changed)
        remove(spark, work, *([f"{self.ledger}/{note['version']}"] if note["version"] else []))


def incremental_replace_slice(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    keys: list[str],
    slice_columns: list[str],
    sequence: str,
    load_column: str,
    markers: str,
    files_per_batch: int | None = None,
    bad_lines: str = FAIL,
) -> None:
    """Each (state, slice) of ``target`` holds all rows of its newest complete load.

    Loads are numbered by ``load_column``. A marker, a JSON record in the folder ``markers`` with the state,
    the slice's columns, the load and ``expected_rows`` (rows of different keys), says what the load
    brings to a slice; it may come before, among or after the rows. Micro-batches only land their rows beside the checkpoint
    and count them. A load is shown, as a whole, once as many rows as announced have landed; until then
    the slice stays as it was. So loads may be split over any number of files, batches and runs; an older
    load that completes late, a repeated file and a replayed batch change nothing, and rows of a
    load that is published already are ignored. A run without new files reads neither landed rows nor target.
    The job fails on landed rows with a blank key, state, slice column or load number, until their batch is
    removed from the landing and arrivals folders; on markers that differ for one load, or announce
    less than one row; and when more rows land than announced. The target keeps the load number.
    """
    fields = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(schema)}
    parts = ["state", *[c for c in slice_columns if c != "state"]]
    loads = SliceLoads(spark, checkpoint, {c: fields[c] for c in parts}, load_column)

    def land(batch: DataFrame, number: int) -> None:
        loads.land(batch, number, keys)

    load_new_files(spark, source, schema, checkpoint, land, files_per_batch, bad_lines)
    if path_exists(spark, markers):
        told = f"{loads.key_types}, expected_rows bigint"
        load_new_files(spark, markers, told, f"{checkpoint.rstrip('/')}-marker-stream", loads.announce)
    loads.settle(schema, target, keys, sequence)
