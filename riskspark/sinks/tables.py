"""Writers: append, keyed upsert, slice replacement, partitioned materialisation, exports.

Rows are checked while they are written to a staging folder beside the target, and put in place by renames
once the checks have passed, so a batch is evaluated once and a failed write leaves the old rows. An upserted
table changes when its next note appears, whole or not at all. Slices and snapshots are swapped folder by
folder; what a job leaves that dies between two renames is made good by the next one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import params as P
from riskspark.operators.dedupe import dedupe_keep_last, keep_first
from riskspark.operators.quality import Watch, key_conditions, missing_columns
from riskspark.session import list_dirs, work_path
from riskspark.sinks.storage import add_files, claim, read_note, recover_folder, remove, replace_folder, swap_partitions, write_note

BUCKET = "_bucket"


def append_rows(df: DataFrame, path: str, truncate: bool = False) -> None:
    """Add rows to a plain table; with ``truncate`` the old rows go once the new ones are all written."""
    spark = df.sparkSession
    recover_folder(spark, path)
    if not truncate:
        df.write.mode("append").parquet(path)
        return
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        df.write.parquet(staged)
    except Exception:
        remove(spark, staged)
        raise
    replace_folder(spark, staged, path.rstrip("/"))


def replace_partitions(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str] | None = None) -> None:
    """Overwrite only the partitions present in ``df``.

    ``rebalance`` gives each partition value few, evenly sized files and lets adaptive execution
    split a partition that holds much more than the others.
    """
    rows = df.hint("rebalance", *partition_by)
    if sort_by:
        rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def materialize(df: DataFrame, path: str, partition_by: list[str], cluster_by: list[str]) -> None:
    """Partitioned table whose files are sorted, so row-group statistics prune by the cluster keys."""
    replace_partitions(df, path, partition_by, cluster_by)


def _stage(
    batch: DataFrame,
    folder: str,
    keys: list[str],
    sequence: str,
    parts: list[str] | None = None,
    state: str | None = None,
    newest: list[Column] | None = None,
) -> tuple[DataFrame, int]:
    """The checked batch with one row per key, written to ``folder`` in the one pass that evaluates it.

    Returns the rows read back, and how many rows the batch had. A batch that breaks a check leaves nothing.
    """
    spark = batch.sparkSession
    needed = [*keys, *[c for c in parts or [] if c not in keys]]
    missing = missing_columns(batch, needed)
    if missing:
        raise ValueError(f"batch lacks key columns: {', '.join(missing)}")
    watch = Watch(batch, key_conditions(needed, state))
    rows = keep_first(watch.rows, keys, newest) if newest else dedupe_keep_last(watch.rows, keys, sequence)
    try:
        if parts:
            rows.hint("rebalance", *parts).write.partitionBy(*parts).parquet(folder)
        else:
            rows.write.parquet(folder)
        written = spark.read.schema(batch.schema).parquet(folder)
        return written, watch.raise_on_violations(written)
    except Exception:
        remove(spark, folder)
        raise


def merge_rows(target: DataFrame, batch: DataFrame, keys: list[str], newest: list[Column] | None = None) -> DataFrame:
    """Target with the batch merged in: matched keys updated, others inserted.

    With ``newest`` (a total order) the row that sorts first wins instead of the batch, for late arrivals.
    """
    if newest:
        return keep_first(target.unionByName(batch, allowMissingColumns=True), keys, newest)
    kept = target.join(batch.select(*keys), keys, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def fitted(batch: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The batch with a stored table's types; columns it lacks are NULL, new ones follow.

    A value that does not fit a key's stored type fails the job: it would become another key.
    """
    columns = []
    for field in schema:
        if field.name not in batch.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.name in keys and batch.schema[field.name].dataType != field.dataType:
            old, new = F.col(field.name), F.col(field.name).try_cast(field.dataType)
            wrong = F.raise_error(F.concat(F.lit(f"{field.name} does not fit the table: "), old.cast("string")))
            columns.append(F.when(old.isNull() | new.isNotNull(), new).otherwise(wrong).alias(field.name))
        else:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
    known = set(schema.names)
    return batch.select(*columns, *[c for c in batch.columns if c not in known])


ROWS_PER_BUCKET = 5_000_000


def upsert(
    batch: DataFrame,
    path: str,
    keys: list[str],
    sequence: str,
    newest: list[Column] | None = None,
    state: str | None = None,
    buckets: int | None = None,
    batch_id: tuple[str, int] | None = None,
) -> None:
    """Keyed merge into a Parquet table kept in hash buckets of the key.

    Bucket count, column types and keys are stored with the table at its first load and hold from then
    on: later batches are fitted to them, another bucket count or key is an error, new columns are
    added. Without ``buckets`` the first load sets their number by its rows. Only buckets that the
    batch touches are read, and each is written once, to a folder of this load. The table's next note
    then names the folder of every bucket: readers see the load as a whole or not at all, and a job that
    dies anywhere leaves the table as it was. The load before stays on disk for readers under way.

    ``batch_id``, a source's name and a number that grows, is remembered with the table: a batch that is
    in the table already changes nothing when it comes again. Ties of ``newest`` are settled by the
    sequence and then by all columns, so the result does not depend on partitioning.
    """
    spark = batch.sparkSession
    number, note = read_note(spark, path)
    places, batches = {}, {}
    if note:
        places, batches = note["places"], note["batches"]
        if batch_id and batches.get(batch_id[0], -1) >= batch_id[1]:
            return
        stored = T.StructType.fromJson(note["schema"])
        if note["keys"] != keys:
            raise ValueError(f"the table's key is {note['keys']}, not {keys}")
        if buckets not in (None, note["buckets"]):
            raise ValueError(f"the table has {note['buckets']} buckets, not {buckets}")
        buckets, batch = note["buckets"], fitted(batch, stored, keys)
    rest = [c for c in sorted(batch.columns) if c not in keys]
    total = [*newest, F.col(sequence).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest]] if newest else None
    staged = work_path(spark, "upsert-batch")
    clean, rows = _stage(batch, staged, keys, sequence, None, state, total)
    if buckets is None:
        buckets = max(64, -(-rows // ROWS_PER_BUCKET))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in batch.schema])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    merged = clean
    if places:
        touched = [str(r[0]) for r in clean.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        held = _rows_at(spark, path, {b: places[b] for b in touched if b in places}, schema)
        merged = merge_rows(held, clean, keys, total)
    claim(spark, path)
    load = f"load-{number + 1:010d}-{uuid.uuid4().hex[:8]}"
    merged.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{load}")
    written = [name.partition("=")[2] for name in list_dirs(spark, f"{path}/{load}")]
    places = {**places, **{b: load for b in written}}
    if batch_id:
        batches = {**batches, batch_id[0]: batch_id[1]}
    changed = {"buckets": buckets, "keys": keys, "schema": json.loads(schema.json()), "places": places, "batches": batches}
    write_note(spark, path, number + 1, changed)
    remove(spark, staged)
    sweep(spark, path)


def sweep(spark: SparkSession, path: str) -> None:
    """Remove the buckets that neither the newest note nor the one before it names."""
    number, note = read_note(spark, path)
    _, before = read_note(spark, path, back=1)
    named = {f"{load}/{BUCKET}={b}" for n in (note, before) if n for b, load in n["places"].items()}
    for load in list_dirs(spark, path):
        if load.startswith("load-") and int(load.split("-")[1]) <= number:
            held = {f"{load}/{name}" for name in list_dirs(spark, f"{path}/{load}")}
            old = held - named
            remove(spark, *([f"{path}/{load}"] if old == held else [f"{path}/{name}" for name in old]))


def _rows_at(spark: SparkSession, path: str, places: dict[str, str], schema: T.StructType) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{load}/{BUCKET}={b}" for b, load in sorted(places.items())])


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """All rows with the table's stored columns, whichever files have them."""
    _, note = read_note(spark, path)
    if note is None:
        raise ValueError(f"{path} is no upserted table")
    return _rows_at(spark, path, note["places"], T.StructType.fromJson(note["schema"]))


def typed(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Declared columns in order, cast to their type; columns the frame lacks become NULL."""
    return df.select(
        *[
            (F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)).alias(name)
            for name, kind in schema.items()
        ]
    )


def typed_upsert(
    batch: DataFrame, path: str, schema: dict[str, str], keys: list[str], sequence: str, buckets: int | None = None,
    batch_id: tuple[str, int] | None = None,
) -> None:
    """Upsert with declared types; ``updated_at`` is stamped on inserted and updated rows only."""
    rows = typed(batch, {**schema, sequence: "bigint"}).withColumn("updated_at", F.current_timestamp())
    upsert(rows, path, keys, sequence, buckets=buckets, batch_id=batch_id)


def replace_slice(
    batch: DataFrame, path: str, keys: list[str], slice_columns: list[str], sequence: str, state: str | None = None
) -> None:
    """Replace every (state, slice) present in the batch with the batch's rows.

    The batch must be the complete picture of its slices.
    """
    parts = ["state", *[c for c in slice_columns if c != "state"]]
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    _stage(batch, staged, keys, sequence, parts, state)
    swap_partitions(batch.sparkSession, staged, path, len(parts))


def append_slice(
    batch: DataFrame, path: str, keys: list[str], slice_columns: list[str], sequence: str, state: str | None = None
) -> None:
    """Same checks as replace_slice, append only: for a first load into empty slices."""
    parts = ["state", *[c for c in slice_columns if c != "state"]]
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    _stage(batch, staged, keys, sequence, parts, state)
    add_files(batch.sparkSession, staged, path, len(parts))


def fill_columns(df: DataFrame, defaults: dict[str, tuple[str, object]], order: list[str]) -> DataFrame:
    """Add absent columns with their typed default, then fix the column order."""
    absent = {c: F.lit(value).cast(kind) for c, (kind, value) in defaults.items() if c not in df.columns}
    return (df.withColumns(absent) if absent else df).select(*order)


BYTE_ORDER_MARK = "\ufeff"


def export_csv(df: DataFrame, path: str, order: list[Column], single_file: bool = False) -> None:
    """Sorted CSV with header and a UTF-8 byte-order mark at the start of every file.

    The order is that of a range-partitioned sort, file after file; one file only when asked for.
    The mark is part of the first column's title, which is where the writer starts a file.
    """
    rows = df.orderBy(*order)
    rows = rows.coalesce(1) if single_file else rows
    first, *others = df.columns
    marked = rows.select(F.col(first).alias(BYTE_ORDER_MARK + first), *others)
    marked.write.mode("overwrite").option("header", True).csv(path)


def marked_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, has_mark) of an export: whether each file starts with the byte-order mark.

    The text reader leaves out the mark and the line ends; whatever else is missing from a file's size is no mark.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("n")
    )
    files = lines.groupBy("file", "size").agg(F.sum(F.col("n") + 1).alias("n"))
    return files.select("file", (F.col("size") - F.col("n") == len(BYTE_ORDER_MARK.encode())).alias("has_mark"))


# --- serving records ---------------------------------------------------------------------

HISTORY_TYPE = (
    "array<struct<year:bigint,arrears_pct:double,processed_arrears:double,revenue_realized:double,chronic:boolean>>"
)


def serving_records(
    scores: DataFrame, integers: list[str], booleans: list[str], texts: list[str], doubles: list[str], history: str
) -> DataFrame:
    """Rows for the serving store, keyed (entity_id, state): no NaN, no text nulls, parsed history."""

    def clean_text(name: str) -> Column:
        return F.when(~F.col(name).isin(P.SERVING_NULL_TOKENS), F.col(name))

    def finite(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    parsed = F.from_json(clean_text(history), HISTORY_TYPE)
    return scores.select(
        "entity_id",
        F.upper("state").alias("state"),
        *[clean_text(c).alias(c) for c in texts],
        *[finite(c).cast("bigint").alias(c) for c in integers],
        *[finite(c).alias(c) for c in doubles],
        *[F.col(c).cast("boolean").alias(c) for c in booleans],
        F.coalesce(parsed, F.array()).alias(history),
    )
