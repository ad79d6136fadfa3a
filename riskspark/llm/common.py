"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import prepare, work_path

SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the cluster's shared folder and read back: cuts lineage durably."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(column: str = "text") -> Column:
    """A text column with NULL as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo the number of folds; a NULL id falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ids take 8 bytes: at most 16 MB of them are broadcast, more are joined by shuffle
BROADCAST_IDS = 2_000_000


def bounded(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids, marked for broadcast only where its counted size allows."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def batches_by_key(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of sorted batches, regrouped so that equal keys never fall into two batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(batch)  # one key all through
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        held.append(batch.slice(0, cut))
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(b.num_rows for b in held) else held[0]
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fixed_binary(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return flat.reshape(len(column), -1).view(dtype).reshape(len(column), width)
