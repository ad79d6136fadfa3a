"""Token counts by scanning flat, unindexed token files for end-of-document identifiers.

A token file is nothing but identifiers of a fixed width, each document followed by the separator
identifier; there is no index and no length anywhere. Files are cut into blocks, each block is searched
with one vectorised comparison, and documents that run over block borders are stitched by a prefix scan:
running sums of identifiers and documents and a running maximum of separator positions per file.

Defined results: a document without tokens counts 0; identifiers after the last separator of a file are
one more document with ``closed`` false; a file whose size is no multiple of the width fails; an empty
file has no documents. Files are read by Spark's binary source, which reads at most 2 GB per file and
fails, without skipping, beyond.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.common import whole

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256
WIDTH = ">u2"
BLOCK = 1 << 18  # identifiers
# fixed value: the pattern of words that belongs to the vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    lines = Path(vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_flat(
    docs: DataFrame, path: str, parts: list[str], order: list[str], text: str = "text", vocabulary: str = VOCABULARY
) -> None:
    """Token files of all documents below ``path``, one folder per value of the ``parts`` columns.

    Rows of one part must come from one partition of ``docs``; they are written in the given order.
    The text writer puts a line end after each row: rows end one byte before the separator does, and
    the line end is that byte, so the files are flat.
    """
    end = np.array([SEPARATOR], WIDTH).tobytes()
    if end[-1] > 127:
        raise ValueError("the separator's last byte must be ASCII")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(vocabulary)
        for batch in batches:
            found = [
                tokens.encode_to_numpy(t.as_py(), disallowed_special=()).astype(WIDTH).tobytes() + end[:-1] for t in batch.column(0)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], names=["ids", *batch.schema.names[1:]])

    keys = list(dict.fromkeys([*parts, *order]))
    rows = docs.select(whole(text).alias("_tf_text"), *keys)
    schema = "ids binary, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    rows = rows.mapInArrow(encode, schema).sortWithinPartitions(*parts, *order)
    (rows.select(F.col("ids").cast("string"), *parts).write.partitionBy(*parts)
        .option("lineSep", chr(end[-1])).option("compression", "none").text(path))


def scan(spark: SparkSession, path: str, group: list[str], separator: int = SEPARATOR, width: str = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per document: the ``group`` columns, its number among their documents from 0, n_tokens, closed.

    Files of one group follow each other in the order of their paths' further partition columns.
    """
    size = np.dtype(width).itemsize
    step = block * size
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    order = [c for c in found.columns if c not in ("path", "modificationTime", "length", "content", *group)]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at")
    pieces = found.filter("length > 0").select(*group, *order, "path", "length", "content", starts)
    pieces = pieces.select(
        *group, *order, "path", "at", "length",
        F.substring("content", (F.col("at") + 1).cast("int"), F.lit(step)).alias("content"),
    )
    keys = [*group, *order, "path", "at", "length"]
    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in keys)
    schema += ", n_ids long, n_ends long, last_end long, lengths array<long>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(len(keys)):
                raw = content.as_buffer()
                if raw.size % size:
                    raise ValueError(f"a token file's size is no multiple of {size}")
                ends = np.flatnonzero(np.frombuffer(raw, width) == separator)
                # the first length is what precedes the first separator in this block
                rows.append((raw.size // size, len(ends), int(ends[-1]) + 1 if len(ends) else 0, np.diff(ends, prepend=-1) - 1))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else []
            if columns:
                names = [*keys, "n_ids", "n_ends", "last_end", "lengths"]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names=names)

    blocks = pieces.select(*keys, "content").mapInArrow(search, schema)
    place = [*order, "path", "at"]
    in_file = Window.partitionBy(*group, *order, "path").orderBy("at")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    ids_before = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    blocks = blocks.withColumn("ids_before", ids_before)
    end = F.when(F.col("n_ends") > 0, F.col("ids_before") + F.col("last_end"))
    blocks = blocks.withColumn("end", end)
    blocks = blocks.withColumn("open", F.col("ids_before") - F.coalesce(F.max("end").over(before), F.lit(0)))
    last = F.col("at") + step >= F.col("length")
    rest = F.col("ids_before") + F.col("n_ids") - F.coalesce(F.max("end").over(in_file.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    blocks = blocks.withColumn("rest", F.when(last & (rest > 0), rest))
    documents = F.col("n_ends") + F.col("rest").isNotNull().cast("long")
    in_group = Window.partitionBy(*group).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("documents_before", F.coalesce(F.sum(documents).over(in_group), F.lit(0)))
    closed = F.transform("lengths", lambda x, i: F.struct((F.when(i == 0, x + F.col("open")).otherwise(x)).alias("n"), F.lit(True).alias("closed")))
    tail = F.when(F.col("rest").isNotNull(), F.array(F.struct(F.col("rest").alias("n"), F.lit(False).alias("closed")))).otherwise(
        F.array().cast("array<struct<n:bigint,closed:boolean>>")
    )
    rows = blocks.select(*group, "documents_before", F.posexplode(F.concat(closed, tail)).alias("i", "doc"))
    return rows.select(
        *group, (F.col("documents_before") + F.col("i")).alias("number"), F.col("doc.n").alias("n_tokens"), F.col("doc.closed").alias("closed")
    )
