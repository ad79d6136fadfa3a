"""Serving records sent to a keyed store in bounded batches, through a Spark data source.

A store is any class that takes the write's options and has ``send(batch)``, which upserts a list of records
by key, all or none, and may be called again with the same records; ``finish(sent)``, called once in the driver
when every task has succeeded; and ``abandon(sent)``, called in the driver instead when the write failed. It is named
by module and class, so that tasks make their own.

Records are checked while they are staged, dealt by key and sorted, so a task that is retried, or a write that
is repeated, sends the same batches again and the store holds every record once.
"""

from __future__ import annotations

import importlib
import json
import os
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from riskspark.operators.quality import Watch, key_conditions, unique
from riskspark.session import work_path
from riskspark.sinks.storage import remove

KEYS = ["entity_id", "state"]
BATCH = 30  # records per request of the published job


@dataclass
class Sent(WriterCommitMessage):
    records: int
    batches: int


def open_store(options: dict):
    module, _, name = options["store"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


class ServingWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = dict(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        store, size = open_store(self.options), int(self.options["batch"])
        waiting: list[dict] = []
        sent = Sent(0, 0)
        for batch in iterator:
            waiting += batch.to_pylist()
            while len(waiting) >= size:
                self._send(store, waiting[:size], sent)
                waiting = waiting[size:]
        if waiting:
            self._send(store, waiting, sent)
        return sent

    def _send(self, store, batch: list[dict], sent: Sent) -> None:
        """One batch; a store that fails is asked again after a growing pause."""
        attempts, pause = int(self.options["attempts"]), float(self.options["pause"])
        for attempt in range(attempts):
            try:
                store.send(batch)
                break
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(pause * 2**attempt)
        sent.records += len(batch)
        sent.batches += 1

    def commit(self, messages: list[Sent | None]) -> None:
        open_store(self.options).finish(_total(messages))

    def abort(self, messages: list[Sent | None]) -> None:
        open_store(self.options).abandon(_total(messages))


def _total(messages: list[Sent | None]) -> Sent:
    done = [m for m in messages if m is not None]
    return Sent(sum(m.records for m in done), sum(m.batches for m in done))


class ServingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "riskspark_serving"

    def writer(self, schema, overwrite: bool) -> ServingWriter:  # noqa: ARG002  the interface's signature
        return ServingWriter(self.options)


def send_records(
    records: DataFrame,
    store: str,
    options: dict[str, str] | None = None,
    keys: list[str] = KEYS,
    batch: int = BATCH,
    senders: int = 8,
    attempts: int = 3,
    pause: float = 0.5,
) -> None:
    """Upsert all records by key into the store ``module:Class``, at most ``senders`` batches at a time.

    Blank or repeated keys fail before anything is sent. A failed write leaves in the store what was sent;
    the same call again completes it.
    """
    if batch < 1 or senders < 1 or attempts < 1:
        raise ValueError("batch, senders and attempts must be at least 1")
    spark = records.sparkSession
    staged = work_path(spark, "serving-records")
    watch = Watch(records, key_conditions(keys))
    try:
        watch.rows.write.parquet(staged)
        rows = spark.read.schema(records.schema).parquet(staged)
        watch.raise_on_violations(rows)
        repeated = unique(rows, keys).agg(F.count(F.lit(1))).first()[0]
        if repeated:
            raise ValueError(f"repeated_key={repeated}")
        spark.dataSource.register(ServingSource)
        dealt = rows.repartition(senders, *keys).sortWithinPartitions(*keys)
        settings = {**(options or {}), "store": store, "batch": batch, "attempts": attempts, "pause": pause}
        dealt.write.format(ServingSource.name()).options(**settings).mode("append").save()
    finally:
        remove(spark, staged)


class FolderStore:
    """A keyed store in a folder that all tasks see: a file per record, replaced as a whole.

    For few records: every record is a file to make, list and open. ``LogStore`` holds many.
    ``_last_run.json`` tells how many records the last complete write sent. Option ``path``.
    """

    def __init__(self, options: dict):
        self.path = Path(options["path"])

    def _put(self, name: str, body: object) -> None:
        self.path.mkdir(parents=True, exist_ok=True)
        aside = self.path / f"_{uuid.uuid4().hex}"
        aside.write_text(json.dumps(body, ensure_ascii=False, default=str))
        os.replace(aside, self.path / name)

    def send(self, batch: list[dict]) -> None:
        for record in batch:
            self._put(f"{record['state']}-{record['entity_id']}.json", record)

    def finish(self, sent: Sent) -> None:
        self._put("_last_run.json", {"complete": True, "records": sent.records, "batches": sent.batches})

    def abandon(self, sent: Sent) -> None:
        self._put("_last_run.json", {"complete": False, "records": sent.records, "batches": sent.batches})


SEGMENT = re.compile(r"segment-(\d{10})-\w+\.log")


class LogStore(FolderStore):
    """A keyed store in a folder that all tasks see: batches are lines of segments, one segment per task and write.

    A line is a checksum and a JSON object: the segment, its number, the line's place in it and the batch. A
    batch whose line is torn was never taken, so a batch holds whole or not at all. Of a key's records the one of
    the highest segment number and place is held; a segment opened after others gets a higher number than
    theirs. Replaced records stay on disk. ``read_log`` reads the store. Option ``path``.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.segment: Path | None = None
        self.number = self.lines = 0

    def _open(self) -> Path:
        self.path.mkdir(parents=True, exist_ok=True)
        numbers = [int(m[1]) for m in map(SEGMENT.fullmatch, os.listdir(self.path)) if m]
        self.number = max(numbers, default=0) + 1
        segment = self.path / f"segment-{self.number:010d}-{uuid.uuid4().hex}.log"
        segment.touch()
        return segment

    def send(self, batch: list[dict]) -> None:
        self.segment = self.segment or self._open()
        self.lines += 1
        head = json.dumps({"segment": self.segment.name, "number": self.number, "line": self.lines})
        body = json.dumps(batch, ensure_ascii=False, default=str)
        line = f'{head[:-1]}, "records": {body}}}'.encode()
        with self.segment.open("ab") as file:  # the first line end closes a line that an earlier try left torn
            file.write(b"\n%d %b\n" % (zlib.crc32(line), line))


def read_log(spark: SparkSession, path: str, schema: str, keys: list[str] = KEYS) -> DataFrame:
    """The records that a ``LogStore`` holds, with the columns of ``schema``."""
    lines = spark.read.option("pathGlobFilter", "segment-*.log").option("lineSep", "\n").schema("value string").text(path)
    checksum, line = F.substring_index("value", " ", 1), F.expr("substring(value, instr(value, ' ') + 1)")
    whole = lines.filter(F.crc32(line.cast("binary")).cast("string") == checksum)
    layout = f"segment string, number long, line long, records array<struct<{schema}>>"
    batches = whole.select(F.from_json(line, layout).alias("b")).select(
        F.struct("b.number", "b.line", "b.segment").alias("_at"), F.inline("b.records")
    )
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_at").desc()))
    return batches.withColumn("_newest", newest).filter("_newest = 1").drop("_at", "_newest")
