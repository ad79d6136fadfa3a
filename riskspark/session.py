"""Session settings and the shared work folder that sinks and file jobs use."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on. The skew settings let adaptive execution split a
# hot join key even when the join output is reused by a following aggregate. Small merged partitions keep
# the memory of a task small, and where all partitions of a join's side are small, it is hashed instead of sorting both.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32MB",
}
INPUT_PER_PARTITION = 16 << 20  # bytes as stored


def build(master: str, app: str = "riskspark", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # call-site capture costs a JVM round trip per column expression while plans are built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, folder: str) -> None:
    """At least one shuffle partition per ``INPUT_PER_PARTITION`` of a folder's tables, so a task's memory does not grow with them."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wanted = fs.getContentSummary(jpath).getLength() // INPUT_PER_PARTITION
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))


def cluster_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Shuffle and scan sizing for a large input.

    About 128 MB per shuffle partition before merging, never fewer than three waves of tasks;
    adaptive execution merges what turns out small.
    """
    partitions = max(input_bytes // (128 << 20), 3 * cores)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
        "spark.sql.files.maxPartitionBytes": "256MB",
    }


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="riskspark-")


def work_path(spark: SparkSession, name: str) -> str:
    """A new, empty path under the cluster's shared folder (``spark.checkpoint.dir``).

    A session in one process (``local[...]``, as in tests) may do without the setting; on a cluster
    its absence is an error, since executors would write to disks that others cannot read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/riskspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared work folder: what several branches read is computed once."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Sorted child folder names; used for partition folders, whose number is small."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory())
