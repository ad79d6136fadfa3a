"""Row-frame aggregates over long per-key histories.

A plain window sends a whole key to one task. Here the position of a row in its key is built
from the time slice it falls in (slice totals plus a position inside the slice), and the frame
is evaluated over blocks of consecutive positions. Each block also receives the last rows of
the block before it, so the frame is exact at block edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which NULL keys meet each other, so no row is lost."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def number_rows(df: DataFrame, keys: list[str], order: list[str], time_slice: Column) -> DataFrame:
    """Add ``position`` (from 0) of each row in its key by ``order``.

    ``time_slice`` must rise with the first order column.
    """
    sliced = df.withColumn("_slice", time_slice)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    local = sliced.withColumn("_in", F.row_number().over(inside) - 1)
    numbered = join_null_safe(local, offsets, [*keys, "_slice"])
    return numbered.withColumn("position", F.col("_skip") + F.col("_in")).drop("_slice", "_skip", "_in")


def trailing(
    numbered: DataFrame,
    keys: list[str],
    frames: dict[str, tuple[int, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add one column per frame: the aggregate over the row and the n-1 rows before it.

    ``frames``: name -> (n, aggregate column). Needs ``position`` from number_rows.
    """
    longest = max(n for n, _ in frames.values())
    if longest > block_rows:
        raise ValueError("a block must hold at least one whole frame")
    block = F.floor(F.col("position") / F.lit(block_rows))
    reaches_next = F.col("position") % block_rows >= block_rows - (longest - 1)
    targets = F.when(reaches_next, F.array(block, block + 1)).otherwise(F.array(block))
    copies = numbered.withColumn("_block", F.explode(targets))
    ordered = Window.partitionBy(*keys, "_block").orderBy("position")
    framed = copies.withColumns({name: agg.over(ordered.rowsBetween(1 - n, 0)) for name, (n, agg) in frames.items()})
    return framed.filter(F.col("_block") == block).drop("_block")
