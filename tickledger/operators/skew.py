"""Joins and running values that stay bounded when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one (partition, offset range) block; offsets are unique in a partition, so this is a bound.
BLOCK_ROWS = 1_000_000


def split_join(big: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``big`` joined to a table with one row per key, so that the rows of a hot key can be split.

    Adaptive execution splits a large partition of a join only if both sides come straight out of
    an exchange made for that join; a side that was just aggregated by the key does not. Packing the
    keys makes the small side be dealt once more, and the big side stays splittable.
    """
    packed = F.struct(*[F.col(k) for k in keys]).alias("_packed")
    values = [c for c in per_key.columns if c not in keys]
    return big.select("*", packed).join(per_key.select(packed, *values), "_packed", how).drop("_packed")


def running_by_key(
    df: DataFrame,
    keys: list[str],
    number: str,
    previous: str,
    carried: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the rows of each key in log order and fetch a column of the row before.

    Rows are windowed inside blocks of ``block_rows`` offsets of one partition, so no task ever
    sorts a whole hot key; the counts and last values of the blocks are then carried forward over
    one row per (key, block).
    """
    block = (F.col("offset") - F.pmod(F.col("offset"), F.lit(block_rows))).alias("_block")
    block_keys = [*keys, "partition", "_block"]
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*block_keys).orderBy("offset")
    numbered = blocked.withColumn("_n", F.row_number().over(inside)).withColumn(
        "_previous", F.lag(carried).over(inside)
    )
    ends = blocked.groupBy(*block_keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.max_by(carried, "offset").alias("_last")
    )
    over_blocks = Window.partitionBy(*keys).orderBy("partition", "_block")
    earlier = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.select(
        *block_keys,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"),
        F.lag("_last").over(over_blocks).alias("_carry"),
    )
    return numbered.join(carries, block_keys).select(
        *df.columns,
        (F.col("_base") + F.col("_n")).alias(number),
        F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_previous")).alias(previous),
    )
