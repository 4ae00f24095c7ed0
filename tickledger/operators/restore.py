"""Restore timers from live creates and saved progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import keys

KEY = S.KEY_COLUMNS
# fixed value: an unset time read as a zero time
ZERO_TIME_US = -62_135_596_800_000_000


def normalize_progress(df: DataFrame, zero_time: bool = False) -> DataFrame:
    """Missing progress means no executions yet.

    ``zero_time`` reads a saved progress without a last time as year 1, which makes the timer due
    at once; by default such a timer has simply not run.
    """
    last = F.col("last_execution")
    if zero_time:
        saved = F.col("completed_executions").isNotNull()
        last = F.coalesce(last, F.when(saved, F.timestamp_micros(F.lit(ZERO_TIME_US))))
    return df.withColumn("last_execution", last).withColumn(
        "completed_executions", F.coalesce(F.col("completed_executions"), F.lit(0))
    )


def restore_state(creates: DataFrame, progress: DataFrame, zero_time: bool = False) -> DataFrame:
    """Live creates with their progress: one row per timer, schedule fields at the top.

    Both sides come out of an aggregate on the key, so the join adds no shuffle of its own.
    """
    saved = progress.select(*KEY, "completed_executions", "last_execution")
    joined = normalize_progress(creates.join(saved, KEY, "left"), zero_time)
    return joined.select(
        *KEY, "create.schedule.*", "completed_executions", "last_execution", F.col("timestamp").alias("created_at")
    )


def with_partition(progress: DataFrame, partitions: int) -> DataFrame:
    """The partition each timer belongs to, as the progress table documents it."""
    return progress.withColumn("partition", keys.partition_of(F.col("timer_uuid"), partitions))


def progress_by_partition(progress: DataFrame, wanted: DataFrame) -> DataFrame:
    """Progress rows of a list of partitions (bounded by the partition count of the topic)."""
    return progress.join(F.broadcast(wanted.select("partition").distinct()), "partition", "left_semi")
