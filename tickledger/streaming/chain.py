"""Fires, their log records and the tables made of them as one running chain of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.sources import logs
from tickledger.sources.tables import write_batch
from tickledger.streaming import fires, projections

# A batch takes up to this many bits of the offsets of a partition.
OFFSET_BITS = 40
# Records are numbered in blocks of this much log time; those without a time in so many shares of their keys, behind all others.
BLOCK_US = 3_600_000_000
SHARES = 256
LAST_BLOCK = 1 << 60


def numbered(records: DataFrame, block_us: int = BLOCK_US) -> DataFrame:
    """Records with ``offset``: their number in their partition from 1 on, in order of time, without gaps.

    A partition is never sorted as a whole: records are sorted inside blocks of time, and only the
    sizes of the blocks are carried forward. Records without a time come last, in order of a hash of their key.
    """
    share = F.lit(LAST_BLOCK) + F.pmod(F.xxhash64("key"), F.lit(SHARES))
    block = F.when(F.col("timestamp").isNull(), share).otherwise(F.floor(F.unix_micros("timestamp") / block_us))
    rows = records.withColumn("_block", block)
    place = ["topic", "partition", "_block"]
    earlier = Window.partitionBy("topic", "partition").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(*place, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    arrival = Window.partitionBy(*place).orderBy("timestamp", "key", F.length("value"), "value")
    placed = rows.withColumn("_number", F.row_number().over(arrival)).join(F.broadcast(before), place)
    return placed.withColumn("offset", F.col("_before") + F.col("_number")).drop("_block", "_before", "_number")


def append_handler(path: str, partitions: int) -> Callable[[DataFrame, int], None]:
    """Append what fires and finishes say to a log of files; a batch that runs again writes the same records.

    A partition numbers its records in order of time, as the broker would: fires first, tombstones
    after the fires of their batch. The number of the batch is the upper part of an offset.
    """

    def handle(events: DataFrame, batch_id: int) -> None:
        records = numbered(logs.fire_records(events, partitions))
        offset = F.lit(batch_id << OFFSET_BITS).cast("long") + F.col("offset")
        write_batch(records.withColumn("offset", offset).select(*S.ENVELOPE.fieldNames()), path, batch_id)

    return handle


def run(records: DataFrame, delay: str, base: str, partitions: int, spark: SparkSession, every: int = projections.FOLD_EVERY) -> None:
    """Work off a stream of records: timers fire, fires become log records, these executions and progress.

    Each link reads the files that the one before has written, from its own checkpoint on: they may
    run at the same time or, as here, each as far as its input goes. Tables are below ``base``:
    ``executions`` by day and the folded table ``progress``, made of one decoding of the log.
    """
    events = fires.fires(records, delay).writeStream.format("parquet").option("path", f"{base}/events")
    fires.run_checked(events.option("checkpointLocation", f"{base}/fires").trigger(availableNow=True).start())
    fired = spark.readStream.schema(fires.OUTPUT_SCHEMA).parquet(f"{base}/events")
    projections.run(fired, append_handler(f"{base}/log", partitions), f"{base}/append")
    log = spark.readStream.schema(S.ENVELOPE).parquet(f"{base}/log")
    handler = projections.execute_log_handler(spark, f"{base}/executions", f"{base}/progress", every)
    projections.run(log, handler, f"{base}/to-tables")
