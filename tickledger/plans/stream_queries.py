"""Streaming queries: the events are read as a stream, worked off, and the sink is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.operators import compaction, restore
from tickledger.plans.log_queries import GENERATION
from tickledger.plans.shape import plain
from tickledger.plans.state_queries import SPLIT_US
from tickledger.session import configure, shared_path
from tickledger.sources import sample
from tickledger.streaming import chain, fence, fires, projections

KEY = S.KEY_COLUMNS
FILES = 4  # the log arrives in so many slices of time; odd partitions are one slice behind
FOLD_EVERY = 2


def _log(spark: SparkSession, sf: str, damaged: bool = False, redelivered: bool = False) -> DataFrame:
    """The log as a stream of ``FILES`` slices, out of order between partitions."""
    rows = sample.spread_records(configure(spark), sf)
    if redelivered:
        rows = sample.with_redelivery(rows)
    path = shared_path(spark, "log")
    _, parts = sample.write_in_files(rows, path, FILES)
    return sample.to_envelope(sample.stream_files(spark, path, rows.schema, parts), damaged)


def stream_timers(spark: SparkSession, sf: str) -> DataFrame:
    base = shared_path(spark, "stream-timers")
    projections.run(_log(spark, sf), projections.timers_handler(base, every=FOLD_EVERY), f"{base}/checkpoint")
    rows = projections.current_timers(projections.read_table(spark, base, projections.TIMER_CHANGES))
    return plain(rows.select(*KEY, "created_offset", "created_at", "create.schedule.cron", "create.schedule.max_executions"))


def stream_dedup_executions(spark: SparkSession, sf: str) -> DataFrame:
    base = shared_path(spark, "stream-executions")
    handler = projections.executions_handler(spark, f"{base}/rows")
    projections.run(_log(spark, sf, redelivered=True), handler, f"{base}/checkpoint")
    rows = projections.read_changes(spark, f"{base}/rows", projections.EXECUTION_ROWS)
    return plain(rows.select(*KEY, "kafka_timestamp", "offset"))


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    base = shared_path(spark, "stream-progress")
    projections.run(_log(spark, sf), projections.progress_handler(base, every=FOLD_EVERY), f"{base}/checkpoint")
    changes = projections.read_table(spark, base, projections.PROGRESS_CHANGES)
    return plain(projections.current_progress(changes).drop("partition"))


def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    base = shared_path(spark, "stream-quarantine")
    handler = projections.quarantine_handler(f"{base}/good", f"{base}/bad")
    projections.run(_log(spark, sf, damaged=True), handler, f"{base}/checkpoint")
    bad = projections.read_changes(spark, f"{base}/bad", projections.BAD_ROWS)
    return plain(bad.select("topic", "offset", "reason"))


def _run_fires(spark: SparkSession, records: DataFrame, label: str, lag: bool = True, **options) -> DataFrame:
    """Events of the timers of some records, which arrive in ``FILES`` slices and, with ``lag``, out of order."""
    base = shared_path(spark, label)
    delay, parts = sample.write_in_files(records, f"{base}/log", FILES, lag, closing=True)
    events = fires.fires(sample.stream_files(spark, f"{base}/log", records.schema, parts), delay, **options)
    writer = events.writeStream.format("parquet").option("path", f"{base}/events")
    query = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    fires.run_checked(query)
    out = spark.read.schema(fires.OUTPUT_SCHEMA).parquet(f"{base}/events")
    return out.select(*KEY, "event", "n", "fire_us")


def stream_fires(spark: SparkSession, sf: str) -> DataFrame:
    return _run_fires(spark, sample.spread_records(configure(spark), sf), "stream-fires")


def late_fires(spark: SparkSession, sf: str) -> DataFrame:
    """One fire per timer and watermark for all that was missed: slices in order, a watermark after each."""
    return _run_fires(spark, sample.spread_records(configure(spark), sf), "late-fires", lag=False, catch_up="coalesce")


def stream_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Timers of the older half of the log restored with their progress, the newer half live."""
    old = F.unix_micros("timestamp") < SPLIT_US
    records = sample.spread_records(configure(spark), sf)
    past = records.where(old)
    state = restore.restore_state(compaction.live_creates(past, parts=("schedule",)), compaction.progress_latest(past))
    return _run_fires(spark, records.where(~old), "stream-restore", restored=state)


def stream_fence(spark: SparkSession, sf: str) -> DataFrame:
    """The create log as far as each partition has seen the marker of its own generation."""
    base = shared_path(spark, "stream-fence")
    writer = fence.released(_log(spark, sf), GENERATION).writeStream.format("parquet").option("path", f"{base}/rows")
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(fence.OUTPUT_SCHEMA).parquet(f"{base}/rows")
    return plain(rows.select("partition", "offset", "fence", "phase", F.col("key").isNull().alias("is_marker")))


def stream_chain(spark: SparkSession, sf: str) -> DataFrame:
    """What the projected tables say after timers have fired over the whole log: executions and progress by timer."""
    base = shared_path(spark, "stream-chain")
    records = sample.spread_records(configure(spark), sf)
    delay, parts = sample.write_in_files(records, f"{base}/commands", FILES, closing=True)
    chain.run(sample.stream_files(spark, f"{base}/commands", records.schema, parts), delay, base, sample.PARTITIONS, spark, FOLD_EVERY)
    done = projections.read_changes(spark, f"{base}/executions", projections.EXECUTION_ROWS)
    counted = done.groupBy(*KEY).agg(F.count(F.lit(1)).alias("executions"))
    progress = projections.current_progress(projections.read_table(spark, f"{base}/progress", projections.PROGRESS_CHANGES))
    return plain(counted.join(progress, KEY, "full").select(*KEY, "executions", "completed_executions", "last_execution"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_timers, stream_dedup_executions, stream_progress, stream_quarantine, stream_fires, late_fires,
        stream_restore, stream_fence, stream_chain,
    )
}
