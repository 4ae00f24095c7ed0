"""Queries over compacted state: timers, executions, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.operators import access, compaction, restore
from tickledger.plans.log_queries import GENERATION
from tickledger.plans.shape import plain
from tickledger.session import configure, shared_path
from tickledger.sources import logs, sample, tables

KEY = S.KEY_COLUMNS
TENANT = "u7"
SPLIT_US = 1_705_363_200_000_000  # 2024-01-16: rows before it are the older batch


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return sample.records(configure(spark), sf)


def live_creates(spark: SparkSession, sf: str) -> DataFrame:
    rows = compaction.live_creates(_records(spark, sf), parts=("schedule",))
    return plain(rows.select(*KEY, "offset", "create.schedule.cron", "create.schedule.start_time"))


def compact_log(spark: SparkSession, sf: str) -> DataFrame:
    return plain(compaction.compact_keys(_records(spark, sf)))


def create_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = compaction.create_sessions(_records(spark, sf), delete_on="any", parts=("schedule",))
    return plain(rows.select(*KEY, "has_delete", "deleted_at", "created_offset"))


def timers_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = compaction.timers_projection(_records(spark, sf), parts=("schedule",))
    return plain(rows.select(*KEY, "created_offset", "created_at", "create.schedule.cron", "create.schedule.max_executions"))


def apply_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    return plain(compaction.apply_tombstones(compaction.upserts(records), records).select("topic", "offset", *KEY))


def executions_append(spark: SparkSession, sf: str) -> DataFrame:
    """Older batch first, then the newer one with redeliveries of both."""
    arriving = sample.with_redelivery(_records(spark, sf))
    old = F.unix_micros("timestamp") < SPLIT_US
    path = shared_path(spark, "executions")
    compaction.executions(arriving.where(old)).write.parquet(path)
    target = spark.read.parquet(path)
    redelivered = _records(spark, sf).where(old & (F.pmod(F.col("offset"), F.lit(7)) == 0))
    batch = compaction.executions(arriving.where(~old).unionByName(redelivered))
    table = target.unionByName(compaction.append_new(batch, target))
    return plain(table.select(*KEY, "kafka_timestamp", "offset"))


def doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = compaction.execution_ids(compaction.executions(_records(spark, sf), ("offset",)))
    return plain(rows.select("offset", "index", "doc_id"))


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    old = F.unix_micros("timestamp") < SPLIT_US
    target = compaction.progress_latest(records.where(old))
    batch = compaction.progress_latest(records.where(~old))
    return plain(compaction.upsert_latest(target, batch).drop("partition"))


def domain_layout(spark: SparkSession, sf: str) -> DataFrame:
    rows = compaction.timers_projection(_records(spark, sf))
    path = shared_path(spark, "timers")
    tables.write_by_bucket(rows.select(*KEY, "created_at", "create"), path)
    back = tables.read_table(spark, path, "domain string, timer_uuid string, created_at timestamp")
    return plain(back.groupBy("domain").agg(F.count(F.lit(1)).alias("timers"), F.min("created_at").alias("first_at")))


def progress_latest(spark: SparkSession, sf: str) -> DataFrame:
    return plain(compaction.progress_latest(_records(spark, sf)).drop("partition"))


def progress_by_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of the partitions whose replay has seen its own marker."""
    progress = compaction.progress_latest(_records(spark, sf)).drop("partition")
    placed = restore.with_partition(progress, sample.PARTITIONS)
    ready = logs.fences(sample.envelope(spark, sf), GENERATION)
    return plain(restore.progress_by_partition(placed, ready).select("partition", *KEY, "completed_executions"))


def progress_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    return plain(compaction.progress_rebuild(_records(spark, sf)))


def running_progress(spark: SparkSession, sf: str) -> DataFrame:
    rows = compaction.running_progress(_records(spark, sf))
    return plain(rows.select(*KEY, "offset", "completed", "previous_execution"))


def advance_progress(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    old = F.unix_micros("timestamp") < SPLIT_US
    before = compaction.progress_latest(records.where(old))
    return plain(compaction.advance_progress(before, records.where(~old)))


def timer_history(spark: SparkSession, sf: str) -> DataFrame:
    return plain(access.timer_history(compaction.executions(_records(spark, sf)), TENANT))


def tenant_read(spark: SparkSession, sf: str) -> DataFrame:
    """One tenant's executions from the table that is laid out by buckets of domains."""
    path = shared_path(spark, "executions")
    tables.write_by_bucket(compaction.executions(_records(spark, sf), ("partition", "offset")), path)
    back = tables.read_table(spark, path, "domain string, timer_uuid string, kafka_timestamp timestamp, offset bigint, domain_bucket int")
    return plain(tables.scoped({"executions": back}, "executions", TENANT).select(*KEY, "kafka_timestamp", "offset"))


def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(access.outcome_counts(compaction.executions(_records(spark, sf))))


def restored(spark: SparkSession, sf: str, zero_time: bool = False) -> DataFrame:
    records = _records(spark, sf)
    return restore.restore_state(compaction.live_creates(records, parts=("schedule",)), compaction.progress_latest(records), zero_time)


def restore_state(spark: SparkSession, sf: str) -> DataFrame:
    return plain(restored(spark, sf))


def normalize_progress(spark: SparkSession, sf: str) -> DataFrame:
    rows = restored(spark, sf, zero_time=True)
    return plain(rows.select(*KEY, "completed_executions", "last_execution"))


QUERIES = {
    f.__name__: f
    for f in (
        live_creates, compact_log, create_sessions, timers_projection, apply_tombstones, executions_append,
        doc_ids, upsert_latest, domain_layout, progress_latest, progress_by_partition, progress_rebuild,
        running_progress, advance_progress, timer_history, tenant_read, outcome_counts, restore_state, normalize_progress,
    )
}
