"""Queries that evaluate schedules over the restored timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import cron as C
from tickledger.functions.codec import decode_records
from tickledger.operators import calendar, compaction, replay, schedule
from tickledger.plans.log_queries import NOW_US
from tickledger.plans.shape import plain
from tickledger.plans.state_queries import restored
from tickledger.session import configure
from tickledger.sources import logs, sample

KEY = S.KEY_COLUMNS
START_US = 1_704_067_200_000_000  # 2024-01-01


def parse_schedules(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts made from the events: five-field, repeat and broken ones."""
    rows = sample.with_k(sample.events(configure(spark), sf))
    k, user = F.col("k").cast("string"), F.col("user_id")
    text = (
        F.when((F.col("event_type") == "click") & (F.col("k") >= 90), F.concat(F.lit("@every "), F.lit("99999999"), k, F.lit("h")))
        .when(F.col("event_type") == "click", F.concat(F.lit("@every "), k, F.lit("s")))
        .when(F.col("event_type") == "view", F.concat(F.lit("@each"), k))
        .otherwise(
            F.concat(
                k, F.lit(" */"), F.pmod(user, F.lit(5)).cast("string"), F.lit(" "),
                F.pmod(user, F.lit(40)).cast("string"), F.lit(" * "),
                F.pmod(F.col("k"), F.lit(9)).cast("string"),
            )
        )
    )
    parsed = C.parse(rows.select(text.alias("cron")).distinct())

    def listed(mask: str, low: int, high: int):
        return F.array_join(F.expr(C.mask_to_array(mask, low, high)).cast("array<string>"), ",")

    fields = F.col("cron_kind") == "fields"
    return plain(
        parsed.select(
            "cron", "cron_kind", "every_s",
            F.when(fields, listed("minute_mask", 0, 59)).alias("minutes"),
            F.when(fields, listed("hour_mask", 0, 23)).alias("hours"),
            F.when(fields, listed("dom_mask", 1, 31)).alias("doms"),
            F.when(fields, listed("dow_mask", 0, 6)).alias("dows"),
            "dom_star", "cron_error",
        )
    )


def next_fire(spark: SparkSession, sf: str) -> DataFrame:
    rows = schedule.next_fire(restored(spark, sf), NOW_US)
    return plain(rows.select(*KEY, "planned_us", "status", "missed", "fire_us"))


def due_timers(spark: SparkSession, sf: str) -> DataFrame:
    rows = schedule.due_timers(restored(spark, sf), NOW_US, within_us=3_600_000_000)
    return plain(rows.select(*KEY, "fire_us", "wait_us"))


def next_n_due(spark: SparkSession, sf: str) -> DataFrame:
    rows = schedule.next_n_due(restored(spark, sf), START_US + 20 * calendar.DAY_US, 100)
    return plain(rows.select(*KEY, "fire_us"))


def termination_status(spark: SparkSession, sf: str) -> DataFrame:
    done = schedule.finished(restored(spark, sf), NOW_US)
    tombs = logs.finish_tombstones(done, sample.PARTITIONS)
    key = F.from_json(F.col("key").cast("string"), S.KEY)
    rows = tombs.select("topic", "partition", key["domain"].alias("domain"), key["timer_uuid"].alias("timer_uuid"), "value")
    return plain(rows.select("topic", "partition", *KEY, F.col("value").isNull().alias("is_tombstone")))


def fire_records(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar's fires and the finished timers as log records, decoded again."""
    fired = _calendar(spark, sf).select(*KEY, F.lit("FIRE").alias("event"), "n", "fire_us")
    done = schedule.finished(restored(spark, sf), NOW_US).select(
        *KEY, F.lit("FINISH").alias("event"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("fire_us")
    )
    log = logs.fire_records(fired.union(done), sample.PARTITIONS)
    placed = log.select("*", F.lit(0).cast("bigint").alias("offset"))
    rows = decode_records(placed)
    return plain(rows.select("topic", "partition", *KEY, "kind", "execute.progress.completed_executions", "execute.progress.last_execution"))


def exhausted(spark: SparkSession, sf: str) -> DataFrame:
    return plain(restored(spark, sf).select(*KEY, schedule.exhausted().alias("exhausted")))


def past_stop(spark: SparkSession, sf: str) -> DataFrame:
    rows = schedule.with_planned(restored(spark, sf))
    return plain(rows.select(*KEY, schedule.past_stop(F.col("planned_us")).alias("past_stop")))


def missed_fire(spark: SparkSession, sf: str) -> DataFrame:
    rows = schedule.with_planned(restored(spark, sf))
    missed = schedule.missed_fire(F.col("planned_us"), F.lit(NOW_US))
    return plain(rows.select(*KEY, missed.alias("missed")))


def _calendar(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.fire_calendar(restored(spark, sf), START_US, NOW_US)


def fire_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_calendar(spark, sf).select(*KEY, "n", "fire_us"))


def rank_fires(spark: SparkSession, sf: str) -> DataFrame:
    return plain(calendar.rank_fires(_calendar(spark, sf).select(*KEY, "fire_us")))


def limit_per_key(spark: SparkSession, sf: str) -> DataFrame:
    unlimited = restored(spark, sf).withColumn("allowed", F.col("max_executions")).withColumn("max_executions", F.lit(0))
    fires = calendar.fire_calendar(unlimited, START_US, NOW_US)
    return plain(calendar.limit_per_key(fires, F.col("allowed")).select(*KEY, "n", "fire_us"))


def _executions(spark: SparkSession, sf: str) -> DataFrame:
    rows = compaction.executions(sample.records(spark, sf), ("offset",))
    return rows.select(*KEY, F.unix_micros("kafka_timestamp").alias("exec_us"))


def planned_vs_actual(spark: SparkSession, sf: str) -> DataFrame:
    return plain(calendar.planned_vs_actual(_calendar(spark, sf), _executions(spark, sf)))


def executions_in_interval(spark: SparkSession, sf: str) -> DataFrame:
    met = calendar.executions_in_interval(_calendar(spark, sf), _executions(spark, sf))
    return plain(met.where(F.col("executions") > 0).select(*KEY, "planned_us", "executions"))


def replay_fires(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of the execution log wakes its timer up once."""
    records = sample.records(configure(spark), sf)
    ticks = records.where(F.col("topic") == S.EXECUTE_TOPIC).select(*KEY, F.unix_micros("timestamp").alias("tick_us"))
    timers = restored(spark, sf).withColumn("completed_executions", F.lit(0)).withColumn(
        "last_execution", F.lit(None).cast("timestamp")
    )
    return plain(replay.replay_fires(timers, ticks))


QUERIES = {
    f.__name__: f
    for f in (
        parse_schedules, next_fire, due_timers, next_n_due, termination_status, fire_records, exhausted, past_stop, missed_fire,
        fire_calendar, rank_fires, limit_per_key, planned_vs_actual, executions_in_interval, replay_fires,
    )
}
