"""Next fires, due timers and finished timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.functions import cron as C


def exhausted() -> Column:
    """All allowed executions are done; zero means no limit."""
    limit = F.coalesce(F.col("max_executions"), F.lit(0))
    return (limit != 0) & (F.col("completed_executions") >= limit)


def missed_fire(fire_us: Column, now_us: Column) -> Column:
    return fire_us < now_us


def past_stop(fire_us: Column) -> Column:
    stop = F.unix_micros("stop_time")
    return F.coalesce(fire_us > stop, F.lit(False))


def with_planned(timers: DataFrame, out: str = "planned_us") -> DataFrame:
    """Next planned instant of each timer from its own schedule, before now and limits count.

    The first fire may fall on the start time itself; later fires are strictly after the last one.
    """
    start, last = F.unix_micros("start_time"), F.unix_micros("last_execution")
    columns = timers.columns
    ready = C.parse(timers).withColumn("_after", F.coalesce(last, start - 1))
    matched = C.with_next_match(ready, "_after", "_match")
    step = F.col("every_s") * C.SECOND_US
    every = F.coalesce(C.truncate_second(last) + step, C.truncate_second(start))
    planned = F.when(F.col("cron_kind") == "every", every).otherwise(F.col("_match"))
    return matched.withColumn(out, planned).select(*columns, out)


def next_fire(timers: DataFrame, now_us: int | Column) -> DataFrame:
    """Add ``fire_us`` (null when the timer is finished), ``missed`` and ``status``.

    Order of the checks: executions used up, next instant, one compensating fire when that is
    already past, stop time.
    """
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    planned = F.col("planned_us")
    fire = F.greatest(planned, now)
    status = (
        F.when(exhausted(), "exhausted")
        .when(planned.isNull(), "no_match")
        .when(past_stop(fire), "past_stop")
        .otherwise("active")
    )
    checked = with_planned(timers).withColumn("status", status)
    active = F.col("status") == "active"
    return checked.withColumn("missed", active & missed_fire(planned, now)).withColumn(
        "fire_us", F.when(active, fire)
    )


def due_timers(timers: DataFrame, now_us: int, within_us: int = 0) -> DataFrame:
    """Timers that fire until now (or within a span after it), with the wait."""
    fires = next_fire(timers, now_us)
    return fires.where(F.col("fire_us") <= now_us + within_us).withColumn("wait_us", F.col("fire_us") - F.lit(now_us))


def next_n_due(timers: DataFrame, now_us: int, n: int) -> DataFrame:
    """The n timers that fire first: each task keeps its own n, the rest never leaves it."""
    fires = next_fire(timers, now_us).where(F.col("fire_us").isNotNull())
    return fires.orderBy("fire_us", "domain", "timer_uuid").limit(n)


def finished(timers: DataFrame, now_us: int) -> DataFrame:
    """Timers without a next fire, with the reason."""
    return next_fire(timers, now_us).where(F.col("fire_us").isNull())
