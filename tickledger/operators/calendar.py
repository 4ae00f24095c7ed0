"""Planned fires of schedules, and how executions met them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import cron as C

KEY = S.KEY_COLUMNS
DAY_US = C.MINUTES_PER_DAY * C.MINUTE_US


def _day(micros: Column) -> Column:
    return ((micros - F.pmod(micros, F.lit(DAY_US))) / DAY_US).cast("bigint")


def _bits(mask: Column) -> Column:
    return F.bit_count(mask)


def fire_calendar(timers: DataFrame, from_us: int | Column, until_us: int | Column) -> DataFrame:
    """Every planned fire in [from, until) of each schedule, numbered from its first fire.

    Bounded by start, stop and max executions. The number of a fire is computed from the day, the
    hour and the minute it falls on, so neither the numbering nor the limit needs a window or a
    shuffle. Rows are expanded in two steps, days and then instants of one day; days beyond the
    execution limit are cut off before the second step. No array is longer than one day of fires
    or the days of the horizon.
    """
    low = F.lit(from_us) if isinstance(from_us, int) else from_us
    high = F.lit(until_us) if isinstance(until_us, int) else until_us
    columns = [c for c in timers.columns if c not in ("low_us", "high_us")]
    start = F.unix_micros("start_time")
    limit = F.coalesce(F.col("max_executions"), F.lit(0)).cast("bigint")
    ready = (
        C.parse(timers)
        .withColumn("_low", low)
        .withColumn("_end", F.least(high - 1, F.unix_micros("stop_time")))
        .withColumn("_after", start - 1)
    )
    ready = C.with_next_match(ready, "_after", "_match")
    is_every = F.col("cron_kind") == "every"
    step = F.col("every_s") * C.SECOND_US
    first = F.when(is_every, C.truncate_second(start)).otherwise(F.col("_match"))
    ready = (
        ready.withColumn("_first", first)
        .withColumn("_step", step)
        .where(F.col("_first") <= F.col("_end"))
        .withColumn("_first_day", _day(F.col("_first")))
        .withColumn("_last_day", _day(F.col("_end")))
    )
    # fires of a full day, and those of the first day that lie before the first fire
    minutes, hours = F.col("minute_mask"), F.col("hour_mask")
    of_day = F.pmod(F.col("_first"), F.lit(DAY_US)) / C.MINUTE_US
    hour, minute = F.floor(of_day / 60).cast("int"), F.pmod(of_day.cast("int"), F.lit(60))
    ready = ready.withColumn("_hour", hour).withColumn("_minute", minute)
    skipped = F.expr(
        "bit_count(hour_mask & (shiftleft(1L, _hour) - 1)) * bit_count(minute_mask)"
        " + bit_count(minute_mask & (shiftleft(1L, _minute) - 1))"
    )
    ready = ready.withColumn("_per_day", _bits(hours) * _bits(minutes)).withColumn("_skipped", skipped)
    matching = F.expr(f"filter(sequence(_first_day, _last_day), d -> {C.day_matches_sql('d')})")
    days_needed = F.floor((limit - 1 + F.col("_skipped")) / F.col("_per_day"))
    needed = F.least(days_needed, F.lit(2**31 - 2)).cast("int") + 1
    matching = F.when(limit > 0, F.slice(matching, F.lit(1), needed)).otherwise(matching)
    # the limit is compared as a number of steps: as an instant it might not fit
    steps = F.expr("(_end - _first) div _step")
    last_every = F.when(limit > 0, F.col("_first") + F.least(limit - 1, steps) * F.col("_step")).otherwise(F.col("_end"))
    every_days = F.sequence(F.col("_first_day"), _day(last_every))
    per_day = ready.select(
        *columns,
        "cron_kind", "_low", "_end", "_first", "_step", "_per_day", "_skipped", "minute_mask", "hour_mask",
        F.posexplode(F.when(is_every, every_days).otherwise(matching)).alias("_index", "_day"),
    ).where((F.col("_day") + 1) * DAY_US > F.col("_low"))
    day_start = F.col("_day") * DAY_US
    hours_of_day, minutes_of_hour = C.mask_to_array("hour_mask", 0, 23), C.mask_to_array("minute_mask", 0, 59)
    clock = F.expr(f"flatten(transform({hours_of_day}, h -> transform({minutes_of_hour}, m -> bigint(h * 60 + m))))")
    from_first = F.greatest(day_start, F.col("_low"), F.col("_first")) - F.col("_first")
    low_k = F.ceil(from_first / F.col("_step"))
    high_k = F.floor((F.least(day_start + DAY_US - 1, F.col("_end")) - F.col("_first")) / F.col("_step"))
    nothing = F.array().cast("array<bigint>")
    repeats = F.when(low_k <= high_k, F.sequence(low_k, high_k)).otherwise(nothing)
    fires = per_day.select(
        *columns,
        "cron_kind", "_low", "_end", "_first", "_step", "_per_day", "_skipped", "_index", "_day",
        F.posexplode(F.when(is_every, repeats).otherwise(clock)).alias("_pos", "_item"),
    )
    fire = F.when(is_every, F.col("_first") + F.col("_item") * F.col("_step")).otherwise(
        day_start + F.col("_item") * C.MINUTE_US
    )
    number = F.when(is_every, F.col("_item") + 1).otherwise(
        F.col("_index").cast("bigint") * F.col("_per_day") + F.col("_pos") + 1 - F.col("_skipped")
    )
    numbered = fires.select(*columns, "_low", "_end", number.cast("bigint").alias("n"), fire.alias("fire_us"))
    within = (F.col("n") >= 1) & F.col("fire_us").between(F.col("_low"), F.col("_end"))
    return numbered.where(within & ((limit == 0) | (F.col("n") <= limit))).select(*columns, "n", "fire_us")


def limit_per_key(fires: DataFrame, limit: Column) -> DataFrame:
    """At most ``limit`` fires of each timer, by their number; zero means all."""
    return fires.where((limit == 0) | (F.col("n") <= limit))


def rank_fires(fires: DataFrame) -> DataFrame:
    """Number the fires of each timer by time.

    For fires that do not carry a number yet; one timer has at most one fire per second of the
    horizon, which bounds the window whatever the number of rows of the log.
    """
    return fires.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("fire_us")).cast("bigint"))


def executions_in_interval(planned: DataFrame, executions: DataFrame) -> DataFrame:
    """Per planned fire, the executions from it until the next planned fire of the timer.

    ``executions`` has KEY and ``exec_us``. Fires fall on whole seconds, so executions are first
    reduced to one row per timer and second inside the map tasks; a timer then holds at most two
    rows per second of the horizon. One shuffle on the key serves the window and the final sum.
    """
    second = C.truncate_second(F.col("exec_us")).alias("_second")
    reduced = executions.groupBy(*KEY, second).agg(
        F.min("exec_us").alias("exec_us"), F.count(F.lit(1)).alias("executions")
    )
    plan_rows = planned.select(
        *KEY,
        F.col("fire_us").alias("_at"),
        F.col("fire_us").alias("_planned"),
        F.col("n"),
        F.lit(None).cast("bigint").alias("exec_us"),
        F.lit(0).cast("bigint").alias("executions"),
    )
    exec_rows = reduced.select(
        *KEY,
        F.col("exec_us").alias("_at"),
        F.lit(None).cast("bigint").alias("_planned"),
        F.lit(None).cast("bigint").alias("n"),
        "exec_us",
        "executions",
    )
    order = Window.partitionBy(*KEY).orderBy(F.col("_at"), F.col("_planned").isNull())
    owned = plan_rows.unionByName(exec_rows).withColumn(
        "planned_us", F.last("_planned", ignorenulls=True).over(order)
    )
    return (
        owned.where(F.col("planned_us").isNotNull())
        .groupBy(*KEY, "planned_us")
        .agg(
            F.max("n").alias("n"),
            F.min("exec_us").alias("first_exec_us"),
            F.sum("executions").alias("executions"),
        )
    )


def planned_vs_actual(planned: DataFrame, executions: DataFrame) -> DataFrame:
    """First execution of every planned fire before the following one: lateness, or missed."""
    met = executions_in_interval(planned, executions)
    return met.select(
        *KEY,
        "n",
        "planned_us",
        F.col("first_exec_us").alias("actual_us"),
        (F.col("first_exec_us") - F.col("planned_us")).alias("lateness_us"),
        F.col("first_exec_us").isNull().alias("missed"),
    )
