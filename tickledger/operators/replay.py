"""Replay a table of wake-up ticks against schedules: one coalesced fire per late tick."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import cron as C

# The fold runs in Python workers that need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = S.KEY_COLUMNS
SECOND_US = C.SECOND_US


def _first_tick(ticks: DataFrame, unit_us: int) -> DataFrame:
    slot = (F.col("tick_us") - F.pmod(F.col("tick_us"), F.lit(unit_us).cast("bigint"))).alias("_slot")
    return ticks.groupBy(*KEY, slot).agg(F.min("tick_us").alias("tick_us")).drop("_slot")


def replay_fires(timers: DataFrame, ticks: DataFrame) -> DataFrame:
    """Fires of each timer when it is only looked at at its ticks (KEY, ``tick_us``).

    A fire happens at the tick itself, so the next fire depends on the one before. For field
    schedules this still has a closed form: a tick fires when a match lies between the tick before
    and itself, and only the first tick of a minute can. A repeat interval is a real fold; only the
    first tick of a second can fire there. Both reductions happen before the shuffle and bound the
    rows of one timer by the length of the horizon.
    """
    state = C.parse(timers).select(
        *KEY,
        "cron_kind",
        "every_s",
        *C.MASKS,
        "dom_star",
        "dow_star",
        F.unix_micros("start_time").alias("start_us"),
        F.unix_micros("stop_time").alias("stop_us"),
        F.coalesce(F.col("max_executions"), F.lit(0)).alias("max_executions"),
        "completed_executions",
        F.unix_micros("last_execution").alias("last_us"),
    )
    fields = _replay_fields(state.where(F.col("cron_kind") == "fields"), ticks)
    every = _replay_every(state.where(F.col("cron_kind") == "every"), ticks)
    return fields.unionByName(every)


def _replay_fields(state: DataFrame, ticks: DataFrame) -> DataFrame:
    rows = _first_tick(ticks, C.MINUTE_US).join(state, KEY)
    in_order = Window.partitionBy(*KEY).orderBy("tick_us")
    initial = F.coalesce(F.col("last_us"), F.col("start_us") - 1)
    # greatest() skips the null of the first tick
    seen = rows.withColumn("_after", F.greatest(F.lag("tick_us").over(in_order), initial))
    matched = C.with_next_match(seen, "_after", "_match")
    fired = matched.where(F.col("_match") <= F.col("tick_us"))
    counted = fired.withColumn(
        "n", F.row_number().over(in_order).cast("bigint") + F.col("completed_executions")
    )
    allowed = (F.col("max_executions") == 0) | (F.col("n") <= F.col("max_executions"))
    in_time = F.coalesce(F.col("tick_us") <= F.col("stop_us"), F.lit(True))
    return counted.where(allowed & in_time).select(*KEY, "n", F.col("tick_us").alias("fire_us"))


def _replay_every(state: DataFrame, ticks: DataFrame) -> DataFrame:
    joined = _first_tick(ticks, SECOND_US).join(
        state.select(*KEY, "every_s", "start_us", "stop_us", "max_executions", "completed_executions", "last_us"), KEY
    )
    # dealt by the packed key: an exchange by the columns of the join counts as done by the join, which
    # adaptive execution may turn into a broadcast or split, and then a timer's ticks are not together
    ordered = joined.repartition(F.struct(*KEY)).sortWithinPartitions(*KEY, "tick_us")
    return ordered.mapInPandas(_fold_every, "domain string, timer_uuid string, n long, fire_us long")


def _fold_every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy walk over sorted ticks; the state of the open timer is carried across batches."""
    open_key = None
    due = count = limit = 0
    stop = np.inf
    for batch in batches:
        out: list[tuple[str, str, int, int]] = []
        for key, rows in batch.groupby(KEY, sort=False):
            row = rows.iloc[0]
            step = int(row["every_s"]) * SECOND_US
            if key != open_key:
                open_key = key
                last = row["last_us"]
                base = row["start_us"] if pd.isna(last) else last
                due = int(base) // SECOND_US * SECOND_US + (0 if pd.isna(last) else step)
                count, limit = int(row["completed_executions"]), int(row["max_executions"])
                stop = np.inf if pd.isna(row["stop_us"]) else int(row["stop_us"])
            ticks = rows["tick_us"].to_numpy()
            at = int(np.searchsorted(ticks, due))
            while at < len(ticks) and ticks[at] <= stop and (limit == 0 or count < limit):
                count += 1
                fire = int(ticks[at])
                out.append((key[0], key[1], count, fire))
                due = fire // SECOND_US * SECOND_US + step
                at = int(np.searchsorted(ticks, due))
        yield pd.DataFrame(out, columns=[*KEY, "n", "fire_us"])
