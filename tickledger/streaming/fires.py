"""Timers that fire in event time, with restorable keyed state.

Create and delete commands arrive as a stream; the state keeps the schedule masks, the progress and
the next due time of each timer. Timers share buckets by the hash of their key: a bucket is one value
in the state store and has one event-time timer, at the first due time in it.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from datetime import date, timedelta
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickledger import schemas as S
from tickledger.functions import codec
from tickledger.functions import cron as C
from tickledger.operators import compaction

# The processor runs in Python workers that need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = S.KEY_COLUMNS
MINUTE_US, SECOND_US, MINUTES_PER_DAY = C.MINUTE_US, C.SECOND_US, C.MINUTES_PER_DAY
DAY_US = MINUTES_PER_DAY * MINUTE_US
DELETE = codec.DELETE
EPOCH = date(1970, 1, 1)

SCHEDULE_FIELDS = [
    ("cron_kind", "string"),
    ("every_s", "long"),
    *[(mask, "long") for mask in C.MASKS],
    ("dom_star", "boolean"),
    ("dow_star", "boolean"),
    ("start_us", "long"),
    ("stop_us", "long"),
    ("max_executions", "long"),
]
STATE_FIELDS = [*SCHEDULE_FIELDS, ("completed", "long"), ("last_us", "long"), ("due_us", "long")]
STATE_NAMES = [name for name, _ in STATE_FIELDS]
STATE_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in STATE_FIELDS)
# Rows of one frame of events, and of one slice of commands.
PART_ROWS = 10_000
# Groups of the keyed state. A call into the state costs as much as some hundred timers, so they share it.
BUCKETS = 2048
NO_TIME = -(1 << 63)
# Name, numbers and times of some events of one timer.
Event = tuple[str, np.ndarray, np.ndarray]
OUTPUT_SCHEMA = "domain string, timer_uuid string, event string, n long, fire_us long"


def _with_schedule(df: DataFrame) -> DataFrame:
    """Schedule columns (cron, start_time, ...) as masks and epoch microseconds."""
    parsed = C.parse(df)
    return (
        parsed.withColumn("start_us", F.unix_micros("start_time"))
        .withColumn("stop_us", F.unix_micros("stop_time"))
        .withColumn("max_executions", F.coalesce(F.col("max_executions"), F.lit(0)).cast("bigint"))
    )


def commands(records: DataFrame) -> DataFrame:
    """Valid create and delete records of a stream as input rows of the timers.

    A create that breaks a rule is no command: it leaves a running timer as it is.
    ``compaction.valid_creates`` has such rows for the quarantine.
    """
    rows = compaction.valid_creates(records)[0].where(F.col("kind").isin(codec.UPSERT, codec.DELETE))
    flat = rows.select("timestamp", "offset", "kind", *KEY, "create.schedule.*")
    names = [name for name, _ in SCHEDULE_FIELDS]
    return _with_schedule(flat).select("timestamp", "offset", "kind", *KEY, *names)


def initial_state(restored: DataFrame) -> DataFrame:
    """Restored timers (``restore.restore_state``) as the state to start from."""
    names = [name for name, _ in SCHEDULE_FIELDS]
    return _with_schedule(restored).select(
        *KEY,
        *names,
        F.col("completed_executions").cast("bigint").alias("completed"),
        F.unix_micros("last_execution").alias("last_us"),
    )


_CLOCKS: dict[tuple[int, int], list[int]] = {}


def _clock(minute_mask: int, hour_mask: int) -> list[int]:
    """Sorted minutes of the day of a schedule; at most 1440, remembered per worker."""
    found = _CLOCKS.get((minute_mask, hour_mask))
    if found is None:
        hours = [h for h in range(24) if hour_mask >> h & 1]
        minutes = [m for m in range(60) if minute_mask >> m & 1]
        if len(_CLOCKS) > 1_000:
            _CLOCKS.clear()
        found = _CLOCKS[minute_mask, hour_mask] = [h * 60 + m for h in hours for m in minutes]
    return found


def next_match(masks: dict, after_us: int) -> int | None:
    """First matching minute strictly after an instant; same rule as ``cron.with_next_match``."""
    clock = _clock(masks["minute_mask"], masks["hour_mask"])
    if not clock:
        return None
    number, minute = divmod(after_us // MINUTE_US + 1, MINUTES_PER_DAY)
    position = bisect_left(clock, minute)
    if position == len(clock):
        number, position = number + 1, 0
    elif not _day_matches(masks, EPOCH + timedelta(days=number)):
        position = 0
    day = EPOCH + timedelta(days=number)
    last = date(day.year + 5, 12, 31)
    while day <= last:
        if not masks["month_mask"] >> day.month & 1:
            day = date(day.year + day.month // 12, day.month % 12 + 1, 1)
            position = 0
        elif _day_matches(masks, day):
            return ((day - EPOCH).days * MINUTES_PER_DAY + clock[position]) * MINUTE_US
        else:
            day += timedelta(days=1)
    return None


def _day_matches(masks: dict, day: date) -> bool:
    dom = bool(masks["dom_mask"] >> day.day & 1)
    dow = bool(masks["dow_mask"] >> (day.isoweekday() % 7) & 1)
    in_month = bool(masks["month_mask"] >> day.month & 1)
    return in_month and ((dom and dow) if masks["dom_star"] or masks["dow_star"] else (dom or dow))


def planned(timer: dict) -> int | None:
    """Next planned instant of a timer, or null when it is finished."""
    if timer["max_executions"] and timer["completed"] >= timer["max_executions"]:
        return None
    start, last = timer["start_us"], timer["last_us"]
    if timer["cron_kind"] == "every":
        step = timer["every_s"] * SECOND_US
        due = start // SECOND_US * SECOND_US if last is None else last // SECOND_US * SECOND_US + step
    elif timer["cron_kind"] == "fields" and start is not None:
        due = next_match(timer, start - 1 if last is None else last)
    else:
        due = None
    if due is not None and timer["stop_us"] is not None and due > timer["stop_us"]:
        return None
    return due


def _python(value):
    if value is None or value != value:  # NaN
        return None
    if isinstance(value, str):
        return value
    return bool(value) if isinstance(value, (bool, np.bool_)) else int(value)


def instants(timer: dict, until: int, most: int) -> np.ndarray:
    """Planned instants of a timer from its due time to ``until``, at most ``most`` of them."""
    at, found, size = timer["due_us"], [], 0
    if timer["cron_kind"] == "every":
        step = timer["every_s"] * SECOND_US
        return at + step * np.arange(min(most, (until - at) // step + 1), dtype=np.int64)
    clock = np.array(_clock(timer["minute_mask"], timer["hour_mask"]), np.int64) * MINUTE_US
    while at is not None and at <= until and size < most:
        midnight = at - at % DAY_US
        rest = midnight + clock[np.searchsorted(clock, at - midnight) :]
        found.append(rest[rest <= until])
        size += len(found[-1])
        at = next_match(timer, int(rest[-1]))
    return np.concatenate([np.zeros(0, np.int64), *found])[:most]


def framed(events: Iterator[tuple[tuple[str, str], Event]]) -> Iterator[pd.DataFrame]:
    """Frames of at most ``PART_ROWS`` events, each given with the key of its timer."""
    held: list[tuple[tuple[str, str], Event]] = []
    size = 0

    def frame() -> pd.DataFrame:
        sizes = [len(n) for _, (_, n, _) in held]
        words = [[key[0] for key, _ in held], [key[1] for key, _ in held], [event[0] for _, event in held]]
        domain, uuid, name = (np.repeat(np.array(column, object), sizes) for column in words)
        n, at = (np.concatenate([event[i] for _, event in held]) for i in (1, 2))
        fire_us = pd.arrays.IntegerArray(at, at == NO_TIME)
        return pd.DataFrame({"domain": domain, "timer_uuid": uuid, "event": name, "n": n, "fire_us": fire_us})

    for key, event in events:
        if held and size + len(event[1]) > PART_ROWS:
            yield frame()
            held, size = [], 0
        held.append((key, event))
        size += len(event[1])
    if held:
        yield frame()


class TimerProcessor(StatefulProcessor):
    """Fires timers when the watermark passes their due time.

    ``all`` fires every planned instant in turn, and before a command takes effect those that were
    due until then; the result does not depend on how the log was cut into batches. ``coalesce``
    fires once, at the watermark, however many instants were missed.

    Events are made as arrays and handed on in frames of at most ``PART_ROWS`` rows, so a timer that
    missed years of seconds needs no more memory than any other. The commands of one key and batch
    are sorted once; the source's batch size bounds them.
    """

    def __init__(self, catch_up: str = "all"):
        if catch_up not in ("all", "coalesce"):
            raise ValueError("catch_up must be 'all' or 'coalesce'")
        self.catch_up = catch_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", STATE_SCHEMA)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        timer = {name: _python(row[name]) for name in STATE_NAMES if name != "due_us"}
        self._schedule(timer)
        # a timer restored as finished still has to report it: wake it at the first watermark
        wake = timer["due_us"] if timer["due_us"] is not None else 0
        self.timer.update(tuple(timer[name] for name in STATE_NAMES))
        self.handle.registerTimer(self._millis(wake))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._frames(key, self._obey(rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._frames(key, self._wake(timerValues.getCurrentWatermarkInMs() * 1000))

    def _obey(self, rows: Iterator[pd.DataFrame]) -> Iterator[Event]:
        timer = self._load()
        self._forget_wake_up(timer)
        timer = yield from self._obeyed(timer, self._in_order(rows))
        self._save(timer)

    def _wake(self, now: int) -> Iterator[Event]:
        timer = yield from self._woken(self._load(), now)
        self._save(timer)

    def _obeyed(self, timer: dict | None, commands: Iterable[dict]):
        """The timer after some commands in log order."""
        if timer is not None and timer["due_us"] is None:
            timer = yield from self._keep(timer)
        for row in commands:
            if timer is not None and self.catch_up == "all":
                before = pd.Timestamp(row["timestamp"]).value // 1000
                timer = yield from self._fire_until(timer, before - 1)
            if row["kind"] == DELETE:
                timer = None
                continue
            timer = {name: _python(row[name]) for name, _ in SCHEDULE_FIELDS}
            timer.update(completed=0, last_us=None)
            timer = yield from self._keep(timer)
        return timer

    def _woken(self, timer: dict | None, now: int):
        """The timer after the watermark has come to ``now``."""
        if timer is not None and timer["due_us"] is None:
            timer = yield from self._keep(timer)
        elif timer is not None and self.catch_up == "all":
            timer = yield from self._fire_until(timer, now)
        elif timer is not None and timer["due_us"] <= now:
            timer = yield from self._fire_late(timer, now)
        return timer

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[dict]:
        """Commands of one key and batch in log order; coalescing only needs the last one."""
        order = ["timestamp", "offset"]
        if self.catch_up == "coalesce":
            last = pd.DataFrame()
            for frame in rows:
                last = pd.concat([last, frame]).sort_values(order).tail(1)
            yield from last.to_dict("records")
            return
        frames = list(rows)
        commands = (frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)).sort_values(order)
        for at in range(0, len(commands), PART_ROWS):
            yield from commands.iloc[at : at + PART_ROWS].to_dict("records")

    @staticmethod
    def _frames(key, events: Iterator[Event]) -> Iterator[pd.DataFrame]:
        """Frames of at most ``PART_ROWS`` events of one timer."""
        return framed((key, event) for event in events)

    @staticmethod
    def _millis(micros: int) -> int:
        return -(-micros // 1000)

    def _load(self) -> dict | None:
        stored = self.timer.get()
        if stored is None:
            return None
        return {name: _python(value) for name, value in zip(STATE_NAMES, stored, strict=True)}

    def _save(self, timer: dict | None) -> None:
        if timer is None:
            self.timer.clear()
            return
        self.timer.update(tuple(timer[name] for name in STATE_NAMES))
        self.handle.registerTimer(self._millis(timer["due_us"]))

    def _forget_wake_up(self, timer: dict | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(self._millis(timer["due_us"] or 0))

    def _schedule(self, timer: dict) -> None:
        timer["due_us"] = planned(timer)

    def _keep(self, timer: dict):
        """The timer with its next due time, or nothing after reporting that it is finished."""
        self._schedule(timer)
        if timer["due_us"] is None:
            yield from self._finish(timer)
            return None
        return timer

    @staticmethod
    def _finish(timer: dict) -> Iterator[Event]:
        yield "FINISH", np.array([timer["completed"]]), np.array([NO_TIME])

    def _fire_late(self, timer: dict, now: int):
        """One fire at ``now`` for all that were missed, or the end of a timer that may not fire any more."""
        if timer["stop_us"] is not None and now > timer["stop_us"]:
            yield from self._finish(timer)
            return None
        timer.update(completed=timer["completed"] + 1, last_us=now)
        yield "FIRE", np.array([timer["completed"]]), np.array([now])
        return (yield from self._keep(timer))

    def _fire_until(self, timer: dict | None, until: int):
        """All fires that are due, some thousands at a time."""
        while timer is not None and timer["due_us"] is not None and timer["due_us"] <= until:
            last = until if timer["stop_us"] is None else min(until, timer["stop_us"])
            left = timer["max_executions"] - timer["completed"] if timer["max_executions"] else PART_ROWS
            at = instants(timer, last, min(left, PART_ROWS))
            yield "FIRE", timer["completed"] + 1 + np.arange(len(at)), at
            timer.update(completed=timer["completed"] + len(at), last_us=int(at[-1]))
            timer = yield from self._keep(timer)
        return timer


HELD_SCHEMA = pa.schema(
    [(name, pa.string()) for name in KEY]
    + [(name, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[kind]) for name, kind in STATE_FIELDS]
)


class BucketProcessor(TimerProcessor):
    """The same for all timers of a bucket: one call into the state for many keys.

    The timers of a bucket are one Arrow table in a value state. Only those that get a command or are
    due become Python values; the others stay columns and are written back as they were read.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "timers binary, wake long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        held, wake = self._read()
        timers = []
        for row in initialState.to_dict("records"):
            timer = {name: _python(row[name]) for name in STATE_NAMES if name != "due_us"}
            self._schedule(timer)
            timers.append(((row["domain"], row["timer_uuid"]), timer))
        self._write(held, timers, wake)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        commands = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        return framed(self._each_obeys(commands.sort_values([*KEY, "timestamp", "offset"], ignore_index=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return framed(self._each_wakes(timerValues.getCurrentWatermarkInMs() * 1000))

    def _each_obeys(self, commands: pd.DataFrame):
        held, wake = self._read()
        domain, uuid = (commands[name].to_numpy(object) for name in KEY)
        first = np.flatnonzero(np.concatenate([[True], (domain[1:] != domain[:-1]) | (uuid[1:] != uuid[:-1])]))
        named = dict.fromkeys(zip(domain[first], uuid[first], strict=True))
        touched = np.fromiter((key in named for key in zip(*(held.column(name).to_pylist() for name in KEY), strict=True)), bool, len(held))
        named |= dict(_timers(held.filter(pa.array(touched))))
        kept, sizes = [], np.diff(first, append=len(commands))
        if self.catch_up == "coalesce":  # only the last command of a key counts
            commands, sizes = commands.iloc[first + sizes - 1], np.ones_like(sizes)
        rows = _dicts(commands)
        for (key, timer), size in zip(named.items(), sizes, strict=True):
            timer = yield from _of(key, self._obeyed(timer, islice(rows, int(size))))
            if timer is not None:
                kept.append((key, timer))
        self._write(held.filter(pa.array(~touched)), kept, wake)

    def _each_wakes(self, now: int):
        held, _ = self._read()
        due = held.column("due_us").to_pandas()
        touched = (due.isna() | (due <= now)).to_numpy(bool)
        kept = []
        for key, timer in _timers(held.filter(pa.array(touched))):
            timer = yield from _of(key, self._woken(timer, now))
            if timer is not None:
                kept.append((key, timer))
        self._write(held.filter(pa.array(~touched)), kept, None)  # the wake-up that came is gone

    def _read(self) -> tuple[pa.Table, int | None]:
        stored = self.bucket.get()
        if stored is None:
            return HELD_SCHEMA.empty_table(), None
        return pa.ipc.open_stream(bytes(stored[0])).read_all(), _python(stored[1])

    def _write(self, held: pa.Table, timers: list[tuple[tuple[str, str], dict]], wake: int | None) -> None:
        """Store the bucket; ``wake`` is the wake-up that is registered for it."""
        columns = [[key[0] for key, _ in timers], [key[1] for key, _ in timers], *([t[name] for _, t in timers] for name in STATE_NAMES)]
        table = pa.concat_tables([held, pa.table([pa.array(c, f.type) for c, f in zip(columns, HELD_SCHEMA, strict=True)], schema=HELD_SCHEMA)])
        due = [0 if at is None else at for at in table.column("due_us").to_pylist()]  # a restored timer that is finished reports it at once
        first = self._millis(min(due)) if due else None
        if wake is not None and wake != first:
            self.handle.deleteTimer(wake)
        if first is None:
            self.bucket.clear()
            return
        if wake != first:
            self.handle.registerTimer(first)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD_SCHEMA) as writer:
            writer.write_table(table.combine_chunks())
        self.bucket.update((sink.getvalue().to_pybytes(), first))


def _timers(table: pa.Table) -> Iterator[tuple[tuple[str, str], dict]]:
    for row in table.to_pylist():
        yield (row.pop("domain"), row.pop("timer_uuid")), row


def _dicts(commands: pd.DataFrame) -> Iterator[dict]:
    """Rows in order; a slice of them at a time becomes Python values, column by column."""
    for at in range(0, len(commands), PART_ROWS):
        part = commands.iloc[at : at + PART_ROWS]
        for row in zip(*(part[name].astype(object).to_list() for name in part.columns), strict=True):
            yield dict(zip(part.columns, row, strict=True))


def _of(key: tuple[str, str], events):
    """Events with the key of their timer; hands on what the events end with."""
    while True:
        try:
            event = next(events)
        except StopIteration as end:
            return end.value
        yield key, event


def _bucketed(rows: DataFrame, buckets: int):
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")).groupBy("_bucket")


def fires(
    records: DataFrame, delay: str, catch_up: str = "all", restored: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """FIRE and FINISH events of the timers that a stream of records creates and deletes.

    ``delay`` is how far the partitions of the log may run apart in time; a command that comes later
    still would be dropped by the engine, so run the stream with ``run_checked``, which ends it
    with an error instead. Start it again from a restored table then.

    ``restored`` starts the timers of an earlier replay with their progress; the batch job that
    computes it ends before the stream starts, which is the gate between replay and live.

    ``buckets`` groups of timers share their calls into the state; it is fixed at the first start of
    a stream and should leave some thousand timers to a bucket at most.
    """
    keyed = _bucketed(commands(records).withWatermark("timestamp", delay), buckets)
    state = None if restored is None else _bucketed(initial_state(restored), buckets)
    return keyed.transformWithStateInPandas(
        BucketProcessor(catch_up), OUTPUT_SCHEMA, "append", "EventTime", initialState=state
    )


def dropped_rows(progress) -> int:
    """Rows that the watermark dropped in a batch."""
    return sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)


def run_checked(query) -> None:
    """Wait for a query of ``fires`` to end; a batch that lost commands stops it with an error.

    The progress of the last batches is looked at after the run and once a second during it.
    """
    seen = -1
    while True:
        ended = query.awaitTermination(1)
        for progress in query.recentProgress:
            if progress.batchId > seen:
                seen = progress.batchId
                if lost := dropped_rows(progress):
                    query.stop()
                    raise RuntimeError(f"batch {seen} lost {lost} late commands: restore the timers and use a longer delay")
        if ended:
            return
