from pyspark.sql import functions as F
import datetime as dt

import pytest

import model
from model import us
from tickledger.operators import calendar, replay, restore, schedule

TIMER = (
    "domain string, timer_uuid string, cron string, start_time timestamp, stop_time timestamp, "
    "max_executions int, completed_executions int, last_execution timestamp"
)


def at(micros):
    return None if micros is None else dt.datetime.fromtimestamp(micros / 1e6, dt.timezone.utc)


def timers(spark, rows):
    """rows: (cron, start, stop, max, completed, last) in microseconds."""
    data = [
        ("d", f"t{i:03}", c, at(s), at(e), m, n, at(last)) for i, (c, s, e, m, n, last) in enumerate(rows)
    ]
    return spark.createDataFrame(data, TIMER)


def fires(spark, rows, now):
    out = schedule.next_fire(timers(spark, rows), now).orderBy("timer_uuid").collect()
    return [(r.fire_us, r.status) for r in out]


S = 1_000_000
HOUR = 3600 * S


def test_golden_timers(spark):
    """A single fire, one compensating fire for a missed one, and a timer that is still waiting."""
    single = ("@every 1s", 1 * S, None, 1, 0, None)
    late = ("@every 1m", 60 * S, None, 2, 1, 60 * S)
    assert fires(spark, [single], 0) == [(1 * S, "active")]
    assert fires(spark, [(*single[:4], 1, 1 * S)], 1 * S) == [(None, "exhausted")]
    assert fires(spark, [late], 150 * S) == [(150 * S, "active")]
    assert fires(spark, [(*late[:4], 2, 150 * S)], 150 * S) == [(None, "exhausted")]
    assert fires(spark, [late], 40 * S) == [(120 * S, "active")]


def test_golden_timers_replayed(spark):
    cases = [
        (("@every 1s", 1 * S, None, 1, 0, None), [0, 1, 2, 3], [(1, 1 * S)]),
        (("@every 1m", 60 * S, None, 2, 1, 60 * S), [150, 300], [(2, 150 * S)]),
        (("@every 1m", 60 * S, None, 2, 1, 60 * S), [40], []),
    ]
    for timer, ticks, expected in cases:
        tick_rows = spark.createDataFrame([("d", "t000", t * S) for t in ticks], "domain string, timer_uuid string, tick_us long")
        got = replay.replay_fires(timers(spark, [timer]), tick_rows).collect()
        assert sorted((r.n, r.fire_us) for r in got) == expected


def test_order_of_the_checks(spark):
    start = us(2024, 1, 1)
    rows = [
        ("0 * * * *", start, start, 0, 0, None),  # first fire exactly at start and stop
        ("0 * * * *", start, start + HOUR - 1, 0, 1, start),  # next fire one microsecond past the stop
        ("0 * * * *", start, start + HOUR, 0, 1, start),  # next fire exactly at the stop
        ("0 * * * *", start, start - 1, 1, 1, start),  # exhausted is reported before past stop
        ("0 0 31 2 *", start, None, 0, 0, None),  # never
        ("@every 1h", start + 700_000, None, 0, 0, None),  # first repeat is cut to the second
        ("0 * * * *", start + 1, None, 0, 0, None),  # start just after a match
    ]
    assert fires(spark, rows, start - HOUR) == [
        (start, "active"),
        (None, "past_stop"),
        (start + HOUR, "active"),
        (None, "exhausted"),
        (None, "no_match"),
        (start, "active"),
        (start + HOUR, "active"),
    ]
    # a compensating fire after the stop time is not sent
    assert fires(spark, [("0 * * * *", start, start + HOUR, 0, 1, start)], start + 2 * HOUR) == [(None, "past_stop")]


def test_progress_defaults(spark):
    df = spark.createDataFrame([(None, None), (2, None)], "completed_executions int, last_execution timestamp")
    plain = [(r.completed_executions, r.last_execution) for r in restore.normalize_progress(df).collect()]
    assert plain == [(0, None), (2, None)]
    zero = restore.normalize_progress(df, zero_time=True).selectExpr("completed_executions c", "unix_micros(last_execution) l")
    assert [(r.c, r.l) for r in zero.collect()] == [(0, None), (2, restore.ZERO_TIME_US)]


def _sample_timers():
    start = us(2024, 1, 1, 5, 7) + 250_000
    crons = ["*/20 3-6 * * *", "0 0 1,15 * 1", "30 6 * * 1-5", "@every 7m", "@every 3h", "15 12 5 * *"]
    rows = []
    for i, cron in enumerate(crons * 3):
        stop = None if i % 3 == 0 else start + (i + 1) * 11 * HOUR
        rows.append((cron, start + i * HOUR, stop, [0, 5, 40][i // 6], 0, None))
    return rows


def test_calendar_equals_repeated_next_fire(spark):
    rows = _sample_timers()
    low, high = us(2024, 1, 3), us(2024, 1, 20)
    got = {}
    for r in calendar.fire_calendar(timers(spark, rows), low, high).collect():
        got.setdefault(r.timer_uuid, []).append((r.n, r.fire_us))
    for i, (cron, start, stop, limit, *_rest) in enumerate(rows):
        expected, last, n = [], None, 0
        while not limit or n < limit:
            fire = model.planned(cron, start, last)
            if fire is None or fire >= high or (stop is not None and fire > stop):
                break
            n, last = n + 1, fire
            if fire >= low:
                expected.append((n, fire))
        assert sorted(got.get(f"t{i:03}", [])) == expected, rows[i]


def test_planned_versus_actual(spark):
    plan = [("d", "a", i + 1, i * 60 * S) for i in range(4)]
    planned = spark.createDataFrame(plan, "domain string, timer_uuid string, n long, fire_us long")
    times = [-5, 0, 61 * S, 61 * S + 5, 61 * S + 5, 119 * S, 500 * S]
    done = spark.createDataFrame([("d", "a", t) for t in times], "domain string, timer_uuid string, exec_us long")
    got = {r.n: (r.actual_us, r.lateness_us, r.missed) for r in calendar.planned_vs_actual(planned, done).collect()}
    assert got == {1: (0, 0, False), 2: (61 * S, S, False), 3: (None, None, True), 4: (500 * S, 320 * S, False)}
    counts = {r.n: r.executions for r in calendar.executions_in_interval(planned, done).collect()}
    assert counts == {1: 1, 2: 4, 3: 0, 4: 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_a_fold(spark, seed):
    import random

    rng = random.Random(seed)
    rows = _sample_timers()
    ticks = {}
    for i, (_cron, start, *_rest) in enumerate(rows):
        t, ticks[i] = start - HOUR, []
        while t < start + 6 * 24 * HOUR:
            t += rng.choice([1, 400_000, S, 59 * S, 60 * S, 13 * 60 * S, HOUR, 9 * HOUR])
            ticks[i].append(t)
    data = [("d", f"t{i:03}", t) for i, ts in ticks.items() for t in ts]
    tick_rows = spark.createDataFrame(data, "domain string, timer_uuid string, tick_us long")
    got = {}
    for r in replay.replay_fires(timers(spark, rows), tick_rows).collect():
        got.setdefault(r.timer_uuid, []).append((r.n, r.fire_us))
    for i, (cron, start, stop, limit, *_rest) in enumerate(rows):
        last, n, expected, base = None, 0, [], None
        for t in ticks[i]:
            if limit and n >= limit:
                break
            base = model.planned(cron, start, last, 20) if base is None else base
            if base is None:
                break
            if base > t:
                continue
            if stop is not None and t > stop:
                break
            last, n, base = t, n + 1, None
            expected.append((n, t))
        assert sorted(got.get(f"t{i:03}", [])) == expected, rows[i]


@pytest.mark.parametrize("cron", ["@every 24h", "0 0 * * *", "* * * * *"])
def test_largest_limit_is_no_limit(spark, cron):
    rows = spark.createDataFrame(
        [("d", "a", cron, 2**31 - 1), ("d", "b", cron, 0)], "domain string, timer_uuid string, cron string, max_executions int"
    ).withColumn("start_time", F.timestamp_micros(F.lit(0))).withColumn("stop_time", F.lit(None).cast("timestamp"))
    got = calendar.fire_calendar(rows, 0, 2 * calendar.DAY_US).groupBy("timer_uuid").count().collect()
    assert len(got) == 2 and len({r["count"] for r in got}) == 1
