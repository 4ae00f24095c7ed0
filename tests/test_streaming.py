import datetime as dt
import random
import zlib

import pytest

import model
from model import us
from pyspark.sql import functions as F

from test_compaction import RECORD, in_projection_order, random_log
from tickledger import schemas as S
from tickledger.functions import codec
from tickledger.operators import compaction
from tickledger.sources import logs, sample
from tickledger.streaming import chain, fence, fires, projections

KEY = S.KEY_COLUMNS


def write_in_files(spark, rows, schema, path, n):
    """One file per slice of the log, in log order."""
    size = -(-len(rows) // n)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)


def envelope_stream(spark, rows, path, n):
    typed = spark.createDataFrame(rows, RECORD).withColumn("generation", F.lit("0")).withColumn("k", F.lit(0))
    log = [tuple(r) for r in sample.to_envelope(typed).orderBy("offset").collect()]
    write_in_files(spark, log, S.ENVELOPE, path, n)
    return logs.stream_log(spark, path, files_per_batch=1)


@pytest.fixture(scope="module")
def rows():
    ordered = in_projection_order(random_log(21, n=120))
    # offsets in projection order, so that file order is log order
    return [(*r[:2], i, r[3], *r[4:]) for i, r in enumerate(ordered)]


def test_timers_and_progress_equal_the_batch_tables(spark, rows, tmp_path):
    stream = envelope_stream(spark, rows, str(tmp_path / "log"), 4)
    records = spark.createDataFrame(rows, RECORD)
    for delete_on in ("execute", "any"):
        base = str(tmp_path / delete_on)
        projections.run(stream, projections.timers_handler(base, delete_on), f"{base}/cp")
        changes = projections.read_table(spark, base, projections.TIMER_CHANGES)
        assert changes.select("batch_id").distinct().count() == 4
        got = {r.timer_uuid: r.created_offset for r in projections.current_timers(changes).collect()}
        expected = compaction.timers_projection(records, delete_on).collect()
        assert got == {r.timer_uuid: r.created_offset for r in expected}
    base = str(tmp_path / "progress")
    projections.run(stream, projections.progress_handler(base), f"{base}/cp")
    changes = projections.read_table(spark, base, projections.PROGRESS_CHANGES)
    got = {r.timer_uuid: r.offset for r in projections.current_progress(changes).collect()}
    assert got == {r.timer_uuid: r.offset for r in compaction.progress_latest(records).collect()}


@pytest.mark.parametrize("table", ["timers", "progress"])
def test_folded_tables_open_as_many_files_at_any_age(spark, rows, tmp_path, table):
    stream, log = str(tmp_path / "table"), str(tmp_path / "log")
    typed = spark.createDataFrame(rows, RECORD).withColumn("generation", F.lit("0")).withColumn("k", F.lit(0))
    sample.to_envelope(typed).coalesce(1).write.parquet(log)
    every = 2
    if table == "timers":
        handler, schema, current = projections.timers_handler(stream, "any", every), projections.TIMER_CHANGES, projections.current_timers
        twin, column = (lambda r: compaction.timers_projection(r, "any")), "created_offset"
    else:
        handler, schema, current = projections.progress_handler(stream, every), projections.PROGRESS_CHANGES, projections.current_progress
        twin, column = compaction.progress_latest, "offset"
    opened, records = [], spark.createDataFrame(rows, RECORD)
    for i in range(7):
        part = (F.col("offset") >= i * 18) & (F.col("offset") < (i + 1) * 18)
        handler(logs.read_log(spark, log).where(part), i)
        if i == 3:
            handler(logs.read_log(spark, log).where(part), i)  # a batch may run again, also right after its fold
        changes = projections.read_table(spark, stream, schema)
        opened.append(changes.select("batch_id").distinct().count())
        got = {r.timer_uuid: r[column] for r in current(changes).collect()}
        assert got == {r.timer_uuid: r[column] for r in twin(records.where(F.col("offset") < (i + 1) * 18)).collect()}
    assert max(opened) <= every
    assert len(projections.entries(spark, f"{stream}/changes", "batch_id")) <= 2 * every
    assert projections.entries(spark, f"{stream}/base", "upto") == [3, 5]


def test_executions_of_other_days_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "rows")
    handler = projections.executions_handler(spark, path)
    day = lambda n: [("execute", 0, n * 10 + i, at(T0 + n * 24 * HOUR + i * MINUTE), codec.UPSERT, "d", "k", None, ((i, at(T0)), b"{}")) for i in range(4)]
    batches = [day(0), day(1), day(0)[:2] + day(2), day(5), day(1)[:1] + day(5)]
    for i, batch in enumerate(batches):
        typed = spark.createDataFrame(batch, RECORD).withColumn("generation", F.lit("0")).withColumn("k", F.lit(0))
        handler(sample.to_envelope(typed), i)
    got = projections.read_changes(spark, path, projections.EXECUTION_ROWS)
    assert sorted(r.offset for r in got.collect()) == [n * 10 + i for n in (0, 1, 2, 5) for i in range(4)]
    some = projections.read_days(spark, path, [dt.date(2024, 1, 1), dt.date(2024, 1, 3), dt.date(2030, 1, 1)])
    assert {f.split("day=")[1][:10] for f in some.inputFiles()} == {"2024-01-01", "2024-01-03"} and some.count() == 8


def test_executions_are_inserted_once(spark, rows, tmp_path):
    records = spark.createDataFrame(rows, RECORD)
    doubled = sorted(rows + rows[::3], key=lambda r: r[2]) + rows[::5]  # near and late redeliveries
    stream = envelope_stream(spark, doubled, str(tmp_path / "log"), 4)
    handler = projections.executions_handler(spark, str(tmp_path / "rows"))
    projections.run(stream, handler, str(tmp_path / "cp"))
    got = projections.read_changes(spark, str(tmp_path / "rows"), projections.EXECUTION_ROWS)
    expected = compaction.executions(records)
    assert got.count() == expected.count() == got.select(*KEY, "kafka_timestamp").distinct().count()
    # running a batch again replaces its rows
    last = got.agg(F.max("batch_id")).first()[0]
    handler(logs.read_log(spark, str(tmp_path / "log")), last)
    again = projections.read_changes(spark, str(tmp_path / "rows"), projections.EXECUTION_ROWS)
    assert again.select(*KEY, "kafka_timestamp").exceptAll(expected.select(*KEY, "kafka_timestamp")).count() == 0
    assert again.count() == expected.count()


T0 = us(2024, 1, 1)
MINUTE, HOUR = 60_000_000, 3_600_000_000


def at(micros):
    return dt.datetime.fromtimestamp(micros / 1e6, dt.timezone.utc)


def command_log(seed, n=40):
    """(kind, key, time, schedule) in time order, closed by a record far in the future."""
    rng = random.Random(seed)
    crons = ["*/15 * * * *", "0 */2 * * *", "@every 25m", "@every 3h", "30 6 * * 1-5"]
    t, out = T0, []
    for _ in range(n):
        t += rng.randint(1, 60) * MINUTE + rng.randint(0, 999) * 1000
        key = f"k{rng.randrange(5)}"
        if rng.random() < 0.25:
            out.append((codec.DELETE, key, t, None))
        else:
            start = t // 1_000_000 * 1_000_000 + rng.choice([0, 0, 40 * MINUTE])
            stop = rng.choice([None, None, t + rng.randint(0, 8) * HOUR])
            out.append((codec.UPSERT, key, t, (rng.choice(crons), start, stop, rng.choice([0, 0, 3]))))
    out.append((codec.DELETE, "closing", t + 9 * HOUR, None))
    return out


def as_records(log):
    rows = []
    for i, (kind, key, t, schedule) in enumerate(log):
        create = None
        if schedule:
            cron, start, stop, limit = schedule
            http = ((f"http://h/{i}", 0, None, None, True),)
            create = (http, (cron, at(start), at(stop) if stop is not None else None, limit), None)
        rows.append(("create", 0, i, at(t), kind, "d", key, create, None))
    return rows


def run_fires(spark, log, path, files, **options):
    for part in files if isinstance(files, list) else [None]:
        rows = as_records(log)
        write_in_files(spark, [rows[i] for i in part] if part else rows, RECORD, f"{path}/log", 1 if part else files)
    schema = spark.read.parquet(f"{path}/log").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    events = fires.fires(stream, options.pop("delay", "0 seconds"), **options)
    writer = events.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
    query = writer.trigger(availableNow=True).start()
    fires.run_checked(query)
    out = spark.read.schema(fires.OUTPUT_SCHEMA).parquet(f"{path}/out").collect()
    watermarks = [p["eventTime"].get("watermark") for p in query.recentProgress]
    got = {}
    for r in out:
        got.setdefault(r.timer_uuid, []).append((r.event, r.n, r.fire_us))
    return {k: sorted(v, key=lambda e: (e[2] or 1 << 62, e[1])) for k, v in got.items()}, watermarks


def expected_fires(log, restored=(), delay=0):
    """Every planned fire of every life of every key, up to the last time of the log less the delay."""
    end = (log[-1][2] - delay) // 1000 * 1000
    lives = [(key, schedule, 0, None, -1) for key, schedule, *_ in ()]
    for key, schedule, done, last in restored:
        lives.append((key, schedule, done, last, -1))
    for i, (kind, key, _t, schedule) in enumerate(log):
        if kind == codec.UPSERT:
            lives.append((key, schedule, 0, None, i))
    got = {}
    for key, (cron, start, stop, limit), done, last, i in lives:
        later = [t for _k, other, t, _s in log[i + 1 :] if other == key]
        until = later[0] - 1 if later else end
        while True:
            fire = None if limit and done >= limit else model.planned(cron, start, last, 20)
            if fire is None or (stop is not None and fire > stop):
                got.setdefault(key, []).append(("FINISH", done, None))
                break
            if fire > until:
                break
            done, last = done + 1, fire
            got.setdefault(key, []).append(("FIRE", done, fire))
    return {k: sorted(v, key=lambda e: (e[2] or 1 << 62, e[1])) for k, v in got.items()}


@pytest.mark.parametrize("files", [1, 3])
def test_all_fires_do_not_depend_on_the_batches(spark, tmp_path, files):
    log = command_log(5)
    got, _ = run_fires(spark, log, str(tmp_path), files)
    assert got == expected_fires(log)


def lagging_files(log):
    """Four files in which half of the keys arrive one file later than the others, as partitions may."""
    n = len(log) - 1  # the closing command comes last
    late = [i for i in range(n) if zlib.crc32(log[i][1].encode()) % 2]
    soon = [i for i in range(n) if i not in set(late)]
    third = lambda rows, k: rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
    return [third(soon, 0), third(soon, 1) + third(late, 0), third(soon, 2) + third(late, 1), third(late, 2) + [n]]


def test_partitions_may_run_apart_by_the_delay(spark, tmp_path):
    log = command_log(5)
    log[-1] = (codec.DELETE, "closing", log[-1][2] + 100 * HOUR, None)
    got, _ = run_fires(spark, log, str(tmp_path), lagging_files(log), delay="100 hours")
    assert got == expected_fires(log, delay=100 * HOUR)


def test_lost_commands_stop_the_stream(spark, tmp_path):
    log = command_log(5)
    with pytest.raises(RuntimeError, match="late commands"):
        run_fires(spark, log, str(tmp_path), lagging_files(log))


def test_invalid_create_leaves_the_timer_alone(spark, tmp_path):
    log = [
        (codec.UPSERT, "a", T0, ("@every 1h", T0, None, 3)),
        (codec.UPSERT, "a", T0 + HOUR + MINUTE, ("not a cron", T0, None, 0)),
        (codec.UPSERT, "b", T0 + 2 * HOUR, ("@every 99999999999h", T0, None, 0)),
        (codec.DELETE, "x", T0 + 9 * HOUR, None),
    ]
    got, _ = run_fires(spark, log, str(tmp_path), 2)
    assert got == expected_fires([log[0], log[-1]])


def test_restored_timers_keep_their_progress(spark, tmp_path):
    log = command_log(9, n=12)
    restored = [
        ("k1", ("*/15 * * * *", T0 - HOUR, None, 0), 4, T0 - 5 * MINUTE),
        ("quiet", ("@every 3h", T0 - 5 * HOUR, None, 4), 2, T0 - 2 * HOUR),
        ("done", ("@daily", T0 - 50 * HOUR, None, 2), 2, T0 - 2 * HOUR),
        ("fresh", ("0 */2 * * *", T0 + 1, None, 0), 0, None),
    ]
    rows = [
        ("d", key, cron, at(start), at(stop) if stop is not None else None, limit, done, at(last) if last is not None else None)
        for key, (cron, start, stop, limit), done, last in restored
    ]
    state = spark.createDataFrame(
        rows,
        "domain string, timer_uuid string, cron string, start_time timestamp, stop_time timestamp, max_executions int, "
        "completed_executions int, last_execution timestamp",
    )
    got, _ = run_fires(spark, log, str(tmp_path), 2, restored=state)
    model_restored = [(k, (c if c != "@daily" else "0 0 * * *", *r), n, last) for k, (c, *r), n, last in restored]
    assert got == expected_fires(log, model_restored)


def test_coalesced_fires_happen_once_per_watermark(spark, tmp_path):
    log = [
        (codec.UPSERT, "a", T0, ("@every 10m", T0, None, 0)),
        (codec.UPSERT, "b", T0, ("*/15 * * * *", T0, None, 2)),
        (codec.UPSERT, "c", T0 + MINUTE, ("@every 10m", T0, T0 + 30 * MINUTE, 0)),
        (codec.DELETE, "x", T0 + 2 * HOUR, None),
        (codec.DELETE, "y", T0 + 2 * HOUR + MINUTE, None),
        (codec.DELETE, "x", T0 + 5 * HOUR, None),
    ]
    got, watermarks = run_fires(spark, log, str(tmp_path), 2, catch_up="coalesce")
    ticks = sorted({us(*dt.datetime.fromisoformat(w[:-1]).timetuple()[:6]) for w in watermarks if w} - {0})
    assert ticks and ticks[-1] == T0 + 5 * HOUR
    expected = {}
    for key, cron, start, stop, limit in [
        ("a", "@every 10m", T0, None, 0), ("b", "*/15 * * * *", T0, None, 2), ("c", "@every 10m", T0, T0 + 30 * MINUTE, 0),
    ]:
        done, last, events = 0, None, []
        for now in ticks:
            base = model.planned(cron, start, last)
            if base > now:
                continue
            if stop is not None and now > stop:
                events.append(("FINISH", done, None))
                break
            done, last = done + 1, now
            events.append(("FIRE", done, now))
            if limit and done >= limit:
                events.append(("FINISH", done, None))
                break
        expected[key] = events
    assert got == expected


class Handle:
    """A processor's state outside of a stream."""

    def __init__(self, value=None):
        self.value, self.timers = value, set()

    def getValueState(self, _name, _schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, millis):
        self.timers.add(millis)

    def deleteTimer(self, millis):
        self.timers.discard(millis)


def state(cron, **fields):
    timer = dict.fromkeys(fires.STATE_NAMES) | {"cron_kind": "fields", "start_us": T0, "max_executions": 0, "completed": 0}
    if cron.startswith("@every"):
        timer |= {"cron_kind": "every", "every_s": int(cron.split()[1][:-1])}
    else:
        low = [0, 0, 1, 1, 0]
        sizes = [60, 24, 32, 13, 7]
        for mask, text, start, end in zip(["minute_mask", "hour_mask", "dom_mask", "month_mask", "dow_mask"], cron.split(), low, sizes, strict=True):
            timer[mask] = sum(1 << v for v in (range(start, end) if text == "*" else map(int, text.split(","))))
        timer |= {"dom_star": cron.split()[2] == "*", "dow_star": cron.split()[4] == "*"}
    timer |= fields
    timer["due_us"] = fires.planned(timer)
    return timer


@pytest.mark.parametrize("cron", ["@every 7s", "@every 86400s", "0,30 6,18 * * *", "5 * 29 2 *", "0 0 1,15 * 1", "* * * * *"])
def test_arrays_of_instants_equal_single_steps(cron):
    timer = state(cron)
    until = T0 + 40 * 24 * HOUR if cron[0] != "5" else T0 + 2000 * 24 * HOUR
    one, want = dict(timer), []
    while one["due_us"] is not None and one["due_us"] <= until and len(want) < 5000:
        want.append(one["due_us"])
        one |= {"last_us": one["due_us"], "completed": one["completed"] + 1}
        one["due_us"] = fires.planned(one)
    for most in (1, 3, 4999):
        assert fires.instants(timer, until, most).tolist() == want[:most]


@pytest.mark.parametrize("limit, stop, total, finished", [(0, None, 31_536_001, False), (20_000_001, None, 20_000_001, True), (0, T0 + 24 * HOUR, 86_401, True)])
def test_a_year_of_seconds_comes_in_small_frames(limit, stop, total, finished):
    processor = fires.TimerProcessor()
    timer = state("@every 1s", max_executions=limit, stop_us=stop)
    handle = Handle(tuple(timer[name] for name in fires.STATE_NAMES))
    processor.init(handle)
    now = type("Times", (), {"getCurrentWatermarkInMs": lambda self: (T0 + 365 * 24 * HOUR) // 1000})()
    seen, events = 0, set()
    for frame in processor.handleExpiredTimer(("d", "k"), now, None):
        assert len(frame) <= fires.PART_ROWS
        fired = frame[frame["event"] == "FIRE"]
        assert not len(fired) or (fired["n"].iloc[0], fired["fire_us"].iloc[0]) == (seen + 1, T0 + seen * 1_000_000)
        seen += len(fired)
        events |= set(frame["event"])
    assert seen == total and ("FINISH" in events) == finished and (handle.value is None) == finished


def test_seconds_missed_for_two_days_in_a_stream(spark, tmp_path):
    log = [(codec.UPSERT, "a", T0, ("@every 1s", T0, None, 0)), (codec.DELETE, "x", T0 + 48 * HOUR, None)]
    got, _ = run_fires(spark, log, str(tmp_path), 2)
    assert [n for _, n, _ in got["a"]] == list(range(1, 172_802))
    assert [at for *_, at in got["a"]] == [T0 + i * 1_000_000 for i in range(172_801)]


def test_partitions_wait_for_their_own_marker(spark, tmp_path):
    create = lambda i: (((f"http://h/{i}", 0, None, None, True),), ("@daily", at(T0), None, i), None)
    marks = {(0, 40): "7", (0, 90): "7", (1, 5): "7", (2, 50): "6"}  # partition 2 sees a foreign one, 3 none
    rows = []
    for i in range(120):
        for p in range(4):
            mark = marks.get((p, i))
            kind = codec.MARKER if mark else codec.UPSERT
            rows.append(("create", p, i, at(T0 + i * MINUTE), kind, None if mark else "d", None if mark else f"k{i}", None if mark else create(i), None, mark or "0"))
    typed = spark.createDataFrame(rows, RECORD + ", generation string").withColumn("k", F.lit(0))
    log = sorted((tuple(r) for r in sample.to_envelope(typed).collect()), key=lambda r: (r[2] + 30 * (r[1] % 2), r[1]))
    write_in_files(spark, log, S.ENVELOPE, str(tmp_path / "log"), 5)
    stream = logs.stream_log(spark, str(tmp_path / "log"), files_per_batch=1)
    writer = fence.released(stream, "7").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) >= 4
    got = spark.read.schema(fence.OUTPUT_SCHEMA).parquet(str(tmp_path / "out"))
    batch = logs.with_phase(spark.createDataFrame(log, S.ENVELOPE), "7", first=True).where("phase <> 'waiting'")
    columns = ["partition", "offset", "fence", "phase", "key", "value"]
    assert got.count() == 240
    assert got.select(*columns).exceptAll(batch.select(*columns)).count() == 0


def test_fires_become_log_records_in_order(spark, tmp_path):
    rows = [("d", "00000000-0000-0000-0000-00000000000a", "FIRE", n, T0 + n * MINUTE) for n in (2, 1, 3)]
    rows += [("d", "00000000-0000-0000-0000-00000000000a", "FINISH", 3, None), ("d", "00000000-0000-0000-0000-00000000000b", "FIRE", 1, T0)]
    handler = chain.append_handler(str(tmp_path), 2)
    events = spark.createDataFrame(rows, fires.OUTPUT_SCHEMA)
    handler(events, 0)
    handler(events, 1)
    handler(events, 1)  # a batch may run again
    log = codec.decode_records(spark.read.schema(S.ENVELOPE).parquet(str(tmp_path)))
    mine = log.where(F.col("timer_uuid").endswith("a")).orderBy("topic", "offset").collect()
    assert [(r.topic, r.kind, r.execute and r.execute.progress.completed_executions) for r in mine] == [
        ("create", codec.DELETE, None)] * 2 + [("execute", codec.UPSERT, 1), ("execute", codec.UPSERT, 2), ("execute", codec.UPSERT, 3), ("execute", codec.DELETE, None)] * 2
    assert log.groupBy("topic", "partition", "offset").count().where("count > 1").count() == 0
    assert {r.offset >> chain.OFFSET_BITS for r in mine} == {0, 1}
