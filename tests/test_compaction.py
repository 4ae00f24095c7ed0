import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import codec
from tickledger.operators import compaction, skew
from tickledger.sources import sample

KEY = S.KEY_COLUMNS
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
RECORD = (
    "topic string, partition int, offset long, timestamp timestamp, kind string, domain string, timer_uuid string, "
    f"create {S.CREATE.simpleString()}, execute {S.EXECUTE.simpleString()}"
)


def random_log(seed, n=400, keys=6):
    """Most rows belong to one key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "k0" if rng.random() < 0.6 else f"k{rng.randrange(keys)}"
        topic, kind = rng.choice(
            [("create", codec.UPSERT), ("create", codec.UPSERT), ("create", codec.DELETE), ("execute", codec.UPSERT), ("execute", codec.DELETE)]
        )
        http = ((f"http://h/{i}", 0, None, None, True),)
        create = (http, ("@daily", T0, None, i), None) if (topic, kind) == ("create", codec.UPSERT) else None
        execute = ((i, T0), b"{}") if (topic, kind) == ("execute", codec.UPSERT) else None
        when = T0 + dt.timedelta(seconds=i // 2)  # pairs share a time
        rows.append((topic, int(key[1:]) % 3, i, when, kind, "d", key, create, execute))
    return rows


def in_projection_order(rows):
    return sorted(rows, key=lambda r: (r[3], r[0], r[2]))


BLOCKS_US = [1, 7_000_000, 3_600_000_000]


@pytest.mark.parametrize("seed, block_us", [(s, BLOCKS_US[s % 3]) for s in range(6)])
@pytest.mark.parametrize("delete_on", ["execute", "any"])
def test_projection_equals_sequential_writes(spark, seed, block_us, delete_on):
    rows = random_log(seed, n=150 + 100 * (seed % 3))
    table = {}
    for topic, _p, offset, _t, kind, _d, key, _c, _e in in_projection_order(rows):
        if kind == codec.DELETE and (delete_on == "any" or topic == "execute"):
            table.pop(key, None)
        elif topic == "create" and kind == codec.UPSERT:
            table.setdefault(key, offset)  # insert only
    got = compaction.timers_projection(spark.createDataFrame(rows, RECORD), delete_on, block_us=block_us).collect()
    assert {r.timer_uuid: r.created_offset for r in got} == table
    assert all(r.create.schedule.max_executions == r.created_offset for r in got)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_read_the_log_once_and_sort_no_payload(spark, sf_dir):
    records = sample.records(spark, sf_dir)
    sessions = plan(compaction.create_sessions(records, parts=("schedule",)))
    assert sessions.count("FileScan") == 1 and "Broadcast" not in sessions and "Aggregate" not in sessions
    tombs = plan(compaction.apply_tombstones(compaction.upserts(records), records))
    assert tombs.count("FileScan") == 2 and "SortAggregate" not in tombs and "ObjectHash" not in tombs
    live = plan(compaction.live_creates(records))
    assert live.count("FileScan") == 2 and "SortAggregate" not in live


def test_session_fields_of_deleted_and_recreated_timers(spark):
    create = ((("http://h/", 0, None, None, True),), ("@daily", T0, None, 0), None)
    row = lambda i, kind, key: ("create", 0, i, T0 + dt.timedelta(hours=i), kind, "d", key, create if kind == codec.UPSERT else None, None)
    log = [row(0, codec.UPSERT, "a"), row(1, codec.DELETE, "a"), row(5, codec.UPSERT, "a"), row(9, codec.UPSERT, "a"), row(2, codec.UPSERT, "b"), row(3, codec.DELETE, "b"), row(4, codec.UPSERT, "c")]
    got = {r.timer_uuid: (r.has_delete, r.deleted_at and r.deleted_at.hour, r.created_offset, r.create is None) for r in compaction.create_sessions(spark.createDataFrame(log + log, RECORD), "any").collect()}
    assert got == {"a": (True, 1, 5, False), "b": (True, 3, None, True), "c": (False, None, 4, False)}


def test_live_creates_equal_a_map(spark):
    rows = random_log(3)
    live = {}
    for topic, _p, offset, _t, kind, _d, key, _c, _e in sorted(rows, key=lambda r: r[2]):
        if topic == "create":
            if kind == codec.DELETE:
                live.pop(key, None)
            else:
                live[key] = offset
    records = spark.createDataFrame(rows, RECORD)
    assert {r.timer_uuid: r.offset for r in compaction.live_creates(records).collect()} == live
    cut = compaction.live_creates(records, parts=("schedule",))
    assert cut.select("create.*").columns == ["schedule"]
    assert {r.timer_uuid: r.create.schedule.max_executions for r in cut.collect()} == live


def test_an_invalid_create_does_not_replace_a_valid_one(spark):
    rows = random_log(1, n=0)
    good = (("http://h/", 0, None, None, True),), ("@daily", T0, None, 0), None
    bad = (("http://h/", 0, None, None, True),), ("nonsense", T0, None, 0), None
    rows = [
        ("create", 0, 1, T0, codec.UPSERT, "d", "k", good, None),
        ("create", 0, 2, T0, codec.UPSERT, "d", "k", bad, None),
    ]
    records = spark.createDataFrame(rows, RECORD)
    assert [r.offset for r in compaction.live_creates(records).collect()] == [1]
    rejected = compaction.valid_creates(records)[1].collect()
    assert [(r.offset, r.rejected) for r in rejected] == [(2, "invalid schedule: invalid cron: expected 5 fields")]


def test_tombstones_remove_earlier_rows_only(spark):
    rows = random_log(5)
    records = spark.createDataFrame(rows, RECORD)
    ups = compaction.upserts(records)
    got = {r.offset for r in compaction.apply_tombstones(ups, records).collect()}
    last = {}
    for row in in_projection_order(rows):
        if row[4] == codec.DELETE:
            last[row[6]] = (row[3], row[0], row[2])
    expected = {
        r[2] for r in rows if r[4] == codec.UPSERT and (r[6] not in last or (r[3], r[0], r[2]) > last[r[6]])
    }
    assert got == expected


@pytest.mark.parametrize("block_rows", [1, 7, 64, 10**6])
def test_running_progress_does_not_depend_on_the_blocks(spark, block_rows):
    rows = random_log(8)
    records = spark.createDataFrame(rows, RECORD)
    got = {r.offset: (r.completed, r.previous_execution) for r in compaction.running_progress(records, block_rows=block_rows).collect()}
    seen, expected = {}, {}
    for topic, _p, offset, when, kind, _d, key, _c, _e in rows:
        if topic == "execute" and kind == codec.UPSERT:
            n, previous = seen.get(key, (0, None))
            expected[offset] = (n + 1, previous)
            seen[key] = (n + 1, when.replace(tzinfo=None))
    assert {k: (n, p and p.replace(tzinfo=None)) for k, (n, p) in got.items()} == expected


def test_a_hot_key_is_split_in_the_join(spark):
    big = spark.range(0, 400_000, 1, 16).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("key"), F.xxhash64("id").alias("offset"))
    per_key = big.groupBy("key").agg(F.count(F.lit(1)).alias("v")).where("key <> 20")
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = skew.split_join(big, per_key, ["key"])
        assert out.count() == 400_000 and out.columns == ["key", "offset", "v"]
        assert {r.v for r in out.where("key = 20").collect()} == {None}
        assert out.where("key = 0 and v <> 360000 + 1").count() == 0
        spread = out.groupBy("key", F.spark_partition_id()).agg(F.bit_xor("offset")).where("key = 0")
        assert len(spread.collect()) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_compaction_is_idempotent_and_replay_safe(spark, sf_dir):
    records = sample.records(spark, sf_dir)
    twice = records.unionByName(records)
    builds = {
        compaction.compact_log: ["offset", "kind"],
        compaction.progress_latest: ["offset", "completed_executions"],
        compaction.executions: ["kafka_timestamp", "offset"],
        compaction.timers_projection: ["created_offset"],
    }
    for build, columns in builds.items():
        once, again = build(records).select(*KEY, *columns), build(twice).select(*KEY, *columns)
        assert once.exceptAll(again).count() == 0 and again.exceptAll(once).count() == 0


def test_upsert_and_advance(spark):
    schema = "domain string, timer_uuid string, completed_executions int, last_execution timestamp, offset long"
    target = spark.createDataFrame([("d", "a", 1, T0, 1), ("d", "b", 5, T0, 2)], schema)
    batch = spark.createDataFrame([("d", "a", 3, T0, 9), ("d", "a", 2, T0, 8), ("d", "c", 1, None, 7)], schema)
    got = {r.timer_uuid: r.completed_executions for r in compaction.upsert_latest(target, batch).collect()}
    assert got == {"a": 3, "b": 5, "c": 1}
    stale = {r.timer_uuid: r.completed_executions for r in compaction.upsert_latest(batch, target).collect()}
    assert stale == got


def test_new_executions_meet_few_rows_of_the_target(spark, sf_dir, tmp_path):
    records = sample.records(spark, sf_dir)
    path = str(tmp_path / "target")
    every = compaction.executions(records)
    every.write.parquet(path)
    target = spark.read.parquet(path)
    by = [*KEY, "kafka_timestamp"]
    batch = every.where(F.pmod("offset", F.lit(50)) == 0)
    ids = batch.count()
    through = compaction.possibly_in(target, batch, by)
    assert through.join(batch, by, "left_semi").count() == ids and through.count() < ids + 0.02 * target.count()
    fresh = batch.withColumn("kafka_timestamp", F.col("kafka_timestamp") + F.expr("interval 1 second"))
    assert compaction.append_new(batch.unionByName(fresh), target).exceptAll(fresh).count() == 0
    assert compaction.append_new(batch.unionByName(fresh), target).count() == fresh.join(target, by, "left_anti").count()
    assert compaction.append_new(batch.limit(0), target).count() == 0
    text = plan(every)
    assert "Aggregate" not in text and text.count("FileScan") == 1
