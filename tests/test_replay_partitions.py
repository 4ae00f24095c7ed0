"""The fold of repeat intervals when adaptive execution splits the join before it."""

import pytest

from model import us
from test_schedule import S, timers
from tickledger.operators import replay


@pytest.fixture
def split_joins(spark):
    """Sorted joins whose larger partitions are split, as those of a hot timer are."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_ticks_of_a_timer_stay_together(split_joins):
    spark = split_joins
    start = us(2024, 1, 1)
    rows = [("@every 90m", start, None, 0, 0, None), ("@every 90m", start, None, 3, 0, None)]
    data = [("d", f"t{i:03}", start + n * 60 * S) for i, size in enumerate((20_000, 2_000)) for n in range(size)]
    ticks = spark.createDataFrame(data, "domain string, timer_uuid string, tick_us long").repartition(4)
    got = {}
    for r in replay.replay_fires(timers(spark, rows), ticks).collect():
        got.setdefault(r.timer_uuid, []).append((r.n, r.fire_us))
    for name, fires in (("t000", -(-20_000 // 90)), ("t001", 3)):
        assert sorted(got[name]) == [(n + 1, start + n * 5400 * S) for n in range(fires)]
