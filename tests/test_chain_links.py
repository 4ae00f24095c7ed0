"""Links of the chain of streams: offsets without one sort per partition, and the log decoded once."""

import random
import re

from pyspark.sql import functions as F

from test_compaction import RECORD, random_log
from tickledger.sources import logs, sample
from tickledger.streaming import chain, fires, projections

MINUTE = 60_000_000
T0 = 1_706_659_200_000_000


def some_events(spark):
    draw = random.Random(5)
    rows = [("d", f"00000000-0000-0000-0000-{i % 40:012d}", "FIRE", i, T0 + draw.randrange(5000) * MINUTE) for i in range(800)]
    rows += [("d", f"00000000-0000-0000-0000-{i:012d}", "FINISH", i, None) for i in range(40)]
    return spark.createDataFrame(rows, fires.OUTPUT_SCHEMA)


def test_offsets_are_gapless_and_in_order_of_time_over_blocks(spark):
    rows = chain.numbered(logs.fire_records(some_events(spark), 3)).toPandas()
    assert len(rows) == 880 and rows.groupby(["topic", "partition"]).ngroups == 6
    for _, own in rows.groupby(["topic", "partition"]):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == list(range(1, len(own) + 1))
        timed = own["timestamp"].notna()
        assert own[timed]["timestamp"].is_monotonic_increasing
        assert not timed.to_numpy()[timed.sum():].any()  # tombstones come last


def test_no_window_over_the_records_of_a_whole_partition(spark):
    plan = chain.numbered(logs.fire_records(some_events(spark), 3))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\).*\[topic#\d+, partition#\d+, _block#\d+L?\]", plan)


def test_one_decoding_gives_both_tables(spark, tmp_path):
    typed = spark.createDataFrame(random_log(3, n=400), RECORD).withColumn("generation", F.lit("0")).withColumn("k", F.lit(0))
    read, seen = sample.to_envelope(typed), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    log = read.mapInArrow(counted, read.schema)
    handler = projections.execute_log_handler(spark, str(tmp_path / "executions"), str(tmp_path / "progress"))
    handler(log, 0)
    assert seen.value == read.count()
    handler(log, 1)  # delivered again
    projections.executions_handler(spark, str(tmp_path / "alone"))(read, 0)
    projections.progress_handler(str(tmp_path / "p"))(read, 0)
    text = lambda rows: sorted(rows.drop("batch_id").select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0])
    table = lambda name: projections.read_changes(spark, str(tmp_path / name), projections.EXECUTION_ROWS)
    assert text(table("executions")) == text(table("alone")) != []
    current = lambda name: projections.current_progress(projections.read_table(spark, str(tmp_path / name), projections.PROGRESS_CHANGES))
    assert text(current("progress")) == text(current("p")) != []
