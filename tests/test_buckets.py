"""Timers that share buckets of the state, and logs that are written in several files a slice."""

import pandas as pd

from test_streaming import HOUR, MINUTE, T0, Handle, command_log, expected_fires, run_fires, state
from tickledger.functions import codec
from tickledger.sources import sample
from tickledger.streaming import fires


class Counted(Handle):
    calls = 0

    def get(self):
        self.calls += 1
        return super().get()

    def update(self, value):
        self.calls += 1
        super().update(value)


def test_the_timers_of_a_bucket_share_their_calls_into_the_state():
    every = {name: state("@every 600s")[name] for name, _ in fires.SCHEDULE_FIELDS}
    at = pd.Timestamp(T0 * 1000)
    rows = [{"timestamp": at, "offset": i, "kind": codec.UPSERT, "domain": "d", "timer_uuid": f"k{i:03}"} | every for i in range(200)]
    handle, processor = Counted(), fires.BucketProcessor()
    processor.init(handle)
    assert list(processor.handleInputRows((0,), iter([pd.DataFrame(rows[:90]), pd.DataFrame(rows[90:])]), None)) == []
    assert handle.calls <= 3 and len(handle.timers) == 1
    now = type("Times", (), {"getCurrentWatermarkInMs": lambda self: (T0 + HOUR) // 1000})()
    got = pd.concat(processor.handleExpiredTimer((0,), now, None))
    assert handle.calls <= 6 and got.groupby("timer_uuid")["n"].apply(list).to_dict() == {f"k{i:03}": [1, 2, 3, 4, 5, 6, 7] for i in range(200)}
    # a delete takes its own timer away only
    gone = pd.DataFrame([rows[7] | {"timestamp": pd.Timestamp((T0 + HOUR + MINUTE) * 1000), "kind": codec.DELETE}])
    assert list(processor.handleInputRows((0,), iter([gone]), None)) == []
    later = type("Times", (), {"getCurrentWatermarkInMs": lambda self: (T0 + HOUR + 10 * MINUTE) // 1000})()
    got = pd.concat(processor.handleExpiredTimer((0,), later, None))
    assert sorted(got["timer_uuid"]) == [f"k{i:03}" for i in range(200) if i != 7] and set(got["n"]) == {8}


def test_all_timers_in_one_bucket(spark, tmp_path):
    log = command_log(5)
    got, _ = run_fires(spark, log, str(tmp_path), 3, buckets=1)
    assert got == expected_fires(log)


def test_slices_have_as_many_files_each(spark, sf_dir, tmp_path):
    records, path = sample.records(spark, sf_dir), str(tmp_path / "log")
    _, parts = sample.write_in_files(records, path, 4, closing=True, part_rows=50)
    assert parts == 5 and len(spark.read.schema(records.schema).parquet(path).inputFiles()) == 5 * parts
    query = sample.stream_files(spark, path, records.schema, parts).select("timestamp", "partition").writeStream.format("parquet")
    run = query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [p.batchId for p in run.recentProgress if p.numInputRows] == list(range(5))
    assert spark.read.parquet(str(tmp_path / "out")).count() == records.count() + 1
