"""Tables of many domains in a bounded number of folders."""

import os

from pyspark.sql import functions as F

from tickledger.sources import tables


def test_many_domains_need_few_folders(spark, tmp_path):
    path = str(tmp_path / "timers")
    rows = spark.range(2_000).select(F.concat(F.lit("u"), F.col("id") % 500).alias("domain"), F.col("id").cast("string").alias("timer_uuid"))
    tables.write_by_bucket(rows, path)
    folders = [name for name in os.listdir(path) if "=" in name]
    assert len(folders) <= tables.BUCKETS
    own = tables.scoped({"timers": tables.read_table(spark, path)}, "timers", "u7")
    assert sorted(int(r.timer_uuid) for r in own.collect()) == [7, 507, 1007, 1507]
    assert f"PartitionFilters: [isnotnull({tables.BUCKET}" in own._jdf.queryExecution().executedPlan().toString()
