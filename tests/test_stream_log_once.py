"""The log of a streaming query is made once, and its tables in few files."""

from pyspark.sql import functions as F

from test_compaction import RECORD, random_log
from tickledger.sources import sample
from tickledger.streaming import projections


def test_records_are_made_once_for_all_slices(spark, sf_dir, tmp_path):
    records, made = sample.records(spark, sf_dir).cache(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    total = records.count()
    path = str(tmp_path / "log")
    sample.write_in_files(records.mapInArrow(counted, records.schema), path, 4)
    assert made.value <= 2 * total  # the bounds of its time, and the records themselves
    written = spark.read.schema(records.schema).parquet(path)
    text = lambda rows: sorted(rows.select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0])
    assert text(written) == text(records) and written.count() == total
    records.unpersist()


def test_a_batch_writes_the_executions_of_a_day_together(spark, tmp_path):
    typed = spark.createDataFrame(random_log(3, n=400), RECORD).withColumn("generation", F.lit("0")).withColumn("k", F.lit(0))
    path, name = str(tmp_path / "rows"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        projections.executions_handler(spark, path)(sample.to_envelope(typed), 0)
    finally:
        spark.conf.set(name, before)
    rows = spark.read.parquet(path)
    assert rows.count() > 20
    assert len(rows.inputFiles()) == rows.select("day").distinct().count()
