"""Keep the projected tables up to date from the logs, one micro-batch at a time.

Each batch is first reduced to one row per key and then appended to a changelog folder of its own,
so a batch that runs again after a failure replaces what it wrote before. The current table is a
fold over the last snapshot and the changes after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tickledger import schemas as S
from tickledger.functions import codec
from tickledger.operators import compaction
from tickledger.sources.tables import write_batch

KEY = S.KEY_COLUMNS

TIMER_CHANGES = (
    "domain string, timer_uuid string, has_delete boolean, created_at timestamp, created_offset long, "
    f"create {S.CREATE.simpleString()}, batch_id long"
)
PROGRESS_CHANGES = (
    "domain string, timer_uuid string, partition int, offset long, completed_executions int, "
    "last_execution timestamp, batch_id long"
)
EXECUTION_ROWS = (
    "domain string, timer_uuid string, kafka_timestamp timestamp, partition int, offset long, "
    f"execute {S.EXECUTE.simpleString()}, day date, batch_id long"
)
# A folded table gets a new snapshot after this many batches.
FOLD_EVERY = 16
GOOD_ROWS = "topic string, partition int, offset long, kind string, domain string, timer_uuid string, batch_id long"
BAD_ROWS = "topic string, partition int, offset long, reason string, key binary, value binary, batch_id long"


def start(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work off everything that is there, in batches, and remember the position in ``checkpoint``."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def run(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = start(stream, handler, checkpoint)
    query.awaitTermination()


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A changelog folder; empty when no batch has been written yet."""
    parsed = T._parse_datatype_string(schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], parsed)
    return spark.read.schema(parsed).parquet(path)


def entries(spark: SparkSession, path: str, name: str, complete: bool = False) -> list[int]:
    """Numbers of the folders ``name=number`` in a folder, in order; ``complete`` ones were written to their end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [(status.getPath(), status.getPath().getName()) for status in files.listStatus(folder)]
    numbers = [(int(text.partition("=")[2]), place) for place, text in found if text.startswith(f"{name}=")]
    done = lambda place: not complete or files.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS"))
    return sorted(number for number, place in numbers if done(place))


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folded table: its newest snapshot as one change, and the changes after it.

    Only the snapshot and at most ``every`` batches are opened, however old the stream is.
    """
    parsed = T._parse_datatype_string(schema)
    rows = T.StructType([f for f in parsed.fields if f.name != "batch_id"])
    upto = max(entries(spark, f"{path}/base", "upto", complete=True), default=-1)
    out = spark.createDataFrame([], parsed)
    if upto >= 0:
        base = spark.read.schema(rows).parquet(f"{path}/base/upto={upto}")
        out = base.withColumn("batch_id", F.lit(upto).cast("long"))
    batches = [f"{path}/changes/batch_id={i}" for i in entries(spark, f"{path}/changes", "batch_id") if i > upto]
    if batches:
        tail = spark.read.schema(parsed).option("basePath", f"{path}/changes").parquet(*batches)
        out = tail if upto < 0 else out.unionByName(tail)
    return out


def add_batch(
    changes: DataFrame, path: str, batch_id: int, schema: str, current: Callable[[DataFrame], DataFrame], every: int
) -> None:
    """Append the changes of a batch to a folded table, and fold it after each ``every`` batches.

    A snapshot counts from its ``_SUCCESS`` file on. What the snapshot before it covers is removed
    then; the newer folders stay for readers that began earlier. A batch that runs again writes the
    same changes and the same snapshot.
    """
    spark = changes.sparkSession
    write_batch(changes, f"{path}/changes", batch_id)
    if (batch_id + 1) % every:
        return
    before = [i for i in entries(spark, f"{path}/base", "upto", complete=True) if i < batch_id]
    names = [f.name for f in T._parse_datatype_string(schema).fields if f.name != "batch_id"]
    current(read_table(spark, path, schema)).select(*names).write.mode("overwrite").parquet(f"{path}/base/upto={batch_id}")
    for old in before[:-1]:
        remove(spark, f"{path}/base/upto={old}")
    for i in entries(spark, f"{path}/changes", "batch_id"):
        if before and i <= before[-1]:
            remove(spark, f"{path}/changes/batch_id={i}")


def timers_handler(path: str, delete_on: str = "execute", every: int = FOLD_EVERY) -> Callable[[DataFrame, int], None]:
    """Per key: whether the batch deletes it, and its first create after the last delete.

    The delete mark is kept next to the create: a batch that deletes and creates again must replace
    an older create, which the create alone could not tell. A batch is read and decoded once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        changes = compaction.create_sessions(codec.decode_records(batch), delete_on).drop("deleted_at")
        fold = lambda rows: current_timers(rows).withColumn("has_delete", F.lit(False))
        add_batch(changes, path, batch_id, TIMER_CHANGES, fold, every)

    return handle


def current_timers(changes: DataFrame) -> DataFrame:
    """Timers after all batches: the first create at or after the last deleting batch.

    A key has at most one row per batch after the last snapshot, which bounds the window.
    """
    last_delete = F.max(F.when(F.col("has_delete"), F.col("batch_id"))).over(Window.partitionBy(*KEY))
    open_rows = changes.withColumn("_last", last_delete).where(
        F.col("create").isNotNull() & (F.col("_last").isNull() | (F.col("batch_id") >= F.col("_last")))
    )
    return compaction.keep_first(open_rows, KEY, F.col("batch_id"), ["created_at", "created_offset", "create"])


def progress_handler(path: str, every: int = FOLD_EVERY) -> Callable[[DataFrame, int], None]:
    """The last progress of each timer of the batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        changes = compaction.progress_latest(codec.decode_records(batch))
        add_batch(changes, path, batch_id, PROGRESS_CHANGES, current_progress, every)

    return handle


def current_progress(changes: DataFrame) -> DataFrame:
    columns = ["partition", "offset", "completed_executions", "last_execution"]
    return compaction.keep_last(changes, KEY, compaction.log_position(), columns)


def read_days(spark: SparkSession, path: str, days: list) -> DataFrame:
    """Stored executions of some days; no other folder is listed or opened."""
    parsed = T._parse_datatype_string(EXECUTION_ROWS)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folders = [f"{path}/day={day}" for day in days]
    there = [f for f in folders if hadoop(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(f))]
    if not there:
        return spark.createDataFrame([], parsed)
    return spark.read.schema(parsed).option("basePath", path).parquet(*there)


def executions_handler(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """Insert executions once, however often and however late they are delivered.

    Duplicates inside a batch are reduced by key, those of earlier batches by an anti join; unlike
    a deduplication with a watermark this drops no late record. The table is laid out by day, the
    day is part of the identity, and only the folders of the days of the batch are read. A batch
    that runs again replaces its own folders.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        insert_executions(spark, codec.decode_records(batch), path, batch_id)

    return handle


def insert_executions(spark: SparkSession, records: DataFrame, path: str, batch_id: int) -> None:
    """Executions of some decoded records that ``path`` does not hold yet, see ``executions_handler``."""
    rows = compaction.executions(records)
    rows = rows.withColumn("day", F.to_date("kafka_timestamp")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        days = [r.day for r in rows.select("day").distinct().collect()]
        stored = read_days(spark, path, days).where(F.col("batch_id") != batch_id)
        new = rows if stored.isEmpty() else compaction.append_new(rows, stored)
        new = new.withColumn("batch_id", F.lit(batch_id).cast("long"))
        # the rows of a day come together, in as many files as their size asks for: not a file per task and day
        writer = new.hint("rebalance", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch_id").parquet(path)
    finally:
        rows.unpersist()


def execute_log_handler(spark: SparkSession, executions: str, progress: str, every: int = FOLD_EVERY) -> Callable[[DataFrame, int], None]:
    """Executions and progress of an execution log, each batch decoded once for both; a batch may run again.

    Both tables are as ``executions_handler`` and ``progress_handler`` make them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        records = codec.decode_records(batch.where(F.col("topic") == S.EXECUTE_TOPIC))
        # lost blocks are decoded again
        records = records.drop("create", "key", "value", "headers").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            insert_executions(spark, records, executions, batch_id)
            add_batch(compaction.progress_latest(records), progress, batch_id, PROGRESS_CHANGES, current_progress, every)
        finally:
            records.unpersist()

    return handle


def quarantine_handler(good_path: str, bad_path: str) -> Callable[[DataFrame, int], None]:
    """Usable records to one folder, malformed ones with their reason to another."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # decoded once for both writes, without the messages, which neither of them reads; lost blocks are decoded again
        records = codec.decode_records(batch).drop("create", "execute", "headers").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = codec.split_quarantine(records)
            write_batch(good.select("topic", "partition", "offset", "kind", *KEY), good_path, batch_id)
            write_batch(bad.select("topic", "partition", "offset", "reason", "key", "value"), bad_path, batch_id)
        finally:
            records.unpersist()

    return handle
