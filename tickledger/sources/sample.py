"""The supplied ``events`` table read as a command log and an execution log.

Signups create timers, errors delete them, views are replay markers, clicks are executions and
purchases are executions or finishes. ``typed`` gives decoded records, ``envelope`` the same
records as key and value bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickledger import schemas as S
from tickledger.functions import codec, keys

PARTITIONS = 8
# Records of one file of a log that is read as a stream, about.
PART_ROWS = 100_000
CRONS = ["*/15 * * * *", "0 * * * *", "30 6 * * 1-5", "0 0 1,15 * 1", "@every 90m", "@daily"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = events(spark, sf_dir).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def with_k(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def timer_uuid(user_id: Column, slot: Column) -> Column:
    return keys.uuid_from_hex(F.md5(F.concat_ws("-", user_id.cast("string"), slot.cast("string")).cast("binary")))


def _result(k: Column, value: Column) -> Column:
    status = F.when(value < 100, F.lit("200")).otherwise(F.lit("500"))
    full = F.concat(
        F.lit('{"StatusCode":'),
        status,
        F.lit(',"Error":"'),
        F.when(k == 97, F.lit("response body size exceeded limit")).otherwise(F.lit("")),
        F.lit('","Proto":"HTTP/1.1","Body":"'),
        k.cast("string"),
        F.lit('","Headers":{"Content-Type":["text/plain"],"X-K":["'),
        k.cast("string"),
        F.lit('","b"]}}'),
    )
    return (
        F.when(k == 99, F.lit('{"Error":"said "no""}'))
        .when(k == 98, F.lit('{"Error":"dial tcp: timeout"}'))
        .otherwise(full)
    )


def typed(rows: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Decoded records: one row per event, the layout of ``codec.decode_records``."""
    k, ts = F.col("k"), F.col("ts").cast("timestamp")
    event = F.col("event_type")
    kind = (
        F.when(event == "signup", codec.UPSERT)
        .when(event == "error", codec.DELETE)
        .when(event == "view", codec.MARKER)
        .when((event == "purchase") & (k < 10), codec.DELETE)
        .otherwise(codec.UPSERT)
    )
    on_create = event.isin("signup", "error", "view")
    cron = F.element_at(F.array(*[F.lit(c) for c in CRONS]), F.pmod(k, F.lit(6)) + 1)
    http = F.struct(
        F.concat(F.lit("https://hook"), k.cast("string"), F.lit(".example.com/run")).alias("url"),
        F.pmod(k, F.lit(2)).alias("method"),
        F.lit(None).cast("binary").alias("body"),
        F.create_map(F.lit("Accept"), F.lit("text/html,text/plain")).alias("headers"),
        (k < 50).alias("save_response_body"),
    ).cast(S.HTTP)
    schedule = F.struct(
        cron.alias("cron"),
        F.date_trunc("second", ts).alias("start_time"),
        F.when(F.pmod(k, F.lit(3)) == 0, ts + F.make_dt_interval(hours=k)).alias("stop_time"),
        F.pmod(k, F.lit(5)).alias("max_executions"),
    ).cast(S.SCHEDULE)
    create = F.struct(
        F.struct(http.alias("http")).alias("task"),
        schedule.alias("schedule"),
        F.struct(ts.alias("create_time")).alias("meta"),
    ).cast(S.CREATE)
    progress = F.struct(
        (F.floor(k / 20) + 1).cast("int").alias("completed_executions"),
        F.when(k != 93, ts).alias("last_execution"),
    ).cast(S.PROGRESS)
    execute = F.struct(
        progress.alias("progress"), _result(k, F.col("value")).cast("binary").alias("result")
    ).cast(S.EXECUTE)
    uuid = timer_uuid(F.col("user_id"), F.pmod(k, F.lit(10)))
    shaped = (
        with_k(rows)
        .withColumn("kind", kind)
        .withColumn("topic", F.when(on_create, S.CREATE_TOPIC).otherwise(S.EXECUTE_TOPIC))
        .withColumn("_uuid", uuid)
    )
    has_key = F.col("kind") != codec.MARKER
    upsert = F.col("kind") == codec.UPSERT
    return shaped.select(
        "topic",
        F.when(has_key, keys.partition_of(F.col("_uuid"), partitions))
        .otherwise(F.pmod(F.col("event_id"), F.lit(partitions)).cast("int"))
        .alias("partition"),
        F.col("event_id").alias("offset"),
        ts.alias("timestamp"),
        "kind",
        F.when(has_key, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("domain"),
        F.when(has_key, F.col("_uuid")).alias("timer_uuid"),
        F.when(upsert & (F.col("topic") == S.CREATE_TOPIC), create).alias("create"),
        F.when(upsert & (F.col("topic") == S.EXECUTE_TOPIC), execute).alias("execute"),
        F.pmod(k, F.lit(3)).cast("string").alias("generation"),
        k.alias("k"),
    )


def to_envelope(records: DataFrame, damaged: bool = False) -> DataFrame:
    """Typed records as bytes. ``damaged`` cuts the key when k = 96 and the value when k = 95."""
    key = codec.encode(F.struct("domain", "timer_uuid"))
    value = F.coalesce(codec.encode(F.col("create")), codec.encode(F.col("execute")))
    if damaged:
        key = F.when(F.col("k") == 96, F.substring(key, 1, 9).cast("binary")).otherwise(key)
        value = F.when(F.col("k") == 95, F.substring(value, 1, 25).cast("binary")).otherwise(value)
    marker = F.struct(F.lit("generationID").alias("key"), F.col("generation").cast("binary").alias("value"))
    first = F.struct(F.lit("trace").alias("key"), F.col("offset").cast("string").cast("binary").alias("value"))
    again = F.struct(F.lit("trace").alias("key"), F.col("k").cast("string").cast("binary").alias("value"))
    is_marker = F.col("kind") == codec.MARKER
    return records.select(
        "topic",
        "partition",
        "offset",
        "timestamp",
        F.when(~is_marker, key).alias("key"),
        F.when(F.col("kind") == codec.UPSERT, value).alias("value"),
        F.when(is_marker, F.array(marker)).otherwise(F.array(first, again)).cast(S.HEADERS).alias("headers"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(events(spark, sf_dir))


def spread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, made by as many tasks as there are cores however few the files: an event is far smaller than its record."""
    return typed(events(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "event_id"))


def envelope(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    return to_envelope(records(spark, sf_dir), damaged)


def with_redelivery(rows: DataFrame) -> DataFrame:
    """At-least-once delivery: every seventh record arrives twice."""
    again = rows.where(F.pmod(F.col("offset"), F.lit(7)) == 0)
    return rows.unionByName(again)


def write_in_files(
    rows: DataFrame, path: str, files: int, lag: bool = True, closing: bool = False, part_rows: int = PART_ROWS
) -> tuple[str, int]:
    """Records as ``files`` slices of log time, one after the other; with ``lag`` odd partitions are one slice behind.

    Returns the delay by which partitions then run apart at most, and the number of files of each slice:
    the same for all, with about ``part_rows`` records each, so that a slice is written and read by many tasks
    and a batch of so many files is one slice. ``closing`` adds the tombstone of an unknown timer, that
    delay after the last command, so that event time reaches the end of the log.
    """
    spark = rows.sparkSession
    us = F.unix_micros("timestamp")
    command = (F.col("topic") == S.CREATE_TOPIC) & (F.col("kind") != codec.MARKER)
    low, high, last, total = rows.agg(F.min(us), F.max(us), F.max(F.when(command, us)), F.count(F.lit(1))).first()
    delay_ms = ((high - low) // files // 1000 + 1000) if lag else 0
    parts = max(1, -(-total // (files * part_rows)))
    number = F.floor((us - low) * files / (high - low + 1)) + (F.pmod("partition", F.lit(2)) if lag else 0)
    # the records are made once, not once for each slice
    rows.withColumn("_slice", number.cast("int")).write.partitionBy("_slice").parquet(f"{path}-slices")
    sliced = spark.read.schema(T.StructType([*rows.schema, T.StructField("_slice", T.IntegerType())])).parquet(f"{path}-slices")
    for i in range(files + lag):
        part = sliced.where(F.col("_slice") == i).drop("_slice")
        if closing and i == files + lag - 1:
            end = spark.range(1).select(F.timestamp_micros(F.lit(last + delay_ms * 1000)).alias("timestamp"))
            end = end.select("timestamp", F.lit(S.CREATE_TOPIC).alias("topic"), F.lit(0).alias("partition"), F.lit(-1).cast("long").alias("offset"), F.lit(codec.DELETE).alias("kind"), F.lit("").alias("domain"), F.lit("closing").alias("timer_uuid"))
            part = part.unionByName(end, allowMissingColumns=True)
        dealt = part.coalesce(1) if parts == 1 else part.repartition(parts, "offset")
        dealt.write.mode("append").parquet(path)
        # a task without records leaves no file behind
        for _ in range((i + 1) * parts - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return f"{delay_ms} milliseconds", parts


def stream_files(spark: SparkSession, path: str, schema, parts: int = 1) -> DataFrame:
    """Such files as a stream, one slice of ``parts`` files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", parts).parquet(path)
