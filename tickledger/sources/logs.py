"""Read, route, bound, inspect and publish keyed logs.

Every function works on the envelope of ``schemas.ENVELOPE``, in batch or as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import codec, keys

KAFKA_COLUMNS = list(S.ENVELOPE.fieldNames())


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored log; the schema is given, so no file is opened to infer it."""
    return spark.read.schema(S.ENVELOPE).format(fmt).load(path)


def stream_log(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """The same log as a stream of newly arriving files."""
    reader = spark.readStream.schema(S.ENVELOPE).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_kafka(spark: SparkSession, servers: str, topics: str = "create,execute", streaming: bool = False) -> DataFrame:
    """Both topics from a Kafka cluster, from the first offset.

    A pass-through to Spark's connector; it needs the connector package on the class path and is
    not covered by the tests.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topics,
        "startingOffsets": "earliest",
        "includeHeaders": "true",
    }
    return reader.options(**options).load().select(*KAFKA_COLUMNS)


def union_logs(create_log: DataFrame, execute_log: DataFrame) -> DataFrame:
    """Two logs as one record stream; the topic column tells them apart."""
    return create_log.unionByName(execute_log)


def route(topic: Column) -> Column:
    """Which projection handles a topic."""
    return (
        F.when(topic == S.CREATE_TOPIC, "timers")
        .when(topic == S.EXECUTE_TOPIC, "executions")
        .otherwise("unknown")
    )


def fences(log: DataFrame, generation: str, first: bool = False) -> DataFrame:
    """Per partition, the last (or first) offset of a generation's own marker: the end of the replay."""
    own = codec.classify_marker(F.col("key"), F.col("headers"), generation) == "MY_MARKER"
    marks = log.where((F.col("topic") == S.CREATE_TOPIC) & own)
    return marks.groupBy("topic", "partition").agg((F.min if first else F.max)("offset").alias("fence"))


def with_phase(log: DataFrame, generation: str, first: bool = False) -> DataFrame:
    """Mark each create record as ``snapshot`` (up to the fence), ``live`` or ``waiting``.

    ``waiting`` partitions have not seen the marker yet. One fence row per topic partition, so the
    broadcast is bounded by the partition count of the topic, whatever the log holds.
    """
    creates = log.where(F.col("topic") == S.CREATE_TOPIC)
    phase = (
        F.when(F.col("fence").isNull(), "waiting")
        .when(F.col("offset") <= F.col("fence"), "snapshot")
        .otherwise("live")
    )
    return creates.join(F.broadcast(fences(log, generation, first)), ["topic", "partition"], "left").withColumn("phase", phase)


def replay_bounded(log: DataFrame, generation: str) -> DataFrame:
    """The create log from its beginning up to the present, the own marker included."""
    return with_phase(log, generation).where(F.col("phase") == "snapshot").drop("phase", "fence")


def inspect(log: DataFrame) -> DataFrame:
    """One readable row per record, whatever its state."""
    value = F.coalesce(codec.document(F.col("create")), codec.document(F.col("execute")))
    return codec.decode_records(log).select(
        "topic",
        "partition",
        "offset",
        "kind",
        "domain",
        "timer_uuid",
        value.alias("value"),
    )


def publish(commands: DataFrame, partitions: int) -> DataFrame:
    """Create commands and deletes as log records ready to be written.

    ``commands`` has domain, timer_uuid and create; a null create becomes a tombstone. Works row by
    row; write the result with ``format("kafka")`` or to files.
    """
    key = F.struct(F.col("domain"), F.col("timer_uuid"))
    return commands.select(
        F.lit(S.CREATE_TOPIC).alias("topic"),
        keys.partition_of(F.col("timer_uuid"), partitions).alias("partition"),
        codec.encode(key).alias("key"),
        F.when(F.col("create").isNotNull(), codec.encode(F.col("create"))).alias("value"),
        F.array().cast(S.HEADERS).alias("headers"),
    )


def finish_tombstones(finished: DataFrame, partitions: int) -> DataFrame:
    """Two tombstones, one per topic, for every finished timer."""
    key = codec.encode(F.struct(F.col("domain"), F.col("timer_uuid")))
    return finished.select(
        F.explode(F.array(F.lit(S.CREATE_TOPIC), F.lit(S.EXECUTE_TOPIC))).alias("topic"),
        keys.partition_of(F.col("timer_uuid"), partitions).alias("partition"),
        key.alias("key"),
        F.lit(None).cast("binary").alias("value"),
        F.array().cast(S.HEADERS).alias("headers"),
    )


def fire_records(events: DataFrame, partitions: int) -> DataFrame:
    """What fires and finishes write to the logs.

    ``events`` has domain, timer_uuid, event, n and fire_us (see ``streaming.fires``). A fire becomes
    an execution with the progress and no result yet, a finish the two tombstones of its timer. The
    time of a fire is the ``timestamp`` of its record; tombstones leave it to the log.
    """
    progress = F.struct(
        F.col("n").cast("int").alias("completed_executions"), F.timestamp_micros("fire_us").alias("last_execution")
    )
    execute = F.struct(progress.alias("progress"), F.lit(None).cast("binary").alias("result")).cast(S.EXECUTE)
    fired = events.where(F.col("event") == "FIRE").select(
        F.lit(S.EXECUTE_TOPIC).alias("topic"),
        keys.partition_of(F.col("timer_uuid"), partitions).alias("partition"),
        codec.encode(F.struct("domain", "timer_uuid")).alias("key"),
        codec.encode(execute).alias("value"),
        F.array().cast(S.HEADERS).alias("headers"),
        F.timestamp_micros("fire_us").alias("timestamp"),
    )
    ended = finish_tombstones(events.where(F.col("event") == "FINISH"), partitions)
    return fired.unionByName(ended, allowMissingColumns=True)
