"""Compact keyed logs into current-state and history tables.

Records are rows of ``codec.decode_records``. Reductions are ``max_by``/``min_by`` aggregates: they
combine inside each map task, so a hot key reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import codec, keys
from tickledger.functions.rules import with_create_error
from tickledger.operators import skew

KEY = S.KEY_COLUMNS
POSITION = ["timestamp", "topic", "offset"]
# Creates and deletes of a key meet in blocks of this much log time before they meet as a whole.
BLOCK_US = 3_600_000_000
# Bits of the bitmap that is sent to all tasks before a join to a large target: 8 MB.
FILTER_BITS = 1 << 26


def log_position() -> Column:
    """Order of the records of one key inside one topic."""
    return F.struct("partition", "offset")


def global_position() -> Column:
    """Order of the records of one key across both topics."""
    return F.struct("timestamp", "topic", "offset")


def packed_position() -> Column:
    """``global_position`` as one number of fixed width, which a hash aggregate can hold.

    The names of the two topics are in the order of their place: create, then execute.
    """
    place = F.unix_micros("timestamp") * 2 + (F.col("topic") == S.EXECUTE_TOPIC).cast("bigint")
    return place.cast("decimal(18,0)") * F.lit(str(2**63)).cast("decimal(19,0)") + F.col("offset").cast("decimal(19,0)")


def _topic(records: DataFrame, topic: str) -> DataFrame:
    return records.where(F.col("topic") == topic)


def upserts(records: DataFrame) -> DataFrame:
    return records.where(F.col("kind") == codec.UPSERT)


def keep_last(df: DataFrame, by: list[str], order: Column, columns: list[str | Column]) -> DataFrame:
    row = F.max_by(F.struct(*columns), order).alias("_row")
    return df.groupBy(*by).agg(row).select(*by, "_row.*")


def keep_first(df: DataFrame, by: list[str], order: Column, columns: list[str | Column]) -> DataFrame:
    row = F.min_by(F.struct(*columns), order).alias("_row")
    return df.groupBy(*by).agg(row).select(*by, "_row.*")


ALL_PARTS = ("task", "schedule", "meta")


def _parts(parts: tuple[str, ...]) -> Column:
    """The create message cut to some of its parts.

    A request body may be a megabyte; an aggregate would carry it through the shuffle even when
    only the schedule is read afterwards, so callers name what they need.
    """
    if parts == ALL_PARTS:
        return F.col("create")
    kept = F.struct(*[F.col("create")[part].alias(part) for part in parts])
    return F.when(F.col("create").isNotNull(), kept).alias("create")


def compact_log(
    records: DataFrame, topic: str = S.CREATE_TOPIC, parts: tuple[str, ...] = ALL_PARTS
) -> DataFrame:
    """Latest upsert or tombstone of every key of a topic."""
    value = _parts(parts).alias("create") if topic == S.CREATE_TOPIC else F.col("execute")
    rows = _topic(records, topic).where(F.col("kind").isin(codec.UPSERT, codec.DELETE))
    return keep_last(rows, KEY, log_position(), ["partition", "offset", "timestamp", "kind", value])


def compact_keys(records: DataFrame) -> DataFrame:
    """Offset and kind of the latest record of every key of each topic, without any payload.

    A key lives in one partition of a topic, so the offset alone orders its records. Offset and kind
    share one long: the aggregate hashes in the map tasks, without sorting the log first.
    """
    rows = records.where(F.col("kind").isin(codec.UPSERT, codec.DELETE))
    packed = F.shiftleft(F.col("offset"), 1) + (F.col("kind") == codec.UPSERT).cast("bigint")
    last = rows.groupBy("topic", *KEY).agg(F.max(packed).alias("_last"))
    kind = F.when(F.col("_last") % 2 == 1, codec.UPSERT).otherwise(codec.DELETE)
    return last.select("topic", *KEY, F.shiftright(F.col("_last"), 1).alias("offset"), kind.alias("kind"))


def valid_creates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(create commands and tombstones that count, rejected creates with the reason)."""
    rows = with_create_error(_topic(records, S.CREATE_TOPIC), "create", "rejected")
    bad = (F.col("kind") == codec.UPSERT) & F.col("rejected").isNotNull()
    return rows.where(~bad).drop("rejected"), rows.where(bad)


def live_creates(records: DataFrame, validate: bool = True, parts: tuple[str, ...] = ALL_PARTS) -> DataFrame:
    """Timers as the runtime sees them: the last valid create wins, a tombstone removes.

    The last record of a key is found from its packed offset alone, which the map tasks combine in
    a hash aggregate. The payload follows late: creates join the winners on their place in the log,
    so nothing that is decoded is sorted or held by an aggregate.
    """
    rows = valid_creates(records)[0] if validate else records
    winners = compact_keys(_topic(rows, S.CREATE_TOPIC)).where(F.col("kind") == codec.UPSERT).select(*KEY, "offset")
    creates = upserts(_topic(rows, S.CREATE_TOPIC)).select(*KEY, "partition", "offset", "timestamp", _parts(parts).alias("create"))
    found = creates.join(winners, [*KEY, "offset"], "left_semi")
    # a record that was delivered twice is still one timer; copies are neighbours after the join
    copy = F.row_number().over(Window.partitionBy(*KEY, "offset").orderBy("partition"))
    return found.withColumn("_copy", copy).where("_copy = 1").select(*KEY, "partition", "offset", "timestamp", "create")


def _deletes(records: DataFrame, delete_on: str) -> Column:
    is_delete = F.col("kind") == codec.DELETE
    if delete_on == "any":
        return is_delete
    if delete_on == "execute":
        return is_delete & (F.col("topic") == S.EXECUTE_TOPIC)
    raise ValueError("delete_on must be 'execute' or 'any'")


def survivors(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the last delete and the first create after it; everything else is settled by these two.

    ``rows`` are creates and deletes with ``is_delete`` and a position (timestamp, topic, offset).
    One pass from the latest row to the earliest with a running flag: nothing is held back. The
    choice is associative, so it may be made in blocks first and over what they left afterwards.
    """
    back = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in POSITION])
    deleted_later = F.max("is_delete").over(back.rowsBetween(Window.unboundedPreceding, -1))
    delete_before = F.lead("is_delete").over(back)
    marked = rows.withColumn("_dead", F.coalesce(deleted_later, F.lit(False))).withColumn("_first", F.coalesce(delete_before, F.lit(True)))
    return marked.where(~F.col("_dead") & (F.col("is_delete") | F.col("_first"))).drop("_dead", "_first")


def create_sessions(
    records: DataFrame, delete_on: str = "execute", parts: tuple[str, ...] = ALL_PARTS, block_us: int = BLOCK_US
) -> DataFrame:
    """Per key, the first create after its last delete, and when that delete was.

    A key whose last delete is not followed by a create keeps a row with ``create`` null, so the
    result can also be merged into an older state of the table. The log is read once; a key meets
    in blocks of ``block_us`` first, so a task holds no more than one block of a hot key, and what
    the blocks leave, two rows each at most, meets by key.
    """
    is_create = (F.col("topic") == S.CREATE_TOPIC) & (F.col("kind") == codec.UPSERT)
    is_delete = _deletes(records, delete_on)
    rows = records.where(is_create | is_delete).select(
        *KEY, *POSITION, is_delete.alias("is_delete"), F.when(is_create, _parts(parts)).alias("create"),
        F.floor(F.unix_micros("timestamp") / block_us).alias("_block"),
    )
    last = survivors(survivors(rows, [*KEY, "_block"]).drop("_block"), KEY)
    back = Window.partitionBy(*KEY).orderBy(*[F.col(c).desc() for c in POSITION])
    # a create comes first, the delete before it second; a delete without a create is alone
    number, deleted_at = F.row_number().over(back), F.lead("timestamp").over(back)
    placed = last.select("*", number.alias("_number"), deleted_at.alias("_deleted_at")).where("_number = 1")
    created = ~F.col("is_delete")
    return placed.select(
        *KEY,
        (F.col("is_delete") | F.col("_deleted_at").isNotNull()).alias("has_delete"),
        F.when(created, F.col("_deleted_at")).otherwise(F.col("timestamp")).alias("deleted_at"),
        F.when(created, F.col("timestamp")).alias("created_at"),
        F.when(created, F.col("offset")).alias("created_offset"),
        "create",
    )


def timers_projection(
    records: DataFrame, delete_on: str = "execute", parts: tuple[str, ...] = ALL_PARTS, block_us: int = BLOCK_US
) -> DataFrame:
    """Timers as the document table keeps them: the first create since the last delete."""
    live = create_sessions(records, delete_on, parts, block_us).where(F.col("create").isNotNull())
    return live.drop("has_delete", "deleted_at")


def apply_tombstones(rows: DataFrame, records: DataFrame, delete_on: str = "any") -> DataFrame:
    """Rows (with KEY, timestamp, topic, offset) that no later tombstone of their key removes.

    The last tombstone of each key is a hash aggregate of numbers: the map tasks combine it. Rows
    meet it in one join by key, whose rows of a hot key can be split over many tasks.
    """
    tombs = records.where(_deletes(records, delete_on)).groupBy(*KEY).agg(F.max(packed_position()).alias("_deleted"))
    kept = F.col("_deleted").isNull() | (packed_position() >= F.col("_deleted"))
    return skew.split_join(rows, tombs, KEY).where(kept).drop("_deleted")


def executions(records: DataFrame, columns: tuple[str, ...] = ("partition", "offset", "execute")) -> DataFrame:
    """Executions inserted once per (domain, timer, broker time); the first delivery stays.

    Leave ``execute`` out of ``columns`` where the result is not read: it need not be shuffled then.
    """
    rows = upserts(_topic(records, S.EXECUTE_TOPIC)).withColumn("kafka_timestamp", F.col("timestamp"))
    by = [*KEY, "kafka_timestamp"]
    # repeats are rare, so combining in the map tasks would only sort the payload there for nothing
    before = F.lag(F.lit(True)).over(Window.partitionBy(*by).orderBy("partition", "offset"))
    return rows.select(*by, *columns, before.alias("_before")).where("_before is null").drop("_before")


def possibly_in(rows: DataFrame, ids: DataFrame, by: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` without most of those whose ``by`` is not in ``ids``; every row that is in it stays.

    The ids set bits of a bitmap by their hash. It is cut into pages of 4 kB and has ``bits`` bits at
    most, whatever the number of ids, so it may be sent to every task.
    """
    place = F.pmod(F.xxhash64(*by), F.lit(bits))
    page, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    pages = ids.select(page.alias("_page"), bit.alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = rows.select("*", page.alias("_page"), bit.alias("_bit")).join(F.broadcast(pages), "_page")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1
    return marked.where(is_set).select(*rows.columns)


def append_new(batch: DataFrame, target: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of a batch of executions that the target does not hold yet.

    An execution is identified by its timer and time, so both sides have unique keys and none is hot.
    Of the target only the ids are read, only in the time span of the batch, and only those that a
    bitmap of the batch's ids lets through reach the join. The batch is read three times: keep it or
    write it first if it is dear to make.
    """
    by = [*KEY, "kafka_timestamp"]
    span = batch.agg(F.min("kafka_timestamp").alias("low"), F.max("kafka_timestamp").alias("high")).first()
    if span.low is None:
        return batch
    old = target.where(F.col("kafka_timestamp").between(F.lit(span.low), F.lit(span.high))).select(*by)
    return batch.join(possibly_in(old, batch.select(*by), by, bits), by, "left_anti")


def execution_ids(rows: DataFrame) -> DataFrame:
    """Index name and document id of each execution."""
    return rows.withColumn("index", keys.dashed(F.lit("executions"), F.col("domain"))).withColumn(
        "doc_id", keys.dashed(F.col("timer_uuid"), F.unix_micros("kafka_timestamp").cast("string"))
    )


def progress_latest(records: DataFrame) -> DataFrame:
    """The last recorded progress of every timer."""
    rows = upserts(_topic(records, S.EXECUTE_TOPIC)).select(
        *KEY, "partition", "offset", "timestamp", "execute.progress.*"
    )
    return keep_last(
        rows, KEY, log_position(), ["partition", "offset", "completed_executions", "last_execution"]
    )


def upsert_latest(target: DataFrame, batch: DataFrame, order: str = "offset") -> DataFrame:
    """Overwrite rows by key: the row with the highest ``order`` of target and batch stays."""
    columns = [c for c in target.columns if c not in KEY]
    return keep_last(target.unionByName(batch.select(*target.columns)), KEY, F.col(order), columns)


def progress_rebuild(records: DataFrame) -> DataFrame:
    """Progress counted from the executions themselves, next to the recorded progress."""
    rows = executions(records, ("offset",))
    counted = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("counted"), F.max("kafka_timestamp").alias("latest")
    )
    stored = progress_latest(records).drop("partition", "offset")
    same = F.col("counted").eqNullSafe(F.col("completed_executions").cast("bigint")) & F.col("latest").eqNullSafe(
        F.col("last_execution")
    )
    return counted.join(stored, KEY, "full").withColumn("mismatch", ~same)


def running_progress(records: DataFrame, **limits: int) -> DataFrame:
    """Completed count after each execution, and the time of the execution before."""
    rows = upserts(_topic(records, S.EXECUTE_TOPIC)).select(*KEY, "partition", "offset", "timestamp")
    return skew.running_by_key(rows, KEY, "completed", "previous_execution", "timestamp", **limits)


def advance_progress(progress: DataFrame, records: DataFrame) -> DataFrame:
    """Fold new executions into a progress table: count added, last time replaced."""
    new = (
        upserts(_topic(records, S.EXECUTE_TOPIC))
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("_new"), F.max("timestamp").alias("_last"))
    )
    joined = progress.join(new, KEY, "full")
    return joined.select(
        *KEY,
        (F.coalesce(F.col("completed_executions"), F.lit(0)) + F.coalesce(F.col("_new"), F.lit(0)))
        .cast("bigint")
        .alias("completed_executions"),
        F.coalesce(F.col("_last"), F.col("last_execution")).alias("last_execution"),
    )
