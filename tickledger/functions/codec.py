"""Decode, encode and classify log records with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickledger import schemas as S
from tickledger.functions.once import evaluate_once

TIME_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

MARKER = "MARKER"
DELETE = "DELETE"
UPSERT = "UPSERT"
BAD_KEY = "BAD_KEY"
BAD_VALUE = "BAD_VALUE"
UNKNOWN_TOPIC = "UNKNOWN_TOPIC"


def decode(raw: Column, schema: T.StructType) -> Column:
    """Bytes to a struct; ``_corrupt_record`` is set when the text does not fit the schema."""
    return F.from_json(raw.cast("string"), S.with_corrupt(schema), TIME_FORMAT)


def is_document(raw: Column) -> Column:
    """Whether the bytes are one whole document: text behind it, a second one or none at all is not."""
    listed = F.from_json(F.concat(F.lit("["), raw.cast("string"), F.lit("]")), "array<string>")
    return F.coalesce(F.size(listed) == 1, F.lit(False))


def encode(message: Column) -> Column:
    """Struct to bytes, unset fields left out."""
    return F.to_json(message, TIME_FORMAT).cast("binary")


def document(message: Column) -> Column:
    """Struct to JSON text with unset fields written out."""
    return F.to_json(message, {**TIME_FORMAT, "ignoreNullFields": "false"})


def with_defaults(column: Column, schema: T.DataType) -> Column:
    """Fill unset scalar fields with the value an unset field has on the wire.

    Unset messages (structs and timestamps) stay null, as they are told apart from a zero value.
    """
    if isinstance(schema, T.StructType) and schema.fields:
        filled = F.struct(
            *[with_defaults(column[f.name], f.dataType).alias(f.name) for f in schema.fields]
        )
        return F.when(column.isNotNull(), filled)
    if isinstance(schema, T.StringType):
        return F.coalesce(column, F.lit(""))
    if isinstance(schema, T.BinaryType):
        return F.coalesce(column, F.lit("").cast("binary"))
    if isinstance(schema, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if isinstance(schema, T.IntegerType):
        return F.coalesce(column, F.lit(0))
    if isinstance(schema, T.MapType):
        return F.coalesce(column, F.create_map().cast(schema))
    return column


def headers_to_map(headers: Column) -> Column:
    """Record headers as a text map; the last value of a repeated name wins."""
    return F.map_from_entries(
        F.transform(
            headers, lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value"))
        )
    )


def classify_marker(key: Column, headers: Column, generation: Column | str) -> Column:
    """MY_MARKER, FOREIGN_MARKER or null for an ordinary record."""
    own = F.lit(generation) if isinstance(generation, str) else generation
    found = F.element_at(headers_to_map(headers), "generationID")
    return F.when(
        key.isNull(),
        F.when(found == own, F.lit("MY_MARKER")).otherwise(F.lit("FOREIGN_MARKER")),
    )


def drop_markers(log: DataFrame) -> DataFrame:
    return log.where(F.col("key").isNotNull())


def decode_records(log: DataFrame) -> DataFrame:
    """One typed row per log record; nothing is dropped.

    ``kind`` says what a consumer does with it. The value is decoded once, with the schema of its
    topic, and ``reason`` is set for the rows that go to quarantine.
    """
    is_create = F.col("topic") == S.CREATE_TOPIC
    is_execute = F.col("topic") == S.EXECUTE_TOPIC
    # every text is made once and parsed once: a filter on the kind or the reason takes no copy of it
    texts = evaluate_once(log, "key", "value")
    decoded = evaluate_once(
        texts.withColumn("_key", decode(F.col("key"), S.KEY))
        .withColumn("_create", F.when(is_create, decode(F.col("value"), S.CREATE)))
        .withColumn("_execute", F.when(is_execute, decode(F.col("value"), S.EXECUTE)))
        .withColumn("_key_whole", is_document(F.col("key")))
        .withColumn("_value_whole", is_document(F.col("value"))),
        "_key", "_create", "_execute", "_key_whole", "_value_whole",
    )
    key_ok = (
        F.col(f"_key.{S.CORRUPT}").isNull()
        & F.col("_key.domain").isNotNull()
        & F.col("_key.timer_uuid").isNotNull()
        & F.col("_key_whole")
    )
    value_bad = F.coalesce(
        F.col(f"_create.{S.CORRUPT}").isNotNull() | F.col(f"_execute.{S.CORRUPT}").isNotNull(),
        F.lit(False),
    ) | ~F.col("_value_whole")
    kind = (
        F.when(~(is_create | is_execute), UNKNOWN_TOPIC)
        .when(F.col("key").isNull(), MARKER)
        .when(~key_ok, BAD_KEY)
        .when(F.col("value").isNull(), DELETE)
        .when(value_bad, BAD_VALUE)
        .otherwise(UPSERT)
    )
    with_kind = decoded.withColumn("kind", kind)
    usable = F.col("kind") == UPSERT
    return with_kind.select(
        "topic",
        "partition",
        "offset",
        "timestamp",
        "kind",
        F.col("_key.domain").alias("domain"),
        F.col("_key.timer_uuid").alias("timer_uuid"),
        F.when(usable & is_create, F.col("_create").dropFields(S.CORRUPT)).alias("create"),
        F.when(usable & is_execute, F.col("_execute").dropFields(S.CORRUPT)).alias("execute"),
        F.when(F.col("kind") == BAD_KEY, F.lit("undecodable key"))
        .when(F.col("kind") == BAD_VALUE, F.lit("undecodable value"))
        .when(F.col("kind") == UNKNOWN_TOPIC, F.lit("unknown topic"))
        .alias("reason"),
        "key",
        "value",
        "headers",
    )


def split_quarantine(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable records, malformed records with the reason)."""
    return records.where(F.col("reason").isNull()), records.where(F.col("reason").isNotNull())
