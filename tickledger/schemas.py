"""Schemas of the log records and of the tables derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


HEADERS = T.ArrayType(_struct(("key", T.StringType()), ("value", T.BinaryType())))

ENVELOPE = _struct(
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("offset", T.LongType()),
    ("timestamp", T.TimestampType()),
    ("key", T.BinaryType()),
    ("value", T.BinaryType()),
    ("headers", HEADERS),
)

KEY = _struct(("domain", T.StringType()), ("timer_uuid", T.StringType()))

HTTP = _struct(
    ("url", T.StringType()),
    ("method", T.IntegerType()),
    ("body", T.BinaryType()),
    ("headers", T.MapType(T.StringType(), T.StringType())),
    ("save_response_body", T.BooleanType()),
)
TASK = _struct(("http", HTTP))
SCHEDULE = _struct(
    ("cron", T.StringType()),
    ("start_time", T.TimestampType()),
    ("stop_time", T.TimestampType()),
    ("max_executions", T.IntegerType()),
)
META = _struct(("create_time", T.TimestampType()))
CREATE = _struct(("task", TASK), ("schedule", SCHEDULE), ("meta", META))

PROGRESS = _struct(
    ("completed_executions", T.IntegerType()), ("last_execution", T.TimestampType())
)
EXECUTE = _struct(("progress", PROGRESS), ("result", T.BinaryType()))

RESULT = _struct(
    ("StatusCode", T.IntegerType()),
    ("Error", T.StringType()),
    ("Proto", T.StringType()),
    ("Body", T.StringType()),
    ("Headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
)


def with_corrupt(schema: T.StructType) -> T.StructType:
    """The same schema plus the column Spark fills for undecodable text."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])


KEY_COLUMNS = ["domain", "timer_uuid"]
CREATE_TOPIC = "create"
EXECUTE_TOPIC = "execute"

# fixed values: names of the request methods by number
METHODS = {0: "GET", 1: "POST"}
# fixed value: largest request and response body in bytes
BODY_LIMIT = 1_000_000
