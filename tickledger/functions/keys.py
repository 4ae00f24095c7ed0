"""Identifiers: uuid texts, partitions of a key, document ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted spellings of a uuid
UUID_PATTERN = (
    "^(?:urn:uuid:)?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    "|^[0-9a-fA-F]{32}$"
    "|^\\{[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\}$"
)


def uuid_from_hex(digits: Column) -> Column:
    """32 hex digits in the usual 8-4-4-4-12 form."""
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digits, start, size) for start, size in parts])


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID_PATTERN), F.lit(False))


def partition_of(timer_uuid: Column, partitions: int) -> Column:
    """Log partition of a timer: CRC-32 of the 16 uuid bytes modulo the partition count."""
    raw = F.unhex(F.replace(timer_uuid, F.lit("-"), F.lit("")))
    return F.pmod(F.crc32(raw), F.lit(partitions).cast("bigint")).cast("int")


def dashed(*parts: Column) -> Column:
    """Composite document id or index name."""
    return F.concat_ws("-", *parts)
