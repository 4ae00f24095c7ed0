"""Execution results: parse, classify, cap the body, wrap errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickledger import schemas as S

# fixed value: error text of a response body that reached the limit
BODY_TOO_LARGE = "response body size exceeded limit"


def parse_result(raw: Column) -> Column:
    """Result bytes to a struct; ``_corrupt_record`` marks text that is not JSON."""
    return F.from_json(raw.cast("string"), S.with_corrupt(S.RESULT))


def result_outcome(raw: Column) -> Column:
    """ok, too_large, error or malformed."""
    parsed = parse_result(raw)
    error = F.coalesce(parsed["Error"], F.lit(""))
    return (
        F.when(raw.isNull() | parsed[S.CORRUPT].isNotNull(), "malformed")
        .when(error == BODY_TOO_LARGE, "too_large")
        .when(error != "", "error")
        .otherwise("ok")
    )


def cap_body(body: Column, keep: Column, limit: int = S.BODY_LIMIT) -> Column:
    """(Body, Error) as recorded: a body of exactly the limit already counts as too large."""
    fits = F.octet_length(body) < limit
    kept = F.coalesce(keep, F.lit(False))
    return F.struct(
        F.when(kept & fits, body).otherwise(F.lit("")).alias("Body"),
        F.when(kept & ~fits, F.lit(BODY_TOO_LARGE)).otherwise(F.lit("")).alias("Error"),
    )


def error_json(message: Column) -> Column:
    """An error message as a result document, properly escaped."""
    return F.to_json(F.struct(message.alias("Error")))
