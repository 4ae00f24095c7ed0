"""All named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickledger.plans import log_queries, oracle, schedule_queries, shard_queries, state_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        **log_queries.QUERIES,
        **state_queries.QUERIES,
        **schedule_queries.QUERIES,
        **shard_queries.QUERIES,
        **stream_queries.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
