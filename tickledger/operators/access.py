"""Tenant-scoped reads and request attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import paths, results
from tickledger.functions.once import evaluate_once
from tickledger.sources.tables import TENANT_TABLES

KEY = S.KEY_COLUMNS

# fixed values: first parts of the request paths that are served
SIGN_IN, SIGN_IN_KEY, SIGN_IN_DONE = "auth", "apikey", "callback"
READS = "elastic"


def scope_decision(requests: DataFrame) -> DataFrame:
    """Index a tenant's request may read, or why it is turned away (``index`` and ``domain`` given)."""
    allowed = F.col("index").isin(*TENANT_TABLES)
    return requests.select(
        *requests.columns,
        F.when(F.col("domain").isNull(), "unauthenticated")
        .when(allowed, "ok")
        .otherwise("bad_index")
        .alias("outcome"),
        F.when(F.col("domain").isNotNull() & allowed, F.concat_ws("-", "index", "domain")).alias("scoped_index"),
    )


def attribute_requests(requests: DataFrame) -> DataFrame:
    """Route, tenant and outcome of each request (``path`` and ``header`` given)."""
    first = evaluate_once(requests.withColumn("_p1", paths.shift_path(F.col("path"))), "_p1")
    second = evaluate_once(first.withColumn("_p2", paths.shift_path(F.col("_p1.tail"))), "_p2")
    third = evaluate_once(
        second.withColumn("_p3", paths.shift_path(F.col("_p2.tail"))).withColumn(
            "tenant", paths.basic_user(F.col("header"))
        ),
        "_p3",
        "tenant",
    )
    head, sub, leaf = F.col("_p1.head"), F.col("_p2.head"), F.col("_p3.head")
    signs_in = (head == SIGN_IN) & (sub == SIGN_IN_KEY)
    route = (
        F.when(signs_in & (leaf == ""), f"{SIGN_IN}/{SIGN_IN_KEY}")
        .when(signs_in & (leaf == SIGN_IN_DONE), f"{SIGN_IN}/{SIGN_IN_KEY}/{SIGN_IN_DONE}")
        .when((head == READS) & sub.isin(*TENANT_TABLES), F.concat(F.lit(f"{READS}/"), sub))
        .when(head == READS, f"{READS}/other")
        .otherwise("unknown")
    )
    needs_user = head == READS
    outcome = (
        F.when(needs_user & F.col("tenant").isNull(), "unauthorized")
        .when(F.col("route") == f"{READS}/other", "bad_request")
        .when(F.col("route") == "unknown", "not_found")
        .otherwise("ok")
    )
    return (
        third.withColumn("route", route)
        .withColumn("outcome", outcome)
        .withColumn("tenant", F.when(needs_user, F.col("tenant")))
        .drop("_p1", "_p2", "_p3")
    )


def timer_history(executions: DataFrame, domain: str) -> DataFrame:
    """One tenant's executions with the outcome of each, in time order inside each timer.

    The rows of a timer stand together; the order is that of each part of the result, not a global one.
    """
    own = executions.where(F.col("domain") == domain).select(
        *KEY, "kafka_timestamp", "offset", results.result_outcome(F.col("execute.result")).alias("outcome")
    )
    return own.repartition(*KEY).sortWithinPartitions(*KEY, "kafka_timestamp", "offset")


def outcome_counts(executions: DataFrame) -> DataFrame:
    """Executions of each timer by outcome."""
    outcome = results.result_outcome(F.col("execute.result")).alias("outcome")
    return executions.groupBy(*KEY, outcome).agg(
        F.count(F.lit(1)).alias("executions"),
        F.min("kafka_timestamp").alias("first_at"),
        F.max("kafka_timestamp").alias("last_at"),
    )
