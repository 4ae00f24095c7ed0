"""Accept or reject commands, as one job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.functions import keys, rules
from tickledger.functions.once import evaluate_once


def judge(commands: DataFrame, now: dt.datetime) -> DataFrame:
    """Commands as they would be published, with the ``reason`` of those that are rejected.

    ``commands`` has domain, timer_uuid and create. A create gets a start time, its create time and,
    without one, an id; a null create is a delete, which needs a well-formed id. Works row by row.
    """
    is_delete = F.col("create").isNull()
    create = rules.stamp_meta(rules.default_start(F.col("create"), now), now)
    filled = commands.withColumn("create", F.when(~is_delete, create)).withColumn(
        "timer_uuid", F.when(is_delete, F.col("timer_uuid")).otherwise(F.coalesce("timer_uuid", rules.random_id()))
    )
    named = evaluate_once(filled, "timer_uuid")  # a random id is drawn once
    checked = rules.with_create_error(named, "create", "_error")
    bad_id = F.when(~keys.is_uuid(F.col("timer_uuid")), F.lit("invalid timer id"))
    reason = F.when(F.col("create").isNull(), bad_id).otherwise(F.coalesce("_error", bad_id))
    return checked.withColumn("reason", reason).drop("_error")


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commands to publish, rejected commands with the reason)."""
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())
