"""Rules for create commands, and the fields a command gets on acceptance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import cron as C
from tickledger.functions.once import evaluate_once


def method_name(method: Column) -> Column:
    """Name of a request method; null for an unknown number."""
    names = F.create_map(*[F.lit(x) for pair in S.METHODS.items() for x in pair])
    return F.try_element_at(names, F.coalesce(method, F.lit(0)))


def split_header_values(headers: Column) -> Column:
    """Every header value cut at commas, without trimming."""
    return F.transform_values(headers, lambda _, value: F.split(value, ",", -1))


def url_host(url: Column) -> Column:
    """Text between ``//`` and the next ``/``, ``?`` or ``#``, without user info; empty if none."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(authority, r"^.*@", "")


def url_error(url: Column) -> Column:
    """Why a url does not parse, or null."""
    host = url_host(url)
    bad = (
        F.when(url.rlike(r"[\x00-\x1f\x7f]"), "control character")
        .when(url.rlike(r"^:"), "missing protocol scheme")
        .when(url.rlike(r"^[^?#]*%(?![0-9A-Fa-f]{2})"), "bad escape")
        .when(url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*[ <>\"]"), "bad host character")
        .when(host.rlike(r"\[") & ~host.rlike(r"^\[[^\[\]]*\](:[0-9]*)?$"), "bad bracket host")
        .when(host.rlike(r"^[^\[]*%[0-7]"), "bad host escape")
        .when(url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#\[]*:[^/?#:@]*[^0-9/?#:@][^/?#:@]*(?:[/?#]|$)"), "bad port")
    )
    return bad


def with_create_error(df: DataFrame, create: str = "create", out: str = "error", body_limit: int = S.BODY_LIMIT) -> DataFrame:
    """Add the first rule a create command breaks, or null when it is accepted."""
    http = F.col(create)["task"]["http"]
    schedule = F.col(create)["schedule"]
    task = F.lit("invalid task: ")
    sched = F.lit("invalid schedule: ")
    columns = df.columns
    with_url = df.withColumn("_cron", schedule["cron"]).withColumn("_url", F.coalesce(http["url"], F.lit("")))
    checked = C.parse(with_url, "_cron").withColumn("_url_error", url_error(F.col("_url")))
    error = (
        F.when(http.isNull(), F.concat(task, F.lit("unknown task")))
        .when(method_name(http["method"]).isNull(), F.concat(task, F.lit("unknown method")))
        .when(F.col("_url_error").isNotNull(), F.concat(task, F.lit("parsing url: "), F.col("_url_error")))
        .when(url_host(F.col("_url")) == "", F.concat(task, F.lit("relative url not allowed")))
        .when(
            F.coalesce(F.octet_length(http["body"]), F.lit(0)) > body_limit,
            F.concat(task, F.lit("request body too large")),
        )
        .when(F.col("cron_kind") == "error", F.concat(sched, F.lit("invalid cron: "), F.col("cron_error")))
        .when(schedule["start_time"].isNull(), F.concat(sched, F.lit("start time required")))
    )
    return evaluate_once(checked.withColumn(out, error).select(*columns, out), out)


def default_start(create: Column, now: dt.datetime) -> Column:
    """A create command without a start time starts now."""
    schedule = create["schedule"]
    start = F.coalesce(schedule["start_time"], F.lit(now))
    return create.withField("schedule", schedule.withField("start_time", start))


def stamp_meta(create: Column, now: dt.datetime) -> Column:
    """Add the create time."""
    return create.withField("meta", F.struct(F.lit(now).alias("create_time")))


def random_id() -> Column:
    return F.expr("uuid()")
