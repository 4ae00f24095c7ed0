"""Queries over the raw logs: scans, classification, decoding, publishing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import codec, keys, paths, results, rules
from tickledger.operators import access, commands
from tickledger.plans.shape import plain
from tickledger.session import configure, shared_path
from tickledger.sources import logs, sample

NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
NOW_US = 1_706_659_200_000_000
GENERATION = "1"


def _log_rows(log: DataFrame, topic: str) -> DataFrame:
    return log.where(F.col("topic") == topic).select(
        "partition",
        "offset",
        F.unix_micros("timestamp").alias("ts_us"),
        F.col("key").isNotNull().alias("has_key"),
        F.col("value").isNotNull().alias("has_value"),
        F.size("headers").alias("n_headers"),
    )


def src_command_log(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_log_rows(sample.envelope(configure(spark), sf), S.CREATE_TOPIC))


def src_execution_log(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_log_rows(sample.envelope(configure(spark), sf), S.EXECUTE_TOPIC))


def route_topics(spark: SparkSession, sf: str) -> DataFrame:
    log = sample.envelope(configure(spark), sf)
    return log.groupBy("topic", logs.route(F.col("topic")).alias("handler")).agg(
        F.count(F.lit(1)).alias("n"), F.count("key").alias("keyed"), F.count("value").alias("valued")
    )


def replay_bounded(spark: SparkSession, sf: str) -> DataFrame:
    bounded = logs.replay_bounded(sample.envelope(configure(spark), sf), GENERATION)
    return plain(bounded.select("partition", "offset", F.col("key").isNull().alias("is_marker")))


def generation_fence(spark: SparkSession, sf: str) -> DataFrame:
    phased = logs.with_phase(sample.envelope(configure(spark), sf), GENERATION)
    return plain(phased.select("partition", "offset", "fence", "phase"))


def publish_commands(spark: SparkSession, sf: str) -> DataFrame:
    commands = sample.records(configure(spark), sf).where(
        (F.col("topic") == S.CREATE_TOPIC) & (F.col("kind") != codec.MARKER)
    )
    path = shared_path(spark, "published")
    logs.publish(commands, sample.PARTITIONS).write.parquet(path)
    back = spark.read.schema(
        "topic string, partition int, key binary, value binary, headers array<struct<key string, value binary>>"
    ).parquet(path)
    key, create = codec.decode(F.col("key"), S.KEY), codec.decode(F.col("value"), S.CREATE)
    return (
        back.select("partition", key.alias("k"), create.alias("c"), F.col("value").isNull().alias("tombstone"))
        .groupBy("partition", "k.domain", "k.timer_uuid", "tombstone", "c.schedule.cron")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("c.schedule.start_time")).alias("first_start_us"))
        .withColumn("partition", F.col("partition").cast("bigint"))
    )


def log_inspect(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs.inspect(sample.envelope(configure(spark), sf))
    value = F.col("value")
    return plain(
        rows.select(
            "topic", "partition", "offset", "kind", "domain", "timer_uuid",
            F.get_json_object(value, "$.schedule.cron").alias("cron"),
            F.get_json_object(value, "$.progress.completed_executions").cast("bigint").alias("completed"),
        )
    )


def log_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs.inspect(sample.envelope(configure(spark), sf))
    return plain(rows.groupBy("topic", "partition", "kind").agg(F.count(F.lit(1)).alias("n")))


def union_logs(spark: SparkSession, sf: str) -> DataFrame:
    log = sample.envelope(configure(spark), sf)
    both = logs.union_logs(
        log.where(F.col("topic") == S.CREATE_TOPIC), log.where(F.col("topic") == S.EXECUTE_TOPIC)
    )
    return plain(both.select("topic", "partition", "offset"))


def drop_markers(spark: SparkSession, sf: str) -> DataFrame:
    return plain(codec.drop_markers(sample.envelope(configure(spark), sf)).select("topic", "offset"))


def classify_markers(spark: SparkSession, sf: str) -> DataFrame:
    log = sample.envelope(configure(spark), sf)
    marker = codec.classify_marker(F.col("key"), F.col("headers"), GENERATION).alias("marker")
    return plain(log.select("offset", marker).where(F.col("marker").isNotNull()))


def classify_records(spark: SparkSession, sf: str) -> DataFrame:
    return plain(codec.decode_records(sample.envelope(configure(spark), sf)).select("offset", "kind"))


def quarantine_malformed(spark: SparkSession, sf: str) -> DataFrame:
    records = codec.decode_records(sample.envelope(configure(spark), sf, damaged=True))
    bad = codec.split_quarantine(records)[1]
    return plain(bad.select("topic", "offset", "reason"))


def validate_create(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as create commands, broken in every way a rule looks for."""
    pages = configure(spark).read.parquet(f"{sf}/pages.parquet")
    n = F.col("page_id")
    relative = F.regexp_replace("url", r"^https?://[^/]*", "")
    url = (
        F.when(n % 5 == 0, relative)
        .when(n % 13 == 0, F.lit("http://exa mple.com/"))
        .when(n % 17 == 0, F.lit("http://[::1]:x/"))
        .when(n % 19 == 0, F.lit("http://[::1]:80/"))
        .when(n % 23 == 0, F.lit("http://a%41b.example.com/"))
        .otherwise(F.col("url"))
    )
    crons = [*sample.CRONS, "61 * * * *", "* * * *", "@sometimes", "@every 2562048h"]
    http = F.struct(
        url.alias("url"),
        F.pmod(n, F.lit(3)).cast("int").alias("method"),
        F.col("html").cast("binary").alias("body"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit(True).alias("save_response_body"),
    )
    create = F.struct(
        F.struct(F.when(n % 11 != 0, http).alias("http")).alias("task"),
        F.struct(
            F.element_at(F.array(*[F.lit(c) for c in crons]), F.pmod(n, F.lit(10)).cast("int") + 1).alias("cron"),
            F.when(n % 7 != 0, F.lit(NOW)).alias("start_time"),
        ).alias("schedule"),
    )
    commands = pages.select("page_id", create.alias("create"))
    return plain(rules.with_create_error(commands, body_limit=15_000).select("page_id", "error"))


def tenant_scope(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.with_k(sample.events(configure(spark), sf))
    wanted = F.array(*[F.lit(t) for t in ("timers", "executions", "progress", "users")])
    requests = rows.select(
        "event_id",
        F.when(F.col("event_type") != "view", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("domain"),
        F.element_at(wanted, F.pmod(F.col("k"), F.lit(4)) + 1).alias("index"),
    )
    return plain(access.scope_decision(requests))


def valid_uuid(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.with_k(sample.events(configure(spark), sf))
    uuid = sample.timer_uuid(F.col("user_id"), F.pmod(F.col("k"), F.lit(10)))
    kind = F.pmod(F.col("k"), F.lit(5))
    given = (
        F.when(kind == 0, uuid)
        .when(kind == 1, F.replace(uuid, F.lit("-"), F.lit("")))
        .when(kind == 2, F.concat(F.lit("urn:uuid:"), F.upper(uuid)))
        .when(kind == 3, F.substring(uuid, 2, 40))
        .otherwise(F.replace(uuid, F.lit("-"), F.lit("_")))
    )
    return plain(rows.select("event_id", given.alias("given"), keys.is_uuid(given).alias("valid")))


def decode_key(spark: SparkSession, sf: str) -> DataFrame:
    log = codec.drop_markers(sample.envelope(configure(spark), sf))
    return plain(log.select("offset", codec.decode(F.col("key"), S.KEY).alias("k")).select("offset", "k.domain", "k.timer_uuid"))


def decode_create(spark: SparkSession, sf: str) -> DataFrame:
    log = sample.envelope(configure(spark), sf).where((F.col("topic") == S.CREATE_TOPIC) & F.col("value").isNotNull())
    rows = log.select("offset", codec.decode(F.col("value"), S.CREATE).alias("c"))
    return plain(
        rows.select(
            "offset",
            "c.task.http.url",
            "c.task.http.method",
            F.element_at("c.task.http.headers", "Accept").alias("accept"),
            "c.task.http.save_response_body",
            "c.schedule.*",
            "c.meta.create_time",
        )
    )


def decode_execute(spark: SparkSession, sf: str) -> DataFrame:
    log = sample.envelope(configure(spark), sf).where((F.col("topic") == S.EXECUTE_TOPIC) & F.col("value").isNotNull())
    rows = log.select("offset", codec.decode(F.col("value"), S.EXECUTE).alias("e"))
    return plain(rows.select("offset", "e.progress.*", F.col("e.result").cast("string").alias("result")))


def encode_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.records(configure(spark), sf).where(F.col("create").isNotNull())
    full = codec.with_defaults(F.col("create"), S.CREATE)
    return plain(rows.select("offset", codec.document(full).alias("document")))


def _creates_without_start(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.records(configure(spark), sf).where(F.col("create").isNotNull())
    schedule = F.col("create.schedule")
    start = F.when(F.pmod(F.col("k"), F.lit(7)) != 0, schedule["start_time"])
    return rows.withColumn("create", F.col("create").withField("schedule", schedule.withField("start_time", start)))


def default_start(spark: SparkSession, sf: str) -> DataFrame:
    rows = _creates_without_start(spark, sf)
    started = rows.withColumn("create", rules.default_start(F.col("create"), NOW))
    return plain(started.select("offset", "create.schedule.start_time"))


def stamp_meta(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.records(configure(spark), sf).where(F.col("create").isNotNull())
    stamped = rows.select("offset", rules.stamp_meta(F.col("create"), NOW).alias("c"), rules.random_id().alias("id"))
    return plain(stamped.select("offset", "c.meta.create_time", keys.is_uuid(F.col("id")).alias("id_ok")))


def accept_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Creates, some without an id, without a start or with a broken text, and deletes, some with a broken id.

    An id that is drawn is not the same twice, so only its form is shown.
    """
    rows = sample.records(configure(spark), sf).where((F.col("topic") == S.CREATE_TOPIC) & (F.col("kind") != codec.MARKER))
    plan = F.col("create.schedule")
    cron = F.when(F.col("k") % 11 == 0, "@sometimes").otherwise(plan["cron"])
    start = F.when(F.col("k") % 7 != 0, plan["start_time"])
    create = F.col("create").withField("schedule", plan.withField("cron", cron).withField("start_time", start))
    is_delete = F.col("kind") == codec.DELETE
    nameless = ~is_delete & (F.col("k") % 5 == 2)
    asked = rows.select(
        "offset", "domain", is_delete.alias("is_delete"),
        F.when(is_delete & (F.col("k") % 13 == 0), "nobody").when(nameless, None).otherwise(F.col("timer_uuid")).alias("timer_uuid"),
        F.when(~is_delete, create).alias("create"), nameless.alias("nameless"),
    )
    judged = commands.judge(asked, NOW)
    good = F.col("reason").isNull()
    return plain(
        judged.select(
            "offset", "domain", "is_delete", "reason", (F.col("nameless") & keys.is_uuid(F.col("timer_uuid"))).alias("id_drawn"),
            F.when(good & ~F.col("nameless"), keys.partition_of(F.col("timer_uuid"), sample.PARTITIONS)).alias("partition"),
            F.when(good, F.col("create.schedule.start_time")).alias("start_time"),
        )
    )


def headers_to_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.envelope(configure(spark), sf).select("offset", codec.headers_to_map(F.col("headers")).alias("m"))
    return plain(
        rows.select("offset", F.col("m")["generationID"].alias("generation"), F.col("m")["trace"].alias("trace"))
    )


def split_header_values(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses as header values: cut at commas, pieces kept as they are."""
    pages = configure(spark).read.parquet(f"{sf}/pages.parquet")
    value = F.regexp_replace("url", r"[./]", ",")
    split = rules.split_header_values(F.create_map(F.lit("X-Parts"), value))["X-Parts"]
    return plain(pages.select("page_id", F.size(split).alias("parts"), F.array_join(split, "|").alias("joined")))


def partition_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = codec.drop_markers(sample.envelope(configure(spark), sf))
    ids = rows.select(codec.decode(F.col("key"), S.KEY)["timer_uuid"].alias("timer_uuid")).distinct()
    return plain(ids.select("timer_uuid", keys.partition_of(F.col("timer_uuid"), 1000).alias("partition")))


def parse_result(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.records(configure(spark), sf).where(F.col("execute").isNotNull())
    parsed = rows.select("offset", results.parse_result(F.col("execute.result")).alias("r"))
    ok = parsed.where(F.col(f"r.{S.CORRUPT}").isNull())
    return plain(
        ok.select(
            "offset",
            F.col("r.StatusCode").alias("status"),
            F.col("r.Error").alias("error"),
            F.col("r.Proto").alias("proto"),
            F.col("r.Body").alias("body"),
            F.array_join(F.try_element_at("r.Headers", F.lit("X-K")), "|").alias("x_k"),
        )
    )


def result_outcome(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.records(configure(spark), sf).where(F.col("execute").isNotNull())
    outcome = results.result_outcome(F.col("execute.result")).alias("outcome")
    return rows.groupBy("domain", outcome).agg(F.count(F.lit(1)).alias("n"))


def cap_body(spark: SparkSession, sf: str) -> DataFrame:
    pages = configure(spark).read.parquet(f"{sf}/pages.parquet")
    capped = results.cap_body(F.col("html"), F.col("page_id") % 3 != 0, 5_000)
    return plain(
        pages.select("page_id", capped.alias("c")).select(
            "page_id", F.octet_length("c.Body").alias("kept_bytes"), F.col("c.Error").alias("error")
        )
    )


def error_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.events(configure(spark), sf)
    message = F.concat(F.lit('dial "tcp"\\'), F.col("event_type"), F.lit(": "), F.col("props"))
    return plain(rows.select("event_id", results.error_json(message).alias("document")))


def shift_path(spark: SparkSession, sf: str) -> DataFrame:
    pages = configure(spark).read.parquet(f"{sf}/pages.parquet")
    path = paths.url_path(F.col("url"))
    n = F.col("page_id")
    messy = (
        F.when(n % 4 == 1, F.concat(F.lit("//."), path))
        .when(n % 4 == 2, F.concat(F.lit("/a/../.."), path, F.lit("/./b//..")))
        .when(n % 4 == 3, F.substring(path, 2, 1 << 20))
        .otherwise(path)
    )
    return plain(pages.select("page_id", paths.shift_path(messy).alias("p")).select("page_id", "p.head", "p.tail"))


ROUTES = [
    "/auth/apikey",
    "/auth/apikey/callback",
    "/elastic/timers",
    "/elastic/executions/_search",
    "/elastic/progress",
    "/other",
    "//auth/./apikey/x/..",
    "/auth/nope",
]


def attribute_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.with_k(sample.events(configure(spark), sf))
    path = F.element_at(F.array(*[F.lit(r) for r in ROUTES]), F.pmod(F.col("k"), F.lit(8)) + 1)
    coded = F.base64(F.concat_ws(":", F.col("user_id").cast("string"), F.col("k").cast("string")).cast("binary"))
    prefix = F.when(F.pmod(F.col("k"), F.lit(10)) == 0, F.lit("Bearer ")).otherwise(F.lit("bAsic "))
    requests = rows.select(path.alias("path"), F.concat(prefix, coded).alias("header"))
    return access.attribute_requests(requests).groupBy("route", "tenant", "outcome").agg(F.count(F.lit(1)).alias("n"))


def method_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.with_k(sample.events(configure(spark), sf))
    number = F.pmod(F.col("k"), F.lit(4))
    return rows.groupBy(number.cast("bigint").alias("method"), rules.method_name(number).alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )


QUERIES = {
    f.__name__: f
    for f in (
        src_command_log, src_execution_log, route_topics, replay_bounded, generation_fence, publish_commands,
        log_inspect, log_counts, union_logs, drop_markers, classify_markers, classify_records,
        quarantine_malformed, validate_create, tenant_scope, valid_uuid, decode_key, decode_create,
        decode_execute, encode_records, default_start, stamp_meta, accept_commands, headers_to_map, split_header_values,
        partition_of, parse_result, result_outcome, cap_body, error_json, shift_path, attribute_requests,
        method_name,
    )
}
