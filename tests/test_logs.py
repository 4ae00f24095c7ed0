import datetime as dt
import json

from pyspark.sql import functions as F

from tickledger import schemas as S
from tickledger.functions import codec, keys, results, rules
from tickledger.sources import logs, sample, tables
from tickledger.operators import commands, compaction

NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)


def test_decoding_gives_back_the_typed_records(spark, sf_dir):
    typed = sample.records(spark, sf_dir)
    decoded = codec.decode_records(sample.envelope(spark, sf_dir))
    shape = ["topic", "partition", "offset", "timestamp", "kind", "domain", "timer_uuid"]
    texts = [F.to_json("create").alias("c"), F.to_json("execute").alias("e")]
    left, right = typed.select(*shape, *texts), decoded.select(*shape, *texts)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_quarantine_keeps_every_record(spark, sf_dir):
    log = sample.envelope(spark, sf_dir, damaged=True)
    good, bad = codec.split_quarantine(codec.decode_records(log))
    assert good.count() + bad.count() == log.count()
    assert {r.reason for r in bad.select("reason").distinct().collect()} == {"undecodable key", "undecodable value"}


def test_odd_records(spark):
    rows = [
        ("create", 0, 1, NOW, b'{"domain":"d","timer_uuid":"u"}', b"{", None),
        ("create", 0, 2, NOW, b'{"domain":"d"}', None, None),
        ("create", 0, 3, NOW, b"\xff\xfe", b"{}", None),
        ("other", 0, 4, NOW, b'{"domain":"d","timer_uuid":"u"}', b"{}", None),
        ("create", 0, 5, NOW, None, b"{}", None),
        ("execute", 0, 6, NOW, b'{"domain":"d","timer_uuid":"u"}', b'{"progress":{"completed_executions":"x"}}', None),
    ]
    got = {r.offset: r.kind for r in codec.decode_records(spark.createDataFrame(rows, S.ENVELOPE)).collect()}
    assert got == {
        1: codec.BAD_VALUE, 2: codec.BAD_KEY, 3: codec.BAD_KEY, 4: codec.UNKNOWN_TOPIC, 5: codec.MARKER, 6: codec.BAD_VALUE,
    }


def test_markers_and_phases(spark):
    mark = lambda g: [("generationID", g.encode())]
    key = b'{"domain":"d","timer_uuid":"u"}'
    rows = [
        ("create", 0, 0, NOW, key, b"{}", None),
        ("create", 0, 1, NOW, None, None, mark("1")),
        ("create", 0, 2, NOW, key, None, None),
        ("create", 0, 3, NOW, None, None, mark("2")),
        ("create", 1, 0, NOW, key, None, None),
        ("create", 1, 1, NOW, None, None, None),
    ]
    log = spark.createDataFrame(rows, S.ENVELOPE)
    phases = {(r.partition, r.offset): r.phase for r in logs.with_phase(log, "1").collect()}
    assert phases == {
        (0, 0): "snapshot", (0, 1): "snapshot", (0, 2): "live", (0, 3): "live", (1, 0): "waiting", (1, 1): "waiting",
    }
    kinds = log.select("offset", codec.classify_marker(F.col("key"), F.col("headers"), "1").alias("m"))
    assert [r.m for r in kinds.collect()] == [None, "MY_MARKER", None, "FOREIGN_MARKER", None, "FOREIGN_MARKER"]


def test_stored_logs_are_read_back(spark, sf_dir, tmp_path):
    log = sample.envelope(spark, sf_dir)
    for fmt in ("parquet", "json"):
        log.write.format(fmt).save(str(tmp_path / fmt))
        back = logs.read_log(spark, str(tmp_path / fmt), fmt)
        assert back.select("topic", "partition", "offset", "key", "value").exceptAll(
            log.select("topic", "partition", "offset", "key", "value")
        ).count() == 0


def test_results(spark):
    long = "x" * 10
    rows = [(1, "abc", True), (2, long, True), (3, long[:9], True), (4, "abc", False), (5, "", True)]
    df = spark.createDataFrame(rows, "i int, body string, keep boolean")
    got = {r.i: (r.c.Body, r.c.Error) for r in df.select("i", results.cap_body(F.col("body"), F.col("keep"), 10).alias("c")).collect()}
    assert got == {1: ("abc", ""), 2: ("", results.BODY_TOO_LARGE), 3: (long[:9], ""), 4: ("", ""), 5: ("", "")}
    texts = [b'{"Error":"a"}', b'{"Error":"said "no""}', b"{}", None, b'{"StatusCode":200}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw binary")
    outcomes = [r.o for r in df.select("i", results.result_outcome(F.col("raw")).alias("o")).orderBy("i").collect()]
    assert outcomes == ["error", "malformed", "ok", "malformed", "ok"]
    message = 'tls: "bad"\\ \n'
    text = spark.createDataFrame([(message,)], "m string").select(results.error_json(F.col("m"))).first()[0]
    assert json.loads(text) == {"Error": message}


def test_create_rules_report_the_first_failure(spark):
    def create(url="http://h.example/x", method=0, body=b"", cron="@daily", start=NOW, task=True):
        http = (url, method, body, None, True) if task else None
        return ((http,), (cron, start, None, 0), None)

    cases = [
        (create(), None),
        (create(task=False, cron="x"), "invalid task: unknown task"),
        (create(method=2, url=""), "invalid task: unknown method"),
        (create(method=None), None),
        (create(url="http://a b/"), "invalid task: parsing url: bad host character"),
        (create(url="http://h/%zz"), "invalid task: parsing url: bad escape"),
        (create(url="/only/path"), "invalid task: relative url not allowed"),
        (create(url=None), "invalid task: relative url not allowed"),
        (create(url="mailto:x@y"), "invalid task: relative url not allowed"),
        (create(url="http://h:80a/"), "invalid task: parsing url: bad port"),
        (create(url="http://u@h:80/?q=%zz"), None),
        (create(body=b"x" * 11), "invalid task: request body too large"),
        (create(body=b"x" * 10), None),
        (create(cron="* *"), "invalid schedule: invalid cron: expected 5 fields"),
        (create(cron="* *", start=None), "invalid schedule: invalid cron: expected 5 fields"),
        (create(start=None), "invalid schedule: start time required"),
    ]
    schema = f"i int, create {S.CREATE.simpleString()}"
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], schema)
    got = {r.i: r.error for r in rules.with_create_error(df, body_limit=10).collect()}
    assert got == {i: error for i, (_, error) in enumerate(cases)}


def test_header_values_keep_their_blanks(spark):
    df = spark.createDataFrame([({"a": "x, y,", "b": ""},)], "h map<string,string>")
    assert df.select(rules.split_header_values(F.col("h"))).first()[0] == {"a": ["x", " y", ""], "b": [""]}


def test_uuid_spellings(spark):
    good = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    texts = {
        good: True, good.upper(): True, "urn:uuid:" + good: True, "{" + good + "}": True,
        good.replace("-", ""): True, good[1:]: False, good + "0": False, "": False, None: False,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.ok for r in df.select("t", keys.is_uuid(F.col("t")).alias("ok")).collect()} == texts


def test_tenants_see_their_own_folder_only(spark, sf_dir, tmp_path):
    import pytest

    timers = compaction.timers_projection(sample.records(spark, sf_dir)).select("domain", "timer_uuid")
    path = str(tmp_path / "timers")
    tables.write_by_domain(timers, path)
    stored = {"timers": tables.read_table(spark, path)}
    own = tables.scoped(stored, "timers", "u3")
    assert own.count() == timers.where("domain = 'u3'").count() > 0
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan
    with pytest.raises(ValueError):
        tables.scoped(stored, "progress", "u3")


def test_only_whole_documents_are_records(spark):
    good, key = b'{"schedule":{"cron":"@daily"}}', b'{"domain":"d","timer_uuid":"t"}'
    values = {good: "UPSERT", good + b" \n": "UPSERT", good + b" trailing": "BAD_VALUE", good + good: "BAD_VALUE", good[:-1]: "BAD_VALUE", b"": "BAD_VALUE", None: "DELETE",
              good + b"," + good: "BAD_VALUE", b"{}": "UPSERT"}
    rows = [("create", 0, i, None, key, v, None) for i, v in enumerate(values)] + [("create", 0, 99, None, key + b"x", good, None)]
    got = {r.offset: r.kind for r in codec.decode_records(spark.createDataFrame(rows, S.ENVELOPE)).collect()}
    assert got == {**dict(enumerate(values.values())), 99: "BAD_KEY"}


def test_bracket_hosts(spark):
    from tickledger.functions import rules

    urls = {
        "http://[::1]/": None, "http://[::1]:80/": None, "http://[::1/": "bad bracket host", "http://[::1]:x/": "bad bracket host", "http://u@[::1]x/": "bad bracket host",
        "http://a%41.com/": "bad host escape", "http://a:b/": "bad port", "http://a.com/%41": None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.e for r in df.select("url", rules.url_error(F.col("url")).alias("e")).collect()} == urls


def test_creates_without_an_id_get_one_each(spark):
    http = (("http://h/", 0, None, None, True),)
    rows = [("d", None if i % 2 else f"00000000-0000-0000-0000-0000000000{i:02d}", (http, ("@daily", None, None, 0), None)) for i in range(40)] + [("d", None, None)]
    asked = spark.createDataFrame(rows, f"domain string, timer_uuid string, create {S.CREATE.simpleString()}")
    good, bad = commands.split(commands.judge(asked, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)))
    assert good.select("timer_uuid").distinct().count() == good.count() == 40
    assert [(r.timer_uuid, r.reason) for r in bad.collect()] == [(None, "invalid timer id")]
