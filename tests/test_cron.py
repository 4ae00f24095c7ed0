import random

import pytest
from pyspark.sql import functions as F

from model import matches, scan_next, us
from tickledger.functions import cron as C
from tickledger.streaming.fires import next_match

ACCEPTED = {
    "*/15 * * * *": ([0, 15, 30, 45], 24),
    "5 4 * * *": ([5], 1),
    "1,2,40-42 1-3 * * *": ([1, 2, 40, 41, 42], 3),
    "3/20 */6 * * mon-fri": ([3, 23, 43], 4),
    "1,,2 * ? JAN,mar ?": ([1, 2], 24),
    "@hourly": ([0], 24),
    "@weekly": ([0], 1),
    "  10   2 * *   0 ": ([10], 1),
}
REJECTED = {
    "": "empty text",
    None: "empty text",
    "* * * *": "expected 5 fields",
    "* * * * * *": "expected 5 fields",
    "@sometimes": "unknown descriptor",
    "@every": "unknown descriptor",
    "@every ": "bad duration",
    "@every 5": "bad duration",
    "@every 1d": "bad duration",
    "60 * * * *": "bad minute field",
    "5-1 * * * *": "bad minute field",
    "*/0 * * * *": "bad minute field",
    "1-2-3 * * * *": "bad minute field",
    "1/2/3 * * * *": "bad minute field",
    "x * * * *": "bad minute field",
    "-1 * * * *": "bad minute field",
    "* 24 * * *": "bad hour field",
    "* * 0 * *": "bad dom field",
    "* * 32 * *": "bad dom field",
    "* * * 13 *": "bad month field",
    "* * * foo *": "bad month field",
    "* * * * 7": "bad dow field",
}
REPEATS = {
    "@every 5s": 5,
    "@every 90m": 5400,
    "@every 1h30m10s": 5410,
    "@every 1.5h": 5400,
    "@every 2500ms": 2,
    "@every 300ms": 1,
    "@every -5s": 1,
    "@every 0": 1,
}


def _parsed(spark, texts):
    df = C.parse(spark.createDataFrame([(t,) for t in texts], "cron string"))
    return {r.cron: r for r in df.collect()}


def test_accepted_texts(spark):
    rows = _parsed(spark, ACCEPTED)
    for text, (minutes, hours) in ACCEPTED.items():
        row = rows[text]
        assert row.cron_kind == "fields" and row.cron_error is None, text
        assert [m for m in range(60) if row.minute_mask >> m & 1] == minutes, text
        assert bin(row.hour_mask).count("1") == hours, text


def test_rejected_texts(spark):
    rows = _parsed(spark, REJECTED)
    for text, reason in REJECTED.items():
        assert (rows[text].cron_kind, rows[text].cron_error) == ("error", reason), text


def test_repeat_texts(spark):
    rows = _parsed(spark, REPEATS)
    for text, seconds in REPEATS.items():
        assert (rows[text].cron_kind, rows[text].every_s) == ("every", seconds), text


def _random_field(rng, low, high, names):
    kind = rng.random()
    if kind < 0.35:
        return "*"
    if kind < 0.5:
        return f"*/{rng.randint(1, high)}"
    if kind < 0.7:
        return str(rng.randint(low, high))
    if kind < 0.8 and names:
        return rng.choice(list(names))
    first = rng.randint(low, high)
    last = rng.randint(first, high)
    return f"{first}-{last},{rng.randint(low, high)}"


def _random_crons(seed, n):
    from model import DAYS, MONTHS

    rng = random.Random(seed)
    bounds = [(0, 59, {}), (0, 23, {}), (1, 31, {}), (1, 12, MONTHS), (0, 6, DAYS)]
    for _ in range(n):
        after = us(2023, 1, 1) + rng.randint(0, 3 * 365 * 86400) * 1_000_000 + rng.choice([0, 0, 1, 999_999])
        if rng.random() < 0.3:
            after = after // 86_400_000_000 * 86_400_000_000 - rng.choice([0, 1])
        fields = [_random_field(rng, *b) for b in bounds]
        fields[3] = rng.choice(["*", "*", fields[3]])
        yield " ".join(fields), after


def test_next_match_equals_a_minute_scan(spark):
    cases = list(_random_crons(7, 60))
    df = spark.createDataFrame(cases, "cron string, after long")
    rows = C.with_next_match(C.parse(df), "after", "found").collect()
    for row in rows:
        days = 45
        expected = scan_next(row.cron, row.after, days)
        if expected is None:  # beyond the scan: it must match, and not within the scanned days
            assert row.found is None or row.found > row.after + days * 86_400_000_000, row
            if row.found is not None:
                assert matches(row.cron, row.found)
        else:
            assert row.found == expected, row


def test_the_state_helper_equals_the_columns(spark):
    cases = list(_random_crons(11, 300))
    df = spark.createDataFrame(cases, "cron string, after long")
    for row in C.with_next_match(C.parse(df), "after", "found").collect():
        assert next_match(row.asDict(), row.after) == row.found, row


@pytest.mark.parametrize(
    "cron, after, expected",
    [
        ("0 0 31 2 *", us(2024, 1, 1), None),
        ("0 0 29 2 *", us(2024, 2, 29), us(2028, 2, 29)),
        ("0 0 1,15 * 1", us(2024, 1, 1), us(2024, 1, 8)),  # both day fields: either one
        ("0 0 */2 * 1", us(2024, 1, 1), us(2024, 1, 15)),  # a stepped star still counts as a star
        ("59 23 31 12 *", us(2024, 12, 31, 23, 59), us(2025, 12, 31, 23, 59)),
        ("* * * * *", us(1969, 12, 31, 23, 59) + 1, us(1970, 1, 1)),
    ],
)
def test_edges(spark, cron, after, expected):
    df = C.parse(spark.createDataFrame([(cron, after)], "cron string, after long"))
    assert C.with_next_match(df, "after", "found").select(F.col("found")).first().found == expected


def test_long_durations_are_an_error_and_stop_nothing(spark):
    texts = {
        "@every 9999999999999h": None, "@every 999999999h999999999h999999999h": None, "@every 2562048h": None, "@every 2562047h": 9223369200,
        "@every 9223372036854775807ns": 9223372036, "@every 9223372036854775808ns": None, "@every " + "9" * 60 + "s": None,
        "@every 1.5h": 5400, "@every -9999999999999h": None, "@every 0.000000000000000000000000000001h": 1,
    }
    rows = C.parse(spark.createDataFrame([(t,) for t in texts], "cron string")).collect()
    assert {r.cron: r.every_s for r in rows} == texts
    assert all((r.cron_error == "bad duration") == (r.every_s is None) for r in rows)
