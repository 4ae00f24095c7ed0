"""Cron texts as bit masks, and next-match search as plain integer arithmetic.

A five-field text becomes five long masks (bit n set = value n matches). Searching the next
matching instant is then a handful of shifts and bit counts: no Python worker, no lookup table and
no join, so a cron text that a third of all timers share costs no more than any other.

The expressions are written as SQL text, which keeps a plan of this size quick to build.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.functions.once import evaluate_once

MINUTE_US = 60_000_000
SECOND_US = 1_000_000
MINUTES_PER_DAY = 1440

# fixed values: ranges and names of the five fields, shorthand texts, duration units
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAY_NAMES = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
FIELDS = [
    ("minute", 0, 59, {}),
    ("hour", 0, 23, {}),
    ("dom", 1, 31, {}),
    ("month", 1, 12, {name: i + 1 for i, name in enumerate(MONTH_NAMES)}),
    ("dow", 0, 6, {name: i for i, name in enumerate(DAY_NAMES)}),
]
SHORTHANDS = {
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
    "@monthly": "0 0 1 * *",
    "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@hourly": "0 * * * *",
}
EVERY = "@every "
UNIT_NANOS = {
    "ns": 1,
    "us": 10**3,
    "µs": 10**3,
    "μs": 10**3,
    "ms": 10**6,
    "s": 10**9,
    "m": 60 * 10**9,
    "h": 3600 * 10**9,
}
_AMOUNT = "([0-9]+[.]?[0-9]*|[.][0-9]+)"
_UNIT = "(" + "|".join(UNIT_NANOS) + ")"

# A weekly pattern repeated six times: 42 days, enough for a month starting on any weekday.
WEEK_REPEAT = sum(1 << (7 * i) for i in range(6))

MASKS = [f"{name}_mask" for name, *_ in FIELDS]
PARSED = ["cron_kind", "every_s", *MASKS, "dom_star", "dow_star", "cron_error"]


def _sql(value) -> str:
    return f"'{value}'" if isinstance(value, str) else f"{value}L" if abs(value) >= 1 << 31 else str(value)


def _map(values: dict) -> str:
    return "map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in values.items()) + ")"


def _lowest(mask: str) -> str:
    """Position of the lowest set bit of a mask that is not zero."""
    return f"bit_count(({mask} & -({mask})) - 1)"


def _has(mask: str, position: str) -> str:
    return f"((shiftright({mask}, {position}) & 1L) = 1L)"


def _number(text: str, names: dict) -> str:
    digits = f"CASE WHEN {text} RLIKE '^[+]?[0-9]{{1,9}}$' THEN int(replace({text}, '+', '')) END"
    return f"coalesce(try_element_at({_map(names)}, lower({text})), {digits})" if names else digits


def _bits_of(sequence: str) -> str:
    return f"aggregate({sequence}, 0L, (acc, x) -> acc | shiftleft(1L, x))"


def _list_mask(text: str, low: int, high: int, names: dict) -> str:
    """Mask of a comma list of numbers, names, ranges and steps; null when an item is wrong.

    Each ``transform`` is one stage whose values the next one reuses, so an item is split once.
    """
    items = f"filter(split({text}, ','), i -> i <> '')"
    pieces = f"transform({items}, i -> struct(split(substring_index(i, '/', 1), '-') AS span, split(i, '/') AS parts))"
    numbers = (
        f"transform({pieces}, p -> struct(p.span[0] IN ('*', '?') AS star, size(p.span) AS ends, size(p.parts) AS parts, "
        f"{_number('p.span[0]', names)} AS first, {_number('get(p.span, 1)', names)} AS last, "
        f"CASE WHEN size(p.parts) = 1 THEN 1 ELSE {_number('get(p.parts, 1)', {})} END AS step))"
    )
    bounds = (
        f"transform({numbers}, n -> struct(n.parts <= 2 AND (n.star OR n.ends <= 2) AND n.step > 0 AS shaped, "
        f"CASE WHEN n.star THEN {low} ELSE n.first END AS first, "
        f"CASE WHEN n.star OR (n.ends = 1 AND n.parts = 2) THEN {high} WHEN n.ends = 1 THEN n.first ELSE n.last END AS last, "
        "n.step AS step))"
    )
    masks = (
        f"transform({bounds}, b -> CASE WHEN b.shaped AND b.first >= {low} AND b.last <= {high} AND b.first <= b.last "
        f"THEN {_bits_of('sequence(b.first, b.last, b.step)')} END)"
    )
    return f"aggregate({masks}, 0L, (acc, x) -> acc | x)"


def _field_mask(text: str, low: int, high: int, names: dict) -> str:
    """Mask of one field, or null when it breaks a rule; the common forms need no list."""
    full = sum(1 << i for i in range(low, high + 1))
    first, last = f"int(substring_index({text}, '-', 1))", f"int(substring_index({text}, '-', -1))"
    return (
        f"CASE WHEN {text} IN ('*', '?') THEN bigint({full}) "
        f"WHEN {text} RLIKE '^[0-9]{{1,2}}$' THEN CASE WHEN int({text}) BETWEEN {low} AND {high} THEN shiftleft(1L, int({text})) END "
        f"WHEN {text} RLIKE '^[*]/[1-9][0-9]?$' THEN {_bits_of(f'sequence({low}, {high}, int(substring({text}, 3, 2)))')} "
        f"WHEN {text} RLIKE '^[0-9]{{1,2}}-[0-9]{{1,2}}$' THEN CASE WHEN {first} >= {low} AND {first} <= {last} AND {last} <= {high} "
        f"THEN shiftleft(1L, {last} + 1) - shiftleft(1L, {first}) END "
        f"ELSE {_list_mask(text, low, high, names)} END"
    )


def _every_seconds(text: str) -> str:
    """Whole seconds of a repeat duration, at least one; null when it is not a duration or too long a one."""
    body = f"substring({text}, {len(EVERY) + 1})"
    parts = [f"regexp_extract_all({body}, '{_AMOUNT}{_UNIT}', {group})" for group in (1, 2)]
    unit = f"element_at({_map(UNIT_NANOS)}, u)"
    # whole nanoseconds in decimals; null as soon as an amount or the sum is no 64-bit number
    amount = (
        f"CASE WHEN double(n) * double({unit}) < 9.3e18D "
        f"THEN try_cast(try_cast(n AS decimal(28, 9)) * CAST({unit} AS decimal(14, 0)) AS bigint) END"
    )
    nanos = f"aggregate(zip_with({parts[0]}, {parts[1]}, (n, u) -> {amount}), 0L, (acc, x) -> try_add(acc, x))"
    return (
        f"CASE WHEN {body} RLIKE '^[-+]?(0|({_AMOUNT}{_UNIT})+)$' THEN "
        f"CASE WHEN {nanos} IS NULL THEN NULL WHEN startswith({body}, '-') THEN 1L ELSE greatest({nanos} div 1000000000L, 1L) END END"
    )


def parse(df: DataFrame, cron: str = "cron") -> DataFrame:
    """Add the parsed form of a cron column (see ``PARSED``)."""
    text = f"`{cron}`"
    named = df.selectExpr(
        "*",
        f"coalesce(try_element_at({_map(SHORTHANDS)}, {text}), {text}, '') AS _text",
        f"coalesce(startswith({text}, '{EVERY}'), false) AS _repeats",
    )
    split = named.selectExpr(
        "*",
        "split(trim(regexp_replace(_text, '[ \\t\\n\\r]+', ' ')), ' ') AS _fields",
        f"CASE WHEN _repeats THEN {_every_seconds(text)} END AS every_s",
    ).selectExpr("*", "NOT startswith(_text, '@') AND size(_fields) = 5 AS _five")
    masked = split.selectExpr(
        "*",
        *[
            f"CASE WHEN _five THEN {_field_mask(f'_fields[{i}]', low, high, names)} END AS {name}_mask"
            for i, (name, low, high, names) in enumerate(FIELDS)
        ],
        *[f"_five AND get(_fields, {i}) RLIKE '(^|,)[*?]([-/,]|$)' AS {name}_star" for i, name in ((2, "dom"), (4, "dow"))],
    )
    wrong_field = ", ".join(f"CASE WHEN {name}_mask IS NULL THEN 'bad {name} field' END" for name, *_ in FIELDS)
    error = (
        "CASE WHEN _text = '' THEN 'empty text' WHEN _repeats THEN CASE WHEN every_s IS NULL THEN 'bad duration' END "
        "WHEN startswith(_text, '@') THEN 'unknown descriptor' WHEN NOT _five THEN 'expected 5 fields' "
        f"ELSE coalesce({wrong_field}) END"
    )
    judged = masked.selectExpr(*_quoted(df.columns), *PARSED[1:-1], "_repeats", f"{error} AS cron_error")
    kind = "CASE WHEN cron_error IS NOT NULL THEN 'error' WHEN _repeats THEN 'every' ELSE 'fields' END AS cron_kind"
    return evaluate_once(judged.selectExpr(*_quoted(df.columns), kind, *PARSED[1:]), *PARSED)


def _quoted(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def day_matches_sql(day: str) -> str:
    """Whether a day number (days since 1970-01-01) is a day of the schedule in scope."""
    date = f"date_from_unix_date(int({day}))"
    dom = _has("dom_mask", f"dayofmonth({date})")
    dow = _has("dow_mask", f"int(pmod({day} + 4, 7))")
    return (
        f"({_has('month_mask', f'month({date})')} AND "
        f"CASE WHEN dom_star OR dow_star THEN {dom} AND {dow} ELSE {dom} OR {dow} END)"
    )


def _month_days(first: str) -> str:
    """Mask of the matching days of the month that starts on the date ``first``."""
    in_month = f"(shiftleft(1L, dayofmonth(last_day({first})) + 1) - 2L)"
    weekday = f"int(pmod(unix_date({first}) + 4, 7))"
    by_dow = f"(shiftleft(shiftright(dow_mask * {WEEK_REPEAT}L, {weekday}), 1) & {in_month})"
    by_dom = f"(dom_mask & {in_month})"
    return (
        f"CASE WHEN {_has('month_mask', f'month({first})')} THEN "
        f"CASE WHEN dom_star OR dow_star THEN {by_dom} & {by_dow} ELSE {by_dom} | {by_dow} END ELSE 0L END"
    )


def with_next_match(df: DataFrame, after: str, out: str) -> DataFrame:
    """First matching instant strictly after ``after`` (both epoch microseconds).

    Needs the columns of ``parse``; null for repeat intervals and broken texts, for a null
    ``after`` and when nothing matches until the end of the fifth year after it.
    """
    usable = "cron_kind = 'fields' AND hour_mask <> 0 AND minute_mask <> 0"
    whole_minute = f"({after} - pmod({after}, {MINUTE_US}L)) div {MINUTE_US}L"
    first_minute = _lowest("minute_mask")
    earliest = f"{_lowest('hour_mask')} * 60 + {first_minute}"
    clock = (
        df.selectExpr("*", f"CASE WHEN {usable} THEN {whole_minute} + 1 END AS _m")
        .selectExpr(
            "*",
            f"(_m - pmod(_m, {MINUTES_PER_DAY}L)) div {MINUTES_PER_DAY}L AS _day",
            f"int(pmod(_m, {MINUTES_PER_DAY}L) div 60) AS _h",
            "int(pmod(_m, 60L)) AS _mi",
        )
        .selectExpr("*", "trunc(date_from_unix_date(int(_day)), 'MM') AS _month", f"{day_matches_sql('_day')} AS _today")
    )
    # the rest of this hour, then the later hours of this day
    this_hour = f"CASE WHEN _today AND {_has('hour_mask', '_h')} THEN minute_mask & shiftleft(-1L, _mi) ELSE 0L END"
    later_hours = "CASE WHEN _today THEN hour_mask & shiftleft(-1L, _h + 1) ELSE 0L END"
    same_day = (
        f"CASE WHEN _in_hour <> 0 THEN _h * 60 + {_lowest('_in_hour')} "
        f"WHEN _in_day <> 0 THEN {_lowest('_in_day')} * 60 + {first_minute} END"
    )
    today = clock.selectExpr("*", f"{this_hour} AS _in_hour", f"{later_hours} AS _in_day").selectExpr(
        "*", f"{same_day} AS _same_day"
    )
    # the rest of this month, then the first later month with a matching day
    rest = f"({_month_days('_month')}) & shiftleft(-1L, dayofmonth(date_from_unix_date(int(_day))) + 1)"
    ahead = (
        "get(filter(sequence(1, 72 - month(_month)), "
        f"k -> ({_month_days('add_months(_month, k)')}) <> 0L), 0)"
    )
    later = (
        today.selectExpr("*", f"CASE WHEN _same_day IS NULL THEN {rest} END AS _in_month")
        .selectExpr("*", f"CASE WHEN _in_month = 0 THEN add_months(_month, {ahead}) END AS _later")
        .selectExpr("*", f"CASE WHEN _later IS NOT NULL THEN {_month_days('_later')} END AS _in_later")
    )
    next_day = (
        "CASE WHEN _same_day IS NOT NULL THEN _day "
        f"WHEN _in_month <> 0 THEN unix_date(_month) + {_lowest('_in_month')} - 1 "
        f"WHEN _later IS NOT NULL THEN unix_date(_later) + {_lowest('_in_later')} - 1 END"
    )
    value = f"(bigint({next_day}) * {MINUTES_PER_DAY} + coalesce(_same_day, {earliest})) * {MINUTE_US}"
    found = later.selectExpr(*_quoted(df.columns), f"CASE WHEN _m IS NOT NULL THEN {value} END AS {out}")
    return evaluate_once(found, out)


def mask_to_array(mask: str, low: int, high: int) -> str:
    """SQL text of the sorted values of a mask."""
    return f"filter(sequence({low}, {high}), x -> {_has(mask, 'x')})"


def truncate_second(micros: Column) -> Column:
    return micros - F.pmod(micros, F.lit(SECOND_US).cast("bigint"))
