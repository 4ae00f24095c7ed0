"""Slow, plain models of the rules, to check the distributed operators against."""

import datetime as dt

MINUTE = 60_000_000
UTC = dt.timezone.utc


def us(*parts):
    return int(dt.datetime(*parts, tzinfo=UTC).timestamp() * 1_000_000)


def _field(text, low, high, names):
    values = set()
    for item in text.split(","):
        span, _, step = item.partition("/")
        first, _, last = span.partition("-")
        if first in ("*", "?"):
            start, end = low, high
        else:
            start = names.get(first.lower(), None) if first.lower() in names else int(first)
            if last:
                end = names.get(last.lower(), None) if last.lower() in names else int(last)
            else:
                end = high if step else start
        values |= set(range(start, end + 1, int(step or 1)))
    return values


MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())}


def matches(cron, micros):
    minute, hour, dom, month, dow = cron.split()
    t = dt.datetime.fromtimestamp(micros / 1e6, UTC)
    if t.minute not in _field(minute, 0, 59, {}) or t.hour not in _field(hour, 0, 23, {}):
        return False
    if t.month not in _field(month, 1, 12, MONTHS):
        return False
    by_dom = t.day in _field(dom, 1, 31, {})
    by_dow = t.isoweekday() % 7 in _field(dow, 0, 6, DAYS)
    starred = any(i[0] in "*?" for f in (dom, dow) for i in f.split(","))
    return (by_dom and by_dow) if starred else (by_dom or by_dow)


def scan_next(cron, after, limit_days):
    t = after // MINUTE * MINUTE + MINUTE
    end = after + limit_days * 1440 * MINUTE
    while t <= end:
        if matches(cron, t):
            return t
        t += MINUTE
    return None


def planned(cron, start, last, limit_days=40):
    """First instant at or after the start, or after the last execution."""
    if cron.startswith("@every "):
        step = int(cron[7:-1]) * {"s": 1, "m": 60, "h": 3600}[cron[-1]] * 1_000_000
        return start // 1_000_000 * 1_000_000 if last is None else last // 1_000_000 * 1_000_000 + step
    return scan_next(cron, start - 1 if last is None else last, limit_days)


def next_fire(cron, start, stop, limit, completed, last, now):
    if limit and completed >= limit:
        return None
    base = planned(cron, start, last)
    if base is None:
        return None
    fire = max(base, now)
    return None if stop is not None and fire > stop else fire
