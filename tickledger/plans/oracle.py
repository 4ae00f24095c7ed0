"""DuckDB SQL with the expected result of each query, written independently of the Spark plans.

Schedules are checked against a minute-by-minute calendar instead of mask arithmetic, projections
against ordered window functions instead of aggregates.
"""

from __future__ import annotations

NOW = 1_706_659_200_000_000
START = 1_704_067_200_000_000
SPLIT = 1_705_363_200_000_000
DAY = 86_400_000_000

_LOG = """
ev AS (
  SELECT event_id AS off, epoch_us(ts) AS ts_us, ts, user_id, event_type, value, props,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events),
lg0 AS (
  SELECT *,
    CASE WHEN event_type IN ('signup','error','view') THEN 'create' ELSE 'execute' END AS topic,
    CASE WHEN event_type = 'view' THEN 'MARKER' WHEN event_type = 'error' THEN 'DELETE'
         WHEN event_type = 'purchase' AND k < 10 THEN 'DELETE' ELSE 'UPSERT' END AS kind,
    CASE WHEN event_type <> 'view' THEN 'u' || user_id END AS domain,
    CASE WHEN event_type <> 'view' THEN md5(user_id || '-' || (k % 10)) END AS h,
    ['*/15 * * * *','0 * * * *','30 6 * * 1-5','0 0 1,15 * 1','@every 90m','@daily'][k % 6 + 1] AS cron,
    ts_us // 1000000 * 1000000 AS start_us,
    CASE WHEN k % 3 = 0 THEN ts_us + k * 3600000000 END AS stop_us,
    k % 5 AS max_executions,
    k // 20 + 1 AS completed,
    CASE WHEN k <> 93 THEN ts_us END AS last_us
  FROM ev),
lg AS (
  SELECT *, substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12) AS timer_uuid
  FROM lg0)"""

_CRC = """
crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(i)))"""


def _crc(items: str) -> str:
    return (
        "xor(list_reduce(list_concat([4294967295::BIGINT], " + items + "), "
        "lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"
    )


_UUID_BYTES = "list_transform(range(16), lambda i: ('0x' || substr(h, 2*i+1, 2))::INTEGER::BIGINT)"
_NAME_BYTES = "list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT)"

_PARTS = (
    _CRC
    + f""",
parts AS (SELECT h, {_crc(_UUID_BYTES)} AS crc FROM (SELECT DISTINCT h FROM lg WHERE h IS NOT NULL) d, crc_table),
plog AS (
  SELECT lg.*, CAST(CASE WHEN kind = 'MARKER' THEN off % 8 ELSE crc % 8 END AS BIGINT) AS part
  FROM lg LEFT JOIN parts USING (h))"""
)

_FENCE = "fence AS (SELECT part, max(off) AS fence FROM plog WHERE kind = 'MARKER' AND k % 3 = 1 GROUP BY part)"

_LIVE = """
live AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY timer_uuid ORDER BY off DESC) AS rn
    FROM lg WHERE topic = 'create' AND kind <> 'MARKER') q
  WHERE rn = 1 AND kind = 'UPSERT')"""

_EXECS = "execs AS (SELECT * FROM lg WHERE topic = 'execute' AND kind = 'UPSERT')"

_PROG = _EXECS + """,
prog AS (
  SELECT domain, timer_uuid, off, completed, last_us FROM (
    SELECT *, row_number() OVER (PARTITION BY timer_uuid ORDER BY off DESC) AS rn FROM execs) q
  WHERE rn = 1)"""

_REST = f"""{_LIVE}, {_PROG},
rest AS (
  SELECT live.domain, live.timer_uuid, live.cron, live.start_us, live.stop_us, live.max_executions, live.ts_us AS created_us,
         coalesce(prog.completed, 0) AS completed, prog.last_us, prog.completed IS NOT NULL AS has_prog
  FROM live LEFT JOIN prog USING (timer_uuid))"""

_CAL = f"""
minutes AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2024-03-05 00:00:00', INTERVAL 1 MINUTE)) AS m),
cal AS (
  SELECT c.cron, epoch_us(m) AS m_us FROM minutes, (VALUES ('*/15 * * * *'),('0 * * * *'),('30 6 * * 1-5'),('0 0 1,15 * 1'),('@daily')) c(cron)
  WHERE CASE c.cron
    WHEN '*/15 * * * *' THEN minute(m) % 15 = 0
    WHEN '0 * * * *' THEN minute(m) = 0
    WHEN '30 6 * * 1-5' THEN minute(m) = 30 AND hour(m) = 6 AND dayofweek(m) BETWEEN 1 AND 5
    WHEN '0 0 1,15 * 1' THEN minute(m) = 0 AND hour(m) = 0 AND (day(m) IN (1, 15) OR dayofweek(m) = 1)
    ELSE minute(m) = 0 AND hour(m) = 0 END)"""

_PLANNED = f"""{_REST}, {_CAL},
asked AS (SELECT *, coalesce(last_us, start_us - 1) AS after_us FROM rest),
planned AS (
  SELECT asked.*, CASE WHEN asked.cron = '@every 90m'
      THEN coalesce(last_us // 1000000 * 1000000 + 5400000000, start_us) ELSE cal.m_us END AS planned_us
  FROM asked ASOF LEFT JOIN cal ON asked.cron = cal.cron AND asked.after_us < cal.m_us)"""

_FIRES = f"""{_PLANNED},
judged AS (
  SELECT *, CASE WHEN max_executions <> 0 AND completed >= max_executions THEN 'exhausted'
      WHEN planned_us IS NULL THEN 'no_match'
      WHEN coalesce(greatest(planned_us, {NOW}) > stop_us, false) THEN 'past_stop' ELSE 'active' END AS status
  FROM planned),
fires AS (
  SELECT *, status = 'active' AND planned_us < {NOW} AS missed,
         CASE WHEN status = 'active' THEN greatest(planned_us, {NOW}) END AS fire_us
  FROM judged)"""


def _calendar(source: str = "rest", high: str = f"{NOW} - 1", low: str = str(START)) -> str:
    """Numbered planned fires of the timers of ``source``; ends are inclusive."""
    return f"""
raw_fires AS (
  SELECT t.*, cal.m_us AS fire_us FROM {source} t JOIN cal ON t.cron = cal.cron AND cal.m_us >= t.start_us
   AND cal.m_us <= least({high}, coalesce(t.stop_us, {high}))
  UNION ALL
  SELECT t.*, t.start_us + i * 5400000000 AS fire_us FROM {source} t, range(1000) r(i)
  WHERE t.cron = '@every 90m' AND t.start_us + i * 5400000000 <= least({high}, coalesce(t.stop_us, {high}))),
ranked_fires AS (SELECT *, row_number() OVER (PARTITION BY timer_uuid, created_us ORDER BY fire_us) AS n FROM raw_fires),
calendar AS (SELECT * FROM ranked_fires WHERE (max_executions = 0 OR n <= max_executions) AND fire_us >= {low})"""


_CALENDAR = f"{_REST}, {_CAL}, {_calendar()}"

_RESULT_TEXT = (
    "CASE WHEN k = 99 THEN '{\"Error\":\"said \"no\"\"}' WHEN k = 98 THEN '{\"Error\":\"dial tcp: timeout\"}' "
    "ELSE '{\"StatusCode\":' || CASE WHEN value < 100 THEN '200' ELSE '500' END || ',\"Error\":\"' || "
    "CASE WHEN k = 97 THEN 'response body size exceeded limit' ELSE '' END || "
    "'\",\"Proto\":\"HTTP/1.1\",\"Body\":\"' || k || '\",\"Headers\":{\"Content-Type\":[\"text/plain\"],\"X-K\":[\"' || k || '\",\"b\"]}}' END"
)
_OUTCOME = "CASE WHEN k = 99 THEN 'malformed' WHEN k = 98 THEN 'error' WHEN k = 97 THEN 'too_large' ELSE 'ok' END"

_SESSIONS = """
marked AS (
  SELECT *, sum(CASE WHEN is_delete THEN 1 ELSE 0 END) OVER (PARTITION BY timer_uuid ORDER BY ts_us, topic, off) AS session,
         sum(CASE WHEN is_delete THEN 1 ELSE 0 END) OVER (PARTITION BY timer_uuid) AS sessions
  FROM (SELECT *, {deletes} AS is_delete, topic = 'create' AND kind = 'UPSERT' AS is_create FROM lg WHERE kind <> 'MARKER') q
  WHERE is_delete OR is_create),
sessions AS (
  SELECT domain, timer_uuid, max(sessions) > 0 AS has_delete,
         max(ts_us) FILTER (WHERE is_delete) AS deleted_at,
         min(off) FILTER (WHERE is_create AND session = sessions) AS created_offset
  FROM marked GROUP BY ALL)"""

_ANY = _SESSIONS.format(deletes="kind = 'DELETE'")
_ON_EXECUTE = _SESSIONS.format(deletes="kind = 'DELETE' AND topic = 'execute'")

RING = 256
_RING = (
    _CRC
    + f""",
members AS (SELECT s_name AS member, s_acctbal >= 0 AS stays FROM supplier),
nodes AS (
  SELECT member, stays, point, {_crc(_NAME_BYTES)} AS hash
  FROM (SELECT member, stays, point, member || point AS name FROM members, range(2) r(point)) q, crc_table),
ring AS (SELECT member, stays, point, hash, hash % {RING} AS idx FROM nodes),
slots AS (SELECT i AS partition FROM range({RING}) r(i)),
old_owner AS (
  SELECT partition, coalesce(arg_max(member, idx * 4294967296 + hash) FILTER (WHERE idx <= partition),
                             arg_max(member, idx * 4294967296 + hash)) AS member
  FROM slots, ring GROUP BY partition),
new_owner AS (
  SELECT partition, coalesce(arg_max(member, idx * 4294967296 + hash) FILTER (WHERE idx <= partition),
                             arg_max(member, idx * 4294967296 + hash)) AS member
  FROM slots, ring WHERE stays GROUP BY partition)"""
)
_KEYS = (
    _LOG
    + ","
    + _RING
    + f""",
key_ids AS (SELECT domain, timer_uuid, h, count(*) AS n_rows FROM lg WHERE h IS NOT NULL GROUP BY ALL),
keyed AS (SELECT domain, timer_uuid, n_rows, {_crc(_UUID_BYTES)} % {RING} AS partition FROM key_ids, crc_table)"""
)


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"


def _log(select: str) -> str:
    return _with(_LOG) + select


LOG_SQL = {
    "src_command_log": _with(_LOG, _PARTS)
    + """SELECT part AS partition, off AS "offset", ts_us, kind <> 'MARKER' AS has_key, kind = 'UPSERT' AS has_value,
         CASE WHEN kind = 'MARKER' THEN 1 ELSE 2 END::BIGINT AS n_headers FROM plog WHERE topic = 'create'""",
    "src_execution_log": _with(_LOG, _PARTS)
    + """SELECT part AS partition, off AS "offset", ts_us, kind <> 'MARKER' AS has_key, kind = 'UPSERT' AS has_value,
         2::BIGINT AS n_headers FROM plog WHERE topic = 'execute'""",
    "route_topics": _log(
        """SELECT topic, CASE topic WHEN 'create' THEN 'timers' ELSE 'executions' END AS handler, count(*) AS n,
           count(*) FILTER (WHERE kind <> 'MARKER') AS keyed, count(*) FILTER (WHERE kind = 'UPSERT') AS valued
           FROM lg GROUP BY topic"""
    ),
    "replay_bounded": _with(_LOG, _PARTS, _FENCE)
    + """SELECT part AS partition, off AS "offset", kind = 'MARKER' AS is_marker
         FROM plog JOIN fence USING (part) WHERE topic = 'create' AND off <= fence""",
    "generation_fence": _with(_LOG, _PARTS, _FENCE)
    + """SELECT part AS partition, off AS "offset", fence, CASE WHEN fence IS NULL THEN 'waiting' WHEN off <= fence THEN 'snapshot' ELSE 'live' END AS phase
         FROM plog LEFT JOIN fence USING (part) WHERE topic = 'create'""",
    "publish_commands": _with(_LOG, _PARTS)
    + """SELECT part AS partition, domain, timer_uuid, kind = 'DELETE' AS tombstone, CASE WHEN kind = 'UPSERT' THEN cron END AS cron,
         count(*) AS n, min(CASE WHEN kind = 'UPSERT' THEN start_us END) AS first_start_us
         FROM plog WHERE topic = 'create' AND kind <> 'MARKER' GROUP BY ALL""",
    "log_inspect": _with(_LOG, _PARTS)
    + """SELECT topic, part AS partition, off AS "offset", kind, domain, timer_uuid,
         CASE WHEN kind = 'UPSERT' AND topic = 'create' THEN cron END AS cron,
         CASE WHEN kind = 'UPSERT' AND topic = 'execute' THEN completed END AS completed FROM plog""",
    "log_counts": _with(_LOG, _PARTS) + "SELECT topic, part AS partition, kind, count(*) AS n FROM plog GROUP BY ALL",
    "union_logs": _with(_LOG, _PARTS) + 'SELECT topic, part AS partition, off AS "offset" FROM plog',
    "drop_markers": _log("""SELECT topic, off AS "offset" FROM lg WHERE kind <> 'MARKER'"""),
    "classify_markers": _log(
        """SELECT off AS "offset", CASE WHEN k % 3 = 1 THEN 'MY_MARKER' ELSE 'FOREIGN_MARKER' END AS marker FROM lg WHERE kind = 'MARKER'"""
    ),
    "classify_records": _log("""SELECT off AS "offset", kind FROM lg"""),
    "quarantine_malformed": _log(
        """SELECT topic, off AS "offset", CASE k WHEN 96 THEN 'undecodable key' ELSE 'undecodable value' END AS reason
           FROM lg WHERE (k = 96 AND kind <> 'MARKER') OR (k = 95 AND kind = 'UPSERT')"""
    ),
    "validate_create": """SELECT page_id, CASE
         WHEN page_id % 11 = 0 THEN 'invalid task: unknown task'
         WHEN page_id % 3 = 2 THEN 'invalid task: unknown method'
         WHEN page_id % 13 = 0 AND page_id % 5 <> 0 THEN 'invalid task: parsing url: bad host character'
         WHEN page_id % 17 = 0 AND page_id % 5 <> 0 THEN 'invalid task: parsing url: bad bracket host'
         WHEN page_id % 23 = 0 AND page_id % 5 <> 0 AND page_id % 19 <> 0 THEN 'invalid task: parsing url: bad host escape'
         WHEN page_id % 5 = 0 THEN 'invalid task: relative url not allowed'
         WHEN strlen(html) > 15000 THEN 'invalid task: request body too large'
         WHEN page_id % 10 = 6 THEN 'invalid schedule: invalid cron: bad minute field'
         WHEN page_id % 10 = 7 THEN 'invalid schedule: invalid cron: expected 5 fields'
         WHEN page_id % 10 = 8 THEN 'invalid schedule: invalid cron: unknown descriptor'
         WHEN page_id % 10 = 9 THEN 'invalid schedule: invalid cron: bad duration'
         WHEN page_id % 7 = 0 THEN 'invalid schedule: start time required' END AS error FROM pages""",
    "tenant_scope": _log(
        """SELECT event_id, domain, "index", CASE WHEN domain IS NULL THEN 'unauthenticated' WHEN k % 4 < 2 THEN 'ok' ELSE 'bad_index' END AS outcome,
           CASE WHEN domain IS NOT NULL AND k % 4 < 2 THEN "index" || '-' || domain END AS scoped_index
           FROM (SELECT off AS event_id, domain, k, ['timers','executions','progress','users'][k % 4 + 1] AS "index" FROM lg) q"""
    ),
    "valid_uuid": _log(
        """SELECT event_id, CASE k % 5 WHEN 0 THEN u WHEN 1 THEN h WHEN 2 THEN 'urn:uuid:' || upper(u) WHEN 3 THEN substr(u, 2) ELSE replace(u, '-', '_') END AS given,
           k % 5 < 3 AS valid
           FROM (SELECT *, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS u
                 FROM (SELECT off AS event_id, k, md5(user_id || '-' || (k % 10)) AS h FROM ev) a) b"""
    ),
    "decode_key": _log("""SELECT off AS "offset", domain, timer_uuid FROM lg WHERE kind <> 'MARKER'"""),
    "decode_create": _log(
        """SELECT off AS "offset", 'https://hook' || k || '.example.com/run' AS url, k % 2 AS method, 'text/html,text/plain' AS accept,
           k < 50 AS save_response_body, cron, start_us AS start_time, stop_us AS stop_time, max_executions, ts_us AS create_time
           FROM lg WHERE topic = 'create' AND kind = 'UPSERT'"""
    ),
    "decode_execute": _log(
        f"""SELECT off AS "offset", completed AS completed_executions, last_us AS last_execution, {_RESULT_TEXT} AS result
           FROM lg WHERE topic = 'execute' AND kind = 'UPSERT'"""
    ),
    "encode_records": _log(
        """SELECT off AS "offset", '{"task":{"http":{"url":"https://hook' || k || '.example.com/run","method":' || (k % 2)
           || ',"body":"","headers":{"Accept":"text/html,text/plain"},"save_response_body":' || CASE WHEN k < 50 THEN 'true' ELSE 'false' END
           || '}},"schedule":{"cron":"' || cron || '","start_time":"' || strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z","stop_time":'
           || coalesce('"' || strftime(make_timestamp(stop_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z"', 'null') || ',"max_executions":' || max_executions
           || '},"meta":{"create_time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}}' AS document
           FROM lg WHERE topic = 'create' AND kind = 'UPSERT'"""
    ),
    "default_start": _log(
        f"""SELECT off AS "offset", CASE WHEN k % 7 = 0 THEN {NOW} ELSE start_us END AS start_time FROM lg WHERE topic = 'create' AND kind = 'UPSERT'"""
    ),
    "stamp_meta": _log(
        f"""SELECT off AS "offset", {NOW}::BIGINT AS create_time, true AS id_ok FROM lg WHERE topic = 'create' AND kind = 'UPSERT'"""
    ),
    "accept_commands": _with(_LOG, _PARTS)
    + f"""SELECT off AS "offset", domain, kind = 'DELETE' AS is_delete, reason, kind = 'UPSERT' AND k % 5 = 2 AS id_drawn,
           CASE WHEN reason IS NULL AND NOT (kind = 'UPSERT' AND k % 5 = 2) THEN part END AS partition,
           CASE WHEN reason IS NULL AND kind = 'UPSERT' THEN CASE WHEN k % 7 = 0 THEN {NOW} ELSE start_us END END AS start_time
           FROM (SELECT *, CASE WHEN kind = 'DELETE' THEN CASE WHEN k % 13 = 0 THEN 'invalid timer id' END
                   WHEN k % 11 = 0 THEN 'invalid schedule: invalid cron: unknown descriptor' END AS reason
                 FROM plog WHERE topic = 'create' AND kind <> 'MARKER') q""",
    "headers_to_map": _log(
        """SELECT off AS "offset", CASE WHEN kind = 'MARKER' THEN (k % 3)::VARCHAR END AS generation,
           CASE WHEN kind <> 'MARKER' THEN k::VARCHAR END AS trace FROM lg"""
    ),
    "split_header_values": """SELECT page_id, 1 + length(regexp_replace(url, '[^./]', '', 'g')) AS parts,
         regexp_replace(url, '[./]', '|', 'g') AS joined FROM pages""",
    "partition_of": _with(_LOG, _PARTS)
    + "SELECT DISTINCT timer_uuid, crc % 1000 AS partition FROM lg JOIN parts USING (h)",
    "parse_result": _log(
        """SELECT off AS "offset", CASE WHEN k <> 98 THEN CASE WHEN value < 100 THEN 200 ELSE 500 END END::BIGINT AS status,
           CASE k WHEN 98 THEN 'dial tcp: timeout' WHEN 97 THEN 'response body size exceeded limit' ELSE '' END AS error,
           CASE WHEN k <> 98 THEN 'HTTP/1.1' END AS proto, CASE WHEN k <> 98 THEN k::VARCHAR END AS body,
           CASE WHEN k <> 98 THEN k || '|b' END AS x_k
           FROM lg WHERE topic = 'execute' AND kind = 'UPSERT' AND k <> 99"""
    ),
    "result_outcome": _log(
        f"""SELECT domain, {_OUTCOME} AS outcome, count(*) AS n FROM lg WHERE topic = 'execute' AND kind = 'UPSERT' GROUP BY ALL"""
    ),
    "cap_body": """SELECT page_id, CASE WHEN page_id % 3 <> 0 AND strlen(html) < 5000 THEN strlen(html) ELSE 0 END::BIGINT AS kept_bytes,
         CASE WHEN page_id % 3 <> 0 AND strlen(html) >= 5000 THEN 'response body size exceeded limit' ELSE '' END AS error FROM pages""",
    "error_json": """SELECT event_id, '{"Error":"dial \\"tcp\\"\\\\' || event_type || ': ' || replace(props, '"', '\\"') || '"}' AS document FROM events""",
    "shift_path": """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
SELECT page_id, coalesce(parts[1], '') AS head, '/' || array_to_string(parts[2:], '/') AS tail FROM s""",
    "attribute_requests": _log(
        """SELECT route, CASE WHEN starts_with(route, 'elastic') AND good THEN user_id::VARCHAR END AS tenant,
           CASE WHEN starts_with(route, 'elastic') AND NOT good THEN 'unauthorized' WHEN route = 'elastic/other' THEN 'bad_request'
                WHEN route = 'unknown' THEN 'not_found' ELSE 'ok' END AS outcome, count(*) AS n
           FROM (SELECT user_id, k % 10 <> 0 AS good, ['auth/apikey','auth/apikey/callback','elastic/timers','elastic/executions',
                 'elastic/other','unknown','auth/apikey','unknown'][k % 8 + 1] AS route FROM ev) q GROUP BY ALL"""
    ),
    "method_name": _log(
        "SELECT k % 4 AS method, CASE k % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS name, count(*) AS n FROM ev GROUP BY ALL"
    ),
}

STATE_SQL = {
    "live_creates": _with(_LOG, _LIVE)
    + 'SELECT domain, timer_uuid, off AS "offset", cron, start_us AS start_time FROM live',
    "compact_log": _log(
        """SELECT topic, domain, timer_uuid, max(off) AS "offset", arg_max(kind, off) AS kind FROM lg
           WHERE kind <> 'MARKER' GROUP BY ALL"""
    ),
    "create_sessions": _with(_LOG, _ANY) + "SELECT domain, timer_uuid, has_delete, deleted_at, created_offset FROM sessions",
    "timers_projection": _with(_LOG, _ON_EXECUTE)
    + """SELECT s.domain, s.timer_uuid, created_offset, lg.ts_us AS created_at, lg.cron, lg.max_executions
         FROM sessions s JOIN lg ON lg.off = s.created_offset""",
    "apply_tombstones": _log(
        """SELECT topic, off AS "offset", domain, timer_uuid FROM lg a WHERE kind = 'UPSERT' AND NOT EXISTS (
           SELECT 1 FROM lg b WHERE b.kind = 'DELETE' AND b.timer_uuid = a.timer_uuid AND b.off > a.off)"""
    ),
    "executions_append": _with(_LOG, _EXECS) + 'SELECT domain, timer_uuid, ts_us AS kafka_timestamp, off AS "offset" FROM execs',
    "doc_ids": _with(_LOG, _EXECS)
    + """SELECT off AS "offset", 'executions-' || domain AS "index", timer_uuid || '-' || ts_us AS doc_id FROM execs""",
    "upsert_latest": _with(_LOG, _PROG)
    + 'SELECT domain, timer_uuid, off AS "offset", completed AS completed_executions, last_us AS last_execution FROM prog',
    "domain_layout": _with(_LOG, _ON_EXECUTE)
    + """SELECT s.domain, count(*) AS timers, min(lg.ts_us) AS first_at FROM sessions s JOIN lg ON lg.off = s.created_offset GROUP BY ALL""",
    "progress_latest": _with(_LOG, _PROG)
    + 'SELECT domain, timer_uuid, off AS "offset", completed AS completed_executions, last_us AS last_execution FROM prog',
    "progress_by_partition": _with(_LOG, _PARTS, _FENCE, _PROG)
    + """SELECT p.crc % 8 AS partition, prog.domain, prog.timer_uuid, prog.completed AS completed_executions
         FROM prog JOIN parts p ON p.h = replace(prog.timer_uuid, '-', '') WHERE p.crc % 8 IN (SELECT part FROM fence)""",
    "progress_rebuild": _with(_LOG, _PROG)
    + """SELECT domain, timer_uuid, counted, latest, completed AS completed_executions, last_us AS last_execution,
         counted IS DISTINCT FROM completed OR latest IS DISTINCT FROM last_us AS mismatch
         FROM (SELECT domain, timer_uuid, count(*) AS counted, max(ts_us) AS latest FROM execs GROUP BY ALL) c JOIN prog USING (domain, timer_uuid)""",
    "running_progress": _with(_LOG, _EXECS)
    + """SELECT domain, timer_uuid, off AS "offset", row_number() OVER w AS completed, lag(ts_us) OVER w AS previous_execution
         FROM execs WINDOW w AS (PARTITION BY timer_uuid ORDER BY off)""",
    "advance_progress": _with(_LOG, _EXECS)
    + f"""SELECT domain, timer_uuid, completed_executions, CASE WHEN last_raw >= 0 THEN last_raw END AS last_execution FROM (
  SELECT domain, timer_uuid,
    (coalesce(arg_max(completed, off) FILTER (WHERE ts_us < {SPLIT}), 0) + count(*) FILTER (WHERE ts_us >= {SPLIT}))::BIGINT AS completed_executions,
    coalesce(max(ts_us) FILTER (WHERE ts_us >= {SPLIT}), arg_max(coalesce(last_us, -1), off) FILTER (WHERE ts_us < {SPLIT})) AS last_raw
  FROM execs GROUP BY ALL) q""",
    "timer_history": _with(_LOG, _EXECS)
    + f"""SELECT domain, timer_uuid, ts_us AS kafka_timestamp, off AS "offset", {_OUTCOME} AS outcome FROM execs WHERE domain = 'u7'""",
    "tenant_read": _with(_LOG, _EXECS)
    + """SELECT domain, timer_uuid, ts_us AS kafka_timestamp, off AS "offset" FROM execs WHERE domain = 'u7'""",
    "outcome_counts": _with(_LOG, _EXECS)
    + f"""SELECT domain, timer_uuid, {_OUTCOME} AS outcome, count(*) AS executions, min(ts_us) AS first_at, max(ts_us) AS last_at FROM execs GROUP BY ALL""",
    "restore_state": _with(_LOG, _REST)
    + """SELECT domain, timer_uuid, cron, start_us AS start_time, stop_us AS stop_time, max_executions, completed AS completed_executions,
         last_us AS last_execution, created_us AS created_at FROM rest""",
    "normalize_progress": _with(_LOG, _REST)
    + """SELECT domain, timer_uuid, completed AS completed_executions,
         coalesce(last_us, CASE WHEN has_prog THEN -62135596800000000 END) AS last_execution FROM rest""",
}
SCHEDULE_SQL = {
    "parse_schedules": _log(
        """, texts AS (
  SELECT DISTINCT event_type = 'click' AS is_every, event_type = 'view' AS is_bad,
    CASE WHEN event_type NOT IN ('click','view') THEN k % 9 END AS dow, CASE WHEN event_type NOT IN ('click','view') THEN user_id % 5 END AS step,
    CASE WHEN event_type NOT IN ('click','view') THEN user_id % 40 END AS dom, k FROM ev),
judged AS (
  SELECT *, CASE WHEN is_every AND k >= 90 THEN '@every 99999999' || k || 'h' WHEN is_every THEN '@every ' || k || 's' WHEN is_bad THEN '@each' || k
      ELSE k || ' */' || step || ' ' || dom || ' * ' || dow END AS cron,
    CASE WHEN is_every THEN CASE WHEN k >= 90 THEN 'bad duration' END WHEN is_bad THEN 'unknown descriptor' WHEN k > 59 THEN 'bad minute field'
      WHEN step = 0 THEN 'bad hour field' WHEN dom NOT BETWEEN 1 AND 31 THEN 'bad dom field' WHEN dow > 6 THEN 'bad dow field' END AS cron_error
  FROM texts)
SELECT cron, CASE WHEN cron_error IS NOT NULL THEN 'error' WHEN is_every THEN 'every' ELSE 'fields' END AS cron_kind,
  CASE WHEN is_every AND k < 90 THEN greatest(k, 1) END AS every_s,
  CASE WHEN cron_error IS NULL AND NOT is_every THEN k::VARCHAR END AS minutes,
  CASE WHEN cron_error IS NULL AND NOT is_every THEN array_to_string(list_filter(range(24), lambda x: x % step = 0), ',') END AS hours,
  CASE WHEN cron_error IS NULL AND NOT is_every THEN dom::VARCHAR END AS doms,
  CASE WHEN cron_error IS NULL AND NOT is_every THEN dow::VARCHAR END AS dows,
  false AS dom_star, cron_error FROM judged"""
    ),
    "next_fire": _with(_LOG, _FIRES) + "SELECT domain, timer_uuid, planned_us, status, missed, fire_us FROM fires",
    "due_timers": _with(_LOG, _FIRES)
    + f"SELECT domain, timer_uuid, fire_us, fire_us - {NOW} AS wait_us FROM fires WHERE fire_us <= {NOW} + 3600000000",
    "next_n_due": (_with(_LOG, _FIRES) + "SELECT domain, timer_uuid, fire_us FROM fires WHERE fire_us IS NOT NULL ORDER BY fire_us, domain, timer_uuid LIMIT 100").replace(
        str(NOW), str(START + 20 * DAY)
    ),
    "termination_status": _with(_LOG, _PARTS, _FIRES)
    + """SELECT topic, p.crc % 8 AS partition, domain, timer_uuid, true AS is_tombstone
         FROM fires JOIN parts p ON p.h = replace(timer_uuid, '-', ''), (VALUES ('create'), ('execute')) t(topic) WHERE fire_us IS NULL""",
    "fire_records": _with(_LOG, _PARTS, _FIRES, _calendar())
    + """SELECT topic, p.crc % 8 AS partition, domain, timer_uuid, kind, completed_executions, last_execution FROM (
  SELECT 'execute' AS topic, domain, timer_uuid, 'UPSERT' AS kind, n AS completed_executions, fire_us AS last_execution FROM calendar
  UNION ALL
  SELECT topic, domain, timer_uuid, 'DELETE', NULL, NULL FROM fires, (VALUES ('create'), ('execute')) t(topic) WHERE fire_us IS NULL) q
JOIN parts p ON p.h = replace(timer_uuid, '-', '')""",
    "exhausted": _with(_LOG, _REST)
    + "SELECT domain, timer_uuid, max_executions <> 0 AND completed >= max_executions AS exhausted FROM rest",
    "past_stop": _with(_LOG, _PLANNED)
    + "SELECT domain, timer_uuid, coalesce(planned_us > stop_us, false) AS past_stop FROM planned",
    "missed_fire": _with(_LOG, _PLANNED) + f"SELECT domain, timer_uuid, planned_us < {NOW} AS missed FROM planned",
    "fire_calendar": _with(_LOG, _CALENDAR) + "SELECT domain, timer_uuid, n, fire_us FROM calendar",
    "rank_fires": _with(_LOG, _CALENDAR) + "SELECT domain, timer_uuid, n, fire_us FROM calendar",
    "limit_per_key": _with(_LOG, _CALENDAR) + "SELECT domain, timer_uuid, n, fire_us FROM calendar",
    "planned_vs_actual": _with(_LOG, _CALENDAR)
    + f""", spans AS (SELECT domain, timer_uuid, n, fire_us, lead(fire_us, 1, 9000000000000000) OVER (PARTITION BY timer_uuid ORDER BY fire_us) AS upto FROM calendar)
SELECT s.domain, s.timer_uuid, s.n, s.fire_us AS planned_us, min(e.ts_us) AS actual_us, min(e.ts_us) - s.fire_us AS lateness_us, min(e.ts_us) IS NULL AS missed
FROM spans s LEFT JOIN execs e ON e.timer_uuid = s.timer_uuid AND e.ts_us >= s.fire_us AND e.ts_us < s.upto GROUP BY 1, 2, 3, 4""",
    "executions_in_interval": _with(_LOG, _CALENDAR)
    + f""", spans AS (SELECT domain, timer_uuid, n, fire_us, lead(fire_us, 1, 9000000000000000) OVER (PARTITION BY timer_uuid ORDER BY fire_us) AS upto FROM calendar)
SELECT s.domain, s.timer_uuid, s.fire_us AS planned_us, count(*) AS executions
FROM spans s JOIN execs e ON e.timer_uuid = s.timer_uuid AND e.ts_us >= s.fire_us AND e.ts_us < s.upto GROUP BY ALL""",
    "replay_fires": _with(_LOG, _REST, _CAL)
    + """, ticks AS (
  SELECT r.*, x.ts_us AS tick_us, row_number() OVER (PARTITION BY r.timer_uuid ORDER BY x.ts_us) AS i
  FROM rest r JOIN lg x ON x.timer_uuid = r.timer_uuid AND x.topic = 'execute'),
seen AS (SELECT t.*, cal.m_us AS match_us FROM ticks t ASOF LEFT JOIN cal ON t.cron = cal.cron AND t.tick_us >= cal.m_us),
walk AS (
  SELECT timer_uuid, 0::BIGINT AS i, NULL::BIGINT AS last_fire, 0::BIGINT AS n, false AS fired FROM (SELECT DISTINCT timer_uuid FROM seen) q
  UNION ALL
  SELECT timer_uuid, i, CASE WHEN fires THEN tick_us ELSE last_fire END, n + CASE WHEN fires THEN 1 ELSE 0 END, fires
  FROM (SELECT s.timer_uuid, s.i, s.tick_us, w.last_fire, w.n,
      (s.max_executions = 0 OR w.n < s.max_executions) AND coalesce(s.tick_us <= s.stop_us, true) AND
      CASE WHEN s.cron = '@every 90m' THEN coalesce(w.last_fire // 1000000 * 1000000 + 5400000000, s.start_us) <= s.tick_us
           ELSE coalesce(CASE WHEN w.last_fire IS NULL THEN s.match_us >= s.start_us ELSE s.match_us > w.last_fire END, false) END AS fires
    FROM walk w JOIN seen s ON s.timer_uuid = w.timer_uuid AND s.i = w.i + 1) q)
SELECT s.domain, s.timer_uuid, w.n, s.tick_us AS fire_us FROM walk w JOIN seen s ON s.timer_uuid = w.timer_uuid AND s.i = w.i WHERE w.fired""",
}

SHARD_SQL = {
    "sort_ring": _with(_RING) + "SELECT member, point, hash, idx FROM ring",
    "ring_ranges": _with(_RING)
    + f""", o AS (SELECT *, lead(idx) OVER w AS nxt, first(idx) OVER w AS first_idx FROM ring
      WINDOW w AS (ORDER BY idx, hash, member ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT member, point, hash, idx, coalesce(nxt, {RING}) AS range_end, CASE WHEN nxt IS NULL THEN first_idx ELSE 0 END AS wrap_end FROM o""",
    "ring_lookup": _with(_KEYS)
    + "SELECT partition, domain, timer_uuid, member FROM keyed JOIN old_owner USING (partition)",
    "assignment_lists": _with(_RING)
    + """SELECT m.member, count(o.partition) AS n, coalesce(string_agg(o.partition::VARCHAR, ',' ORDER BY o.partition), '') AS partitions
         FROM members m LEFT JOIN old_owner o USING (member) GROUP BY m.member""",
    "assignment_diff": _with(_KEYS)
    + """, c AS (SELECT partition, count(*) AS keys FROM keyed GROUP BY partition),
d AS (SELECT coalesce(o.member, n.member) AS member, coalesce(o.partition, n.partition) AS partition,
      CASE WHEN n.member IS NULL THEN 'lost' WHEN o.member IS NULL THEN 'gained' ELSE 'kept' END AS status
      FROM old_owner o FULL JOIN new_owner n ON o.member = n.member AND o.partition = n.partition)
SELECT d.*, coalesce(c.keys, 0) AS keys FROM d LEFT JOIN c USING (partition)""",
    "difference_assignments": _with(_KEYS)
    + """SELECT o.member, domain, timer_uuid FROM keyed JOIN old_owner o USING (partition) JOIN new_owner n USING (partition) WHERE o.member <> n.member""",
    "intersect_assignments": _with(_KEYS)
    + """SELECT o.member, domain, timer_uuid FROM keyed JOIN old_owner o USING (partition) JOIN new_owner n USING (partition) WHERE o.member = n.member""",
    "moved_keys": _with(_KEYS)
    + """SELECT partition, domain, timer_uuid, o.member AS old_member, n.member AS new_member
         FROM keyed JOIN old_owner o USING (partition) JOIN new_owner n USING (partition) WHERE o.member <> n.member""",
    "shard_load": _with(_KEYS)
    + """, l AS (SELECT member, count(*) AS keys, sum(n_rows)::BIGINT AS rows FROM keyed JOIN old_owner USING (partition) GROUP BY member), m AS (SELECT DISTINCT member FROM members),
f AS (SELECT member, coalesce(keys, 0) AS keys, coalesce(rows, 0) AS rows FROM m LEFT JOIN l USING (member))
SELECT member, keys, rows, rows / (SELECT avg(rows) FROM f) AS skew FROM f""",
}

_MARK = "mark AS (SELECT max(ts_us) // 1000 * 1000 AS w FROM lg WHERE topic = 'create' AND kind <> 'MARKER')"
_LIVES = f"""
{_MARK},
lives AS (
  SELECT q.*, ts_us AS created_us, coalesce(upto - 1, w) AS high_us FROM (
    SELECT *, lead(ts_us) OVER (PARTITION BY timer_uuid ORDER BY ts_us, off) AS upto
    FROM lg WHERE topic = 'create' AND kind <> 'MARKER') q, mark WHERE kind = 'UPSERT')"""
_PAST = f"""
{_MARK},
past AS (SELECT * FROM lg WHERE ts_us < {SPLIT}),
past_live AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timer_uuid ORDER BY off DESC) AS rn FROM past
    WHERE topic = 'create' AND kind <> 'MARKER') q WHERE rn = 1 AND kind = 'UPSERT'),
past_prog AS (
  SELECT timer_uuid, arg_max(completed, off) AS done, arg_max(coalesce(last_us, -1), off) AS last_run
  FROM past WHERE topic = 'execute' AND kind = 'UPSERT' GROUP BY timer_uuid),
next_command AS (SELECT timer_uuid, min(ts_us) AS upto FROM lg WHERE ts_us >= {SPLIT} AND topic = 'create' AND kind <> 'MARKER' GROUP BY timer_uuid),
old_lives AS (
  SELECT l.domain, l.timer_uuid, l.cron, l.start_us, l.stop_us, l.max_executions, coalesce(p.done, 0) AS done,
         CASE WHEN p.last_run >= 0 THEN p.last_run END AS run_us, coalesce(c.upto - 1, w) AS high_us
  FROM past_live l LEFT JOIN past_prog p USING (timer_uuid) LEFT JOIN next_command c USING (timer_uuid), mark)"""


def _events(lives: str, name: str) -> str:
    """Fires and ends of lives: (domain, timer_uuid, life, cron, start_us, stop_us, max_executions, done, run_us, high_us)."""
    base = "coalesce(run_us // 1000000 * 1000000 + 5400000000, start_us)"
    return f"""
{name}_inst AS (
  SELECT t.*, cal.m_us AS fire_us FROM {lives} t JOIN cal ON t.cron = cal.cron AND cal.m_us > coalesce(t.run_us, t.start_us - 1)
  UNION ALL
  SELECT t.*, {base} + i * 5400000000 AS fire_us FROM {lives} t, range(1000) r(i) WHERE t.cron = '@every 90m'),
{name}_placed AS (
  SELECT *, done + row_number() OVER (PARTITION BY timer_uuid, life ORDER BY fire_us) AS n, fire_us <= least(high_us, coalesce(stop_us, high_us)) AS in_time FROM {name}_inst),
{name}_ends AS (
  SELECT domain, timer_uuid, life, done, max_executions AS most, stop_us, done + count(*) FILTER (WHERE in_time) AS n, min(fire_us) FILTER (WHERE NOT in_time) AS later
  FROM {name}_placed GROUP BY domain, timer_uuid, life, done, max_executions, stop_us),
{name} AS (
  SELECT domain, timer_uuid, 'FIRE' AS event, n, fire_us FROM {name}_placed WHERE in_time AND (max_executions = 0 OR n <= max_executions)
  UNION ALL
  SELECT domain, timer_uuid, 'FINISH', CASE WHEN most = 0 THEN n ELSE least(n, greatest(most, done)) END, NULL
  FROM {name}_ends WHERE (most > 0 AND n >= most) OR coalesce(later > stop_us, false))"""


def _late(files: int) -> str:
    """Timers that fire once per watermark: commands of one file, then the watermark of the files before, file by file."""
    fields = "domain, timer_uuid, cron, start_us, stop_us, max_executions"
    over = "(max_executions > 0 AND done >= max_executions) OR due IS NULL OR coalesce(due > stop_us, false)"

    def due(table: str) -> str:
        return f"""SELECT a.*, CASE WHEN a.cron = '@every 90m' THEN coalesce(a.last_us // 1000000 * 1000000 + 5400000000, a.start_us) ELSE cal.m_us END AS due
  FROM {table} a ASOF LEFT JOIN cal ON a.cron = cal.cron AND coalesce(a.last_us, a.start_us - 1) < cal.m_us"""

    steps = [f"""
cmd AS (SELECT lg.*, (ts_us - low) * {files} // (high - low + 1) AS f FROM lg, (SELECT min(ts_us) AS low, max(ts_us) AS high FROM lg) q WHERE topic = 'create' AND kind <> 'MARKER'),
marks AS (SELECT f, max(max(ts_us)) OVER (ORDER BY f) // 1000 * 1000 AS w FROM cmd GROUP BY f),
kept0 AS (SELECT {fields}, 0::BIGINT AS done, NULL::BIGINT AS last_us FROM cmd WHERE false)"""]
    for i in range(1, files + 2):
        w = f"coalesce((SELECT w FROM marks WHERE f = {i - 2}), -1)"
        steps.append(f"""
in{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timer_uuid ORDER BY ts_us DESC, off DESC) AS rn FROM cmd WHERE f = {i - 1}) q WHERE rn = 1),
set{i} AS (
  SELECT * FROM kept{i - 1} WHERE timer_uuid NOT IN (SELECT timer_uuid FROM in{i})
  UNION ALL SELECT {fields}, 0, NULL FROM in{i} WHERE kind = 'UPSERT'),
due{i} AS ({due(f'set{i}')}),
held{i} AS (SELECT *, {over} AS over, {w} AS w, coalesce({w} > stop_us, false) AS stopped FROM due{i}),
next{i} AS (SELECT {fields}, done + 1 AS done, w AS last_us FROM held{i} WHERE NOT over AND due <= w AND NOT stopped),
again{i} AS (SELECT *, {over} AS over FROM ({due(f'next{i}')}) q),
said{i} AS (
  SELECT domain, timer_uuid, 'FINISH' AS event, done AS n, NULL::BIGINT AS fire_us FROM held{i} WHERE over OR (due <= w AND stopped)
  UNION ALL SELECT domain, timer_uuid, 'FIRE', done, last_us FROM next{i}
  UNION ALL SELECT domain, timer_uuid, 'FINISH', done, NULL FROM again{i} WHERE over),
kept{i} AS (
  SELECT {fields}, done, last_us FROM held{i} WHERE NOT over AND due > w
  UNION ALL SELECT {fields}, done, last_us FROM again{i} WHERE NOT over)""")
    return ",".join(steps)


_LATE_FILES = 4
_NEW = "SELECT domain, timer_uuid, off AS life, cron, start_us, stop_us, max_executions, 0::BIGINT AS done, NULL::BIGINT AS run_us, high_us FROM lives"

STREAM_SQL = {
    "stream_timers": STATE_SQL["timers_projection"],
    "stream_dedup_executions": STATE_SQL["executions_append"],
    "stream_progress": STATE_SQL["progress_latest"],
    "stream_quarantine": LOG_SQL["quarantine_malformed"],
    "stream_fires": _with(_LOG, _LIVES, _CAL, f"new AS ({_NEW})", _events("new", "said")) + "SELECT * FROM said",
    "late_fires": _with(_LOG, _CAL, _late(_LATE_FILES))
    + " UNION ALL ".join(f"SELECT domain, timer_uuid, event, n, fire_us FROM said{i}" for i in range(1, _LATE_FILES + 2)),
    "stream_restore": _with(_LOG, _CAL, _PAST)
    + f""", lives AS (
  SELECT q.*, ts_us AS created_us, coalesce(upto - 1, w) AS high_us FROM (
    SELECT *, lead(ts_us) OVER (PARTITION BY timer_uuid ORDER BY ts_us, off) AS upto
    FROM lg WHERE topic = 'create' AND kind <> 'MARKER' AND ts_us >= {SPLIT}) q, mark WHERE kind = 'UPSERT'),
new AS ({_NEW} UNION ALL SELECT domain, timer_uuid, -1, cron, start_us, stop_us, max_executions, done, run_us, high_us FROM old_lives),
{_events('new', 'said')}
SELECT * FROM said""",
    "stream_chain": _with(_LOG, _LIVES, _CAL, f"new AS ({_NEW})", _events("new", "said"))
    + """SELECT domain, timer_uuid, count(DISTINCT fire_us) AS executions, CAST(arg_max(n, fire_us * 1000 + n) AS BIGINT) AS completed_executions, max(fire_us) AS last_execution
         FROM said WHERE event = 'FIRE' GROUP BY domain, timer_uuid""",
    "stream_fence": _with(_LOG, _PARTS, _FENCE.replace("max(off)", "min(off)"))
    + """SELECT part AS partition, off AS "offset", fence, CASE WHEN off <= fence THEN 'snapshot' ELSE 'live' END AS phase, kind = 'MARKER' AS is_marker
         FROM plog JOIN fence USING (part) WHERE topic = 'create'""",
}

SQL = {**LOG_SQL, **STATE_SQL, **SCHEDULE_SQL, **SHARD_SQL, **STREAM_SQL}
