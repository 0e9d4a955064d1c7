"""The catalogue's queries as plain SQL over the same tables, written from the rules alone."""

from __future__ import annotations

RAW = """
parts AS (
  SELECT event_id AS n, ts, event_id % 17 AS v, event_id % 4 AS o,
    '"eventId":"evt-' || event_id || '"' AS e,
    '"msPlayed":' || CAST(floor(value * 1000) AS BIGINT) AS m,
    '"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"' AS t,
    '"trackId":"t' || (event_id % 97) || '"' AS k,
    '"userId":"u' || user_id || '"' AS u,
    ':"u' || user_id || '"' AS uv, ':"t' || (event_id % 97) || '"' AS kv
  FROM events),
raw AS (
  SELECT n, ts, v, 'events/input/' || n || '.json' AS source, 'evt-file-' || n AS fallback_id,
    CASE o WHEN 0 THEN 'partner-feed' WHEN 1 THEN 'internal-batch' WHEN 2 THEN 'untrusted-source'
      ELSE 'unknown-app' END AS origin,
    CASE v
      WHEN 3 THEN '{' || e || ',' || m || ',' || t || ',' || k || ',"userID"' || uv || '}'
      WHEN 4 THEN '{' || e || ',' || m || ',' || t || ',' || k || ',' ||
        CASE WHEN o >= 2 THEN '"UserId"' || uv ELSE u END || '}'
      WHEN 5 THEN '{' || e || ',' || m || ',' || t || ',' || k || ',"user_id"' || uv || '}'
      WHEN 6 THEN '{' || e || ',' || m || ',' || t || ',"track_id"' || kv || ',' || u || '}'
      WHEN 7 THEN '{"event_id":"evt-' || n || '",' || m || ',"time_stamp":"' ||
        strftime(ts, '%Y-%m-%dT%H:%M:%S') || '",' || k || ',' || u || '}'
      WHEN 8 THEN '{"User.Id"' || uv || ',' || e || ',' || m || ',' || t || ',' || k || '}'
      WHEN 9 THEN '{"USERID"' || uv || ',' || e || ',' || m || ',' || t || ',' || k || ',"user.id":"other"}'
      WHEN 10 THEN '{"TRACKID"' || kv || ',' || e || ',' || m || ',' || t || ',"track-id"' || kv || ',' || u || '}'
      WHEN 11 THEN '{' || e || ',' || m || ',' || t || ',' || u || '}'
      WHEN 12 THEN '{' || e || ',' || m || ',"timestamp":' || (1700000000 + n) || ',' || k || ',' || u || '}'
      WHEN 13 THEN '{' || e || ',"msPlayed":"three minutes",' || t || ',' || k || ',' || u || '}'
      WHEN 14 THEN '{"USER_ID"' || uv || ',' || e || ',' || m || ',' || t || ',' || k || ',"userId":null}'
      WHEN 15 THEN '{' || e || ',"msPlayed":-1,' || t || ',' || k || ',"userId":""}'
      WHEN 16 THEN '{' || e || ','
      ELSE '{' || e || ',' || m || ',' || t || ',' || k || ',' || u || '}' END AS payload
  FROM parts),
good AS (SELECT * FROM raw WHERE json_valid(payload))"""

# keys in byte order: only one of the payload forms is not written that way
CANONICAL = """CASE WHEN contains(payload, ',"UserId":')
  THEN '{' || regexp_extract(payload, ',("UserId":"[^"]*")', 1) || ',' || regexp_replace(substr(payload, 2), ',"UserId":"[^"]*"', '')
  ELSE payload END"""

KEYS = (
    RAW
    + """,
fields(field, norm, nr) AS (VALUES ('eventId', 'eventid', 1), ('userId', 'userid', 2),
  ('trackId', 'trackid', 3), ('timestamp', 'timestamp', 4), ('msPlayed', 'msplayed', 5)),
keys AS (SELECT n, ts, origin, payload, unnest(json_keys(payload)) AS k FROM good),
ks AS (
  SELECT n, ts, origin, field, nr, k,
    CASE WHEN json_type(payload, '$."' || k || '"') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN')
      THEN json_extract_string(payload, '$."' || k || '"') END AS txt
  FROM keys JOIN fields ON lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g')) = norm),
prop AS (
  SELECT n, field, nr, any_value(origin) AS origin, any_value(ts) AS ts, min(k) AS first_key,
    string_agg(k, ',' ORDER BY k) AS cands, bool_or(k = field AND txt IS NOT NULL) AS direct,
    CASE WHEN count(*) > 1 AND count(DISTINCT txt) + max(CASE WHEN txt IS NULL THEN 1 ELSE 0 END) > 1
      THEN 'ambiguous' ELSE 'unique' END AS outcome
  FROM ks GROUP BY n, field, nr)"""
)

TRUSTED = "(field <> 'userId' OR origin IN ('partner-feed', 'internal-batch'))"


def _learned(gate: str) -> str:
    return f""",
learned AS (
  SELECT field, first_key AS k, min(n) AS pos, arg_min(ts, n) AS learned_at
  FROM prop
  WHERE NOT direct AND outcome = 'unique' AND first_key <> field AND field <> 'msPlayed' AND {gate}
  GROUP BY field, first_key)"""


LEARNED = KEYS + _learned(TRUSTED)

HITS = (
    LEARNED
    + """,
aliases AS (SELECT field, field AS k, -1 AS pos FROM fields UNION ALL SELECT field, k, pos FROM learned),
after_hits AS (
  SELECT n, field, nr, arg_min(txt, pos) AS txt, arg_min(k, pos) AS k, any_value(ts) AS ts
  FROM ks JOIN aliases USING (field, k) WHERE txt IS NOT NULL AND pos <= n GROUP BY n, field, nr),
before_hits AS (
  SELECT DISTINCT n, field FROM ks JOIN aliases USING (field, k) WHERE txt IS NOT NULL AND pos < n),
wide AS (
  SELECT good.n, good.ts, source, origin, fallback_id, payload,
    max(txt) FILTER (WHERE field = 'eventId') AS event_id, max(txt) FILTER (WHERE field = 'userId') AS user_id,
    max(txt) FILTER (WHERE field = 'trackId') AS track_id, max(txt) FILTER (WHERE field = 'timestamp') AS stamp,
    max(txt) FILTER (WHERE field = 'msPlayed') AS ms
  FROM good LEFT JOIN after_hits USING (n) GROUP BY ALL),
need AS (SELECT n, ts, origin, field, nr FROM good, fields WHERE field <> 'msPlayed'),
gaps AS (
  SELECT need.*, coalesce(outcome, 'none') AS found, first_key, coalesce(cands, '') AS cands
  FROM need ANTI JOIN before_hits USING (n, field) LEFT JOIN (SELECT n, field, outcome, first_key, cands FROM prop) p USING (n, field)),
decided AS (
  SELECT *, CASE WHEN found <> 'unique' THEN found
    WHEN field <> 'userId' OR origin IN ('partner-feed', 'internal-batch') THEN 'healed' ELSE 'denied' END AS outcome
  FROM gaps)"""
)

DATETIME = (
    r"^-?([1-9][0-9]{3,}|0[0-9]{3})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
    r"T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)"
    r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?$"
)

FAULTS = (
    HITS
    + f""",
faults(n, shape, path, "constraint", value) AS (
  SELECT n, 'StreamingEventShape', 'eventId', 'minCount', NULL FROM wide WHERE event_id IS NULL
  UNION ALL SELECT n, 'StreamingEventShape', 'eventId', 'minLength', event_id FROM wide WHERE length(event_id) < 1
  UNION ALL SELECT n, 'StreamingEventShape', 'eventTimestamp', 'minCount', NULL FROM wide WHERE stamp IS NULL
  UNION ALL SELECT n, 'StreamingEventShape', 'eventTimestamp', 'datatype', stamp FROM wide
    WHERE NOT regexp_matches(stamp, '{DATETIME}') OR (regexp_matches(stamp, '{DATETIME}') AND try_cast(left(stamp, 10) AS DATE) IS NULL)
  UNION ALL SELECT n, 'StreamingEventShape', 'msPlayed', 'datatype', ms FROM wide
    WHERE NOT regexp_matches(ms, '^([+]?[0-9]+|-0+)$')
  UNION ALL SELECT n, 'StreamingEventShape', 'performedBy', 'minCount', NULL FROM wide WHERE user_id IS NULL
  UNION ALL SELECT n, 'StreamingEventShape', 'performedBy', 'node', user_id FROM wide WHERE user_id = ''
  UNION ALL SELECT n, 'StreamingEventShape', 'involvesTrack', 'minCount', NULL FROM wide WHERE track_id IS NULL
  UNION ALL SELECT n, 'StreamingEventShape', 'involvesTrack', 'node', track_id FROM wide WHERE track_id = ''
  UNION ALL SELECT n, 'UserShape', 'userId', 'minLength', user_id FROM wide WHERE user_id = ''
  UNION ALL SELECT n, 'TrackShape', 'trackId', 'minLength', track_id FROM wide WHERE track_id = '')"""
)

NS = "http://example.org/ontology#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


def _iri(kind: str, text: str) -> str:
    kept = f"regexp_replace({text}, '[^A-Za-z0-9._-]', '', 'g')"
    return f"('http://example.org/{kind}/' || CASE WHEN {kept} = '' THEN 'unknown' ELSE {kept} END)"


_EVENT = _iri("event", "coalesce(event_id, fallback_id)")
_USER, _TRACK = _iri("user", "user_id"), _iri("track", "track_id")

TRIPLES = (
    HITS
    + f""",
triples(n, s, p, o, o_kind, datatype) AS (
  SELECT n, {_EVENT}, '{TYPE}', '{NS}StreamingEvent', 'iri', NULL FROM wide
  UNION ALL SELECT n, {_EVENT}, '{NS}eventId', event_id, 'literal', '{XSD}string' FROM wide WHERE event_id IS NOT NULL
  UNION ALL SELECT n, {_EVENT}, '{NS}eventTimestamp', stamp, 'literal', '{XSD}dateTime' FROM wide WHERE stamp IS NOT NULL
  UNION ALL SELECT n, {_EVENT}, '{NS}msPlayed', ms, 'literal', '{XSD}nonNegativeInteger' FROM wide WHERE ms IS NOT NULL
  UNION ALL SELECT n, {_EVENT}, '{NS}performedBy', {_USER}, 'iri', NULL FROM wide WHERE user_id IS NOT NULL
  UNION ALL SELECT n, {_EVENT}, '{NS}involvesTrack', {_TRACK}, 'iri', NULL FROM wide WHERE track_id IS NOT NULL
  UNION ALL SELECT n, {_USER}, '{TYPE}', '{NS}User', 'iri', NULL FROM wide WHERE user_id IS NOT NULL
  UNION ALL SELECT n, {_USER}, '{NS}userId', user_id, 'literal', '{XSD}string' FROM wide WHERE user_id IS NOT NULL
  UNION ALL SELECT n, {_TRACK}, '{TYPE}', '{NS}Track', 'iri', NULL FROM wide WHERE track_id IS NOT NULL
  UNION ALL SELECT n, {_TRACK}, '{NS}trackId', track_id, 'literal', '{XSD}string' FROM wide WHERE track_id IS NOT NULL)"""
)

METRICS = (
    HITS
    + """,
metrics AS (
  SELECT n, coalesce(event_id, fallback_id) AS event_id, user_id, track_id, fallback_id, try_cast(ms AS BIGINT) AS ms_played
  FROM wide
  WHERE user_id IS NOT NULL AND regexp_matches(ms, '^[+-]?[0-9]+$') AND try_cast(ms AS BIGINT) >= 0)"""
)

KEPT = (
    METRICS
    + """,
kept AS (
  SELECT user_id, ms_played FROM metrics
  QUALIFY row_number() OVER (PARTITION BY coalesce(track_id, fallback_id) ORDER BY n DESC) = 1)"""
)

# the first events that may teach each of the five spellings, in the forms that hold them
TWINS = """
f AS (SELECT o_orderkey AS n, o_orderkey % 7 AS form, o_orderkey // 7 % 3 <> 0 AS trusted FROM orders),
firsts AS (
  SELECT *, min(n) FILTER (WHERE form IN (1, 2) AND trusted) OVER () AS at_a, min(n) FILTER (WHERE form = 2) OVER () AS at_b,
    min(n) FILTER (WHERE form = 4) OVER () AS at_c, min(n) FILTER (WHERE form = 6 AND trusted) OVER () AS at_d FROM f),
o AS (SELECT *, min(n) FILTER (WHERE form = 3 AND n > at_d) OVER () AS at_e FROM firsts)"""

LOG = (
    METRICS
    + FAULTS.removeprefix(HITS)
    + """,
lines AS (
  SELECT n, 0 AS rk, 'WARN' AS level, 'breach' AS stage, string_agg(field, ',' ORDER BY nr) AS missing FROM gaps GROUP BY n
  UNION ALL SELECT n, nr, CASE outcome WHEN 'healed' THEN 'INFO' ELSE 'WARN' END, outcome, NULL FROM decided WHERE outcome <> 'none'
  UNION ALL SELECT n, 8, 'WARN', 'metric_failed', NULL FROM metrics WHERE ms_played >= 100000000
  UNION ALL SELECT n, 9, 'INFO', 'conforms', NULL FROM good ANTI JOIN faults USING (n)
  UNION ALL SELECT n, 9, 'WARN', 'not_conforming', coalesce(missing, '') FROM (SELECT DISTINCT n FROM faults)
    LEFT JOIN (SELECT n, string_agg(field, ',' ORDER BY nr) AS missing FROM need ANTI JOIN after_hits USING (n, field) GROUP BY n) g USING (n)),
log AS (SELECT n, row_number() OVER (PARTITION BY n ORDER BY rk) - 1 AS seq, level, stage, missing, ts FROM lines JOIN good USING (n))"""
)

AUDIT = (
    HITS
    + """,
audit AS (
  SELECT l.field AS canonical, l.k AS raw_key, l.learned_at, greatest(l.learned_at, max(a.ts)) AS last_used_at
  FROM learned l LEFT JOIN after_hits a ON a.field = l.field AND a.k = l.k GROUP BY l.field, l.k, l.learned_at)"""
)


def _view(keys: str) -> str:
    """The healed view: every learned key counts for every row."""
    picks = []
    for field, column, cast in (
        ("eventId", "event_id", False),
        ("timestamp", "event_timestamp", False),
        ("msPlayed", "ms_played", True),
        ("userId", "user_id", False),
        ("trackId", "track_id", False),
    ):
        text = "try_cast(txt AS BIGINT)" if cast else "txt"
        picks.append(f"arg_min({text}, pos) FILTER (WHERE field = '{field}' AND {text} IS NOT NULL) AS {column}")
    return (
        HITS
        + f""",
view_rows AS (
  SELECT good.n AS id, good.source, good.ts AS received_at, {', '.join(picks)}
  FROM good LEFT JOIN (SELECT ks.n, field, k, pos, json_extract_string(payload, '$."' || k || '"') AS txt
    FROM ks JOIN aliases USING (field, k) JOIN good USING (n) WHERE {keys}) c USING (n)
  GROUP BY good.n, good.source, good.ts)"""
    )


SAFE_VIEW = _view("regexp_matches(k, '^[A-Za-z_][A-Za-z0-9_]*$')")
FULL_VIEW = _view("true")
VIEW_SELECT = " SELECT * FROM view_rows"


def _sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


_VIA = ", ".join(
    f"max(k) FILTER (WHERE field = '{f}') AS {c}_via"
    for f, c in (
        ("eventId", "event_id"), ("userId", "user_id"), ("trackId", "track_id"),
        ("timestamp", "event_timestamp"), ("msPlayed", "ms_played"),
    )
)
_DIRECT = ", ".join(
    f"max(txt) FILTER (WHERE field = '{f}' AND k = '{f}') AS {c}"
    for f, c in (
        ("eventId", "event_id"), ("userId", "user_id"), ("trackId", "track_id"),
        ("timestamp", "event_timestamp"), ("msPlayed", "ms_played"),
    )
)
_LIST = "coalesce((SELECT string_agg(field, ',' ORDER BY nr) FROM {0} x WHERE x.n = good.n), '')"


def oracles() -> dict[str, str]:
    found = {
        "canonical_extract": _sql(KEYS, f"SELECT good.n, {_DIRECT} FROM good LEFT JOIN ks USING (n) GROUP BY good.n"),
        "resolved_via": _sql(HITS, f"SELECT good.n, {_VIA} FROM good LEFT JOIN after_hits USING (n) GROUP BY good.n"),
        "missing_required": _sql(
            HITS,
            "SELECT good.n, coalesce(b.m, '') AS missing_before, coalesce(a.m, '') AS missing_after FROM good "
            "LEFT JOIN (SELECT n, string_agg(field, ',' ORDER BY nr) AS m FROM gaps GROUP BY n) b USING (n) "
            "LEFT JOIN (SELECT n, string_agg(field, ',' ORDER BY nr) AS m FROM need ANTI JOIN after_hits USING (n, field) GROUP BY n) a USING (n)",
        ),
        "used_keys": _sql(
            HITS,
            "SELECT good.n, coalesce(u.m, '') AS used, coalesce(f.m, '') AS unused FROM good "
            "LEFT JOIN (SELECT n, string_agg(k, ',' ORDER BY k) AS m FROM after_hits GROUP BY n) u USING (n) "
            "LEFT JOIN (SELECT n, string_agg(k, ',' ORDER BY k) AS m FROM keys ANTI JOIN after_hits USING (n, k) GROUP BY n) f USING (n)",
        ),
        "normalized_keys": _sql(
            KEYS,
            "SELECT k AS raw_key, lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g')) AS norm, any_value(field) AS canonical, count(*) AS n "
            "FROM keys LEFT JOIN fields ON lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g')) = norm GROUP BY k",
        ),
        "matching_keys": _sql(
            KEYS,
            "SELECT ks.n, field AS canonical, k AS raw_key, txt AS text, txt IS NOT NULL AS scalar "
            "FROM ks JOIN (SELECT n, field, direct FROM prop) d USING (n, field) WHERE k = field OR NOT direct",
        ),
        "rename_candidates": _sql(
            KEYS,
            "SELECT g.n, f.field AS canonical, coalesce(outcome, 'none') AS outcome, "
            "CASE WHEN outcome = 'unique' THEN first_key END AS raw_key, coalesce(cands, '') AS candidates "
            "FROM good g CROSS JOIN fields f LEFT JOIN prop p ON p.n = g.n AND p.field = f.field "
            "WHERE f.field <> 'msPlayed' AND NOT coalesce(direct, false)",
        ),
        "ambiguous_breaches": _sql(HITS, "SELECT n, field AS canonical, cands AS candidates FROM gaps WHERE found = 'ambiguous'"),
        "policy_decisions": _sql(
            HITS,
            "SELECT n, origin, field AS canonical, first_key AS raw_key, outcome = 'healed' AS allow FROM decided WHERE found = 'unique'",
        ),
        "policy_disabled_decisions": _sql(
            KEYS,
            "SELECT origin, field AS canonical, first_key AS raw_key, true AS allow, count(*) AS n FROM prop "
            "WHERE NOT direct AND outcome = 'unique' AND field <> 'msPlayed' GROUP BY ALL",
        ),
        "learned_aliases": _sql(
            LEARNED, "SELECT field AS canonical, k AS raw_key, pos AS learned_from, learned_at FROM learned"
        ),
        "learned_aliases_without_policy": _sql(
            KEYS + _learned("true"), "SELECT field AS canonical, k AS raw_key, pos AS learned_from FROM learned"
        ),
        "learned_aliases_by_joins": _sql(
            LEARNED, "SELECT field AS canonical, k AS raw_key, pos AS learned_from, learned_at FROM learned"
        ),
        "registry_union": _sql(
            LEARNED,
            "SELECT field AS canonical, field AS raw_key, true AS is_default FROM fields UNION SELECT field, k, false FROM learned",
        ),
        "alias_audit": _sql(
            AUDIT,
            "SELECT canonical, raw_key, CAST(learned_at AS VARCHAR) AS learned_at, CAST(last_used_at AS VARCHAR) AS last_used_at "
            "FROM audit ORDER BY canonical, raw_key",
        ),
        "stale_aliases": _sql(
            AUDIT,
            "SELECT * FROM audit WHERE last_used_at < (SELECT max(last_used_at) FROM audit) - INTERVAL 1 SECOND ORDER BY last_used_at",
        ),
        "orders_loop_view": "SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderstatus AS status, o_orderpriority AS priority, "
        "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS placed FROM orders",
        "orders_loop_log": "WITH o AS (SELECT o_orderkey % 2 AS batch_id, length(o_orderpriority) >= 6 AS good FROM orders) "
        "SELECT batch_id, CASE WHEN good THEN 'INFO' ELSE 'WARN' END AS level, CASE WHEN good THEN 'conforms' ELSE 'not_conforming' END AS stage, "
        "count(*) AS n FROM o GROUP BY ALL "
        "UNION ALL SELECT 0, 'WARN', 'breach', 1 FROM orders HAVING count(*) FILTER (WHERE o_orderkey % 6 = 0) > 0 "
        "UNION ALL SELECT 0, 'INFO', 'healed', 1 FROM orders HAVING count(*) FILTER (WHERE o_orderkey % 6 = 0) > 0",
        "orders_loop_registry": "SELECT 'orderKey' AS canonical, 'order_key' AS raw_key, min(o_orderkey) AS learned_from FROM orders "
        "WHERE o_orderkey % 6 = 0",
        "orders_loop_reports": "WITH o AS (SELECT o_orderkey % 2 AS batch_id, count(*) AS rows_in, "
        "count(*) FILTER (WHERE length(o_orderpriority) >= 6) AS conforming, "
        "CASE WHEN count(*) FILTER (WHERE o_orderkey % 6 = 0) > 0 THEN 1 ELSE 0 END AS healed FROM orders GROUP BY 1) "
        "SELECT batch_id, rows_in, 0 AS malformed, conforming, rows_in - conforming AS not_conforming, healed, "
        "rows_in + 2 * healed AS decisions, rows_in + 2 * healed AS timed FROM o",
        "orders_loop_tail": "WITH o AS (SELECT o_orderkey AS n, o_orderdate AS ts, length(o_orderpriority) >= 6 AS good, "
        "o_orderkey = min(o_orderkey) FILTER (WHERE o_orderkey % 6 = 0) OVER () AS first FROM orders), "
        "log AS (SELECT n, ts, CASE WHEN first THEN 2 ELSE 0 END AS seq, CASE WHEN good THEN 'conforms' ELSE 'not_conforming' END AS stage FROM o "
        "UNION ALL SELECT n, ts, 0, 'breach' FROM o WHERE first UNION ALL SELECT n, ts, 1, 'healed' FROM o WHERE first) "
        "SELECT n, seq, stage FROM log ORDER BY ts DESC, n % 2 DESC, n DESC, seq DESC LIMIT 300",
        "claimed_keys": _sql(
            TWINS,
            "SELECT n, 'order_key' AS canonical, CASE WHEN n = at_a THEN 'healed' ELSE 'denied' END AS outcome, 'ORDERKEY' AS raw_key "
            "FROM o WHERE form IN (1, 2) AND n <= coalesce(at_a, n) "
            "UNION ALL SELECT n, 'orderKey', 'none', NULL FROM o WHERE form = 1 "
            "UNION ALL SELECT n, 'orderKey', 'healed', 'Order-Key' FROM o WHERE n = at_b "
            "UNION ALL SELECT n, field, 'ambiguous', NULL FROM o, (VALUES ('order_key'), ('orderKey')) f(field) WHERE form = 3 AND n < coalesce(at_d, n + 1) "
            "UNION ALL SELECT n, 'orderKey', 'healed', 'orderkey' FROM o WHERE n = at_e "
            "UNION ALL SELECT n, 'orderKey', 'healed', 'ORDER_KEY' FROM o WHERE n = at_c "
            "UNION ALL SELECT n, 'order_key', 'none', NULL FROM o WHERE form = 5 "
            "UNION ALL SELECT n, 'order_key', CASE WHEN n = at_d THEN 'healed' ELSE 'denied' END, 'OrderKEY' FROM o WHERE form = 6 AND n <= coalesce(at_d, n)",
        ),
        "claimed_key_aliases": _sql(
            TWINS,
            "SELECT canonical, raw_key, learned_from FROM (SELECT 'order_key' AS canonical, 'ORDERKEY' AS raw_key, max(at_a) AS learned_from FROM o "
            "UNION ALL SELECT 'orderKey', 'Order-Key', max(at_b) FROM o UNION ALL SELECT 'orderKey', 'ORDER_KEY', max(at_c) FROM o "
            "UNION ALL SELECT 'order_key', 'OrderKEY', max(at_d) FROM o UNION ALL SELECT 'orderKey', 'orderkey', max(at_e) FROM o) WHERE learned_from IS NOT NULL",
        ),
        "reconnected_registry": _sql(
            LEARNED,
            "SELECT field AS canonical, k AS raw_key, pos // 1000 - (SELECT min(n) // 1000 FROM raw) AS session, pos % 1000 + 1 AS tag FROM learned",
        ),
        "reconnected_latest": _sql(
            METRICS,
            "SELECT track_id AS event_id, user_id, ms_played, n // 1000 - (SELECT min(n) // 1000 FROM raw) AS session, n % 1000 + 1 AS tag "
            "FROM metrics WHERE track_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC) = 1",
        ),
        "streamed_view": "SELECT CAST(s_suppkey AS VARCHAR) AS event_id, CASE WHEN s_suppkey % 3 <> 0 THEN 'n' || s_nationkey END AS user_id, "
        "s_name AS track_id, CAST(s_suppkey * 10 AS BIGINT) AS ms_played, true AS numbered, true AS just_now FROM supplier",
        "streamed_log": "SELECT 'denied' AS stage, count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0 HAVING count(*) > 0 "
        "UNION ALL SELECT 'not_conforming', count(*) FROM supplier WHERE s_suppkey % 3 = 0 HAVING count(*) > 0 "
        "UNION ALL SELECT 'conforms', count(*) FROM supplier WHERE s_suppkey % 3 <> 0 HAVING count(*) > 0 "
        "UNION ALL SELECT 'healed', 1 FROM supplier HAVING count(*) FILTER (WHERE s_suppkey % 2 = 0) > 0",
        "healed_view": _sql(SAFE_VIEW, VIEW_SELECT),
        "healed_view_all_keys": _sql(FULL_VIEW, VIEW_SELECT),
        "healed_view_from_text": _sql(SAFE_VIEW, VIEW_SELECT),
        "healed_lookup": _sql(
            SAFE_VIEW,
            "SELECT user_id, track_id, event_timestamp, ms_played FROM view_rows WHERE event_id = 'evt-24'",
        ),
        "indexed_lookup": _sql(
            SAFE_VIEW,
            "SELECT event_id, user_id, track_id, event_timestamp, ms_played FROM view_rows WHERE event_id IN ('evt-24', 'evt-7', 'evt-21', 'evt-16', 'nobody')",
        ),
        "played_per_user": _sql(
            SAFE_VIEW,
            "SELECT user_id, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM view_rows GROUP BY user_id",
        ),
        "verdicts": _sql(FAULTS, "SELECT n, n NOT IN (SELECT n FROM faults) AS conforms FROM good"),
        "violation_report": _sql(FAULTS, "SELECT * FROM faults"),
        "graph_verdicts": _sql(FAULTS, "SELECT n, n NOT IN (SELECT n FROM faults) AS conforms FROM good"),
        "graph_violation_counts": _sql(
            FAULTS, 'SELECT shape, path, "constraint", count(*) AS n FROM faults GROUP BY ALL'
        ),
        "shape_counts_graph": _sql(
            TRIPLES,
            f"SELECT p, count(*) AS nodes, max(c) AS most_values FROM (SELECT n, s, p, count(*) AS c FROM triples WHERE p <> '{TYPE}' GROUP BY ALL) GROUP BY p",
        ),
        "event_triples": _sql(TRIPLES, "SELECT * FROM triples"),
        "ntriples_lines": _sql(
            TRIPLES,
            "SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE "
            "'\"' || replace(replace(replace(replace(o, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r') || '\"' || "
            f"CASE WHEN datatype = '{XSD}string' THEN '' ELSE '^^<' || datatype || '>' END END || ' .' AS line FROM triples",
        ),
        "orders_reference_check": "WITH o AS (SELECT o_orderkey, o_custkey + o_orderkey % 3 * 50 AS o_custkey FROM orders) "
        "SELECT o_orderkey, o_custkey FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
        "nested_reference_check": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN "
        "(SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA')",
        "contract_on_orders": "WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority, "
        "CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS placed FROM orders) "
        "SELECT o_orderkey, 'OrderShape' AS shape, 'status' AS path, 'minCount' AS \"constraint\", NULL AS value FROM o WHERE status IS NULL "
        "UNION ALL SELECT o_orderkey, 'OrderShape', 'priority', 'minLength', o_orderpriority FROM o WHERE length(o_orderpriority) < 6 "
        "UNION ALL SELECT o_orderkey, 'OrderShape', 'placed', 'datatype', placed FROM o WHERE length(placed) = 10",
        "metric_latest": _sql(METRICS, "SELECT event_id, user_id, ms_played, n FROM metrics QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC) = 1"),
        "metric_latest_per_track": _sql(
            METRICS,
            "SELECT coalesce(track_id, fallback_id) AS event_id, user_id, ms_played, n FROM metrics "
            "QUALIFY row_number() OVER (PARTITION BY coalesce(track_id, fallback_id) ORDER BY n DESC) = 1",
        ),
        "encrypted_user_totals": _sql(
            METRICS,
            "SELECT user_id, count(*) AS n, CAST(sum(ms_played) % 100000000 AS BIGINT) AS total FROM metrics WHERE ms_played < 100000000 GROUP BY user_id",
        ),
        "kept_user_totals": _sql(KEPT, "SELECT user_id, count(*) AS n, CAST(sum(ms_played) % 100000000 AS BIGINT) AS total FROM kept GROUP BY user_id"),
        "kept_one_user": _sql(
            KEPT, "SELECT user_id, count(*) AS n, CAST(sum(ms_played) % 100000000 AS BIGINT) AS total FROM kept WHERE user_id = 'u7' GROUP BY user_id"
        ),
        "encrypted_one_user": _sql(
            METRICS,
            "SELECT user_id, count(*) AS n, CAST(sum(ms_played) % 100000000 AS BIGINT) AS total FROM metrics WHERE ms_played < 100000000 AND user_id = 'u7' GROUP BY user_id",
        ),
        "user_ciphertexts": _sql(
            METRICS, "SELECT event_id, ms_played AS revealed FROM metrics WHERE user_id = 'u7' AND ms_played < 100000000 ORDER BY event_id"
        ),
        "raw_audit_count": _sql(RAW, "SELECT count(*) AS n, count(*) AS last_id FROM good"),
        "raw_log_ids": _sql(RAW, f"SELECT row_number() OVER (ORDER BY n) AS id, source, {CANONICAL} AS payload, ts AS received_at FROM good"),
        "quarantine": _sql(RAW, "SELECT n, source, payload FROM raw WHERE NOT json_valid(payload)"),
        "canonical_payload": _sql(RAW, f"SELECT n, {CANONICAL} AS payload FROM good"),
        "canonical_properties": "SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events",
        "envelope_identity": "SELECT 'amqp:q' || (user_id % 3) || ':' || event_id AS source, "
        "CASE WHEN event_type = 'error' THEN 'unknown-app' ELSE event_type END AS origin, 'amqp-' || event_id AS fallback_id, "
        "props AS payload, ts AS received_at FROM events",
        "file_identity": "WITH f AS (SELECT page_id, list_last(string_split(url, '/')) AS f FROM pages) "
        "SELECT page_id, coalesce(nullif(regexp_extract(f, '^(.+?)([.][^.]*)?$', 1), ''), 'unknown') AS stem FROM f",
        "text_functions": "SELECT doc_id, md5(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) AS normal_form, "
        "md5(coalesce(nullif(regexp_replace(text, '[^A-Za-z0-9._-]', '', 'g'), ''), 'unknown')) AS iri_part, "
        "md5(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r')) AS escaped FROM documents",
        "wrapped_totals": "SELECT o_custkey, CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) % 100000000 AS BIGINT) AS total "
        "FROM orders GROUP BY o_custkey",
        "number_texts": "SELECT o_orderkey, try_cast(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS BIGINT) AS rounded, "
        "try_cast(o_orderkey || 'e2' AS BIGINT) AS hundreds, try_cast(o_orderkey || '.49999999999999' AS BIGINT) AS below_half, "
        "try_cast('-' || o_orderkey || '.5000000000000001' AS BIGINT) AS negative_half, "
        "try_cast(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderkey || '.9' END AS BIGINT) AS not_always_a_number FROM orders",
        "decision_log_counts": _sql(LOG, "SELECT level, stage, count(*) AS n FROM log GROUP BY ALL"),
        "decision_tail": _sql(LOG, "SELECT n, seq, level, stage FROM log ORDER BY ts DESC, n DESC, seq DESC LIMIT 500"),
        "decision_level_filter": _sql(LOG, "SELECT n, stage, missing FROM log WHERE level IN ('ERROR', 'WARN')"),
        "parsed_decision_lines": _sql(
            RAW,
            "SELECT n, CASE WHEN n % 17 = 16 THEN 1704067200000 ELSE n END AS ts_ms, CASE WHEN n % 17 = 16 THEN 'ERROR' ELSE 'WARN' END AS level, "
            "CASE WHEN n % 17 = 16 THEN 'console' ELSE 'ingest' END AS target, CASE WHEN n % 17 = 16 THEN "
            "'unreadable decision line: {\"ts_ms\":' || n || ',\"level\":\"WARN\",\"target\":\"ingest\",\"message\":\"seen\",\"fields\":{\"origin\":\"' || origin || '\"}' "
            "ELSE 'seen' END AS message, CASE WHEN n % 17 <> 16 THEN origin END AS origin FROM raw",
        ),
        "stored_decision_counts": _sql(LOG, "SELECT CAST(3 AS BIGINT) AS batch_id, level, stage, count(*) AS n FROM log GROUP BY ALL"),
        "decisions_without_encryption": _sql(
            LOG, "SELECT stage, count(*) AS n FROM log WHERE stage <> 'metric_failed' GROUP BY stage"
        ),
        "policy_unreadable_decisions": _sql(
            KEYS,
            "SELECT origin, field AS canonical, first_key AS raw_key, false AS allow, count(*) AS n FROM prop "
            "WHERE NOT direct AND outcome = 'unique' AND field <> 'msPlayed' GROUP BY ALL",
        ),
        "base64_texts": "SELECT doc_id, md5(base64(encode(text))) AS coded, md5(encode(text)) AS back FROM documents",
        "order_graph_violations": "SELECT o_orderkey AS g, f.shape, f.path, f.\"constraint\" FROM orders, "
        "(VALUES ('StreamingEventShape', 'eventId', 'maxCount'), ('StreamingEventShape', 'eventTimestamp', 'datatype'), "
        "('StreamingEventShape', 'performedBy', 'class'), ('StreamingEventShape', 'performedBy', 'node'), "
        "('UserShape', 'userId', 'datatype'), ('StreamingEventShape', 'involvesTrack', 'minCount')) f(shape, path, \"constraint\") "
        "WHERE CASE WHEN f.\"constraint\" = 'maxCount' THEN o_orderkey % 3 = 0 WHEN f.path = 'eventTimestamp' THEN o_orderkey % 4 = 0 "
        "WHEN f.\"constraint\" = 'class' THEN o_custkey % 5 = 0 WHEN f.\"constraint\" = 'node' THEN o_custkey % 7 = 0 "
        "WHEN f.path = 'userId' THEN o_custkey % 7 = 0 AND o_custkey % 5 <> 0 ELSE o_orderkey % 11 = 0 END",
    }
    # saved and loaded, the policy and the contract say the same
    found["policy_from_tables"] = found["policy_decisions"]
    found["contract_from_tables"] = found["contract_on_orders"]
    return found
