"""The registered queries once more as plain SQL, for an independent check."""

from __future__ import annotations

ACTIVITY = """
activity AS (
  SELECT user_id, ts, event_id, value, event_type, k,
         (event_id + k * 97) * 128 + k AS ingest_seq,
         event_type IN ('purchase', 'signup') AS has_value,
         event_type IN ('click', 'purchase', 'signup', 'view') AS has_type,
         event_type IN ('click', 'error', 'signup') AS has_k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""

LATEST = """
latest AS (
  SELECT user_id, ts, event_id, value, event_type, k
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM activity)
  WHERE rn = 1
)"""

EXPIRING = """
expiring AS (
  SELECT *, ts + to_seconds(CASE WHEN k < 30 OR k = 0 THEN 86400 ELSE k * 3600 END) AS expires_at FROM latest
)"""

CURRENT = """
current_rows AS (
  SELECT user_id,
         arg_max(value, ingest_seq) FILTER (WHERE has_value) AS value,
         arg_max(event_type, ingest_seq) FILTER (WHERE has_type) AS event_type,
         arg_max(k, ingest_seq) FILTER (WHERE has_k) AS k,
         arg_max(ts, ingest_seq) AS ts
  FROM activity GROUP BY user_id
)"""

# Orders without ties: the last order of a customer and day.
ORDER_LOG = """
order_log AS (
  SELECT o_custkey, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders)
  WHERE rn = 1
)"""


def _activity_pit(spine: str, log: str, names: str) -> str:
    columns = ", ".join(f"f.{n}" for n in names.split(", "))
    return f"""
WITH {ACTIVITY}
SELECT s.spine_id, s.user_id, s.label_timestamp, {columns}, f.ts AS feature_timestamp
FROM ({spine}) s ASOF LEFT JOIN ({log}) f ON s.user_id = f.user_id AND s.label_timestamp >= f.ts"""


def _spine(where: str = "true", at: str = "ts") -> str:
    return f"SELECT event_id AS spine_id, user_id, {at} AS label_timestamp FROM activity WHERE {where}"


def _merge(order: str) -> str:
    return f"""
WITH {ACTIVITY}
SELECT user_id,
       arg_max(value, {order}) FILTER (WHERE has_value) AS value,
       arg_max(event_type, {order}) FILTER (WHERE has_type) AS event_type,
       arg_max(k, {order}) FILTER (WHERE has_k) AS k,
       concat_ws(',', CASE WHEN bool_or(has_value) THEN 'value' END,
                      CASE WHEN bool_or(has_type) THEN 'event_type' END,
                      CASE WHEN bool_or(has_k) THEN 'k' END) AS feature_keys
FROM activity GROUP BY user_id"""


# --- schemas -----------------------------------------------------------------------------

SPECS = """
lines AS (
  SELECT l_orderkey AS o_orderkey, 'f' || (l_partkey % 5) AS name,
         CASE l_returnflag WHEN 'A' THEN 'float64' WHEN 'N' THEN 'int64' ELSE 'string' END AS dtype,
         CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'R' THEN '''none''' ELSE '0' END END AS dflt,
         row_number() OVER w AS place
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)
),
feats AS (
  SELECT o_orderkey, name, min(place) AS place,
         arg_max({'dtype': dtype, 'dflt': dflt}, place) AS def
  FROM lines GROUP BY o_orderkey, name
),
specs AS (
  SELECT o_orderkey, o_custkey, o_orderdate,
         'view_' || o_custkey AS feature_view,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version,
         CASE WHEN o_orderstatus = 'P' THEN 'account_id' ELSE 'entity_id' END AS ent,
         CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'event_time' ELSE 'event_timestamp' END AS tscol,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'FORWARD' WHEN '2' THEN 'FULL' WHEN '3' THEN 'NONE'
              ELSE 'BACKWARD' END AS mode
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
),
newest AS (SELECT feature_view, max(version) AS latest_version FROM specs GROUP BY feature_view)"""

SUCCESSIVE = """
pairs AS (
  SELECT n.feature_view, n.version, n.mode, o.o_orderkey AS old_key, n.o_orderkey AS new_key,
         o.ent AS old_ent, n.ent AS new_ent, o.tscol AS old_ts, n.tscol AS new_ts
  FROM specs n JOIN specs o ON o.feature_view = n.feature_view AND o.version = n.version - 1
)"""

FINDINGS = """
matched AS (
  SELECT p.feature_view, p.version, p.mode, o.name, o.place, o.def AS o, n.def AS n, 1 AS section
  FROM pairs p JOIN feats o ON o.o_orderkey = p.old_key
  LEFT JOIN feats n ON n.o_orderkey = p.new_key AND n.name = o.name
  WHERE p.mode IN ('BACKWARD', 'FULL')
  UNION ALL
  SELECT p.feature_view, p.version, p.mode, n.name, n.place, o.def AS o, n.def AS n, 2 AS section
  FROM pairs p JOIN feats n ON n.o_orderkey = p.new_key
  LEFT JOIN feats o ON o.o_orderkey = p.old_key AND o.name = n.name
  WHERE p.mode IN ('FORWARD', 'FULL')
),
judged AS (
  SELECT feature_view, version, mode, section, place,
         CASE WHEN section = 1 AND n IS NULL AND o.dflt IS NOT NULL THEN 'warning'
              WHEN section = 2 AND o IS NULL AND n.dflt IS NOT NULL THEN 'warning'
              WHEN n IS NULL OR o IS NULL OR o.dtype <> n.dtype THEN 'error' END AS severity,
         CASE WHEN section = 1 AND n IS NULL AND o.dflt IS NULL
                THEN 'BACKWARD: field ''' || name || ''' removed from new schema but had no default — old data cannot be read.'
              WHEN section = 1 AND n IS NULL
                THEN 'BACKWARD: field ''' || name || ''' removed; old data will use default=' || o.dflt || '.'
              WHEN section = 2 AND o IS NULL AND n.dflt IS NULL
                THEN 'FORWARD: new required field ''' || name || ''' (no default) added to schema — old consumers cannot handle this data.'
              WHEN section = 2 AND o IS NULL
                THEN 'FORWARD: new optional field ''' || name || ''' added; old consumers will ignore it.'
              WHEN section = 1 AND o.dtype <> n.dtype
                THEN 'BACKWARD: field ''' || name || ''' type changed ''' || o.dtype || ''' → ''' || n.dtype || '''. Type changes break backward compatibility.'
              WHEN o.dtype <> n.dtype
                THEN 'FORWARD: field ''' || name || ''' type changed ''' || o.dtype || ''' → ''' || n.dtype || '''.'
         END AS message
  FROM matched
  UNION ALL
  SELECT feature_view, version, mode, 3, 0, 'error',
         'entity_column renamed ''' || old_ent || ''' → ''' || new_ent || '''. This is never compatible.'
  FROM pairs WHERE mode <> 'NONE' AND old_ent <> new_ent
  UNION ALL
  SELECT feature_view, version, mode, 4, 0, 'error',
         'timestamp_column renamed ''' || old_ts || ''' → ''' || new_ts || '''.'
  FROM pairs WHERE mode <> 'NONE' AND old_ts <> new_ts
),
findings AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY feature_view, version ORDER BY section, place) - 1 AS INTEGER) AS position
  FROM judged WHERE severity IS NOT NULL
),
tally AS (
  SELECT p.feature_view, p.version, p.mode,
         count(*) FILTER (WHERE f.severity = 'error') AS n_errors,
         count(*) FILTER (WHERE f.severity = 'warning') AS n_warnings,
         coalesce(string_agg(f.message, '; ' ORDER BY f.position) FILTER (WHERE f.severity = 'error'), '') AS errors,
         coalesce(string_agg(f.message, '; ' ORDER BY f.position) FILTER (WHERE f.severity = 'warning'), '') AS warnings
  FROM pairs p LEFT JOIN findings f ON f.feature_view = p.feature_view AND f.version = p.version
  GROUP BY p.feature_view, p.version, p.mode
)"""

CATALOG = """
view_events AS (
  SELECT 'view_' || o_custkey AS name, version,
         CASE WHEN o_orderstatus = 'F' THEN 3600 ELSE 0 END AS ttl_seconds,
         o_orderpriority AS description,
         NOT (o_orderstatus = 'P' AND left(o_orderpriority, 1) = '5') AS is_active,
         o_orderdate + to_seconds(version) AS changed_at
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version
        FROM orders)
),
folded AS (
  SELECT name, min(changed_at) AS created_at, max(changed_at) AS updated_at, bool_and(is_active) AS is_active,
         arg_max({'v': version, 't': ttl_seconds, 'd': description}, changed_at) FILTER (WHERE is_active) AS spec
  FROM view_events GROUP BY name
)"""

TYPED = """
texts AS (
  SELECT event_id,
         CASE event_type WHEN 'click' THEN CAST(k AS VARCHAR)
              WHEN 'view' THEN ' ' || k || ' '
              WHEN 'purchase' THEN k || '.5'
              WHEN 'signup' THEN CASE WHEN k < 50 THEN 'Yes' ELSE 'FALSE' END
              ELSE '[' || k || ', ' || user_id || ']' END AS raw
  FROM activity
)"""

STREAMED = """
applied AS (SELECT * FROM activity WHERE event_type IN ('click', 'purchase', 'view'))"""


ORACLE: dict[str, str] = {
    "pit_user_activity": _activity_pit(
        _spine("event_type = 'error'"), "SELECT * FROM activity WHERE event_type = 'click'", "value, k"
    ),
    "pit_orders_ties": f"""
WITH {ORDER_LOG}
SELECT s.*, f.o_totalprice, f.o_orderstatus, f.o_orderpriority, f.o_orderdate AS feature_timestamp
FROM (SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, l_shipdate AS label_timestamp
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) s
ASOF LEFT JOIN order_log f ON s.o_custkey = f.o_custkey AND s.label_timestamp >= f.o_orderdate""",
    "pit_before_any_data": f"""
WITH {ORDER_LOG}
SELECT s.*, f.o_totalprice, f.o_orderstatus, f.o_orderpriority, f.o_orderdate AS feature_timestamp
FROM (SELECT c_custkey AS o_custkey, TIMESTAMP '1994-12-31' AS label_timestamp FROM customer) s
ASOF LEFT JOIN order_log f ON s.o_custkey = f.o_custkey AND s.label_timestamp >= f.o_orderdate""",
    "pit_day_before": _activity_pit(
        _spine(at="ts - INTERVAL 1 DAY"), "SELECT * FROM activity", "value, event_type, k"
    ),
    "pit_inclusive": _activity_pit(_spine(), "SELECT * FROM activity", "value, event_type, k"),
    "pit_duplicate_spine": _activity_pit(
        _spine("event_type IN ('error', 'signup')") + " UNION ALL " + _spine("event_type IN ('error', 'signup')"),
        "SELECT * FROM activity WHERE event_type = 'purchase'",
        "value",
    ),
    "pit_feature_subset": _activity_pit(
        _spine("event_type = 'view'"),
        "SELECT * FROM activity WHERE event_type IN ('click', 'signup')",
        "event_type, k",
    ),
    "pit_hot_entities": f"""
WITH {ACTIVITY}
SELECT s.spine_id, s.event_type, s.label_timestamp, f.user_id, f.k, f.ts AS feature_timestamp
FROM (SELECT event_id AS spine_id, event_type, ts - INTERVAL 1 HOUR AS label_timestamp FROM activity) s
ASOF LEFT JOIN activity f ON s.event_type = f.event_type AND s.label_timestamp >= f.ts""",
    "pit_monthly_marks": """
WITH one_per_day AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey DESC) AS rn
                 FROM orders) WHERE rn = 1
)
SELECT s.o_orderpriority, s.label_timestamp, f.o_totalprice, f.o_orderstatus, f.o_orderdate AS feature_timestamp
FROM (SELECT DISTINCT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS label_timestamp FROM orders) s
ASOF LEFT JOIN one_per_day f ON s.o_orderpriority = f.o_orderpriority AND s.label_timestamp >= f.o_orderdate""",
    "pit_array_spine": f"""
WITH {ACTIVITY},
spine AS (
  SELECT event_id, CAST(i AS BIGINT) AS spine_id,
         [user_id, user_id + 1, user_id][i] AS user_id, [ts, ts, ts - INTERVAL 2 DAY][i] AS label_timestamp
  FROM activity, (SELECT unnest([1, 2, 3]) AS i) WHERE event_type = 'purchase'
)
SELECT s.*, f.value, f.ts AS feature_timestamp
FROM spine s ASOF LEFT JOIN (SELECT user_id, ts, value FROM activity WHERE event_type = 'view') f
ON s.user_id = f.user_id AND s.label_timestamp >= f.ts""",
    "latest_per_entity": f"WITH {ACTIVITY}, {LATEST} SELECT * FROM latest",
    "latest_with_ties": """
SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC""",
    "latest_for_entities": """
SELECT DISTINCT ON (o_custkey) * FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC""",
    "latest_vectors": """
SELECT label, vec_id, len(embedding) AS dims, CAST(embedding[1] AS DOUBLE) AS first_value,
       CAST(embedding[-1] AS DOUBLE) AS last_value
FROM (SELECT DISTINCT ON (label) * FROM embeddings ORDER BY label, vec_id DESC)""",
    "log_time_range": """
SELECT event_id, user_id, ts FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-29 12:00:00'""",
    "materialize_window": f"""
WITH {ACTIVITY}, {LATEST}
SELECT * FROM latest WHERE ts BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-29 12:00:00'""",
    "materialize_as_of": f"""
WITH {ACTIVITY}
SELECT user_id, ts, event_id, value, event_type, k
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM activity WHERE ts <= TIMESTAMP '2024-01-29 12:00:00')
WHERE rn = 1 AND ts >= TIMESTAMP '2024-01-20 00:00:00'""",
    "materialize_job": f"""
WITH {ACTIVITY}, {LATEST}
SELECT user_id, value, event_type, k, epoch_us(ts) // 1000 AS event_ts_ms,
       CAST(epoch(TIMESTAMP '2024-01-30 12:00:00' + INTERVAL 7 DAY) AS BIGINT) AS expires_s
FROM latest WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'""",
    "run_history": """
WITH done AS (
  SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS at FROM lineitem GROUP BY l_orderkey
)
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'view_' || o_custkey AS feature_view,
       CASE WHEN d.n IS NULL OR o_orderstatus = 'O' THEN 'running'
            WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN coalesce(d.n, 0) ELSE 0 END AS entities_materialized,
       o_orderdate AS created_at,
       CASE WHEN o_orderstatus <> 'O' THEN d.at END AS completed_at
FROM orders LEFT JOIN done d ON d.l_orderkey = o_orderkey""",
    "field_merge_arrival": _merge("ingest_seq"),
    "field_merge_event_time": _merge("row(ts, event_id)"),
    "online_lookup": f"""
WITH {ACTIVITY}, {CURRENT}
SELECT c_custkey AS user_id, c_mktsegment, r.value, r.event_type, r.k, r.user_id IS NOT NULL AS found
FROM customer LEFT JOIN current_rows r ON r.user_id = c_custkey""",
    "online_feature_subset": f"""
WITH {ACTIVITY}, {CURRENT}
SELECT c_custkey AS user_id, c_mktsegment, r.k FROM customer JOIN current_rows r ON r.user_id = c_custkey""",
    "missing_entities": f"""
WITH {ACTIVITY}, {CURRENT}
SELECT c_custkey AS user_id, c_mktsegment FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM current_rows)""",
    "delete_online": f"""
WITH {ACTIVITY}, {CURRENT}
SELECT * FROM current_rows WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "online_expiry": f"""
WITH {ACTIVITY}, {LATEST}, {EXPIRING}
SELECT user_id, k, expires_at, epoch_us(ts) // 1000 AS event_ts_ms FROM expiring""",
    "online_unexpired": f"""
WITH {ACTIVITY}, {LATEST}, {EXPIRING}
SELECT * FROM expiring WHERE expires_at > TIMESTAMP '2024-01-30 12:00:00'""",
    "online_count": f"""
WITH {ACTIVITY}, {LATEST}, {EXPIRING}
SELECT count(*) AS online_entities FROM expiring WHERE expires_at > TIMESTAMP '2024-01-30 12:00:00'""",
    "wide_pivot": """
SELECT user_id,
       arg_max(value, row(ts, event_id)) FILTER (WHERE event_type = 'click') AS click,
       arg_max(value, row(ts, event_id)) FILTER (WHERE event_type = 'error') AS error,
       arg_max(value, row(ts, event_id)) FILTER (WHERE event_type = 'purchase') AS purchase,
       arg_max(value, row(ts, event_id)) FILTER (WHERE event_type = 'signup') AS signup,
       arg_max(value, row(ts, event_id)) FILTER (WHERE event_type = 'view') AS view
FROM events GROUP BY user_id""",
    "offline_stats": """
SELECT count(*) AS total_rows, count(DISTINCT user_id) AS unique_entities,
       min(ts) AS earliest_ts, max(ts) AS latest_ts FROM events""",
    "offline_stats_by_view": """
SELECT event_type, count(*) AS total_rows, count(DISTINCT user_id) AS unique_entities,
       min(ts) AS earliest_ts, max(ts) AS latest_ts FROM events GROUP BY event_type""",
    "view_stats": f"""
WITH {ACTIVITY}, {LATEST}, {EXPIRING},
online AS (
  SELECT event_type, count(*) AS n FROM expiring WHERE expires_at > TIMESTAMP '2024-01-30 12:00:00' GROUP BY event_type
)
SELECT e.event_type, count(*) AS total_rows, count(DISTINCT e.user_id) AS unique_entities,
       min(e.ts) AS earliest_ts, max(e.ts) AS latest_ts, coalesce(max(o.n), 0) AS online_entities
FROM events e LEFT JOIN online o ON o.event_type = e.event_type GROUP BY e.event_type""",
    "unknown_features": """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'severity' ELSE '' END AS unknown FROM events""",
    "validate_updates": f"""
WITH {ACTIVITY}
SELECT event_id,
       CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 3 ELSE 2 END AS BIGINT) AS n_keys,
       CASE WHEN has_value THEN value END AS value, CASE WHEN has_type THEN event_type END AS event_type,
       CASE WHEN has_k THEN k END AS k,
       CASE WHEN event_type = 'error' THEN 'unknown features: severity' END AS problem
FROM activity""",
    "typed_decode": f"""
WITH {ACTIVITY}, {TYPED}
SELECT event_id,
       CASE WHEN regexp_full_match(trim(raw), '[0-9.]+') THEN CAST(trim(raw) AS DOUBLE) END AS as_float,
       CASE WHEN regexp_full_match(trim(raw), '[0-9]+') THEN CAST(trim(raw) AS BIGINT) END AS as_int,
       lower(raw) IN ('true', '1', 'yes') AS as_bool,
       TRY_CAST(raw AS BIGINT[])[1] AS list_first,
       TRY_CAST(raw AS BIGINT[])[2] AS list_second
FROM texts""",
    "text_encode": f"""
WITH {ACTIVITY}
SELECT event_id, event_type AS event_type_text, CAST(k AS VARCHAR) AS k_text,
       CASE WHEN k > 50 THEN 'True' ELSE 'False' END AS high_text,
       '[' || k || ', ' || user_id || ']' AS pair_text,
       CASE WHEN event_type = 'click' THEN CAST(k AS VARCHAR) ELSE 'None' END AS maybe_text,
       CAST(value AS VARCHAR) AS value_text
FROM activity""",
    "update_messages": f"""
WITH {ACTIVITY}
SELECT 'user_activity:' || user_id AS key, event_id AS message_id, 'user_activity' AS feature_view,
       CAST(3 AS INTEGER) AS schema_version, 'api' AS producer_id,
       CASE WHEN has_k THEN k END AS k, CASE WHEN has_type THEN event_type END AS event_type,
       CASE WHEN has_value THEN value END AS value
FROM activity""",
    "stream_current_values": f"""
WITH {ACTIVITY}, {STREAMED}
SELECT user_id,
       arg_max(value, ingest_seq) FILTER (WHERE event_type = 'purchase') AS value,
       arg_max(event_type, ingest_seq) AS event_type,
       arg_max(k, ingest_seq) FILTER (WHERE event_type = 'click') AS k,
       arg_max(epoch_us(ts) // 1000, ingest_seq) AS event_ts_ms,
       CAST(epoch(TIMESTAMP '2024-01-30 12:00:00' + INTERVAL 7 DAY) AS BIGINT) AS expires_s
FROM applied GROUP BY user_id""",
    "stream_log": f"""
WITH {ACTIVITY}, {STREAMED}
SELECT event_id, user_id, ts, CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS BIGINT) AS n_keys,
       CASE WHEN event_type = 'purchase' THEN value END AS value, event_type,
       CASE WHEN event_type = 'click' THEN k END AS k
FROM applied""",
    "stream_two_batches": f"""
WITH {ACTIVITY}, {STREAMED}
SELECT user_id,
       arg_max(value, ingest_seq) FILTER (WHERE event_type = 'purchase') AS value,
       arg_max(event_type, ingest_seq) AS event_type,
       arg_max(k, ingest_seq) FILTER (WHERE event_type = 'click') AS k,
       count(*) AS n_logged
FROM applied GROUP BY user_id""",
    "json_rows": "SELECT event_id, user_id, event_type, ts FROM events",
    "array_file": """
SELECT row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS position, event_id, ts
FROM events WHERE event_type IS NOT NULL""",
    "typed_refusals": f"""
WITH {ACTIVITY}
SELECT event_id,
       CASE event_type WHEN 'click' THEN 'wrong type: k' WHEN 'view' THEN 'wrong type: value' END AS problem,
       CASE WHEN event_type NOT IN ('click', 'view') THEN k END AS k,
       CASE WHEN event_type NOT IN ('click', 'view') THEN value END AS value
FROM activity""",
    "partial_rows": f"""
WITH {ACTIVITY}
SELECT user_id,
       arg_max(value, (ts, event_id)) AS value,
       arg_max(event_type, (ts, event_id)) AS event_type,
       arg_max(k, (ts, event_id)) FILTER (WHERE event_type = 'click') AS k
FROM activity WHERE event_type IN ('click', 'purchase') GROUP BY user_id""",
    "untyped_read": """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 2 = 0 THEN '[' || o_custkey || ', ' || o_orderkey || ']' ELSE o_orderpriority END AS raw,
       CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::DOUBLE END AS first,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::DOUBLE END AS second
FROM orders""",
    "retyped_history": f"""
WITH {ACTIVITY}
SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 'k' ELSE '' END || k AS k, NULL::DOUBLE AS later
FROM activity WHERE event_type IN ('click', 'view')""",
    "change_messages": f"""
WITH {SPECS}
SELECT feature_view AS key, feature_view, lag(version) OVER (PARTITION BY feature_view ORDER BY version) AS old_version,
       version AS new_version, CASE WHEN version = 1 THEN 'create' ELSE 'update' END AS change_type
FROM specs""",
    "versions_listed": f"""
WITH {SPECS}
SELECT version, mode AS compatibility_mode, version = max(version) OVER () AS is_latest,
       row_number() OVER (ORDER BY version DESC) AS place
FROM specs WHERE feature_view = 'view_1'""",
    "schema_of_version": f"""
WITH {SPECS}
SELECT s.feature_view, s.version, s.version = w.latest_version AS is_latest, f.n_features
FROM specs s JOIN newest w ON w.feature_view = s.feature_view
JOIN (SELECT o_orderkey, count(*) AS n_features FROM feats GROUP BY o_orderkey) f ON f.o_orderkey = s.o_orderkey
WHERE s.feature_view = 'view_2' AND s.version = 2 OR s.feature_view = 'view_4' AND s.version = w.latest_version""",
    "pit_one_hot_entity": f"""
WITH {ACTIVITY}
SELECT s.event_id AS spine_id, 'all' AS "all", s.ts AS label_timestamp, f.value, f.k, f.ts AS feature_timestamp
FROM (SELECT * FROM activity WHERE event_type = 'error') s
ASOF LEFT JOIN (
  SELECT * FROM activity WHERE event_type IN ('click', 'purchase')
  QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) = 1
) f ON s.ts >= f.ts""",
    "pit_short_list": _activity_pit(
        "SELECT i AS spine_id, u AS user_id, TIMESTAMP '2024-01-05 12:00:00' + to_days(CAST(5 * i AS INTEGER)) AS label_timestamp "
        "FROM range(5) a(i), range(1, 4) b(u)",
        "SELECT * FROM activity",
        "value, event_type, k",
    ),
    "stream_quarantine": """
SELECT event_id,
       CASE WHEN event_type = 'signup' THEN 'no_such_view' ELSE 'user_activity' END AS feature_view,
       CASE WHEN event_type = 'signup' THEN 'no such view' ELSE 'unknown features: severity' END AS problem
FROM events WHERE event_type IN ('signup', 'error')""",
    "versions_latest": f"""
WITH {SPECS}
SELECT s.feature_view, s.version, s.mode AS compatibility_mode, s.version = w.latest_version AS is_latest,
       s.o_orderdate AS created_at, f.features
FROM specs s JOIN newest w ON w.feature_view = s.feature_view
JOIN (SELECT o_orderkey, string_agg(name || ':' || def.dtype, ',' ORDER BY place) AS features
      FROM feats GROUP BY o_orderkey) f ON f.o_orderkey = s.o_orderkey""",
    "latest_version_numbers": f"WITH {SPECS} SELECT * FROM newest",
    "change_feed": f"""
WITH {SPECS}
SELECT feature_view, lag(version) OVER (PARTITION BY feature_view ORDER BY version) AS old_version,
       version AS new_version, CASE WHEN version = 1 THEN 'create' ELSE 'update' END AS change_type
FROM specs""",
    "compat_audit": f"""
WITH {SPECS}, {SUCCESSIVE}, {FINDINGS}
SELECT feature_view, version, mode, position, severity, message FROM findings""",
    "compat_summary": f"""
WITH {SPECS}, {SUCCESSIVE}, {FINDINGS}
SELECT feature_view, version, mode, n_errors = 0 AS compatible, n_errors, n_warnings FROM tally""",
    "spec_changes": f"""
WITH {SPECS}, {SUCCESSIVE}
SELECT coalesce(a.feature_view, b.feature_view) AS feature_view, coalesce(a.version, b.version) AS version,
       coalesce(a.name, b.name) AS feature_name, a.def.dtype AS old_dtype, b.def.dtype AS new_dtype,
       CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed'
            WHEN a.def.dtype <> b.def.dtype THEN 'retyped' ELSE 'same' END AS change
FROM (SELECT p.feature_view, p.version, f.name, f.def FROM pairs p JOIN feats f ON f.o_orderkey = p.old_key) a
FULL OUTER JOIN
     (SELECT p.feature_view, p.version, f.name, f.def FROM pairs p JOIN feats f ON f.o_orderkey = p.new_key) b
ON a.feature_view = b.feature_view AND a.version = b.version AND a.name = b.name""",
    "register_schemas": f"""
WITH {SPECS},
pairs AS (
  SELECT n.feature_view, n.version, n.mode, o.o_orderkey AS old_key, n.o_orderkey AS new_key,
         o.ent AS old_ent, n.ent AS new_ent, o.tscol AS old_ts, n.tscol AS new_ts
  FROM specs n JOIN specs o ON o.feature_view = n.feature_view AND o.version = 1 AND n.version = 2
), {FINDINGS}
SELECT feature_view, CASE WHEN n_errors = 0 THEN CAST(2 AS INTEGER) END AS version, n_errors = 0 AS accepted,
       errors, warnings FROM tally
UNION ALL
SELECT feature_view, CAST(1 AS INTEGER), true, '', '' FROM newest WHERE latest_version = 1""",
    "dry_run": f"""
WITH {SPECS},
pairs AS (
  SELECT n.feature_view, n.version, o.mode, o.o_orderkey AS old_key, n.o_orderkey AS new_key,
         o.ent AS old_ent, n.ent AS new_ent, o.tscol AS old_ts, n.tscol AS new_ts
  FROM newest w JOIN specs o ON o.feature_view = w.feature_view AND o.version = w.latest_version
  JOIN specs n ON n.feature_view = w.feature_view AND n.version = 1
), {FINDINGS}
SELECT feature_view, n_errors = 0 AS compatible, mode, n_errors, n_warnings FROM tally""",
    "view_catalog": f"""
WITH {CATALOG}
SELECT name, CASE WHEN spec IS NOT NULL THEN 'entity_id' END AS entity_column,
       CASE WHEN spec IS NOT NULL THEN 'event_timestamp' END AS timestamp_column,
       spec.v AS schema_version, CAST(spec.t AS INTEGER) AS ttl_seconds, spec.d AS description,
       created_at, updated_at, is_active
FROM folded""",
    "active_views_with_spec": f"""
WITH {SPECS}, {CATALOG}
SELECT c.name, 'entity_id' AS entity_column, c.spec.v AS schema_version,
       CAST(f.n AS INTEGER) AS feature_count, strftime(c.updated_at, '%Y-%m-%dT%H:%M:%S') AS updated
FROM folded c JOIN specs s ON s.feature_view = c.name AND s.version = c.spec.v
JOIN (SELECT o_orderkey, count(*) AS n FROM feats GROUP BY o_orderkey) f ON f.o_orderkey = s.o_orderkey
WHERE c.is_active""",
    "count_views": f"WITH {CATALOG} SELECT count(*) AS views FROM folded WHERE is_active",
    "rows_of_active_views": f"""
WITH {CATALOG}
SELECT 'view_' || o_custkey AS feature_view, o_orderkey, o_totalprice FROM orders
WHERE 'view_' || o_custkey IN (SELECT name FROM folded WHERE is_active)""",
    "replayed_after_retype": f"""
WITH {ACTIVITY}
SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'k' ELSE '' END || k AS k
FROM activity WHERE event_type = 'view' OR event_type = 'click' AND event_id % 2 = 0""",
    "stream_ties": f"""
WITH {ACTIVITY}, {STREAMED},
numbered AS (SELECT *, date_trunc('day', ts) AS day, event_id * 7 % 3 AS batch FROM applied)
SELECT user_id,
       arg_max(event_id, (day, batch, -event_id)) AS newest_event,
       arg_max({{'v': CASE WHEN event_type = 'purchase' THEN value END}}, (day, batch, -event_id)).v AS newest_value,
       arg_max(value, (batch, -event_id)) FILTER (WHERE event_type = 'purchase') AS value,
       arg_max(event_type, (batch, -event_id)) AS event_type,
       arg_max(k, (batch, -event_id)) FILTER (WHERE event_type = 'click') AS k
FROM numbered GROUP BY user_id""",
    "refresh_incremental": f"""
WITH {ACTIVITY}
SELECT user_id, arg_max(value, (ts, event_id % 3, event_id)) AS value,
       arg_max(event_type, (ts, event_id % 3, event_id)) AS event_type,
       arg_max(k, (ts, event_id % 3, event_id)) AS k, epoch_us(max(ts)) // 1000 AS event_ts_ms,
       CAST(epoch(TIMESTAMP '2024-01-30 12:00:00' + INTERVAL 7 DAY) AS BIGINT) AS expires_s
FROM activity GROUP BY user_id""",
    "stats_from_sketches": """
SELECT count(*) AS total_rows, true AS near, min(ts) AS min_timestamp, max(ts) AS max_timestamp FROM events""",
}

# The same rows with their places.
ORACLE |= {
    "ordered_training_rows": f"""
SELECT *, row_number() OVER (ORDER BY spine_id) - 1 AS position FROM ({ORACLE["pit_user_activity"]})""",
    "views_by_name": f"""
SELECT *, row_number() OVER (ORDER BY name) - 1 AS position FROM ({ORACLE["active_views_with_spec"]})""",
    "runs_newest_first": f"""
SELECT *, row_number() OVER (PARTITION BY feature_view ORDER BY created_at DESC, job_id) - 1 AS position,
       count(*) OVER (PARTITION BY feature_view) AS runs
FROM ({ORACLE["run_history"]})""",
}
