"""The same results as :mod:`tallyspark.plans.queries`, as SQL over the same tables.

Written against the row-level definitions: samples are labelled one by one and aggregated
once, without the shortcuts the Spark plans take.
"""

from __future__ import annotations

from tallyspark.operators.pricing import DEFAULT_PRICE_BOOK

ORACLES: dict[str, str] = {}

# -- building blocks (each is a list of CTEs) --------------------------------------------

EV = """
ev AS (
  SELECT event_id, ts AS event_time, 'svc_' || event_type || '_bytes' AS metric,
    CASE user_id % 3 WHEN 0 THEN 'TOPIC' WHEN 1 THEN 'PRINCIPAL' ELSE 'UNKNOWN' END AS entity_type,
    CASE user_id % 3
      WHEN 0 THEN 'stage' || (user_id % 2) || '.app' || (user_id % 5) || '.subject' || user_id || '.v1'
      WHEN 1 THEN 'sa-' || user_id ELSE '' END AS name,
    CASE event_id % 4 WHEN 3 THEN 0.0 ELSE value END AS value,
    props
  FROM events)"""

RULES = r"""
rules(rule_id, rk, vf, vu, etype, rx) AS (VALUES
  ('r1', 1, NULL::TIMESTAMP, NULL::TIMESTAMP, 'TOPIC', 'stage([01])\.(app[0-9]+)\..+'),
  ('r3', 2, NULL, TIMESTAMP '2024-01-15', 'TOPIC', 'stage0\..*'),
  ('r4', 3, TIMESTAMP '2024-01-15', NULL, 'TOPIC', 'stage0\..*'),
  ('r5', 4, NULL, NULL, 'PRINCIPAL', 'sa-(\d+)'),
  ('r6', 5, NULL, NULL, 'TOPIC', '.*\.app2\..*'),
  ('r7', 6, NULL, NULL, 'TOPIC', '.*\.app3\..*'),
  ('r8', 7, NULL, NULL, 'TOPIC', '(STAGE1)\..*'),
  ('r2', 8, NULL, NULL, 'TOPIC', '.*\.app1\..*')),
entries(rule_id, key, tmpl, is_text) AS (VALUES
  ('r1', 'stage', 'tier \1', false), ('r1', 'app', '\2', false),
  ('r2', 'app', 'billing', true), ('r3', 'cost-unit', 'alpha', true), ('r4', 'cost-unit', 'beta', true),
  ('r5', 'team', 'team-\1', false), ('r5', 'app', 'svc', true),
  ('r6', 'readers', 'sa-1,,sa-4', true), ('r6', 'writers', 'sa-7,sa-10,,', true),
  ('r7', 'readers', ',', true), ('r7', 'writers', '', true),
  ('r8', 'raw', '$2', true), ('r8', 'zone', 'z-\1', false))"""


def label_ctes(src: str, out: str, key: str) -> str:
    """Label rows of ``src`` (key, entity_type, name, event_time) by brute force."""
    return f"""
{out}_kv AS (
  SELECT {key}, e.key, arg_max(CASE WHEN is_text THEN tmpl
      ELSE regexp_replace(s.name, rx, tmpl, 'gi') END, rk) AS val
  FROM {src} s JOIN rules r ON r.etype = s.entity_type AND regexp_full_match(s.name, r.rx, 'i')
    AND (vf IS NULL OR s.event_time >= vf) AND (vu IS NULL OR s.event_time < vu)
  JOIN entries e USING (rule_id) GROUP BY ALL),
{out}_ctx AS (
  SELECT {key}, '{{' || string_agg('"' || key || '":"' || val || '"', ',' ORDER BY key) || '}}' AS cj
  FROM {out}_kv GROUP BY ALL),
{out} AS (
  SELECT s.*, coalesce(cj, '{{}}') AS context_json FROM {src} s LEFT JOIN {out}_ctx USING ({key}))"""


LAB = f"WITH {EV},{RULES},{label_ctes('ev', 'lab', 'event_id')}"

PRICES = """
prices(metric, base, factor) AS (VALUES ('svc_click_bytes', 0.1::DOUBLE, 0.05::DOUBLE),
  ('svc_view_bytes', 0.0, 0.002), ('svc_error_bytes', 1.5, 0.0), ('svc_purchase_bytes', 0.25, 0.01))"""


def facts_ctes(src: str) -> str:
    return f"""
win AS (
  SELECT date_trunc('hour', event_time)::TIMESTAMP AS start_time,
    date_trunc('hour', event_time)::TIMESTAMP + INTERVAL 1 HOUR AS end_time,
    entity_type, name, metric AS initial_metric_name, context_json,
    CASE WHEN metric = 'svc_error_bytes' THEN max(value) ELSE sum(value) END AS value
  FROM {src} GROUP BY start_time, end_time, entity_type, name, metric, context_json),
{PRICES},
idd AS (
  SELECT w.*, base + factor * value AS cost, '{{}}' AS tags,
    coalesce(context_json->>'topic', 'unknown') AS target
  FROM win w LEFT JOIN prices p ON p.metric = w.initial_metric_name),
facts AS (
  SELECT *, sha1(strftime(start_time, '%Y-%m-%dT%H:%M:%SZ') || strftime(end_time, '%Y-%m-%dT%H:%M:%SZ')
    || initial_metric_name || entity_type || name || tags || context_json || target) AS row_id
  FROM idd)"""


FACTS = f"{LAB},{facts_ctes('lab')}"
E_RANGE = "start_time >= TIMESTAMP '2024-01-03' AND end_time <= TIMESTAMP '2024-01-27 12:00:00'"
S_RANGE = "start_time >= TIMESTAMP '1996-01-01' AND end_time <= TIMESTAMP '2000-01-01'"


def j(key: str) -> str:
    return f"""json_extract_string(context_json, '$."{key}"')"""


def split_ctes(policy: str) -> str:
    """Shares of the labelled rows; ``policy`` handles the missing key."""
    missing = {
        "fallback": "['unknown']",
        "drop": "[]::VARCHAR[]",
        "pass": "[NULL]::VARCHAR[]",
    }[policy]
    return f"""
sp AS (
  SELECT *, CASE metric WHEN 'svc_click_bytes' THEN {j('readers')}
      WHEN 'svc_view_bytes' THEN {j('writers')} END AS txt,
    entity_type = 'TOPIC' AND metric IN ('svc_click_bytes', 'svc_view_bytes') AS splits
  FROM lab),
ml AS (
  SELECT *, CASE WHEN NOT splits THEN [NULL]::VARCHAR[] WHEN txt IS NULL THEN {missing}
      WHEN regexp_full_match(txt, ',+') THEN []::VARCHAR[]
      ELSE string_split(regexp_replace(txt, ',+$', ''), ',') END AS members
  FROM sp),
ex AS (SELECT *, unnest(members) AS member, len(members) AS n FROM ml),
sh AS (
  SELECT row_number() OVER () AS sid, event_time, metric, context_json AS old_json, name AS old_name,
    member, CASE WHEN member IS NULL THEN entity_type ELSE 'PRINCIPAL' END AS entity_type,
    coalesce(member, name) AS name, CASE WHEN member IS NULL THEN value ELSE value / n END AS value
  FROM ex),{label_ctes('sh', 'shl', 'sid')},
shares AS (
  SELECT event_time, metric, entity_type, name, value, CASE WHEN member IS NULL THEN old_json
    WHEN context_json = '{{}}' THEN '{{"topic":"' || old_name || '"}}'
    ELSE left(context_json, len(context_json) - 1) || ',"topic":"' || old_name || '"}}' END AS context_json
  FROM shl)"""


LINE = """
place AS (SELECT s_suppkey, n_name AS nation, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lwin AS (
  SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS start_time,
    date_trunc('day', l_shipdate)::TIMESTAMP + INTERVAL 1 DAY AS end_time,
    'supplier-' || l_suppkey AS name, 'line_' || l_returnflag || '_bytes' AS initial_metric_name,
    l_suppkey, CASE WHEN l_returnflag = 'N' THEN max(l_quantity) ELSE sum(l_quantity) END AS value
  FROM lineitem GROUP BY date_trunc('day', l_shipdate), l_suppkey, l_returnflag),
lf AS (
  SELECT w.*, nation, region,
    CASE initial_metric_name WHEN 'line_A_bytes' THEN 0.1::DOUBLE + 0.05::DOUBLE * value
      WHEN 'line_N_bytes' THEN 0.0::DOUBLE + 0.002::DOUBLE * value END AS cost,
    CASE WHEN nation IS NULL THEN '{}'
      ELSE '{"nation":"' || nation || '","region":"' || region || '"}' END AS context_json
  FROM lwin w LEFT JOIN place USING (s_suppkey))""".replace(
    "LEFT JOIN place USING (s_suppkey)", "LEFT JOIN place ON s_suppkey = l_suppkey"
)
LF = f"WITH {LINE}"

BILLS = """
wide AS (
  SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS bill_id,
    date_trunc('month', o_orderdate)::TIMESTAMP AS period_from,
    date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 1 MONTH AS period_to,
    sum(CASE WHEN o_orderkey % 4 = 0 THEN round(o_totalprice) END) AS storage,
    sum(CASE WHEN o_orderkey % 4 = 1 THEN round(o_totalprice) END) AS network_read,
    sum(CASE WHEN o_orderkey % 4 = 2 THEN round(o_totalprice) END) AS network_write,
    sum(round(o_totalprice)) AS all_lines, month(date_trunc('month', o_orderdate)) AS m
  FROM orders GROUP BY ALL),
bills_wide AS (
  SELECT bill_id, period_from, period_to, coalesce(storage, 0.0) AS storage,
    coalesce(network_read, 0.0) AS network_read, coalesce(network_write, 0.0) AS network_write,
    coalesce(CASE WHEN m % 2 = 0 THEN all_lines ELSE storage + network_read + network_write END, 0.0) AS total
  FROM wide),
bills AS (
  SELECT bill_id, period_from, period_to, metric, CAST(round(amount * 100) AS BIGINT) AS cents FROM (
    SELECT *, 'line_A_bytes' AS metric, storage AS amount FROM bills_wide UNION ALL
    SELECT *, 'line_R_bytes', network_read FROM bills_wide UNION ALL
    SELECT *, 'line_N_bytes', network_write FROM bills_wide))"""


def alloc(keys: list[str]) -> str:
    ks = ", ".join(keys)
    named = ", ".join(f"coalesce({k}, '<other>') AS {k}" for k in keys)
    return f"""
grp AS (
  SELECT bill_id, metric, cents, {ks}, sum(value) AS total
  FROM lf JOIN bills ON metric = initial_metric_name AND start_time >= period_from AND end_time <= period_to
  WHERE cents IS NOT NULL AND cents <> 0 GROUP BY ALL),
alloc AS (
  SELECT bill_id, metric, {named}, coalesce({keys[-1]}, '<other>') AS name,
    total / sum(total) OVER (PARTITION BY bill_id, metric) * cents AS price
  FROM grp)"""


DAILY = f"""
daily AS (
  SELECT coalesce({j('cost-unit')}, 'unknown') AS name,
    time_bucket(INTERVAL 24 HOUR, start_time, TIMESTAMP '2024-01-03') AS time, sum(value) AS value
  FROM facts WHERE {E_RANGE} GROUP BY ALL)"""

GAUGE = f"""
gs AS (
  SELECT 'usage_' || initial_metric_name AS name, lower(entity_type) AS k, name AS v, value, start_time,
    context_json FROM facts),
gk AS (SELECT name, unnest(json_keys(context_json)) AS key FROM gs UNION SELECT name, k FROM gs),
gid AS (SELECT row_number() OVER () AS gid, * FROM gs),
gw AS (
  SELECT gid, '{{' || string_agg('"' || key || '":"' || coalesce(CASE WHEN key = k THEN v
      ELSE json_extract_string(context_json, '$."' || key || '"') END, '') || '"', ',' ORDER BY key) || '}}' AS tags_json
  FROM gid JOIN gk USING (name) GROUP BY gid),
snap AS (
  SELECT name, tags_json, arg_max(value, start_time) AS value, max(start_time) AS last_seen
  FROM gid JOIN gw USING (gid) GROUP BY ALL)"""

SPLIT_FACTS = f"{LAB},{split_ctes('fallback')},{facts_ctes('shares')}"

ACL = """
t AS (
  SELECT p_brand || '.' || p_type AS topic, max(p_size) AS size FROM part GROUP BY ALL),
u AS (
  SELECT s_suppkey AS k, 'user-' || s_suppkey AS usr,
    CASE WHEN s_suppkey % 11 = 0 THEN 'unknown' ELSE 'group-' || s_nationkey END AS grp,
    'Brand#' || (s_suppkey % 25 + 1) || '.ECONOMY' AS lit, 'Brand#' || (s_suppkey % 9 + 1) AS pre
  FROM supplier WHERE s_suppkey % 13 <> 0),
a(usr, scope, res, ar, dr, aw, dw) AS (
  SELECT usr, 'L', lit, true, false, false, false FROM u WHERE k % 5 = 0 UNION ALL
  SELECT usr, 'L', lit, false, false, false, true FROM u WHERE k % 5 = 0 UNION ALL
  SELECT usr, 'P', pre, false, false, true, false FROM u WHERE k % 5 = 1 UNION ALL
  SELECT usr, '*', '*', true, false, true, false FROM u WHERE k % 5 = 2 UNION ALL
  SELECT usr, '*', '*', true, false, true, false FROM u WHERE k % 5 = 3 UNION ALL
  SELECT usr, 'P', pre, false, true, false, true FROM u WHERE k % 5 = 3 UNION ALL
  SELECT usr, 'L', lit, true, false, false, false FROM u WHERE k % 5 = 3),
pairs AS (
  SELECT topic, usr, bool_or(ar) AND NOT bool_or(dr) AS can_read, bool_or(aw) AND NOT bool_or(dw) AS can_write,
    bool_or(scope <> '*') AS special
  FROM t JOIN a ON scope = '*' OR (scope = 'L' AND topic = res) OR (scope = 'P' AND starts_with(topic, res))
  GROUP BY ALL),
lists AS (
  SELECT topic, size,
    coalesce((SELECT string_agg(DISTINCT grp, ',' ORDER BY grp) FROM pairs JOIN u USING (usr)
      WHERE pairs.topic = t.topic AND can_read), '') AS readers,
    coalesce((SELECT string_agg(DISTINCT grp, ',' ORDER BY grp) FROM pairs JOIN u USING (usr)
      WHERE pairs.topic = t.topic AND can_write), '') AS writers
  FROM t),
gen AS (
  SELECT topic AS rule_id, 'TOPIC' AS entity_type, size,
    '(eu-1[.])?' || replace(topic, '.', '[.]') || '([.]copy)?' AS regex,
    '{"readers":"' || readers || '","size":"' || size || '","writers":"' || writers || '"}' AS context_json
  FROM lists)"""

CLUSTER = """
cr AS (
  SELECT CASE l_partkey % 4 WHEN 0 THEN 'request' WHEN 1 THEN 'response' WHEN 2 THEN 'retained' ELSE 'lag' END AS m,
    'lkc-' || (l_suppkey % 3) AS kafka_id, 'sa-' || l_suppkey AS principal_id, 't-' || l_suppkey AS topic,
    CASE WHEN l_linenumber % 2 = 0 THEN 'Produce' ELSE 'Fetch' END AS typ,
    'g' || (l_orderkey % 4) AS cg, l_quantity AS value
  FROM lineitem)"""

# -- the queries -------------------------------------------------------------------------

ORACLES["raw_parsed"] = """
SELECT date_trunc('second', ts)::TIMESTAMP AS "timestamp", 'svc_' || event_type AS name, value, 'u' || user_id AS topic
FROM events WHERE event_id % 10 <> 7"""

ORACLES["corrupt_records"] = """
SELECT 'events/' || event_type AS source, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL"""

ORACLES["raw_balance"] = """
SELECT event_type AS source, CASE WHEN event_id % 5 < 3 THEN 'valid' ELSE 'corrupt' END AS side, count(*) AS n,
  max(CASE event_id % 5 WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
    WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE date_trunc('second', ts) END)::TIMESTAMP AS newest
FROM events GROUP BY ALL"""

ORACLES["labelled_equal_paths"] = f"""
WITH {EV},
r AS (SELECT i, CASE WHEN i <> 5 THEN 'm' || lpad(i::VARCHAR, 2, '0') ELSE '' END AS id, i % 7 AS age,
  'k' || (i % 3) AS key, 'v' || i AS value FROM range(62) t(i) WHERE i % 4 <> 0),
e AS (SELECT DISTINCT entity_type, name, event_time FROM ev),
best AS (SELECT entity_type, name, key, arg_max(value, lpad(age::VARCHAR, 2, '0') || id) AS value
  FROM (SELECT DISTINCT entity_type, name FROM e WHERE entity_type = 'TOPIC') n
  JOIN r ON n.name LIKE '%.app' || (r.i % 5) || '.%' GROUP BY ALL),
maps AS (SELECT entity_type, name, '{{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}}' AS context_json
  FROM best GROUP BY ALL)
SELECT path, entity_type, name, coalesce(context_json, '{{}}') AS context_json, count(*) AS n
FROM e LEFT JOIN maps USING (entity_type, name), (VALUES ('inline'), ('joined')) p(path) GROUP BY ALL"""

ORACLES["odd_templates"] = f"""
WITH {EV},
e AS (SELECT DISTINCT name, event_time, substr(name, 4) AS digits FROM ev WHERE entity_type = 'PRINCIPAL')
SELECT path, name, '{{"class":"${{x}}","hidden":"<$1>","nested":"$1;$2","quoted":"<' || digits || '>"}}' AS context_json, count(*) AS n
FROM e, (VALUES ('inline'), ('joined')) p(path) GROUP BY ALL"""

ORACLES["normalized_metrics"] = f"""
WITH {EV} SELECT event_time, entity_type, name, metric AS initial_metric_name, value FROM ev"""

ORACLES["clean_names"] = """
SELECT p_partkey, replace(replace(replace('io.vendor.' || replace(p_name, ' ', '/') || '.ratio_b', '.', '_'),
  '/', '_'), 'io_', '') AS metric_name FROM part"""

ORACLES["valid_tags"] = """
SELECT event_type, CASE WHEN user_id % 4 IN (0, 1) THEN 'ok' ELSE 'rejected' END AS verdict, count(*) AS n,
  round(sum(value), 6) AS value FROM events GROUP BY ALL"""

ORACLES["hour_floor"] = """
SELECT event_id, date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR AS hour_start,
  date_trunc('hour', ts)::TIMESTAMP AS hour_end, epoch_ms(date_trunc('hour', ts)::TIMESTAMP) AS end_millis
FROM events"""

ORACLES["parsed_instants"] = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts)::TIMESTAMP END AS from_iso,
  date_trunc('second', ts)::TIMESTAMP AS from_seconds, date_trunc('millisecond', ts)::TIMESTAMP AS from_millis
FROM events"""

CHANGES = """
WITH newest AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
cur AS (SELECT * FROM newest WHERE o_orderstatus <> 'F')"""

ORACLES["price_per_gb"] = f"""{CHANGES}
SELECT 'customer_' || o_custkey || CASE WHEN o_custkey % 7 > 3 THEN '_count' ELSE '_bytes' END AS metric_name,
  CASE WHEN o_custkey % 7 > 3 THEN NULL
    ELSE floor(o_totalprice / 1e14::DOUBLE * 107374182400000.0::DOUBLE + 0.5) / 100000.0::DOUBLE END AS per_gb FROM cur"""

ORACLES["latest_rules"] = f"""{CHANGES}
SELECT 'customer-' || o_custkey AS rule_id, o_orderdate AS creation_time,
  'customer-' || o_custkey || '[.].*' AS regex, o_orderpriority AS priority FROM cur"""

ORACLES["latest_prices"] = f"""{CHANGES}
SELECT 'customer_' || o_custkey || '_bytes' AS metric_name, o_orderdate AS creation_time,
  (o_custkey % 7)::DOUBLE AS base_cost, o_totalprice / 1e14::DOUBLE AS cost_factor FROM cur"""

ORACLES["rule_changelog"] = f"""{CHANGES}
SELECT 'customer-' || o_custkey AS rule_id, o_orderdate AS creation_time, o_orderpriority AS priority FROM cur"""

ORACLES["price_changelog"] = f"""{CHANGES}
SELECT 'customer_' || o_custkey || '_bytes' AS metric_name, (o_custkey % 7)::DOUBLE AS base_cost,
  o_totalprice / 1e14::DOUBLE AS cost_factor FROM cur"""

ORACLES["rules_from_json"] = """
SELECT 'id-' || s_suppkey AS rule_id, 'TOPIC' AS entity_type, 'supplier-' || s_suppkey AS regex,
  '{"name":"' || s_name || '","nation":"' || s_nationkey || '"}' AS context_json FROM supplier"""

ORACLES["prices_from_json"] = """
SELECT 'part_' || p_partkey || '_bytes' AS metric_name, p_size::DOUBLE AS base_cost,
  p_retailprice / 1000::DOUBLE AS cost_factor FROM part"""

ORACLES["labelled_metrics"] = f"""{LAB}
SELECT event_time, entity_type, name, metric AS initial_metric_name, value, context_json FROM lab"""

ORACLES["labelled_by_segments"] = f"""{LAB}
SELECT entity_type, context_json, count(*) AS n, round(sum(value), 6) AS value FROM lab GROUP BY ALL"""

ORACLES["context_ranges"] = f"""
WITH {EV},{RULES},
nm AS (SELECT DISTINCT entity_type, name FROM ev),
m AS (SELECT nm.*, coalesce(vf, TIMESTAMP '1000-01-01') AS lo, coalesce(vu, TIMESTAMP '9999-12-31') AS hi
  FROM nm JOIN rules ON etype = entity_type AND regexp_full_match(name, rx, 'i')),
b AS (SELECT entity_type, name, lo AS b FROM m UNION SELECT entity_type, name, hi FROM m),
sg AS (SELECT row_number() OVER () AS sid, * FROM (
  SELECT entity_type, name, b AS event_time, lead(b) OVER (PARTITION BY entity_type, name ORDER BY b) AS until
  FROM b) WHERE until IS NOT NULL),{label_ctes('sg', 'sgl', 'sid')}
SELECT entity_type, name, strftime(event_time, '%Y-%m-%d') AS seg_from, strftime(until, '%Y-%m-%d') AS seg_until,
  context_json FROM sgl WHERE context_json <> '{{}}'"""

ORACLES["labelled_at_scale"] = """
SELECT r_name AS region, n_name AS nation, count(*) AS n, round(sum(l_quantity), 6) AS value
FROM lineitem LEFT JOIN (supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  ON l_suppkey = s_suppkey GROUP BY ALL"""

ORACLES["labelled_open_rules"] = """
SELECT 'zone-' || (l_partkey % 500) AS zone, 'b' || (l_partkey % 1000) || '.' AS bay, count(*) AS n,
  round(sum(l_quantity), 6) AS value FROM lineitem GROUP BY ALL"""

ORACLES["labelled_rule_history"] = """
WITH v AS (SELECT o_orderdate AS since, arg_max(o_orderpriority, lpad(o_orderkey::VARCHAR, 12, '0')) AS priority
  FROM orders GROUP BY ALL)
SELECT 'ledger-' || l_returnflag AS name,
  CASE WHEN l_shipdate < since + INTERVAL 30 DAY THEN priority ELSE 'none' END AS priority,
  count(*) AS n, round(sum(l_quantity), 6) AS value
FROM lineitem ASOF LEFT JOIN v ON l_shipdate >= since GROUP BY ALL"""

ORACLES["rejected_rules"] = """
SELECT 'rule-' || s_suppkey AS rule_id, '(supplier-' || s_suppkey AS regex FROM supplier WHERE s_suppkey % 7 = 0"""

ORACLES["template_missing_group"] = f"""{LAB}
SELECT name, {j('raw')} AS raw, {j('zone')} AS zone, count(*) AS n FROM lab WHERE {j('zone')} IS NOT NULL GROUP BY ALL"""

ORACLES["context_probe"] = f"""
WITH {RULES},
s AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'SA-' || user_id
  ELSE 'stage1.app1.subject' || user_id || '.v1' END AS name FROM events),
p AS (SELECT row_number() OVER () AS pid, name, entity_type, TIMESTAMP '2024-01-20' AS event_time
  FROM s, (VALUES ('TOPIC'), ('PRINCIPAL')) e(entity_type)),{label_ctes('p', 'pl', 'pid')}
SELECT name, entity_type, context_json FROM pl"""

for _policy in ("fallback", "drop", "pass"):
    ORACLES[f"split_{_policy}"] = f"""{LAB},{split_ctes(_policy)}
SELECT entity_type, name, metric AS initial_metric_name, context_json, count(*) AS n, round(sum(value), 6) AS value
FROM shares GROUP BY ALL"""

ORACLES["split_facts"] = f"""{SPLIT_FACTS}
SELECT start_time, entity_type, name, initial_metric_name, context_json, target, round(value, 6) AS value,
  round(cost, 6) AS cost FROM facts"""

ORACLES["hourly_sum_max"] = f"""{FACTS}
SELECT start_time, end_time, entity_type, name, initial_metric_name, tags, context_json,
  round(value, 6) AS value FROM facts"""

ORACLES["hourly_cost_by_context"] = f"""{FACTS}
SELECT start_time, coalesce({j('app')}, 'unknown') AS app, coalesce({j('cost-unit')}, 'unknown') AS cost_unit,
  round(sum(value), 6) AS value, round(sum(cost), 6) AS cost FROM facts GROUP BY ALL"""

SERIES = f"""
WITH {EV},
ser AS (SELECT event_time, metric AS name, value,
  CASE WHEN entity_type = 'TOPIC' THEN '{{"env":"dev","source":"metric-api","topic":"' || name || '"}}'
    ELSE '{{"env":"dev","source":"metric-api"}}' END AS tags_json
  FROM ev WHERE metric IN ('svc_click_bytes', 'svc_view_bytes', 'svc_error_bytes'))"""

ORACLES["selected_series"] = f"{SERIES} SELECT event_time, name, tags_json, value FROM ser"

ALL_SERIES = f"""
WITH {EV},
ser AS (SELECT event_time, metric AS name, value, '{{"env":"dev"' || coalesce(',"k":"' || (props->>'$.k') || '"', '')
  || CASE entity_type WHEN 'TOPIC' THEN ',"topic":"' || name || '"' WHEN 'PRINCIPAL' THEN ',"principal_id":"' || name || '"'
    ELSE '' END || '}}' AS tags_json FROM ev)"""

ORACLES["series_max"] = f"""{ALL_SERIES}
SELECT date_trunc('hour', event_time)::TIMESTAMP AS period_start, name, tags_json, max(value) AS value
FROM ser GROUP BY ALL"""

ORACLES["series_diff"] = f"""{ALL_SERIES}
SELECT date_trunc('hour', event_time)::TIMESTAMP AS period_start, name, tags_json,
  round(arg_max(value, (event_time, value)) - arg_min(value, (event_time, value)), 6) AS value FROM ser GROUP BY ALL"""

ORACLES["priced_lines"] = f"""{LF}
SELECT start_time, end_time, name, initial_metric_name, context_json, round(value, 6) AS value,
  round(cost, 6) AS cost FROM lf"""

_book = ", ".join(f"({i}, '{m}', {b!r}::DOUBLE, {f!r}::DOUBLE)" for i, (m, b, f) in enumerate(DEFAULT_PRICE_BOOK))
ORACLES["default_prices"] = f"""
WITH book(i, metric, base, factor) AS (VALUES {_book}),
w AS (SELECT coalesce(metric, 'other') AS initial_metric_name, base, factor, sum(l_quantity) * 1e9::DOUBLE AS value
  FROM lineitem LEFT JOIN book ON i = l_partkey % {len(DEFAULT_PRICE_BOOK) + 1} GROUP BY ALL)
SELECT initial_metric_name, round(value, 6) AS value, round(base + factor * value, 6) AS cost FROM w"""

ORACLES["windowed_records"] = f"""{LF}
SELECT start_time, name, initial_metric_name, round(value, 6) AS value, round(cost, 6) AS cost, region FROM lf"""

ORACLES["fact_ids"] = f"{FACTS} SELECT row_id, target, round(value, 6) AS value FROM facts"

ORACLES["table_friendly"] = f"""{FACTS}
SELECT start_time, end_time, initial_metric_name, entity_type, name, tags, context_json AS context,
  round(value, 6) AS value, round(cost, 6) AS cost FROM facts"""

VERSIONED = """
WITH v AS (
  SELECT l_shipdate AS start_time, l_shipdate + INTERVAL 1 DAY AS end_time, 'supplier-' || l_suppkey AS name,
    '{"flag":"' || l_returnflag || '"}' AS context_json, l_quantity AS value,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS version
  FROM lineitem),
vi AS (SELECT *, sha1(strftime(start_time, '%Y-%m-%dT%H:%M:%SZ') || strftime(end_time, '%Y-%m-%dT%H:%M:%SZ')
  || 'line_bytes' || 'TOPIC' || name || '{}' || context_json || 'unknown') AS row_id FROM v)"""

ORACLES["upsert_by_row_id"] = f"""{VERSIONED}
SELECT start_time, name, context_json, row_id, value FROM vi
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY version DESC) = 1"""

ORACLES["upsert_by_window_key"] = f"""{VERSIONED}
SELECT start_time, name, context_json, value FROM vi
QUALIFY row_number() OVER (PARTITION BY start_time, end_time, name ORDER BY version DESC) = 1"""

ORACLES["stored_facts"] = f"""{LF}
SELECT start_time, name, initial_metric_name, round(value, 6) AS value FROM lf"""

ORACLES["stored_facts_range"] = f"""{LF}
SELECT initial_metric_name, count(*) AS n, min(start_time) AS oldest, round(sum(value), 6) AS value FROM lf
WHERE start_time >= TIMESTAMP '1996-01-01' AND end_time <= TIMESTAMP '1997-01-01' GROUP BY ALL"""

ORACLES["stored_by_window_key"] = f"""{LF}
SELECT initial_metric_name, initial_metric_name <> 'line_A_bytes' AS before, count(*) AS n,
  round(sum(CASE WHEN initial_metric_name = 'line_A_bytes' THEN value ELSE 0 END), 6) AS value FROM lf GROUP BY ALL"""

ORACLES["retention_kept"] = f"""{LF}
SELECT initial_metric_name, count(*) AS n, min(start_time) AS oldest, round(sum(value), 6) AS value
FROM lf WHERE epoch_ms(start_time) // 2419200000 >= epoch_ms(TIMESTAMP '1998-06-15') // 2419200000 GROUP BY ALL"""

ORACLES["range_export"] = f"""{FACTS}
SELECT initial_metric_name, entity_type, name, tags, context_json AS context, round(value, 6) AS value, target,
  row_id AS id FROM facts WHERE {E_RANGE}"""

for _fmt in ("json", "csv", "parquet"):
    ORACLES[f"import_roundtrip_{_fmt}"] = f"""{FACTS}
SELECT start_time, initial_metric_name, entity_type, name, context_json, target, row_id, round(value, 6) AS value
FROM facts WHERE {E_RANGE}"""

ORACLES["reprocessed_facts"] = f"""{FACTS}
SELECT start_time, row_id, round(value, 6) AS value, round(cost, 6) AS cost FROM facts
WHERE start_time >= TIMESTAMP '2024-01-10 07:00:00'"""

ORACLES["metric_keys"] = f"""
WITH {EV} SELECT concat_ws(':', metric, CASE WHEN entity_type <> 'UNKNOWN' THEN name END) AS record_key, count(*) AS n
FROM ev GROUP BY ALL"""

ORACLES["aggregated_export"] = f"""{LF},
g AS (SELECT coalesce(nation, 'unknown') AS nation, initial_metric_name AS m, sum(value) AS v FROM lf
  WHERE {S_RANGE} GROUP BY ALL),
p AS (SELECT *, v / sum(v) OVER (PARTITION BY m) * 100 AS pc FROM g)
SELECT nation, {", ".join(f"round(max(CASE WHEN m = 'line_{s}_bytes' THEN v END), 6) AS {s}_bytes, "
  f"round(max(CASE WHEN m = 'line_{s}_bytes' THEN pc END), 2) AS {s}_percent" for s in "ANR")}
FROM p GROUP BY nation"""

ORACLES["metric_names"] = f"""{FACTS}
SELECT initial_metric_name AS metric_name, max(end_time) AS last_seen,
  CASE WHEN initial_metric_name = 'svc_error_bytes' THEN 'MAX' ELSE 'SUM' END AS aggregation_type
FROM facts GROUP BY ALL"""

ORACLES["raw_metric_names"] = f"""
WITH {EV} SELECT metric AS metric_name, max(event_time) AS last_seen,
  CASE WHEN metric = 'svc_error_bytes' THEN 'MAX' ELSE 'SUM' END AS aggregation_type FROM ev GROUP BY ALL"""

ORACLES["distinct_metrics"] = f"{LF} SELECT DISTINCT initial_metric_name FROM lf"

ORACLES["context_keys"] = f"""{FACTS}
SELECT DISTINCT unnest(json_keys(context_json)) AS context_key FROM facts"""

ORACLES["context_values"] = f"""{FACTS}
SELECT DISTINCT {j('app')} AS context_value FROM facts WHERE {j('app')} IS NOT NULL"""

ORACLES["tag_keys"] = f"""
WITH {EV} SELECT DISTINCT unnest(CASE entity_type WHEN 'TOPIC' THEN ['env', 'k', 'topic']
  WHEN 'PRINCIPAL' THEN ['env', 'k', 'principal_id'] ELSE ['env', 'k'] END) AS tag_key FROM ev"""

ORACLES["tag_values"] = f"WITH {EV} SELECT DISTINCT name AS tag_value FROM ev WHERE entity_type = 'TOPIC'"

ORACLES["picked_context"] = f"""{FACTS},
p AS (SELECT '{{' || concat_ws(',', CASE WHEN {j('app')} IS NOT NULL THEN '"app":"' || {j('app')} || '"' END,
  CASE WHEN {j('cost-unit')} IS NOT NULL THEN '"cost-unit":"' || {j('cost-unit')} || '"' END) || '}}' AS context_json
  FROM facts)
SELECT context_json, count(*) AS n FROM p GROUP BY ALL"""

ORACLES["history_raw"] = f"""{FACTS}
SELECT start_time, end_time, name, initial_metric_name, row_id, round(value, 6) AS value FROM facts
WHERE {E_RANGE} AND initial_metric_name IN ('svc_click_bytes', 'svc_error_bytes')"""

ORACLES["history_series"] = f"""{LF}
SELECT name, 0::BIGINT AS chunk, string_agg(strftime(start_time, '%Y%m%d'), ',' ORDER BY start_time) AS times,
  string_agg(CAST(value::BIGINT AS VARCHAR), ',' ORDER BY start_time) AS "values"
FROM lf WHERE {S_RANGE} AND initial_metric_name = 'line_R_bytes' GROUP BY name"""

ORACLES["history_series_chunks"] = f"""{LF},
p AS (SELECT region AS name, date_trunc('month', start_time)::TIMESTAMP AS moment, value FROM lf
  WHERE {S_RANGE.replace('start_time', "date_trunc('month', start_time)::TIMESTAMP")} AND initial_metric_name = 'line_R_bytes'),
c AS (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY moment, value) - 1) // 50 AS chunk FROM p)
SELECT name, chunk, CAST(count(*) AS INTEGER) AS n, min(moment) AS first, max(moment) AS last, round(sum(value), 6) AS value
FROM c GROUP BY ALL"""

ORACLES["history_grouped_auto"] = f"""{FACTS}
SELECT coalesce({j('app')}, 'unknown') AS name,
  time_bucket(INTERVAL 24 HOUR, start_time, TIMESTAMP '2024-01-03') AS time, round(sum(value), 6) AS value
FROM facts WHERE {E_RANGE} GROUP BY ALL"""

ORACLES["history_grouped_hours"] = f"""{FACTS}
SELECT coalesce({j('cost-unit')}, 'unknown') AS name,
  time_bucket(INTERVAL 7 HOUR, start_time, TIMESTAMP '2024-01-03') AS time, round(sum(value), 6) AS value
FROM facts WHERE {E_RANGE} AND initial_metric_name = 'svc_view_bytes' GROUP BY ALL"""

ORACLES["history_grouped_single"] = f"""{LF}
SELECT coalesce(region, 'unknown') AS name, TIMESTAMP '1996-01-01' AS time, round(sum(value), 6) AS value
FROM lf WHERE {S_RANGE} AND initial_metric_name = 'line_A_bytes' GROUP BY ALL"""

ORACLES["history_two_keys"] = f"""{LF}
SELECT coalesce(region, 'unknown') AS name, coalesce(nation, 'unknown') AS nation,
  time_bucket(INTERVAL 8760 HOUR, start_time, TIMESTAMP '1996-01-01') AS time, round(sum(value), 6) AS value
FROM lf WHERE {S_RANGE} GROUP BY ALL"""

ORACLES["metric_totals"] = f"""{FACTS}
SELECT initial_metric_name, round(sum(value), 6) AS total FROM facts WHERE {E_RANGE} GROUP BY ALL"""

ORACLES["share_table_1key"] = f"""{FACTS},
g AS (SELECT initial_metric_name AS metric, {j('app')} AS app, sum(value) AS total FROM facts WHERE {E_RANGE} GROUP BY ALL)
SELECT metric, coalesce(app, '<unknown>') AS app, round(total, 6) AS total,
  round(total / sum(total) OVER (PARTITION BY metric), 6) AS percentage FROM g"""

ORACLES["share_table_2keys"] = f"""{LF},
g AS (SELECT initial_metric_name AS metric, region, nation, sum(value) AS total FROM lf
  WHERE start_time >= TIMESTAMP '1996-01-01' GROUP BY ALL)
SELECT metric, coalesce(region, '<unknown>') AS region, coalesce(nation, '<unknown>') AS nation,
  round(total, 6) AS total, round(total / sum(total) OVER (PARTITION BY metric), 6) AS percentage FROM g"""

ORACLES["share_csv"] = f"""{FACTS},
g AS (SELECT initial_metric_name AS metric, {j('stage')} AS stage, {j('cost-unit')} AS cost_unit, sum(value) AS total
  FROM facts GROUP BY ALL)
SELECT metric, coalesce(stage, '<unknown>') AS stage, coalesce(cost_unit, '<unknown>') AS cost_unit,
  round(total, 6) AS total, round(total / sum(total) OVER (PARTITION BY metric), 6) AS percentage FROM g"""

ORACLES["bill_lines"] = f"WITH {BILLS} SELECT bill_id, period_from, period_to, metric, cents FROM bills"

ORACLES["bill_allocation"] = f"""{LF},{BILLS},{alloc(['nation', 'region'])}
SELECT bill_id, metric, nation, region, name, round(price, 3) AS price FROM alloc"""

ORACLES["bill_all_keys"] = ORACLES["bill_allocation"]

ORACLES["bill_edges"] = f"""{LF},{BILLS},{alloc(['nation'])}
SELECT bill_id, 'total' AS source, 'line_A_bytes' AS target, round(storage, 6) AS value FROM bills_wide UNION ALL
SELECT bill_id, 'total', 'line_R_bytes', round(network_read, 6) FROM bills_wide UNION ALL
SELECT bill_id, 'total', 'line_N_bytes', round(network_write, 6) FROM bills_wide UNION ALL
SELECT bill_id, 'total', 'other', round(total - storage - network_read - network_write, 6) FROM bills_wide UNION ALL
SELECT bill_id, metric, name, round(price / 100, 3) FROM alloc WHERE price >= 10"""

ORACLES["bill_check"] = f"""
WITH {BILLS} SELECT bill_id, total, total - storage - network_read - network_write AS other,
  total > 0 AND abs(storage + network_read + network_write - total) > 0.01 AS mismatch FROM bills_wide"""

ORACLES["series_matrix"] = f"""{FACTS},{DAILY}
SELECT time, {", ".join(f"round(nullif(sum(CASE WHEN name = '{n}' THEN value END), 0), 6) AS {n}"
  for n in ("alpha", "beta", "unknown"))} FROM daily GROUP BY time"""

ORACLES["series_normalized"] = f"""{FACTS},{DAILY}
SELECT time, name, round(value / sum(value) OVER (PARTITION BY time) * 100, 6) AS percent FROM daily WHERE value <> 0"""

ORACLES["series_csv"] = f"""{LF},
h AS (SELECT coalesce(region, 'unknown') AS name, time_bucket(INTERVAL 720 HOUR, start_time, TIMESTAMP '1996-01-01') AS time,
  round(sum(value), 1) AS value FROM lf WHERE {S_RANGE} GROUP BY ALL)
SELECT strftime(time, '%Y-%m-%dT%H:%M:%SZ') || ',' || name || ',' || CAST(value AS VARCHAR) AS line FROM h"""

ORACLES["series_totals"] = f"{FACTS},{DAILY} SELECT name, round(sum(value), 6) AS total FROM daily GROUP BY name"

ORACLES["gauge_snapshot"] = f"""{FACTS},{GAUGE}
SELECT name, tags_json, round(value, 6) AS value, last_seen FROM snap"""

ORACLES["active_gauges"] = f"""{FACTS},{GAUGE}
SELECT name, tags_json, round(value, 6) AS value FROM snap
WHERE last_seen + INTERVAL 86430 SECOND >= (SELECT max(last_seen) FROM snap)"""

PANEL = f"""{SPLIT_FACTS},
pg AS (SELECT 'usage_' || initial_metric_name AS gauge, entity_type, name, context_json, value, start_time,
  CASE WHEN entity_type = 'PRINCIPAL' THEN name ELSE coalesce({j('principal')}, '') END AS principal,
  CASE WHEN entity_type = 'TOPIC' THEN name ELSE coalesce({j('topic')}, '') END AS topic FROM facts),
px AS (SELECT gauge, principal, topic, max(value) AS value FROM pg WHERE principal <> 'unknown'
  GROUP BY gauge, principal, topic, entity_type, name, context_json)"""

ORACLES["panel_sum_by_principal"] = f"""{PANEL}
SELECT principal, round(sum(value), 6) AS value FROM px WHERE gauge = 'usage_svc_click_bytes' GROUP BY ALL"""

ORACLES["panel_max_by_topic"] = f"""{PANEL}
SELECT topic, round(max(value), 6) AS value FROM pg WHERE gauge = 'usage_svc_view_bytes' AND principal <> 'unknown'
  AND start_time <= TIMESTAMP '2024-01-20 12:00:00' AND start_time > TIMESTAMP '2024-01-15 12:00:00' GROUP BY ALL"""

ORACLES["panel_share"] = f"""{PANEL}
SELECT 'sa-1' AS principal, round(sum(CASE WHEN principal = 'sa-1' THEN value END) / nullif(sum(value), 0), 6) AS share
FROM px WHERE gauge = 'usage_svc_click_bytes'"""

ORACLES["label_values"] = f"""{PANEL}
SELECT DISTINCT principal AS label FROM pg WHERE principal <> ''"""

ORACLES["topic_access"] = f"""
WITH {ACL},
g AS (SELECT usr, bool_or(ar) AS can_read, bool_or(aw) AS can_write FROM a WHERE scope = '*' GROUP BY usr)
SELECT topic, usr AS "user", can_read, can_write FROM pairs WHERE special UNION ALL
SELECT '*', usr, can_read, can_write FROM g"""

ORACLES["access_long_prefix"] = """
WITH t AS (SELECT DISTINCT p_brand || '.' || repeat('x', 300) || '.' || p_size AS topic, p_brand FROM part)
SELECT 'user-' || s_suppkey AS "user", length(topic)::INTEGER AS topic_length, md5(topic) AS topic_md5, true AS can_read, false AS can_write
FROM t JOIN supplier ON p_brand = 'Brand#' || (s_suppkey % 25 + 1) WHERE s_suppkey % 13 <> 0"""

ORACLES["recalculated_rules"] = f"WITH {ACL} SELECT rule_id, regex FROM gen WHERE size % 3 <> 1"

OLD_ACL = (
    ACL.replace("max(p_size) AS size", "max(p_size) + CASE WHEN max(p_size) % 17 = 0 THEN 1 ELSE 0 END AS size")
    .replace("s_suppkey % 11 = 0", "s_suppkey % 11 = 0 OR (s_suppkey % 3 = 0 AND s_suppkey % 5 IN (0, 1, 4))")
    .replace("k % 5 = 0", "k % 5 = 0 AND k % 4 <> 1")
    .replace("k % 5 = 1", "k % 5 = 1 AND k % 4 <> 1")
)
ORACLES["recalculated_changes"] = f"""
WITH {ACL},
before AS (WITH {OLD_ACL} SELECT rule_id, context_json FROM gen)
SELECT gen.rule_id, regex, gen.context_json FROM gen JOIN before USING (rule_id)
WHERE gen.context_json <> before.context_json"""

ORACLES["generated_rules"] = f"WITH {ACL} SELECT rule_id, entity_type, regex, context_json FROM gen"

ORACLES["changed_rules"] = f"WITH {ACL} SELECT rule_id, regex FROM gen WHERE size % 3 <> 1"

ORACLES["schema_counts"] = """
WITH s AS (SELECT DISTINCT p_brand || '-' || p_type || CASE p_partkey % 4 WHEN 0 THEN '-key' WHEN 1 THEN '-value'
  WHEN 2 THEN '' ELSE '-value-key' END AS subject, p_size AS version FROM part)
SELECT TIMESTAMP '2024-01-01' AS event_time, 'kafka.topic.schema.count' AS name, count(*) AS schemas,
  '{"kafka_id":"lkc-1","topic":"' || regexp_replace(regexp_replace(subject, '-value$', ''), '-key$', '') || '"}' AS tags_json
FROM s WHERE subject LIKE '%-key' OR subject LIKE '%-value' GROUP BY tags_json"""

ORACLES["partition_counts"] = """
SELECT 'supplier-' || l_suppkey AS name, 'TOPIC' AS entity_type, 'kafka.topic.partition.count' AS initial_metric_name,
  count(DISTINCT l_linenumber)::DOUBLE AS value FROM lineitem GROUP BY l_suppkey"""

ORACLES["metric_counts"] = f"WITH {EV} SELECT metric AS name, count(*) AS sent FROM ev GROUP BY ALL"

ORACLES["flattened_pages"] = """
SELECT date_trunc('second', ts)::TIMESTAMP AS "timestamp",
  CASE (event_id // 100) % 3 WHEN 0 THEN 'PRINCIPAL' ELSE 'TOPIC' END AS entity_type, 'id-' || user_id AS name,
  'vendor_server_sent_bytes' AS initial_metric_name, count(*) AS n, sum(floor(value)) AS value
FROM events WHERE (event_id // 100) % 3 <> 2 GROUP BY ALL"""

ORACLES["rollup_daily"] = f"""{FACTS}
SELECT date_trunc('day', start_time)::TIMESTAMP AS period_start, initial_metric_name, {j('app')} AS app,
  round(CASE WHEN initial_metric_name = 'svc_error_bytes' THEN max(value) ELSE sum(value) END, 6) AS value,
  round(sum(cost), 6) AS cost FROM facts GROUP BY period_start, initial_metric_name, app"""

ORACLES["rollup_monthly"] = f"""{LF}
SELECT date_trunc('month', start_time)::TIMESTAMP AS period_start, initial_metric_name, region,
  round(CASE WHEN initial_metric_name = 'line_N_bytes' THEN max(value) ELSE sum(value) END, 6) AS value,
  round(sum(cost), 6) AS cost FROM lf GROUP BY period_start, initial_metric_name, region"""

ORACLES["rollup_maintained"] = ORACLES["rollup_monthly"]

ORACLES["unclassified_entities"] = f"""{FACTS}
SELECT entity_type, name, count(*) AS windows FROM facts GROUP BY ALL HAVING bool_and(context_json = '{{}}')"""

ORACLES["backtest_prices"] = f"""{LF},
ph AS (SELECT 'line_' || CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END || '_bytes' AS metric,
  date_trunc('year', o_orderdate)::TIMESTAMP + INTERVAL 1 YEAR AS since, count(*) / 1000.0::DOUBLE AS factor
  FROM orders GROUP BY ALL),
pi AS (SELECT *, lead(since) OVER (PARTITION BY metric ORDER BY since) AS until FROM ph)
SELECT initial_metric_name, CAST(year(start_time) AS INTEGER) AS year, count(*) AS n,
  round(sum(0.5::DOUBLE + factor * value), 6) AS cost
FROM lf LEFT JOIN pi ON metric = initial_metric_name AND start_time >= since AND (until IS NULL OR start_time < until)
GROUP BY ALL"""

ORACLES["base_charge"] = f"""{FACTS}
SELECT name AS principal, count(DISTINCT start_time) AS hours, count(DISTINCT start_time) * 0.5::DOUBLE AS cost
FROM facts WHERE entity_type = 'PRINCIPAL' GROUP BY ALL"""

ORACLES["usage_by_cluster_principal"] = f"""
WITH {CLUSTER}
SELECT kafka_id, principal_id, sum(CASE WHEN m = 'request' THEN value END) AS produced_bytes,
  sum(CASE WHEN m = 'response' THEN value END) AS fetched_bytes
FROM cr WHERE (m = 'request' AND typ = 'Produce') OR (m = 'response' AND typ = 'Fetch') GROUP BY ALL"""

ORACLES["usage_by_cluster_topic"] = f"""
WITH {CLUSTER}
SELECT kafka_id, topic, min(CASE WHEN m = 'retained' THEN value END) AS retained_bytes_min,
  max(CASE WHEN m = 'retained' THEN value END) AS retained_bytes_max,
  coalesce(string_agg(DISTINCT cg, ',' ORDER BY cg) FILTER (m = 'lag'), '') AS consumergroups
FROM cr WHERE m IN ('retained', 'lag') GROUP BY ALL"""

ORACLES["gap_filled"] = f"""{FACTS},
h AS (SELECT coalesce({j('app')}, 'unknown') AS name, start_time AS time, sum(value) AS value FROM facts
  WHERE {E_RANGE} GROUP BY ALL),
g AS (SELECT name, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM h GROUP BY name)
SELECT g.name, g.time, round(last_value(h.value IGNORE NULLS) OVER (PARTITION BY g.name ORDER BY g.time
  ROWS UNBOUNDED PRECEDING), 6) AS value, h.value IS NULL AS is_filled
FROM g LEFT JOIN h USING (name, time)"""

ORACLES["weighted_share"] = f"""{LF},
w AS (SELECT coalesce(region, 'unknown') AS name, sum(value * CASE initial_metric_name WHEN 'line_A_bytes'
  THEN 1.0::DOUBLE ELSE 2.4::DOUBLE END) AS weighted FROM lf
  WHERE initial_metric_name IN ('line_A_bytes', 'line_R_bytes') GROUP BY ALL)
SELECT name, round(weighted, 6) AS weighted, round(weighted / sum(weighted) OVER (), 6) AS share FROM w"""

ORACLES["unit_category_summary"] = f"""{LF},
c AS (SELECT date_trunc('year', start_time)::TIMESTAMP AS period_start, coalesce(region, 'unknown') AS unit,
  CASE WHEN initial_metric_name = 'line_A_bytes' THEN 'storage' ELSE 'transfer' END AS category, value, cost FROM lf)
SELECT period_start, unit, category, round(sum(value), 6) AS value, round(sum(cost), 6) AS cost,
  CAST(grouping(period_start, unit, category) AS INTEGER) AS level
FROM c GROUP BY GROUPING SETS ((period_start, unit, category), (period_start, unit), (period_start))"""

# Run once on one batch of input, the stream gives the batch result.
ORACLES["stream_equals_batch"] = f"""{FACTS}
SELECT start_time, entity_type, name, initial_metric_name, context_json, round(value, 6) AS value,
  round(cost, 6) AS cost FROM facts"""

ORACLES["stream_in_steps"] = f"""{FACTS}
SELECT sink, initial_metric_name AS metric, count(*) AS n, round(sum(value), 6) AS value
FROM facts, (VALUES ('facts'), ('table_friendly'), ('windowed')) s(sink) GROUP BY ALL"""

ORACLES["live_gauges"] = f"""{FACTS},{GAUGE}
SELECT name, tags_json, round(value, 6) AS value, last_seen FROM snap
WHERE last_seen + INTERVAL 3630 SECOND >= (SELECT max(last_seen) FROM snap)"""

# The batches are cut by event time, so the rule that comes with the third one labels what is from then on.
ORACLES["stream_remembered_labels"] = rf"""{LAB}
SELECT entity_type, name, {j('app')} AS app, {j('team')} AS team, {j('cost-unit')} AS cost_unit, {j('zone')} AS zone,
  CASE WHEN event_time >= TIMESTAMP '2024-01-20' AND entity_type = 'TOPIC' AND regexp_full_match(name, '.*\.app[0-2]\..*')
    THEN 'second' END AS epoch,
  count(*) AS n, round(sum(value), 6) AS value FROM lab GROUP BY ALL"""

ORACLES["stream_reprocessed"] = f"""{FACTS}
SELECT start_time, entity_type, name, initial_metric_name, context_json, round(value, 6) AS value,
  round(CASE WHEN initial_metric_name = 'svc_click_bytes' AND start_time >= TIMESTAMP '2024-01-15 10:00:00'
    THEN 0.1 + 0.07 * value ELSE cost END, 6) AS cost FROM facts"""

ORACLES["paged_files"] = ORACLES["flattened_pages"]

ORACLES["split_by_default_map"] = f"""{SPLIT_FACTS}
SELECT entity_type, name, CASE initial_metric_name WHEN 'svc_click_bytes' THEN 'kafka_server_brokertopicmetrics_bytesout_total'
  WHEN 'svc_view_bytes' THEN 'kafka_server_brokertopicmetrics_bytesin_total' ELSE initial_metric_name END AS initial_metric_name,
  count(*) AS n, round(sum(value), 6) AS value FROM facts GROUP BY ALL"""
