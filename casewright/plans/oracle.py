"""The registered queries in SQL, written independently of the operators.

Pairs are found by comparing every two events of a scope, graphs by recursive
queries, and so on: the plain meaning, not the plan.
"""

from __future__ import annotations

from casewright import vocab
from casewright.plans.derived import CASE_STEPS, HYPOTHESIS_STEPS
from casewright.plans.testview import SEC_SQL

SQL: dict[str, str] = {}

SEC = "WITH RECURSIVE " + SEC_SQL


def _texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _rows(rows) -> str:
    """A VALUES list of texts and text lists."""
    cell = lambda v: _texts(v) if isinstance(v, list) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _band(col: str, names) -> str:
    return (
        f"CASE WHEN {col} >= 85 THEN '{names[0]}' WHEN {col} >= 70 THEN '{names[1]}' "
        f"WHEN {col} >= 40 THEN '{names[2]}' ELSE '{names[3]}' END"
    )


STRENGTH = _band("severity", ("critical", "strong", "moderate", "weak"))

# -- evidence ------------------------------------------------------------------------------------

EV = SEC + f""",
ev AS (
  SELECT *, 'E-' || event_id AS evidence_id, category AS evidence_type, {STRENGTH} AS strength,
    event_type || CASE category
      WHEN 'process' THEN ': ' || pname || ' (PID ' || pid || ')'
      WHEN 'network' THEN ': ' || src_ip || ' → ' || dst_ip
      WHEN 'dns' THEN ': DNS ' || dns_query
      WHEN 'file' THEN ': ' || file_path
      ELSE ': ' || reg_key END AS title,
    event_type || ' detected on ' || host || ' (severity ' || severity || ').' AS description,
    CAST(CASE reliability WHEN 'completely_reliable' THEN 1.0 WHEN 'usually_reliable' THEN 0.85
      WHEN 'fairly_reliable' THEN 0.7 WHEN 'not_usually_reliable' THEN 0.5 WHEN 'unreliable' THEN 0.3
      WHEN 'cannot_be_judged' THEN 0.2 ELSE 0.5 END AS DOUBLE) AS confidence
  FROM sec)"""

SQL["evidence_from_events"] = EV + """
SELECT case_id, evidence_id, evidence_type, strength, title, description, confidence,
  epoch_us(ts) AS observed_at, true AS has_context FROM ev"""

SQL["evidence_hash_check"] = SEC + """
SELECT tenant_id, count(*) AS n, count(*) AS ok, count(DISTINCT event_id) AS hashes FROM sec GROUP BY 1"""

SQL["evidence_summary"] = EV + """
SELECT tenant_id, 'total' AS dimension, 'all' AS value, count(*) AS items FROM ev GROUP BY 1
UNION ALL SELECT tenant_id, 'strength', strength, count(*) FROM ev GROUP BY 1, 3
UNION ALL SELECT tenant_id, 'type', evidence_type, count(*) FROM ev GROUP BY 1, 3"""

SQL["evidence_highlighted"] = EV + """,
t AS (SELECT *, CASE WHEN strength IN ('strong', 'critical') THEN 0 ELSE 1 END AS tier FROM ev),
b AS (SELECT *, min(tier) OVER (PARTITION BY case_id) AS best FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, evidence_id) AS rank FROM b WHERE tier = best)
SELECT case_id, rank, evidence_id, strength, title FROM r WHERE rank <= 3"""

SQL["evidence_verified"] = EV + """
SELECT evidence_id, strength, severity % 6 = 0 AS verified, CASE WHEN severity % 6 = 0 THEN 'analyst' END AS verified_by,
  CASE WHEN severity % 6 = 0 THEN 'review' END AS method FROM ev"""

SQL["category_inference"] = SEC + """
SELECT category AS given, CASE category WHEN 'network' THEN 'process' WHEN 'dns' THEN 'process' ELSE category END AS inferred,
  count(*) AS n FROM sec GROUP BY 1, 2"""

SQL["event_fingerprint_dups"] = SEC + """
SELECT sha256(CAST(json_object('category', category, 'command_line', NULL, 'dst_ip', dst_ip, 'event_type', event_type,
  'file_path', file_path, 'host', host, 'parent_name', parent_name, 'platform', 'windows', 'process_name', pname,
  'process_pid', pid, 'registry_key', reg_key, 'rule_id', rule_id, 'source', 'sysmon', 'src_ip', src_ip, 'user', usr)
  AS VARCHAR)) AS fingerprint, count(*) AS copies
FROM sec GROUP BY 1 HAVING count(*) > 1"""

# -- timeline --------------------------------------------------------------------------------------

SQL["timeline_window"] = SEC + """
SELECT event_id, epoch_us(ts) AS timestamp, category, severity, host, pname AS process_name,
  coalesce(array_to_string(techs, ','), '') AS mitre_techniques,
  CASE WHEN category = 'process' THEN event_type || ': ' || pname || ' (PID ' || pid || ')' ELSE event_type END AS summary
FROM sec WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""

SQL["timeline_for_host"] = SEC + """
SELECT event_id, epoch_us(ts) AS timestamp, category, severity FROM sec WHERE host = 'HOST-4'"""
SQL["timeline_since_until"] = SEC + """
SELECT event_id, epoch_us(ts) AS timestamp FROM sec WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09 12:00:00'"""
SQL["verdict_bands"] = SEC + """
SELECT event_id, CASE WHEN severity >= 70 THEN 'high priority' WHEN severity >= 40 THEN 'medium priority' ELSE 'low priority' END AS verdict FROM sec"""
SQL["timeline_high_severity"] = SEC + """
SELECT host, category, count(*) AS n, max(severity) AS top FROM sec WHERE severity >= 70 GROUP BY 1, 2"""

SQL["timeline_related_process"] = SEC + """
SELECT event_id, host, pid AS process_pid, ppid AS parent_pid FROM sec WHERE pid = 1042 OR ppid = 1042"""

SQL["timeline_dedup_first"] = SEC + """
SELECT event_id, epoch_us(ts) AS timestamp, 0 AS copy FROM sec"""

SQL["timeline_bounds_by_host"] = SEC + """
SELECT host, first(event_id ORDER BY ts, event_id) AS first_event, last(event_id ORDER BY ts, event_id) AS last_event,
  epoch_us(min(ts)) AS earliest, epoch_us(max(ts)) AS latest,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_seconds, count(*) AS events
FROM sec GROUP BY 1"""

# -- correlation -----------------------------------------------------------------------------------

_TESTS = [
    ("same_host", "lower(a.host) = lower(b.host)"),
    ("same_user", "lower(a.usr) = lower(b.usr)"),
    ("same_process_name", "lower(a.host) = lower(b.host) AND lower(a.pname) = lower(b.pname)"),
    ("same_process_id", "lower(a.host) = lower(b.host) AND a.pid = b.pid"),
    ("parent_child", "lower(a.host) = lower(b.host) AND (coalesce(a.ppid = b.pid, false) OR coalesce(b.ppid = a.pid, false))"),
    ("same_file_hash", "a.file_sha = b.file_sha"),
    ("same_file_path", "lower(a.file_path) = lower(b.file_path)"),
    ("same_source_ip", "a.src_ip = b.src_ip"),
    ("same_destination_ip", "a.dst_ip = b.dst_ip"),
    ("same_dns_query", "lower(a.dns_query) = lower(b.dns_query)"),
    ("same_registry_key", "lower(a.reg_key) = lower(b.reg_key)"),
    ("same_mitre_technique", "list_has_any(a.techs, b.techs)"),
    ("same_rule", "lower(a.rule_id) = lower(b.rule_id)"),
]


def pairs(scope: str, window: int = 300, mode: str = "or", least: float = 0.4, ordered: bool = True, base: str = SEC) -> str:
    """CTEs ending in ``pr``: every qualifying pair of a scope, by comparing all pairs in the window."""
    w = vocab.REASON_WEIGHTS
    flag = lambda n: f"CAST({n} AS INTEGER)"
    score = "least(1.0, " + " + ".join(f"CAST({w[n]} AS DOUBLE) * {flag(n)}" for n, _ in _TESTS) + ")"
    if mode == "or":
        confidence = "1.0 - " + " * ".join(f"(1.0 - CAST({w[n]} AS DOUBLE) * {flag(n)})" for n, _ in _TESTS)
    else:
        confidence = "greatest(" + ", ".join(f"CAST({w[n]} AS DOUBLE) * {flag(n)}" for n, _ in _TESTS) + ")"
    before = (
        f"(a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id)) AND b.ts <= a.ts + INTERVAL {window} SECOND"
        if ordered else
        f"a.event_id <> b.event_id AND b.ts <= a.ts + INTERVAL {window} SECOND AND b.ts >= a.ts - INTERVAL {window} SECOND"
    )
    return base + f""",
p0 AS (
  SELECT a.tenant_id, a.case_id, a.host, a.is_persist AS seed, a.event_id AS source_event_id, b.event_id AS related_event_id,
    abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS delta,
    {", ".join(f"coalesce({test}, false) AS {name}" for name, test in _TESTS)}
  FROM sec a JOIN sec b ON {scope} AND {before}),
p1 AS (
  SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN {n} THEN '{n}' END" for n, _ in _TESTS)}], lambda x: x IS NOT NULL), ',') AS reasons,
    {" + ".join(flag(n) for n, _ in _TESTS)} AS reason_count, {score} AS score, {confidence} AS confidence FROM p0),
pr AS (SELECT * FROM p1 WHERE reason_count >= 1 AND confidence >= {least} - 1e-9)"""


PAIR_COLUMNS = """source_event_id, related_event_id, reasons, reason_count, round(delta, 6) AS time_delta_seconds,
  round(score, 6) AS score, round(confidence, 6) AS confidence"""
PAIR_ORDER = "round(confidence, 9) DESC, round(score, 9) DESC, source_event_id, related_event_id"

SQL["pair_correlation"] = pairs("a.tenant_id = b.tenant_id") + f"""
SELECT tenant_id, {PAIR_COLUMNS} FROM pr"""

SQL["pair_correlation_max_mode"] = pairs("a.tenant_id = b.tenant_id", mode="max", least=0.3) + f"""
SELECT tenant_id, {PAIR_COLUMNS} FROM pr"""

SQL["correlation_top500"] = pairs("a.tenant_id = b.tenant_id") + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY {PAIR_ORDER}) AS rank FROM pr)
SELECT tenant_id, rank, {PAIR_COLUMNS} FROM r WHERE rank <= 500"""

#: Repeated deliveries add no pair.
SQL["pair_correlation_repeated_ids"] = SQL["pair_correlation"]

#: A thousand times denser: an hour of events in under four seconds.
DENSE = SEC + """,
packed AS (SELECT * REPLACE (make_timestamp(epoch_us(ts) // 1000) AS ts) FROM sec)"""
SQL["correlation_top_dense"] = pairs("a.tenant_id = b.tenant_id", base=DENSE).replace("FROM sec a JOIN sec b", "FROM packed a JOIN packed b") + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY {PAIR_ORDER}) AS rank FROM pr)
SELECT tenant_id, rank, {PAIR_COLUMNS} FROM r WHERE rank <= 50"""

_CASE_SCOPE = "a.case_id = b.case_id AND a.tenant_id = b.tenant_id"
_COUNTED = """
SELECT case_id, count(confidence) AS pairs, coalesce(round(sum(CAST(confidence AS DECIMAL(30, 12))), 6)::DOUBLE, 0) AS confidence_sum,
  count(*) FILTER (confidence < 0.5) AS weak_pairs
FROM (SELECT DISTINCT case_id FROM sec) LEFT JOIN pr USING (case_id) GROUP BY 1"""
SQL["pair_counts_by_case"] = pairs(_CASE_SCOPE) + _COUNTED
_DENSE_PAIRS = pairs(_CASE_SCOPE, base=DENSE).replace("FROM sec a JOIN sec b", "FROM packed a JOIN packed b")
SQL["pair_counts_dense"] = _DENSE_PAIRS + _COUNTED
SQL["best_pair_dense"] = _DENSE_PAIRS + f"""
SELECT case_id, tenant_id, source_event_id, related_event_id, reasons, round(confidence, 6) AS confidence FROM pr
QUALIFY row_number() OVER (PARTITION BY case_id, tenant_id ORDER BY {PAIR_ORDER}) = 1"""

SQL["correlation_topk_per_host"] = pairs("a.host = b.host", window=3600) + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY {PAIR_ORDER}) AS rank FROM pr)
SELECT host, rank, {PAIR_COLUMNS} FROM r WHERE rank <= 5"""

SQL["correlate_seed_events"] = pairs("a.tenant_id = b.tenant_id AND a.is_persist", window=3600, ordered=False) + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY source_event_id
  ORDER BY round(confidence, 9) DESC, round(score, 9) DESC, related_event_id) AS rank FROM pr)
SELECT rank, {PAIR_COLUMNS} FROM r WHERE rank <= 3"""

SQL["correlation_reason_counts"] = pairs("a.tenant_id = b.tenant_id") + f""",
each AS (SELECT unnest(string_split(reasons, ',')) AS reason FROM pr),
cat(reason, category) AS (VALUES {_rows([(n, c) for n, _, c, _ in vocab.CORRELATION_REASONS])})
SELECT reason, category, count(*) AS pairs FROM each JOIN cat USING (reason) GROUP BY 1, 2"""

# -- graph -----------------------------------------------------------------------------------------


def _json(kind: str, value: str, host: bool = False, scope: bool = False, algorithm: bool = False) -> str:
    parts = [f"'entity_type', '{kind}'"]
    if algorithm:
        parts.append("'hash_algorithm', 'sha256'")
    if host:
        parts.append("'host', lower(host)")
    if scope:
        parts.append("'identity_scope', 'local'")
    parts += [f"'normalized_value', {value}", "'schema_version', '1.0'", "'tenant_id', tenant_id"]
    return f"CAST(json_object({', '.join(parts)}) AS VARCHAR)"


def _mention(kind, value, normalized, role="", on_host=False, where=None, source="sec", **json):
    return (
        f"SELECT tenant_id, case_id, event_id, ts, category, '{kind}' AS entity_type, {value} AS value, {normalized} AS normalized_value, "
        f"{'lower(host)' if on_host else 'NULL'} AS host, '{role}' AS role, {_json(kind, normalized, **json)} AS js "
        f"FROM {source} WHERE {where or value + ' IS NOT NULL'}"
    )


MENTIONS = [
    _mention("host", "host", "lower(host)"),
    _mention("user", "usr", "lower(usr)", on_host=True, host=True, scope=True),
    _mention("process", "pname", "lower(pname) || '|pid:' || pid", "child", on_host=True, host=True),
    _mention("process", "parent_name", "lower(parent_name) || '|pid:' || ppid", "parent", on_host=True, host=True),
    _mention("file", "file_path", "lower(file_path)", on_host=True, host=True),
    _mention("hash", "file_sha", "file_sha", algorithm=True),
    _mention("ip", "src_ip", "src_ip", "source"),
    _mention("ip", "dst_ip", "dst_ip", "destination"),
    _mention("domain", "dns_query", "rtrim(lower(dns_query), '.')"),
    _mention("mitre_technique", "tech", "tech", source="(SELECT *, unnest(techs) AS tech FROM sec)"),
]
REGISTRY = _mention("registry", "reg_key", "lower(reg_key)", on_host=True, host=True)


def graph(extra: list[str] | None = None, base: str = SEC) -> str:
    """CTEs ``m`` (mentions), ``ent`` (entities), ``e`` (edges per event), ``rel`` (resolved edges)."""
    union = " UNION ALL ".join(MENTIONS + (extra or []))
    return base + f""",
m0 AS ({union}),
m1 AS (SELECT *, sha256(js) AS fp FROM m0),
m2 AS (SELECT *, sha1(unhex('{vocab.ENTITY_NAMESPACE.replace("-", "")}') || encode(fp)) AS d FROM m1),
m AS (SELECT *, substr(d,1,8) || '-' || substr(d,9,4) || '-5' || substr(d,14,3) || '-'
  || substr('89ab', ((strpos('0123456789abcdef', substr(d,17,1)) - 1) % 4) + 1, 1) || substr(d,18,3) || '-' || substr(d,21,12) AS eid FROM m2),
ent AS (SELECT tenant_id, fp AS fingerprint, min(eid) AS entity_id, min(entity_type) AS entity_type,
  first(value ORDER BY ts, event_id, role) AS value, min(normalized_value) AS normalized_value, min(host) AS host,
  epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(*) AS mention_count FROM m GROUP BY 1, 2),
e AS (
  SELECT a.tenant_id, a.case_id, a.event_id, a.ts, a.eid AS src, 'spawned' AS rel, b.eid AS dst FROM m a JOIN m b USING (event_id)
    WHERE a.role = 'parent' AND b.role = 'child' AND a.eid <> b.eid
  UNION ALL SELECT a.tenant_id, a.case_id, a.event_id, a.ts, a.eid, 'run_as', b.eid FROM m a JOIN m b USING (event_id)
    WHERE a.role = 'child' AND b.entity_type = 'user'
  UNION ALL SELECT a.tenant_id, a.case_id, a.event_id, a.ts, a.eid, 'has_hash', b.eid FROM m a JOIN m b USING (event_id)
    WHERE a.entity_type = 'file' AND b.entity_type = 'hash'
  UNION ALL SELECT a.tenant_id, a.case_id, a.event_id, a.ts, a.eid, 'connected_to', b.eid FROM m a JOIN m b USING (event_id)
    WHERE a.role = 'child' AND b.role = 'destination' AND a.category = 'network'),
rel AS (SELECT tenant_id, src, rel, dst, count(*) AS event_count, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen,
  sha256(CAST(json_object('relationship_type', rel, 'schema_version', '1.0', 'source_id', src, 'source_type', 'entity',
    'target_id', dst, 'target_type', 'entity', 'tenant_id', tenant_id) AS VARCHAR)) AS fingerprint FROM e GROUP BY 1, 2, 3, 4),
adj AS (SELECT src AS node, dst AS other, rel FROM rel UNION ALL SELECT dst, src, rel FROM rel)"""


G = graph()
PROPERTIES = """,
pp AS (SELECT fp AS fingerprint, last(ppid ORDER BY m.ts, m.event_id) AS ppid FROM m JOIN sec ON sec.event_id = m.event_id
  WHERE role = 'child' AND ppid IS NOT NULL GROUP BY 1),
pr_ent AS (SELECT ent.*, CASE WHEN entity_type = 'process' THEN 'identity_quality=pid' || coalesce(',parent_pid=' || ppid, '')
  || ',pid=' || split_part(normalized_value, '|pid:', 2) ELSE '' END AS properties FROM ent LEFT JOIN pp USING (fingerprint))"""
SQL["entities_resolved"] = G + PROPERTIES + """
SELECT fingerprint, entity_id, tenant_id, entity_type, value, normalized_value, host, first_seen, last_seen, mention_count,
  properties FROM pr_ent"""
SQL["relationships_merged"] = G + """,
n AS (SELECT e.*, CAST(replace(event_id, 'E-', '') AS BIGINT) AS k FROM e),
x AS (SELECT tenant_id, src, rel, dst, first(k % 5 ORDER BY ts, event_id) AS seen_by,
  first(k ORDER BY ts, event_id) FILTER (k % 3 = 0) AS third, bool_or(k % 3 <> 0) AS other FROM n GROUP BY 1, 2, 3, 4)
SELECT fingerprint, CASE WHEN other THEN 'other=1,' ELSE '' END || 'seen_by=' || seen_by || coalesce(',third=' || third, '') AS properties
FROM x JOIN rel USING (tenant_id, src, rel, dst)"""
_SOME = SEC.replace("'tenant-' || (u % 3) AS tenant_id", "CASE WHEN u % 3 <> 0 THEN 'tenant-' || (u % 3) END AS tenant_id")
G_SOME = graph(base=_SOME)
SQL["entities_null_tenant"] = G_SOME + PROPERTIES + """
SELECT fingerprint, entity_id, tenant_id, entity_type, value, normalized_value, host, first_seen, last_seen, mention_count,
  properties FROM pr_ent"""


def _folded(policy: str, column: str) -> str:
    """Strength of the edges of a group, folded one after the other."""
    values = f"list({column} ORDER BY ts, event_id)"
    return {"max": f"max({column})", "left": f"({values})[1]", "right": f"({values})[-1]", "avg": f"list_reduce({values}, lambda a, b: (a + b) / 2)"}[policy]


def _own(side: str) -> str:
    """Text of the properties of a group, the first or the last value of each key."""
    pick = {"left": "first", "right": "last"}[side]
    return (
        f"CASE WHEN bool_or(k % 3 <> 0) THEN 'other=1,' ELSE '' END || 'seen_by=' || {pick}(k % 5 ORDER BY ts, event_id) "
        f"|| coalesce(',third=' || {pick}(k ORDER BY ts, event_id) FILTER (k % 3 = 0), '')"
    )


_EDGES = """,
n AS (SELECT e.*, CAST(replace(event_id, 'E-', '') AS BIGINT) AS k, (k % 7) / 8.0::DOUBLE AS weight, (k % 5) / 4.0::DOUBLE AS confidence FROM e)"""


def _policy(strength: str, on_property: str, on_metadata: str) -> str:
    own = "'rel=' || any_value(rel)" if on_property == "raise" else _own(on_property)
    noted = "'rel=' || any_value(rel)" if on_metadata == "raise" else f"'noted=' || {'first' if on_metadata == 'left' else 'last'}(k % 4 ORDER BY ts, event_id)"
    return f"""SELECT '{strength}/{on_property}/{on_metadata}' AS policy, n.tenant_id, any_value(fingerprint) AS fingerprint,
  round({_folded(strength, "weight")}, 6) AS weight, round({_folded(strength, "confidence")}, 6) AS confidence, {own} AS properties, {noted} AS metadata,
  array_to_string(list_sort(list(DISTINCT 't' || (k % 6))), ',') AS tags, count(*) AS event_count, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen
FROM n JOIN rel AS r ON n.tenant_id IS NOT DISTINCT FROM r.tenant_id AND n.src = r.src AND n.rel = r.rel AND n.dst = r.dst GROUP BY n.tenant_id, n.src, n.rel, n.dst"""


SQL["relationships_merge_policies"] = G_SOME + _EDGES + "\n" + "\nUNION ALL ".join(
    _policy(*p) for p in (("max", "left", "left"), ("avg", "right", "left"), ("left", "left", "right"), ("right", "right", "right"), ("max", "raise", "raise"))
).replace("any_value(rel)", "any_value(n.rel)")


def _extended(strength: str, conflict: str) -> str:
    one = {"left": "coalesce(s.{c}, f.{c})", "right": "coalesce(f.{c}, s.{c})", "max": "greatest(s.{c}, f.{c})", "avg": "CASE WHEN s.{c} IS NULL OR f.{c} IS NULL THEN coalesce(s.{c}, f.{c}) ELSE (s.{c} + f.{c}) / 2 END"}
    a, b = ("s", "f") if conflict == "left" else ("f", "s")
    pick = lambda c: f"coalesce({a}.{c}, {b}.{c})"
    return f"""SELECT '{strength}/{conflict}' AS policy, tenant_id, fingerprint, round({one[strength].format(c="weight")}, 6) AS weight,
  round({one[strength].format(c="confidence")}, 6) AS confidence,
  CASE WHEN s.other OR f.other THEN 'other=1,' ELSE '' END || 'seen_by=' || {pick("seen_by")} || coalesce(',third=' || {pick("third")}, '') AS properties,
  'noted=' || {pick("noted")} AS metadata, array_to_string(list_sort(list_distinct(list_concat(coalesce(s.tags, []), coalesce(f.tags, [])))), ',') AS tags,
  coalesce(s.event_count, 0) + coalesce(f.event_count, 0) AS event_count FROM s FULL JOIN f USING (fingerprint, tenant_key, tenant_id)"""


def _half(name: str, where: str) -> str:
    first = lambda x: f"first({x} ORDER BY ts, event_id)"
    return f""",
{name} AS (SELECT coalesce(n.tenant_id, '') AS tenant_id, n.tenant_id IS NULL AS tenant_key, any_value(fingerprint) AS fingerprint, {first("weight")} AS weight,
  {first("confidence")} AS confidence, bool_or(k % 3 <> 0) AS other, {first("k % 5")} AS seen_by, {first("k")} FILTER (k % 3 = 0) AS third, {first("k % 4")} AS noted,
  list(DISTINCT 't' || (k % 6)) AS tags, count(*) AS event_count
  FROM n JOIN rel AS r ON n.tenant_id IS NOT DISTINCT FROM r.tenant_id AND n.src = r.src AND n.rel = r.rel AND n.dst = r.dst WHERE {where}
  GROUP BY n.tenant_id, n.src, n.rel, n.dst)"""


SQL["relationships_extended"] = (
    G_SOME + _EDGES + _half("s", "ts >= TIMESTAMP '2024-01-16'") + _half("f", "ts < TIMESTAMP '2024-01-16'") + "\nSELECT * REPLACE (nullif(tenant_id, '') AS tenant_id) FROM ("
    + "\nUNION ALL ".join(_extended(*p) for p in (("left", "left"), ("right", "right"), ("avg", "left"), ("max", "right"))) + ")"
)
SQL["entity_lists_united"] = G_SOME + """,
k AS (SELECT tenant_id, fp, ts, event_id, role, CAST(replace(event_id, 'E-', '') AS BIGINT) AS n FROM m WHERE entity_type IN ('domain', 'ip')),
o AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, fp ORDER BY ts, event_id, role) AS spot FROM k),
p AS (SELECT *, max(CASE WHEN n % 37 = 0 THEN spot ELSE 0 END) OVER (PARTITION BY tenant_id, fp) AS plain, max(spot) OVER (PARTITION BY tenant_id, fp) AS newest FROM o),
i AS (SELECT tenant_id, fp, spot, 0 AS place, (n % 3)::VARCHAR AS item FROM p WHERE spot > plain
  UNION ALL SELECT tenant_id, fp, spot, 1, '"x' || (n % 4) || '"' FROM p WHERE spot > plain),
f AS (SELECT tenant_id, fp, item, min((spot, place)) AS earliest FROM i GROUP BY 1, 2, 3),
u AS (SELECT tenant_id, fp, '[' || string_agg(item, ',' ORDER BY earliest) || ']' AS seen FROM f GROUP BY 1, 2)
SELECT p.tenant_id, p.fp AS fingerprint, CASE WHEN any_value(plain) = any_value(newest) THEN 'plain' ELSE any_value(u.seen) END AS seen,
  first(n % 4 ORDER BY spot)::VARCHAR AS noted
FROM p LEFT JOIN u ON u.fp = p.fp AND u.tenant_id IS NOT DISTINCT FROM p.tenant_id GROUP BY p.tenant_id, p.fp"""
SQL["entity_type_counts"] = G + "\nSELECT entity_type, count(*) AS n FROM ent GROUP BY 1"
SQL["entity_provenance"] = G + "\nSELECT eid AS entity_id, count(DISTINCT event_id) AS events FROM m GROUP BY 1"
SQL["relationships_resolved"] = G + """
SELECT fingerprint, rel AS relationship_type, src AS source_id, dst AS target_id, event_count, first_seen, last_seen FROM rel"""
SQL["relationship_type_counts"] = G + """
SELECT rel AS relationship_type, CASE rel WHEN 'spawned' THEN 'process' WHEN 'run_as' THEN 'identity'
  WHEN 'has_hash' THEN 'file' ELSE 'network' END AS category, count(*) AS n FROM rel GROUP BY 1, 2"""
SQL["relationships_reversed"] = G + """
SELECT sha256(CAST(json_object('relationship_type', rel, 'schema_version', '1.0', 'source_id', dst, 'source_type', 'entity',
    'target_id', src, 'target_type', 'entity', 'tenant_id', tenant_id) AS VARCHAR)) AS fingerprint,
  dst AS source_id, rel AS relationship_type, src AS target_id FROM rel WHERE rel = 'connected_to'"""
SQL["graph_stats"] = G + """
SELECT (SELECT count(*) FROM ent WHERE tenant_id = 'tenant-1') AS entities,
  (SELECT count(DISTINCT entity_type) FROM ent WHERE tenant_id = 'tenant-1') AS entity_types,
  (SELECT count(DISTINCT host) FROM ent WHERE tenant_id = 'tenant-1') AS hosts,
  (SELECT count(*) FROM rel WHERE tenant_id = 'tenant-1') AS relationships"""
SQL["graph_extend"] = G + PROPERTIES + "\nSELECT fingerprint, entity_type, value, first_seen, last_seen, mention_count, properties FROM pr_ent"
SQL["entity_lookup"] = G + """
SELECT entity_id, entity_type, value, host FROM ent
WHERE (entity_type = 'ip' AND normalized_value = '203.0.113.7') OR (entity_type = 'file' AND host = 'host-3')"""
SQL["relationship_lookup"] = G + """
SELECT fingerprint, src AS source_id, dst AS target_id, true AS fingerprint_ok FROM rel WHERE rel = 'connected_to'"""
SQL["entity_flag_rows"] = G + f"""
SELECT entity_id, entity_type IN ({", ".join(repr(t) for t in sorted(vocab.OCCURRENCE_ENTITY_TYPES))}) AS is_occurrence,
  entity_type NOT IN ({", ".join(repr(t) for t in sorted(vocab.OCCURRENCE_ENTITY_TYPES))}) AS is_substantive,
  entity_type IN ({", ".join(repr(t) for t in sorted(vocab.GLOBAL_ENTITY_TYPES))}) AS is_global,
  entity_type IN ({", ".join(repr(t) for t in sorted(vocab.HOST_SCOPED_ENTITY_TYPES))}) OR entity_type = 'user' AS is_host_scoped,
  true AS fingerprint_ok, '' AS errors FROM ent"""
SQL["relationship_flag_rows"] = G + """
SELECT fingerprint, CASE rel WHEN 'spawned' THEN 'process' WHEN 'run_as' THEN 'identity' WHEN 'has_hash' THEN 'file' ELSE 'network' END AS category,
  rel = 'connected_to' AS is_symmetric, false AS is_investigation, '' AS errors FROM rel"""
SQL["entity_provenance_added"] = G + """
SELECT fp AS fingerprint, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(*) AS mention_count FROM m GROUP BY 1
HAVING min(ts) < TIMESTAMP '2024-01-16'"""
SQL["neighbors"] = G + """
SELECT DISTINCT node, other AS entity_id, entity_type, value, host, rel AS relationship_type
FROM adj JOIN ent ON ent.entity_id = adj.other"""

_SEEDED = G + """,
seed AS (SELECT entity_id FROM ent WHERE entity_type = 'ip' AND value = '203.0.113.7'),
walk(node, d) AS (SELECT entity_id, 0 FROM seed UNION SELECT adj.other, d + 1 FROM walk JOIN adj USING (node) WHERE d < 2),
near AS (SELECT node, min(d) AS depth FROM walk GROUP BY 1)"""
SQL["subgraph_2hop"] = _SEEDED + """
SELECT entity_id, entity_type, depth FROM ent JOIN near ON node = entity_id
UNION ALL SELECT fingerprint, rel, -1 FROM rel WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)"""
_CHILD = """,
child AS (SELECT min(dst) AS id FROM rel WHERE rel = 'spawned' AND tenant_id = 'tenant-1'),
spawn AS (SELECT DISTINCT src, dst FROM rel WHERE rel = 'spawned')"""
SQL["lineage_of_entity"] = G + _CHILD + """,
way(node, path) AS (SELECT id, [id] FROM child
  UNION ALL SELECT src, list_append(path, src) FROM way JOIN spawn ON dst = node WHERE NOT list_contains(path, src) AND len(path) <= 4),
best AS (SELECT path FROM way ORDER BY len(path) DESC, path LIMIT 1)
SELECT unnest(path) AS entity_id, generate_subscripts(path, 1) - 1 AS position FROM best"""
SQL["process_lineage_preset"] = G + _CHILD + """,
walk(node, d) AS (SELECT id, 0 FROM child
  UNION SELECT CASE WHEN src = node THEN dst ELSE src END, d + 1 FROM walk JOIN spawn ON src = node OR dst = node WHERE d < 5),
near AS (SELECT node, min(d) AS depth FROM walk GROUP BY 1)
SELECT entity_id, value, host, depth FROM ent JOIN near ON node = entity_id WHERE entity_type = 'process'"""
SQL["shortest_path"] = G + """,
ends AS (SELECT (SELECT entity_id FROM ent WHERE tenant_id = 'tenant-1' AND entity_type = 'ip' AND value = '203.0.113.7') AS a,
  (SELECT entity_id FROM ent WHERE tenant_id = 'tenant-1' AND entity_type = 'ip' AND value = '203.0.113.21') AS b),
walk(node, d) AS (SELECT a, 0 FROM ends UNION SELECT adj.other, d + 1 FROM walk JOIN adj USING (node) WHERE d < 5),
lev AS (SELECT node, min(d) AS d FROM walk GROUP BY 1),
via AS (SELECT l.node, min(p.node) AS prev FROM lev l JOIN adj ON adj.other = l.node JOIN lev p ON p.node = adj.node AND p.d = l.d - 1 GROUP BY 1),
back(node, d) AS (SELECT node, d FROM lev WHERE node = (SELECT b FROM ends)
  UNION ALL SELECT via.prev, d - 1 FROM back JOIN via USING (node) WHERE d > 0)
SELECT d AS position, node AS entity_id FROM back"""
SQL["shortest_paths_many"] = G + """,
ask AS (SELECT a.entity_id AS source_id, b.entity_id AS target_id FROM ent a, ent b WHERE a.tenant_id = 'tenant-1' AND b.tenant_id = 'tenant-1'
  AND a.entity_type = 'ip' AND a.value IN ('203.0.113.7', '203.0.113.8', '10.0.1.1') AND b.entity_type = 'process' AND b.host = 'host-4'),
walk(source_id, node, d) AS (SELECT DISTINCT source_id, source_id, 0 FROM ask
  UNION SELECT source_id, adj.other, d + 1 FROM walk JOIN adj USING (node) WHERE d < 4),
lev AS (SELECT source_id, node, min(d) AS d FROM walk GROUP BY 1, 2),
via AS (SELECT l.source_id, l.node, min(p.node) AS prev FROM lev l JOIN adj ON adj.other = l.node
  JOIN lev p ON p.source_id = l.source_id AND p.node = adj.node AND p.d = l.d - 1 GROUP BY 1, 2),
back(source_id, target_id, node, d) AS (SELECT ask.source_id, target_id, target_id, d FROM ask JOIN lev ON lev.source_id = ask.source_id AND node = target_id
  UNION ALL SELECT back.source_id, target_id, via.prev, d - 1 FROM back JOIN via ON via.source_id = back.source_id AND via.node = back.node WHERE d > 0)
SELECT source_id, target_id, d AS position, node AS entity_id FROM back"""
REACH = """,
sp AS (SELECT DISTINCT case_id, src, dst FROM e WHERE rel = 'spawned'),
below(case_id, root, node, d) AS (SELECT case_id, src, dst, 1 FROM sp
  UNION SELECT b.case_id, b.root, sp.dst, d + 1 FROM below b JOIN sp ON sp.case_id = b.case_id AND sp.src = b.node WHERE d < 10),
reach AS (SELECT case_id, root, count(DISTINCT node) AS below FROM below GROUP BY 1, 2)"""
SQL["process_spawn_reach"] = G + REACH + "\nSELECT case_id, root, below FROM reach"
SQL["cross_host_entities"] = G + """
SELECT value, entity_type, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts, count(DISTINCT host) AS host_count
FROM ent WHERE host IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT host) >= 2"""
SQL["shared_hashes_across_hosts"] = G + """
SELECT h.normalized_value AS hash_value, 'sha256' AS algo, string_agg(DISTINCT f.host, ',' ORDER BY f.host) AS hosts, count(DISTINCT f.host) AS host_count
FROM rel JOIN ent f ON f.entity_id = src JOIN ent h ON h.entity_id = dst WHERE rel = 'has_hash'
GROUP BY 1 HAVING count(DISTINCT f.host) >= 2"""
SQL["top_connected_entities"] = G + """
SELECT entity_id, entity_type, value, host, count(*) AS degree FROM adj JOIN ent ON entity_id = node
GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3 ORDER BY degree DESC, entity_id LIMIT 20"""
SQL["recent_entities"] = G + """
SELECT entity_id, entity_type, value, first_seen FROM ent ORDER BY first_seen DESC, entity_id LIMIT 50"""
SQL["lateral_movement_edges"] = G + """,
l AS (SELECT rel.tenant_id, src, dst AS hash_id, f.first_seen, f.host FROM rel JOIN ent f ON f.entity_id = src WHERE rel = 'has_hash'),
o AS (SELECT hash_id, first(src ORDER BY first_seen, src) AS target_id, first(host ORDER BY first_seen, src) AS target_host FROM l GROUP BY 1)
SELECT src AS source_id, host AS source_host, target_id, target_host, 'matches_hash' AS relationship_type
FROM l JOIN o USING (hash_id) WHERE src <> target_id AND host <> target_host AND tenant_id = 'tenant-1'"""
SQL["entities_by_technique"] = G + """
SELECT entity_id, entity_type, value, host FROM ent WHERE tenant_id = 'tenant-0' AND entity_id IN (
  SELECT eid FROM m JOIN sec USING (event_id) WHERE list_contains(techs, 'T1105'))"""
SQL["persistence_artifacts"] = graph([REGISTRY]) + """
SELECT entity_id, entity_type, value, host FROM ent WHERE entity_type IN ('registry', 'file') AND entity_id IN (
  SELECT eid FROM m JOIN sec USING (event_id) WHERE is_persist)"""
SQL["high_severity_entities"] = G + """,
w AS (SELECT eid, max(severity) AS severity FROM m JOIN sec USING (event_id) WHERE severity >= 70 GROUP BY 1)
SELECT entity_id, entity_type, value, severity FROM ent JOIN w ON eid = entity_id"""
SQL["case_graph"] = G + """,
c AS (SELECT DISTINCT eid FROM m WHERE case_id = 'HOST-7/2024-01-15')
SELECT entity_id, value, rel AS relationship_type, other AS other_id FROM ent JOIN c ON eid = entity_id LEFT JOIN adj ON node = entity_id"""

# -- process tree ------------------------------------------------------------------------------------

TREE = """WITH RECURSIVE
p AS (SELECT event_id AS n, event_id % 12 AS h, event_id // 12 AS m FROM events),
t AS (SELECT 'HOST-' || h || '|pid:' || m AS node, 'E-' || n AS event_id, h, m,
  CASE WHEN m > 0 THEN CASE WHEN m % 50 = 0 THEN m + 10000000 ELSE (m - 1) // 3 END END AS pp FROM p),
tree AS (SELECT t.node, t.event_id, q.node AS parent, t.pp IS NOT NULL AND q.node IS NULL AS is_orphan
  FROM t LEFT JOIN t q ON q.h = t.h AND q.m = t.pp),
up(node, ancestor, distance) AS (SELECT node, node, CAST(0 AS BIGINT) FROM tree
  UNION ALL SELECT up.node, tree.parent, distance + 1 FROM up JOIN tree ON tree.node = up.ancestor WHERE tree.parent IS NOT NULL)"""
SQL["process_roots_orphans"] = TREE + "\nSELECT node, event_id, is_orphan FROM tree WHERE parent IS NULL"
SQL["process_descendants"] = TREE + """
SELECT tree.node, event_id FROM tree JOIN up USING (node) WHERE ancestor = 'HOST-3|pid:4' AND distance > 0"""
SQL["process_children"] = TREE + "\nSELECT node, event_id, parent FROM tree WHERE parent = 'HOST-5|pid:2'"
SQL["process_lineage"] = TREE + "\nSELECT node, ancestor, distance FROM up"
SQL["process_descendant_counts"] = TREE + """
SELECT a.node, last(a.ancestor ORDER BY a.distance) AS root, max(a.distance) AS depth, min(c.n) - 1 AS descendants
FROM up a JOIN (SELECT ancestor, count(*) AS n FROM up GROUP BY 1) c ON c.ancestor = a.node GROUP BY 1"""
SQL["process_intervals"] = TREE + """,
c AS (SELECT ancestor, count(*) AS n FROM up GROUP BY 1),
w AS (SELECT node, last(ancestor ORDER BY distance) AS root, max(distance) AS depth,
  list(CAST(split_part(ancestor, ':', 2) AS BIGINT) ORDER BY distance DESC) AS way FROM up GROUP BY 1),
o AS (SELECT w.*, n - 1 AS descendants, row_number() OVER (PARTITION BY root ORDER BY way) - 1 AS enter FROM w JOIN c ON c.ancestor = w.node)
SELECT node, root, depth, descendants, enter, enter + descendants AS leave FROM o"""
SQL["process_subtree"] = TREE + """
SELECT up.node, d.depth, 'below' AS side FROM up JOIN (SELECT node, max(distance) AS depth FROM up GROUP BY 1) d USING (node)
  WHERE ancestor = 'HOST-3|pid:4' AND distance > 0
UNION ALL SELECT ancestor, distance, 'above' FROM up WHERE node = 'HOST-3|pid:4'"""

# -- detection ---------------------------------------------------------------------------------------

_LOLBINS = _rows([(b, s, d, ",".join(t)) for b, s, d, t in vocab.LOLBINS])
_LEVELS = "CASE level WHEN 'INFO' THEN 10 WHEN 'LOW' THEN 30 WHEN 'MEDIUM' THEN 50 WHEN 'HIGH' THEN 70 ELSE 90 END"
FOUND = SEC + f""",
bins(binary_name, level, description, techniques) AS (VALUES {_LOLBINS}),
lol AS (SELECT event_id, 'lolbin.' || binary_name AS rule_id, 'LOLBin execution: ' || binary_name AS rule_name,
  {_LEVELS} AS severity, level AS severity_name, description, techniques AS mitre_techniques
  FROM sec JOIN bins ON lower(pname) = binary_name WHERE category = 'process'),
sig AS (
  SELECT event_id, 'S-1' AS rule_id, 'Shell from explorer' AS rule_name, 70 AS severity, 'HIGH' AS severity_name,
    'Rule Shell from explorer matched' AS description, 'T1059.001' AS mitre_techniques FROM sec
    WHERE (lower(pname) = 'powershell.exe' OR lower(pname) LIKE 'cmd%') AND event_type = 'click' AND lower(host) LIKE 'host-_'
  UNION ALL SELECT event_id, 'S-2', 'Persistence key', 90, 'CRITICAL', 'Autorun key touched', '' FROM sec
    WHERE coalesce(contains(lower(reg_key), 'software\\k1'), false) OR coalesce(contains(lower(file_path), 'f7.bin'), false)
  UNION ALL SELECT event_id, 'S-3', 'Odd domain', 30, 'LOW', 'Rule Odd domain matched', 'T1071' FROM sec
    WHERE (coalesce(contains(lower(dns_query), 'example.com'), false) AND coalesce(usr LIKE 'user1%', false)) OR coalesce(rule_id = 'R-5', false))"""
_FINDING = "event_id, rule_id, rule_name, severity, severity_name, description, mitre_techniques"
SQL["lolbin_findings"] = FOUND + f"\nSELECT {_FINDING} FROM lol"
SQL["sigma_many_rules"] = SEC + """,
rule AS (SELECT range AS i, 'user' || (range % 40) AS u FROM range(2000)),
hit AS (SELECT case_id, event_id, i FROM sec JOIN rule ON lower(usr) = u AND CASE i % 4
  WHEN 0 THEN host = 'HOST-' || (i % 12) AND event_type IN ('click', 'view')
  WHEN 1 THEN contains(lower(dns_query), 'd' || (i % 20) || '.ex') AND (lower(pname) = 'mshta.exe' OR lower(pname) LIKE 'cmd%')
  WHEN 2 THEN coalesce(lower(reg_key) LIKE '%k' || (i % 15), false) OR coalesce(contains(file_path, 'f' || (i % 25) || '.bin'), false)
  ELSE rule_id = 'R-' || (i % 11) AND src_ip LIKE '10._.' || (i % 4) || '.%' END)
SELECT case_id, event_id, 'M-' || i AS rule_id, 'Rule ' || i AS rule_name, CASE WHEN i % 2 = 0 THEN 30 ELSE 70 END AS severity,
  CASE WHEN i % 2 = 0 THEN 'LOW' ELSE 'HIGH' END AS severity_name, 'Rule Rule ' || i || ' matched' AS description FROM hit"""

SQL["sigma_findings"] = FOUND + f"\nSELECT {_FINDING} FROM sig"
SQL["detection_stats"] = FOUND + """,
f AS (SELECT rule_id, severity_name FROM lol UNION ALL SELECT rule_id, severity_name FROM sig)
SELECT 'total' AS dimension, 'all' AS value, count(*) AS findings FROM f
UNION ALL SELECT 'rule', rule_id, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'severity', severity_name, count(*) FROM f GROUP BY 2"""

# -- intel ----------------------------------------------------------------------------------------------

IOC = SEC + """,
s AS (SELECT event_id, 'hash' AS indicator_type, file_sha AS indicator FROM sec WHERE file_sha IS NOT NULL
  UNION ALL SELECT event_id, 'ip', src_ip FROM sec WHERE src_ip IS NOT NULL
  UNION ALL SELECT event_id, 'ip', dst_ip FROM sec WHERE dst_ip IS NOT NULL
  UNION ALL SELECT event_id, 'domain', rtrim(lower(dns_query), '.') FROM sec WHERE dns_query IS NOT NULL),
i AS (SELECT indicator_type, indicator, count(*) AS sightings FROM s GROUP BY 1, 2),
x AS (SELECT *, CAST(nullif(regexp_extract(indicator, '(\\d+)(\\.example\\.com)?$', 1), '') AS INTEGER) AS v FROM i WHERE indicator_type <> 'hash'),
q AS (SELECT indicator_type, indicator, unnest(['virustotal', 'otx', 'misp']) AS provider FROM i),
res AS (SELECT q.*,
  coalesce((provider = 'virustotal' AND indicator_type = 'ip' AND starts_with(indicator, '203.') AND v % 3 = 0)
    OR (provider = 'otx' AND indicator_type = 'domain' AND v % 4 = 0), false) AS found,
  CASE WHEN provider = 'misp' AND indicator_type = 'hash' AND substr(indicator, 1, 1) < '4' THEN 'timeout' END AS error, v
  FROM q LEFT JOIN x USING (indicator_type, indicator)),
verdict AS (SELECT indicator_type, indicator, provider, found, CASE WHEN found THEN v % 5 ELSE 0 END AS malicious_count,
  CASE WHEN found THEN 10 ELSE 0 END AS total_count, error FROM res)"""
SQL["indicators_distinct"] = IOC + "\nSELECT indicator_type, indicator, sightings FROM i"
SQL["intel_enrichment"] = IOC + """
SELECT indicator_type, indicator, provider, found, malicious_count, total_count,
  round(CASE WHEN total_count > 0 THEN malicious_count / CAST(total_count AS DOUBLE) ELSE 0.0 END, 6) AS detection_ratio,
  malicious_count > 0 AS is_malicious, error FROM verdict"""
SQL["intel_first_answers"] = SQL["intel_enrichment"]
SQL["intel_summary"] = IOC + """
SELECT count(DISTINCT indicator) AS indicator_count,
  count(*) FILTER (error IS NULL AND malicious_count > 0) AS malicious,
  count(*) FILTER (error IS NULL AND malicious_count = 0 AND found) AS suspicious,
  count(*) FILTER (error IS NULL AND malicious_count = 0 AND NOT found) AS clean,
  count(*) FILTER (error IS NOT NULL) AS errors FROM verdict"""
SQL["intel_events"] = IOC + """
SELECT event_id, count(*) AS hits, max(malicious_count) AS worst FROM s JOIN verdict USING (indicator_type, indicator)
WHERE malicious_count > 0 GROUP BY 1"""
SQL["intel_url_pages"] = """
WITH u AS (SELECT DISTINCT url AS indicator FROM pages WHERE url <> ''),
q AS (SELECT *, unnest(['virustotal', 'otx', 'misp']) AS provider FROM u)
SELECT 'url' AS indicator_type, indicator, provider, provider = 'misp' AND length(indicator) % 3 = 0 AS found,
  CASE WHEN provider = 'misp' AND length(indicator) % 3 = 0 THEN length(indicator) % 4 ELSE 0 END AS malicious_count,
  CASE WHEN provider <> 'misp' THEN 'unsupported indicator type' END AS error FROM q"""
SQL["intel_responses"] = IOC + """,
a AS (SELECT *, length(indicator) AS n FROM q)
SELECT provider, indicator_type, indicator,
  CASE provider WHEN 'virustotal' THEN true WHEN 'otx' THEN n % 3 > 0 ELSE n % 2 = 0 END AS found,
  CASE provider WHEN 'virustotal' THEN n % 4 + n % 2 WHEN 'otx' THEN n % 3 ELSE 2 * (1 - n % 2) END AS malicious_count,
  CASE provider WHEN 'virustotal' THEN n % 4 + n % 2 + 6 WHEN 'otx' THEN n % 3 ELSE 2 * (1 - n % 2) END AS total_count,
  CASE provider WHEN 'virustotal' THEN n - 20 END AS reputation,
  CASE provider WHEN 'virustotal' THEN 'alpha,trojan,zeta' WHEN 'otx' THEN 'a,b' ELSE CASE WHEN n % 2 = 0 THEN 'tlp:red' ELSE '' END END AS tags
FROM a"""

# -- hypotheses ---------------------------------------------------------------------------------------------

_TEMPLATES = _rows([(t, m, c, ",".join(x), str(len(x))) for t, m, c, x in vocab.HYPOTHESIS_TEMPLATES])


def hypotheses(base: str = EV) -> str:
    """CTEs ending in ``hyp``: MAIN and COUNTER per case and technique."""
    return base + f""",
tpl(technique, main_text, counter_text, missing, n_missing) AS (VALUES {_TEMPLATES}),
te AS (SELECT case_id, tenant_id, evidence_id, severity, unnest(techs) AS technique FROM ev),
tc AS (SELECT case_id, technique, min(tenant_id) AS tenant_id, count(*) AS n FROM te GROUP BY 1, 2),
h0 AS (SELECT tc.*, coalesce(main_text, 'Possible activity related to ' || technique) AS main_text,
  coalesce(counter_text, 'Legitimate activity that could be misclassified as ' || technique) AS counter_text,
  coalesce(missing, 'additional corroborating evidence') AS missing, CAST(coalesce(n_missing, '1') AS INTEGER) AS n_missing
  FROM tc LEFT JOIN tpl USING (technique)),
h1 AS (
  SELECT case_id, tenant_id, technique, 'main' AS kind, 1 AS kind_rank, main_text AS statement, main_text,
    CASE WHEN n >= 2 THEN 'supported' ELSE 'proposed' END AS status,
    CAST(CASE n WHEN 1 THEN 0.3 WHEN 2 THEN 0.55 WHEN 3 THEN 0.7 WHEN 4 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence,
    n AS support_count, missing, n_missing FROM h0
  UNION ALL SELECT case_id, tenant_id, technique, 'counter', 2, counter_text, main_text, 'proposed', 0.0, 0, missing, n_missing FROM h0),
h2 AS (SELECT *, sha256(CAST(json_object('hypothesis_type', kind, 'schema_version', '1.0', 'statement', lower(statement),
  'tenant_id', tenant_id) AS VARCHAR)) AS fingerprint FROM h1),
hyp AS (SELECT *, 'H-' || substr(sha256(case_id || '|' || fingerprint), 1, 12) AS hypothesis_id FROM h2)"""


HYP = hypotheses()
SQL["hypothesis_main_counter"] = HYP + """
SELECT case_id, kind AS hypothesis_type, statement, technique AS mitre_techniques, status, confidence, support_count,
  missing AS missing_evidence, fingerprint, hypothesis_id FROM hyp"""
SQL["hypothesis_support"] = HYP + """
SELECT case_id, hypothesis_id, evidence_id FROM te JOIN hyp USING (case_id, technique) WHERE kind = 'main'"""
_AGAINST = """,
ag AS (SELECT hypothesis_id, evidence_id FROM hyp JOIN ev USING (case_id)
  WHERE kind = 'main' AND statement = 'Possible ingress tool transfer' AND severity % 10 = 3)"""
SQL["hypotheses_merged"] = HYP + _AGAINST + """,
su AS (SELECT fingerprint, evidence_id, true AS s, false AS c FROM te JOIN hyp USING (case_id, technique) WHERE kind = 'main'
  UNION ALL SELECT fingerprint, evidence_id, false, true FROM ag JOIN hyp USING (hypothesis_id)),
li AS (SELECT fingerprint, evidence_id, bool_or(s) AS s, bool_or(c) AS c FROM su GROUP BY 1, 2),
lc AS (SELECT fingerprint, count(*) FILTER (s) AS s, count(*) FILTER (c) AS c, count(*) FILTER (s AND c) AS o FROM li GROUP BY 1)
SELECT fingerprint, any_value(kind) AS hypothesis_type, any_value(statement) AS statement,
  CASE WHEN bool_or(status = 'supported') THEN 'supported' ELSE 'proposed' END AS status, max(confidence) AS confidence,
  string_agg(DISTINCT technique, ',' ORDER BY technique) AS mitre_techniques,
  array_to_string(list_sort(list_distinct(flatten(list(string_split(missing, ','))))), ',') AS missing_evidence,
  coalesce(any_value(lc.s), 0) AS support_count, coalesce(any_value(lc.c), 0) AS contradict_count, coalesce(any_value(lc.o), 0) AS overlap_count
FROM hyp LEFT JOIN lc USING (fingerprint) GROUP BY 1"""
SQL["hypothesis_contradictions"] = HYP + _AGAINST + """
SELECT hypothesis_id, support_count, (SELECT count(*) FROM ag WHERE ag.hypothesis_id = hyp.hypothesis_id) AS contradict_count FROM hyp"""
SQL["evidence_flag_rows"] = HYP + _AGAINST + """
SELECT evidence_id, strength IN ('strong', 'critical') AS is_strong, strength = 'critical' AS is_critical, confidence >= 0.75 AS is_high_confidence,
  evidence_type = 'derived' AS is_derived, severity % 6 = 0 AS is_verified, 0 AS supports_hypotheses, count(ag.evidence_id) AS contradicts_hypotheses
FROM ev LEFT JOIN ag USING (evidence_id) GROUP BY ALL"""
SQL["evidence_edges"] = hypotheses(graph(base=EV)) + _AGAINST + """
SELECT evidence_id AS source, 'Evidence' AS source_type, event_id AS target, 'Event' AS target_type, 'REFERENCES' AS relationship FROM ev
UNION ALL SELECT evidence_id, 'Evidence', hypothesis_id, 'Hypothesis', 'CONTRADICTS' FROM ag
UNION ALL SELECT evidence_id, 'Evidence', 'E-E-' || (CAST(replace(event_id, 'E-', '') AS BIGINT) - 1), 'Evidence', 'DERIVED_FROM' FROM ev WHERE severity % 7 = 0
UNION ALL SELECT DISTINCT evidence_id, 'Evidence', eid, 'Entity', 'ABOUT' FROM ev JOIN m USING (event_id)"""
CASE_PAIRS = "a.case_id = b.case_id AND a.tenant_id = b.tenant_id"
TOP_PAIR = """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(confidence, 9) DESC,
  round(score, 9) DESC, source_event_id, related_event_id) AS rank FROM pr)),
subc AS (SELECT case_id, tenant_id, 'Correlation PAIR-' || substr(sha256(source_event_id || '|' || related_event_id), 1, 10)
  || ' (reasons: ' || replace(reasons, ',', ', ') || ').' AS rationale,
  sha256(CAST(json_object('hypothesis_type', 'sub', 'schema_version', '1.0', 'statement',
    'correlated event cluster indicates a single activity', 'tenant_id', tenant_id) AS VARCHAR)) AS fp
  FROM best WHERE rank = 1 AND confidence >= 0.5 - 1e-12)"""
SQL["hypothesis_sub_correlation"] = pairs(CASE_PAIRS) + TOP_PAIR + """
SELECT case_id, 'Correlated event cluster indicates a single activity' AS statement, rationale,
  'H-' || substr(sha256(case_id || '|' || fp), 1, 12) AS hypothesis_id FROM subc"""
CHAIN = REACH + """,
named AS (SELECT DISTINCT eid, value, normalized_value, host, tenant_id FROM m WHERE entity_type = 'process'),
ch AS (SELECT case_id, tenant_id, value, below, row_number() OVER (PARTITION BY case_id
  ORDER BY below DESC, normalized_value, host) AS r FROM reach JOIN named ON eid = root WHERE below >= 2),
subp AS (SELECT case_id, tenant_id, 'Process chain from ' || value || ' reaches depth ' || (below + 1) || '.' AS rationale,
  sha256(CAST(json_object('hypothesis_type', 'sub', 'schema_version', '1.0', 'statement',
    'multi-process execution chain detected', 'tenant_id', tenant_id) AS VARCHAR)) AS fp FROM ch WHERE r = 1)"""
SQL["hypothesis_sub_chain"] = G + CHAIN + """
SELECT case_id, 'Multi-process execution chain detected' AS statement, rationale, 'T1059' AS mitre_techniques,
  'H-' || substr(sha256(case_id || '|' || fp), 1, 12) AS hypothesis_id FROM subp"""
SQL["hypothesis_sub_shared_hash"] = SEC + """,
w AS (SELECT tenant_id AS case_id, file_sha, count(DISTINCT host) AS hosts FROM sec WHERE file_sha IS NOT NULL GROUP BY 1, 2)
SELECT case_id, 'Same file hash observed across multiple hosts' AS statement,
  'Hash ' || first(file_sha ORDER BY file_sha) || ' observed across ' || first(hosts ORDER BY file_sha) || ' hosts.' AS rationale
FROM w WHERE hosts > 1 GROUP BY 1"""
SQL["hypothesis_findings"] = HYP + """
SELECT case_id, statement, CASE WHEN support_count >= 3 THEN 'strong_support' WHEN support_count = 2 THEN 'supported' ELSE 'single_support' END AS finding
  FROM hyp WHERE kind = 'main'
UNION ALL SELECT case_id, statement, 'ready_for_confirmed' FROM hyp WHERE kind = 'main' AND status = 'supported' AND confidence >= 0.7
UNION ALL SELECT case_id, statement, 'missing_evidence' FROM hyp WHERE kind = 'main'"""
SQL["hypothesis_updates"] = HYP + """,
lg AS (SELECT hypothesis_id, CAST(CAST(replace(event_id, 'E-', '') AS BIGINT) % 50 AS VARCHAR) AS ev_id,
  (CAST(replace(event_id, 'E-', '') AS BIGINT) + i) % 2 = 0 AS for_it, epoch_us(ts) + i * 1000000 AS t
  FROM hyp JOIN sec USING (case_id), (SELECT unnest([0, 1]) AS i)),
sd AS (SELECT hypothesis_id, ev_id, first(for_it ORDER BY t, for_it DESC) AS for_it FROM lg GROUP BY 1, 2)
SELECT hypothesis_id, count(*) FILTER (for_it) AS support_count, count(*) FILTER (NOT for_it) AS contradict_count,
  'zz-memory-image' AS last_missing FROM sd GROUP BY 1"""
SQL["counter_findings"] = HYP + """
SELECT case_id, statement, 'no_support' AS finding, missing AS needed FROM hyp WHERE kind = 'counter'"""


def _log(steps: list[str], table: dict[str, list[str]]) -> str:
    allowed = _rows([(a, b) for a, targets in table.items() for b in targets])
    return SEC + f""",
allowed(prev_status, status) AS (VALUES {allowed}),
log AS (SELECT case_id, ts, event_id AS step_id, {_texts(steps)}[severity % {len(steps)} + 1] AS status,
  CASE WHEN severity % 3 = 0 THEN 'analyst' || (severity % 5) END AS analyst FROM sec),
st AS (SELECT *, lag(status) OVER (PARTITION BY case_id ORDER BY ts, step_id) AS prev_status FROM log)"""


_VIOLATIONS = """
SELECT case_id, step_id, prev_status, status FROM st WHERE prev_status IS NOT NULL
  AND (prev_status, status) NOT IN (SELECT prev_status, status FROM allowed)"""
SQL["hypothesis_status_violations"] = _log(HYPOTHESIS_STEPS, vocab.HYPOTHESIS_TRANSITIONS) + _VIOLATIONS
SQL["case_status_violations"] = _log(CASE_STEPS, vocab.CASE_TRANSITIONS) + _VIOLATIONS
SQL["case_current_state"] = _log(CASE_STEPS, vocab.CASE_TRANSITIONS) + """
SELECT case_id, last(status ORDER BY ts, step_id) AS status,
  last(analyst ORDER BY ts, step_id) FILTER (analyst IS NOT NULL) AS analyst FROM log GROUP BY 1"""

# -- risk and cases --------------------------------------------------------------------------------------------

_CASE = hypotheses(graph(base=pairs(CASE_PAIRS, base=EV)) + CHAIN + TOP_PAIR) + """,
allh AS (
  SELECT case_id, kind, kind_rank, fingerprint, hypothesis_id, status, confidence, support_count, n_missing FROM hyp
  UNION ALL SELECT case_id, 'sub', 3, fp, 'H-' || substr(sha256(case_id || '|' || fp), 1, 12), 'proposed', 0.0, 0, 0 FROM subp
  UNION ALL SELECT case_id, 'sub', 3, fp, 'H-' || substr(sha256(case_id || '|' || fp), 1, 12), 'proposed', 0.0, 0, 0 FROM subc),
val AS (SELECT *, CASE status WHEN 'proposed' THEN 5.0 ELSE 25.0 END * confidence AS value FROM allh),
re AS (SELECT case_id, sum(CASE strength WHEN 'weak' THEN 5.0 WHEN 'moderate' THEN 10.0 WHEN 'strong' THEN 20.0 ELSE 30.0 END) AS raw,
  avg(CAST(confidence AS DECIMAL(20,12))) AS conf, count(*) AS n FROM ev GROUP BY 1),
rc AS (SELECT case_id, CAST(sum(CAST(confidence * 5.0 AS DECIMAL(20,12))) AS DOUBLE) AS raw, count(*) AS n FROM best GROUP BY 1),
rh AS (SELECT case_id, max(value) AS raw, sum(n_missing) AS missing, avg(CASE WHEN support_count > 0 THEN 1.0 ELSE 0.0 END) AS coverage,
  max(confidence) AS conf, count(*) AS n FROM val GROUP BY 1),
sc AS (SELECT re.case_id, least(re.raw, 40.0) AS e, least(coalesce(rc.raw, 0.0), 20.0) AS c, least(coalesce(rh.raw, 0.0), 40.0) AS h,
  -least(coalesce(missing, 0) * 2.0, 15.0) AS p, re.conf AS ec, coalesce(coverage, 0.0) AS cov, coalesce(rh.conf, 0.0) AS hc,
  re.n AS en, coalesce(rc.n, 0) AS cn, coalesce(rh.n, 0) AS hn
  FROM re LEFT JOIN rc USING (case_id) LEFT JOIN rh USING (case_id)),
risk AS (SELECT *, CAST(greatest(0, least(100, round_even(CAST(e + c + h + p AS DOUBLE), 0))) AS INTEGER) AS risk_score FROM sc)"""
SQL["risk_by_case"] = _CASE + """
SELECT case_id, risk_score, round(0.4 * ec + 0.3 * cov + 0.3 * hc, 6) AS confidence,
  round_even(CAST(e AS DOUBLE), 2) AS evidence_score, round_even(c, 2) AS correlation_score,
  round_even(CAST(h AS DOUBLE), 2) AS hypothesis_score, round_even(CAST(p AS DOUBLE), 2) AS penalty_score,
  en AS evidence_count, cn AS correlation_count, hn AS hypothesis_count FROM risk"""
SQL["risk_factors_top5"] = _CASE + """,
f AS (
  SELECT case_id, 'evidence:' || evidence_id AS name, 'evidence' AS category,
    CAST(CASE strength WHEN 'weak' THEN 5.0 WHEN 'moderate' THEN 10.0 WHEN 'strong' THEN 20.0 ELSE 30.0 END AS DOUBLE) AS contribution FROM ev
  UNION ALL SELECT case_id, 'correlation:PAIR-' || substr(sha256(source_event_id || '|' || related_event_id), 1, 10), 'correlation',
    round_even(confidence * 5.0, 3) FROM best
  UNION ALL SELECT case_id, 'hypothesis:' || hypothesis_id, 'hypothesis', round_even(CAST(value AS DOUBLE), 3) FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, kind_rank, fingerprint) AS r FROM val) WHERE r = 1 AND value > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY contribution DESC, category, name) AS rank FROM f WHERE contribution > 0)
SELECT case_id, rank, name, category, contribution FROM g WHERE rank <= 5"""
SQL["risk_evolution"] = SEC + """,
d AS (SELECT host, date_trunc('day', ts) AS ts, CAST(round_even(avg(severity), 0) AS INTEGER) AS risk_score FROM sec GROUP BY 1, 2),
p AS (SELECT *, lag(risk_score, 1, 0) OVER (PARTITION BY host ORDER BY ts) AS previous_risk_score FROM d)
SELECT host, epoch_us(CAST(ts AS TIMESTAMP)) AS ts, risk_score, previous_risk_score, risk_score - previous_risk_score AS delta FROM p"""
_PRIORITY = _band("max(severity)", ("critical", "high", "medium", "low"))
SQL["risk_summaries"] = _CASE + """,
f AS (
  SELECT case_id, 'evidence:' || evidence_id AS name, 'evidence' AS category,
    CAST(CASE strength WHEN 'weak' THEN 5.0 WHEN 'moderate' THEN 10.0 WHEN 'strong' THEN 20.0 ELSE 30.0 END AS DOUBLE) AS contribution FROM ev
  UNION ALL SELECT case_id, 'correlation:PAIR-' || substr(sha256(source_event_id || '|' || related_event_id), 1, 10), 'correlation',
    round_even(confidence * 5.0, 3) FROM best
  UNION ALL SELECT case_id, 'hypothesis:' || hypothesis_id, 'hypothesis', round_even(CAST(value AS DOUBLE), 3) FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, kind_rank, fingerprint) AS r FROM val) WHERE r = 1 AND value > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY contribution DESC, category, name) AS rank FROM f WHERE contribution > 0),
top AS (SELECT case_id, string_agg(name, ', ' ORDER BY rank) AS top FROM g WHERE rank <= 3 GROUP BY 1)
SELECT case_id, risk_score >= 70 AS is_high_risk, risk_score >= 85 AS is_critical_risk, 'Risk ' || risk_score || '/100' AS head,
  coalesce(top, 'none') AS top FROM risk LEFT JOIN top USING (case_id)"""
SQL["case_summary"] = _CASE + f""",
cs AS (SELECT case_id, min(tenant_id) AS tenant_id, max(severity) AS severity, {_PRIORITY} AS priority, count(*) AS event_count FROM sec GROUP BY 1),
ne AS (SELECT case_id, count(DISTINCT fp) AS entity_count FROM m GROUP BY 1),
nr AS (SELECT case_id, count(DISTINCT (src, rel, dst)) AS relationship_count FROM e GROUP BY 1)
SELECT case_id, tenant_id, severity, priority, 'triaged' AS status, event_count, en AS evidence_count, cn AS correlation_count,
  hn AS hypothesis_count, entity_count, coalesce(relationship_count, 0) AS relationship_count
FROM cs JOIN risk USING (case_id) LEFT JOIN ne USING (case_id) LEFT JOIN nr USING (case_id)"""
SQL["case_links"] = hypotheses(graph(base=EV)) + """
SELECT case_id, event_id AS target, 'Event' AS target_type, 'OBSERVED' AS relationship FROM sec
UNION ALL SELECT case_id, evidence_id, 'Evidence', 'CONTAINS' FROM ev
UNION ALL SELECT DISTINCT case_id, rule_id, 'Alert', 'TRIGGERED_BY' FROM sec WHERE rule_id IS NOT NULL
UNION ALL SELECT case_id, hypothesis_id, 'Hypothesis', 'EXPLORES' FROM hyp
UNION ALL SELECT DISTINCT case_id, eid, 'Entity', 'INVOLVES' FROM m
UNION ALL SELECT DISTINCT case_id, 'alex', 'Analyst', 'OWNED_BY' FROM sec"""
SQL["case_list_page"] = SEC + """,
c AS (SELECT case_id, tenant_id, max(severity) AS severity, epoch_us(min(ts)) AS created_at FROM sec GROUP BY 1, 2)
SELECT case_id, severity, created_at FROM c WHERE tenant_id = 'tenant-1' AND severity >= 85
ORDER BY created_at DESC, case_id LIMIT 20 OFFSET 20"""
SQL["case_count"] = SEC + "\nSELECT count(DISTINCT case_id) AS cases FROM sec WHERE tenant_id = 'tenant-2'"

# -- reports -----------------------------------------------------------------------------------------------------

SQL["report_timeline"] = EV + """
SELECT case_id, evidence_id, epoch_us(ts) AS observed_at, category, severity, strength, title FROM ev"""
_ACTIONS = _rows([(t, str(i), a) for t, actions in vocab.TECHNIQUE_ACTIONS for i, a in enumerate(actions)])
SQL["recommended_actions"] = HYP + f""",
act(technique, i, action) AS (VALUES {_ACTIONS}),
u AS (
  SELECT case_id, action, 0 AS part, kind_rank, fingerprint, CAST(i AS INTEGER) AS i FROM hyp JOIN act USING (technique) WHERE kind = 'main'
  UNION ALL SELECT case_id, 'Collect missing evidence: ' || unnest(string_split(missing, ',')), 1, kind_rank, fingerprint,
    unnest(range(0, n_missing)) FROM hyp),
p AS (SELECT case_id, action, min((part, kind_rank, fingerprint, i)) AS place FROM u GROUP BY 1, 2),
gen(i, action) AS (VALUES (0, '{vocab.GENERIC_ACTIONS[0]}'), (1, '{vocab.GENERIC_ACTIONS[1]}'))
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY place) - 1 AS INTEGER) AS position, action FROM p
UNION ALL SELECT case_id, i, action FROM (SELECT DISTINCT case_id FROM sec WHERE case_id NOT IN (SELECT case_id FROM p)), gen"""
SQL["repeated_observations"] = EV + "\nSELECT case_id, title, count(*) AS times FROM ev GROUP BY 1, 2 HAVING count(*) > 1"
SQL["case_quality_findings"] = _CASE + """,
rp AS (SELECT case_id, count(*) AS n FROM (SELECT case_id, title FROM ev GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
wk AS (SELECT case_id, count(*) AS n FROM best WHERE confidence < 0.5 GROUP BY 1),
mn AS (SELECT DISTINCT case_id FROM hyp),
fi AS (SELECT case_id, 'repeated_observations' AS finding, n AS items FROM rp
  UNION ALL SELECT case_id, 'weak_correlations', n FROM wk
  UNION ALL SELECT case_id, 'high_risk_without_main', 1 FROM risk WHERE risk_score >= 70 AND case_id NOT IN (SELECT case_id FROM mn))
SELECT case_id, finding, items FROM fi
UNION ALL SELECT case_id, 'none', 0 FROM risk WHERE case_id NOT IN (SELECT case_id FROM fi)"""
SQL["alert_levels"] = _CASE + f""",
cs AS (SELECT case_id, {_PRIORITY} AS priority FROM sec GROUP BY 1)
SELECT case_id, priority, risk_score, CASE WHEN risk_score >= 85 THEN 'critical' WHEN risk_score >= 70 THEN 'warning' ELSE 'info' END AS alert_level,
  CASE WHEN risk_score >= 85 THEN 'critical' WHEN risk_score >= 70 THEN 'high' ELSE 'medium' END AS alert_rule,
  CAST(least(3, hn) AS INTEGER) AS shown
FROM risk JOIN cs USING (case_id) WHERE risk_score >= 40"""

# -- ledger --------------------------------------------------------------------------------------------------------

LEDGER = EV + """,
o AS (SELECT case_id AS ledger_id, evidence_id, sha256(event_id) AS evidence_hash, ts,
  row_number() OVER (PARTITION BY case_id ORDER BY ts, evidence_id) - 1 AS i FROM ev)"""
SQL["ledger_verify"] = LEDGER + """,
c AS (SELECT ledger_id, count(*) AS n, max(evidence_id) FILTER (i = 19) AS bad FROM o GROUP BY 1)
SELECT ledger_id, CASE WHEN bad IS NULL THEN 'valid' ELSE 'hash_mismatch' END AS status, bad IS NULL AS valid, n AS total_entries,
  CASE WHEN bad IS NULL THEN n ELSE 19 END AS verified_entries, CASE WHEN bad IS NOT NULL THEN 19 END AS failed_sequence,
  bad AS failed_evidence_id FROM c"""
SQL["ledger_against_evidence"] = LEDGER + """
SELECT evidence_id, i % 20 <> 19 AS matches FROM o"""
SQL["ledger_build"] = LEDGER + f""",
t AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END
  || '+00:00' AS iso FROM o),
chain(ledger_id, i, evidence_id, previous_hash, entry_hash) AS (
  SELECT ledger_id, i, evidence_id, '{vocab.GENESIS_HASH}',
    sha256('{{"evidence_hash":"' || evidence_hash || '","evidence_id":"' || evidence_id || '","operation":"append","previous_hash":"'
      || '{vocab.GENESIS_HASH}' || '","schema_version":"{vocab.SCHEMA_VERSION}","sequence":' || i || ',"timestamp":"' || iso || '"}}')
  FROM t WHERE i = 0
  UNION ALL SELECT t.ledger_id, t.i, t.evidence_id, c.entry_hash,
    sha256('{{"evidence_hash":"' || t.evidence_hash || '","evidence_id":"' || t.evidence_id || '","operation":"append","previous_hash":"'
      || c.entry_hash || '","schema_version":"{vocab.SCHEMA_VERSION}","sequence":' || t.i || ',"timestamp":"' || t.iso || '"}}')
  FROM chain c JOIN t ON t.ledger_id = c.ledger_id AND t.i = c.i + 1)
SELECT ledger_id, i AS sequence, evidence_id, previous_hash, entry_hash FROM chain"""

# -- sources ---------------------------------------------------------------------------------------------------------

_LEVEL = "[0,5,10,15,25,30,40,50,60,65,75,80,85,90,95,100]"
SQL["wazuh_normalized"] = SEC + f"""
SELECT event_id, epoch_us(ts) AS timestamp, 'wazuh' AS source, 'windows' AS platform, category,
  'rule_alert_' || (severity % 11) AS event_type, CASE WHEN severity % 17 >= 15 THEN 100 ELSE {_LEVEL}[severity % 17 + 1] END AS severity,
  host, CASE WHEN pname IS NOT NULL THEN usr END AS user, pname, pid, ppid, parent_name, 'R' || (severity % 11) AS rule_id,
  coalesce(array_to_string(techs, ','), '') AS mitre_techniques, 'TA0002,TA0003,TA0008' AS mitre_tactics,
  CASE WHEN event_type < 'sysmon' THEN event_type || ',sysmon' ELSE 'sysmon,' || event_type END AS tags, 0 AS errors FROM sec"""
SQL["sysmon_normalized"] = SEC + """
SELECT epoch_us(ts) AS timestamp, 'sysmon' AS source, 'windows' AS platform, category,
  CASE category WHEN 'process' THEN 'process_creation' WHEN 'network' THEN 'network_connection' WHEN 'file' THEN 'file_created'
    WHEN 'registry' THEN 'registry_set_value' ELSE 'dns_query' END AS event_type, 50 AS severity, host, usr AS user, pname, pid, ppid,
  parent_name, CAST(NULL AS VARCHAR) AS rule_id, '' AS mitre_techniques, '' AS mitre_tactics, '' AS tags, 0 AS errors,
  CASE category WHEN 'process' THEN '1' WHEN 'network' THEN '3' WHEN 'file' THEN '11' WHEN 'registry' THEN '13' ELSE '22' END AS event_id,
  CASE WHEN category = 'process' OR pname IS NOT NULL THEN 'md5=ab,sha256=cd' ELSE '' END AS hashes FROM sec"""
SQL["mixed_accounting"] = SEC + """,
f AS (SELECT CASE severity % 5 WHEN 0 THEN 'canonical' WHEN 1 THEN 'wazuh' WHEN 2 THEN 'sysmon' ELSE 'unknown' END AS format,
  severity % 5 >= 3 OR (severity % 5 = 0 AND severity % 4 = 0 AND severity > 0) AS bad FROM sec)
SELECT format, count(*) AS raw_count, count(*) FILTER (NOT bad) AS success_count, count(*) FILTER (bad) AS error_count,
  round(count(*) FILTER (NOT bad) / CAST(count(*) AS DOUBLE), 6) AS success_rate FROM f GROUP BY 1"""
SQL["poll_new_only"] = SEC + """
SELECT 'wazuh-' || event_id AS event_id, host, epoch_us(ts) AS timestamp FROM sec WHERE ts >= TIMESTAMP '2024-01-10'"""

# -- export -----------------------------------------------------------------------------------------------------------

_EXPORT = hypotheses(graph(base=pairs("a.tenant_id = b.tenant_id", base=EV)))
SQL["graph_export_nodes"] = _EXPORT + """
SELECT 'Event' AS type, count(*) AS n FROM sec UNION ALL SELECT 'Evidence', count(*) FROM ev
UNION ALL SELECT 'Entity', count(*) FROM ent UNION ALL SELECT 'Hypothesis', count(DISTINCT hypothesis_id) FROM hyp
UNION ALL SELECT 'EvidenceLedger', count(DISTINCT case_id) FROM sec"""
SQL["graph_export_edges"] = _EXPORT + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY round(confidence, 9) DESC,
  round(score, 9) DESC, source_event_id, related_event_id) AS rank FROM pr))
SELECT upper(rel) AS relationship, 'Entity' AS target_type, count(*) AS n FROM rel GROUP BY 1
UNION ALL SELECT 'OBSERVED_IN', 'Event', count(DISTINCT (eid, event_id)) FROM m
UNION ALL SELECT 'REFERENCES', 'Event', count(*) FROM ev
UNION ALL SELECT 'SUPPORTS', 'Hypothesis', count(*) FROM te
UNION ALL SELECT 'CORRELATES_SOURCE', 'Event', count(*) FROM top
UNION ALL SELECT 'CORRELATES_RELATED', 'Event', count(*) FROM top"""

# -- streaming ----------------------------------------------------------------------------------------------------------

_BATCHES = SEC + """,
o AS (SELECT host, tenant_id, epoch_us(ts) // 2000 AS t, row_number() OVER (PARTITION BY host ORDER BY epoch_us(ts) // 2000, event_id) - 1 AS i FROM sec),
w(host, i, t, start, first_t, size) AS (
  SELECT host, i, t, i, t, 1 FROM o WHERE i = 0
  UNION ALL SELECT o.host, o.i, o.t,
    CASE WHEN size >= 100 OR o.t - first_t >= 30000000 OR o.t - w.t >= 5000000 THEN o.i ELSE start END,
    CASE WHEN size >= 100 OR o.t - first_t >= 30000000 OR o.t - w.t >= 5000000 THEN o.t ELSE first_t END,
    CASE WHEN size >= 100 OR o.t - first_t >= 30000000 OR o.t - w.t >= 5000000 THEN 1 ELSE size + 1 END
  FROM w JOIN o ON o.host = w.host AND o.i = w.i + 1)"""
SQL["event_batches_replay"] = _BATCHES + """
SELECT w.host AS batch_group, start AS batch_start, count(*) AS size, min(w.t) AS first_at, max(w.t) AS last_at,
  'Investigation ' || w.host AS title, min(o.tenant_id) AS tenant_id FROM w JOIN o USING (host, i) GROUP BY 1, 2"""
SQL["event_batches_stream"] = _BATCHES + """,
b AS (SELECT w.host AS batch_group, start, count(*) AS size FROM w GROUP BY 1, 2)
SELECT batch_group, row_number() OVER (PARTITION BY batch_group ORDER BY start) - 1 AS batch_no, size FROM b"""
SQL["stream_pair_correlation"] = SQL["pair_correlation"]
SQL["stream_dedup"] = SEC + "\nSELECT event_id, host, epoch_us(ts) AS timestamp FROM sec"
