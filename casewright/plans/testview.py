"""The driver's ``events`` table read as canonical security events.

The mapping is a plain projection (rules in FIXTURES.md), so filters and column
selection still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewright.schemas import EVENT
from casewright.session import configure

PROCESS_NAMES = [
    "PowerShell.exe", "cmd.exe", "certutil.exe", "mshta.exe",
    "svchost.exe", "rundll32.exe", "explorer.exe", "sdbinst.exe",
]
TECHNIQUES = [
    ["T1059.001"], ["T1105"], ["T1071", "T1105"], ["T1546.011"], ["T1003.001"], ["T1047"], None, None, None,
]
RELIABILITIES = [
    "completely_reliable", "usually_reliable", "fairly_reliable",
    "not_usually_reliable", "unreliable", "cannot_be_judged", None,
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: list, index: str) -> str:
    """Value at a 0-based position of a fixed list, as SQL text."""
    text = lambda v: "NULL" if v is None else f"'{v}'"
    return f"element_at(array({', '.join(text(v) for v in values)}), CAST({index} AS INT) + 1)"


def _struct(context: str, /, **given: str) -> str:
    """A context struct as SQL text; fields that are not given are null."""
    fields = EVENT[context].dataType.fields
    parts = [f"'{f.name}', CAST({given.get(f.name, 'NULL')} AS {f.dataType.simpleString()})" for f in fields]
    return f"named_struct({', '.join(parts)})"


def sec_events(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """Canonical events with a ``case_id`` of host and day; as a table or as a stream."""
    table = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    if streaming:
        raw = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    else:
        raw = table
    raw = raw.selectExpr(
        "event_id AS n", "CAST(ts AS TIMESTAMP) AS ts", "user_id AS u", "event_type",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "CASE event_type WHEN 'click' THEN 'process' WHEN 'view' THEN 'network' WHEN 'purchase' THEN 'file' "
        "WHEN 'signup' THEN 'dns' ELSE 'registry' END AS category",
    )
    child = "category = 'process' AND k % 4 <> 0"
    only = lambda where, struct: f"CASE WHEN {where} THEN {struct} END"
    process = _struct(
        "process", name=_pick(PROCESS_NAMES, "k % 8"), pid="1000 + n % 97",
        parent_pid=f"CASE WHEN {child} THEN 1000 + (7 * n) % 97 END",
        parent_name=f"CASE WHEN {child} THEN {_pick(PROCESS_NAMES, '(k + 3) % 8')} END",
    )
    techniques = " ".join(
        f"WHEN {i} THEN array({', '.join(repr(t) for t in ts)})" for i, ts in enumerate(TECHNIQUES) if ts
    )
    given = {
        "event_id": "concat('E-', n)",
        "schema_version": "'1.0'",
        "tenant_id": "concat('tenant-', u % 3)",
        "timestamp": "ts",
        "source": "'sysmon'",
        "platform": "'windows'",
        "category": "category",
        "event_type": "event_type",
        "source_reliability": _pick(RELIABILITIES, "u % 7"),
        "severity": "k",
        "host": "concat('HOST-', u % 12)",
        "user": "CASE WHEN k % 10 <> 9 THEN concat('user', u % 40) END",
        "rule_id": "CASE WHEN k % 5 = 0 THEN concat('R-', k % 11) END",
        "mitre_techniques": f"CASE k % 9 {techniques} END",
        "process": only("category IN ('process', 'network', 'dns')", process),
        "network": only(
            "category = 'network'",
            _struct(
                "network", source_ip="concat('10.0.', u % 4, '.', u % 50)", destination_ip="concat('203.0.113.', k % 30)"
            ),
        ),
        "file": only(
            "category = 'file'",
            _struct(
                "file", path=r"concat('C:\\tmp\\f', k % 25, '.bin')", hashes="map('sha256', sha2(concat('f', k % 25), 256))"
            ),
        ),
        "registry": only(
            "category = 'registry'",
            _struct("registry", key=r"concat('HKLM\\Software\\K', k % 15)", is_persistence_key="k % 15 < 3"),
        ),
        "dns": only("category = 'dns'", _struct("dns", query="concat('D', k % 20, '.example.com.')")),
    }
    columns = [f"CAST({given.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in EVENT.fields]
    return raw.selectExpr(*columns, "concat('HOST-', u % 12, '/', date_format(ts, 'yyyy-MM-dd')) AS case_id")


def sec_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One process start per event: on each of 12 hosts a ternary tree, some parents missing."""
    raw = read(spark, sf_dir, "events").select("event_id").selectExpr("event_id AS n", "event_id DIV 12 AS m")
    parent = "CASE WHEN m > 0 THEN CASE WHEN m % 50 = 0 THEN m + 10000000 ELSE (m - 1) DIV 3 END END"
    process = _struct("process", name="concat('p', m % 8)", pid="m", parent_pid=parent)
    return raw.selectExpr("concat('E-', n) AS event_id", "concat('HOST-', n % 12) AS host", f"{process} AS process")


#: The same events for DuckDB, flat.
SEC_SQL = r"""
raw AS (
  SELECT event_id AS n, ts, user_id AS u, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE event_type WHEN 'click' THEN 'process' WHEN 'view' THEN 'network'
              WHEN 'purchase' THEN 'file' WHEN 'signup' THEN 'dns' ELSE 'registry' END AS category
  FROM events),
sec AS (
  SELECT 'E-' || n AS event_id, ts, 'tenant-' || (u % 3) AS tenant_id, event_type, category, k AS severity,
    (['completely_reliable','usually_reliable','fairly_reliable','not_usually_reliable','unreliable',
      'cannot_be_judged',NULL])[u % 7 + 1] AS reliability,
    'HOST-' || (u % 12) AS host, 'HOST-' || (u % 12) || '/' || strftime(ts, '%Y-%m-%d') AS case_id,
    CASE WHEN k % 10 <> 9 THEN 'user' || (u % 40) END AS usr,
    CASE WHEN category IN ('process','network','dns') THEN
      (['PowerShell.exe','cmd.exe','certutil.exe','mshta.exe','svchost.exe','rundll32.exe','explorer.exe','sdbinst.exe'])[k % 8 + 1] END AS pname,
    CASE WHEN category IN ('process','network','dns') THEN 1000 + n % 97 END AS pid,
    CASE WHEN category = 'process' AND k % 4 <> 0 THEN 1000 + (7 * n) % 97 END AS ppid,
    CASE WHEN category = 'process' AND k % 4 <> 0 THEN
      (['PowerShell.exe','cmd.exe','certutil.exe','mshta.exe','svchost.exe','rundll32.exe','explorer.exe','sdbinst.exe'])[(k + 3) % 8 + 1] END AS parent_name,
    CASE WHEN category = 'network' THEN '10.0.' || (u % 4) || '.' || (u % 50) END AS src_ip,
    CASE WHEN category = 'network' THEN '203.0.113.' || (k % 30) END AS dst_ip,
    CASE WHEN category = 'dns' THEN 'D' || (k % 20) || '.example.com.' END AS dns_query,
    CASE WHEN category = 'file' THEN 'C:\tmp\f' || (k % 25) || '.bin' END AS file_path,
    CASE WHEN category = 'file' THEN sha256('f' || (k % 25)) END AS file_sha,
    CASE WHEN category = 'registry' THEN 'HKLM\Software\K' || (k % 15) END AS reg_key,
    CASE WHEN category = 'registry' THEN k % 15 < 3 END AS is_persist,
    CASE WHEN k % 5 = 0 THEN 'R-' || (k % 11) END AS rule_id,
    CASE k % 9 WHEN 0 THEN ['T1059.001'] WHEN 1 THEN ['T1105'] WHEN 2 THEN ['T1071','T1105']
      WHEN 3 THEN ['T1546.011'] WHEN 4 THEN ['T1003.001'] WHEN 5 THEN ['T1047'] END AS techs
  FROM raw)
"""
