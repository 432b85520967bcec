import json

import pytest
from pyspark.sql import functions as F

from casewright.plans.investigate import investigate
from casewright.sources import normalize
from casewright.sources.store import Store, delete_cases, delete_tenant, load_cases, save_cases

ALERT = {
    "id": "17", "timestamp": "2026-09-26T10:00:00.000+0000", "location": "x",
    "rule": {
        "id": 92058, "level": 12, "description": "Shim Database", "groups": ["Sysmon", "Windows"],
        "mitre": {"id": "t1546.011", "tactic": ["Persistence", "privilege_escalation", "nonsense"]},
    },
    "agent": {"id": "001", "name": "WIN-01"},
    "data": {"win": {"system": {"eventID": "1"}, "eventdata": {
        "Image": "C:/Windows/sdbinst.exe", "processId": "0x10", "parentProcessId": "812",
        "ParentImage": "C:\\Windows\\svchost.exe", "User": "SYSTEM",
    }}},
}
SYSMON = {
    "EventID": 1, "UtcTime": "2026-09-26 10:00:00.000", "Computer": "WIN-02", "User": "kim", "Image": "C:\\a\\b.exe",
    "ProcessId": "7", "ParentProcessId": "bad", "Hashes": "MD5=AB,junk,SHA256=CD,MD5=EF",
}
CANONICAL = {"event_id": "E", "timestamp": "2026-09-26T10:00:00Z", "source": "edr", "event_type": "x", "severity": 5, "tags": [" B", "a", "A "]}


def raw(spark, *items):
    return spark.createDataFrame([(i if isinstance(i, str) else json.dumps(i),) for i in items], "raw string")


def test_wazuh(spark):
    row = normalize.wazuh_events(raw(spark, ALERT)).first()
    assert (row.event_id, row.severity, row.platform, row.category, row.event_type) == ("17", 85, "windows", "process", "shim_database")
    assert (row.host, row.user, row.rule_id, row.rule_level) == ("WIN-01", "SYSTEM", "92058", 12)
    assert (row.mitre_techniques, row.mitre_tactics, row.tags) == (["T1546.011"], ["TA0003", "TA0004"], ["sysmon", "windows"])
    p = row.process
    assert (p.name, p.pid, p.parent_pid, p.parent_name, p.image_path) == ("sdbinst.exe", 16, 812, "svchost.exe", "C:/Windows/sdbinst.exe")
    assert row.errors == [] and row.timestamp.isoformat().startswith("2026-09-26T10:00:00")


@pytest.mark.parametrize(
    "change, column, expected",
    [
        ({"data": {"audit": {}}}, "platform", "linux"), ({"data": {}, "location": "/var/Ubuntu"}, "platform", "linux"),
        ({"data": {}, "rule": {"groups": ["Firewall"]}}, "category", "network"), ({"data": {}, "rule": {"groups": []}}, "category", "other"),
        ({"data": {}, "rule": {"id": 5}}, "event_type", "wazuh_event_5"), ({"rule": {"level": "0"}}, "severity", 0),
        ({"rule": {"level": 99}}, "severity", 100), ({"agent": {"id": "7"}}, "host", "7"),
        ({"data": {"win": {"eventdata": {"newProcessName": "a.exe"}}}}, "category", "process"),
    ],
)
def test_wazuh_rules(spark, change, column, expected):
    assert normalize.wazuh_events(raw(spark, {**ALERT, **change})).first()[column] == expected


def test_sysmon(spark):
    row = normalize.sysmon_events(raw(spark, SYSMON)).first()
    assert (row.category, row.event_type, row.severity, row.host) == ("process", "process_creation", 50, "WIN-02")
    assert (row.process.name, row.process.pid, row.process.parent_pid) == ("b.exe", 7, None)
    assert row.process.hashes == {"md5": "ef", "sha256": "cd"} and row.event_id.endswith("-1")
    assert normalize.sysmon_events(raw(spark, {"EventID": "99", "UtcTime": "no"})).first().errors == ["timestamp is missing or not a time"]


def test_canonical_validation(spark):
    good = normalize.canonical_events(raw(spark, CANONICAL)).first()
    assert good.errors == [] and good.tags == ["a", "b"] and good.category == "other" and good.platform == "unknown"
    bad = normalize.canonical_events(raw(spark, {**CANONICAL, "severity": 101, "source": "x", "odd": 1, "mitre_techniques": ["A1"], "mitre_tactics": ["TB"]})).first()
    assert len(bad.errors) == 5
    inferred = normalize.canonical_events(raw(spark, {**CANONICAL, "network": {"url": "http://x"}, "file": {"path": "p"}})).first()
    assert inferred.category == "http"
    with pytest.raises(Exception, match="severity"):
        normalize.strict(normalize.canonical_events(raw(spark, {**CANONICAL, "severity": -1}))).collect()


def test_mixed_records(spark):
    rows = normalize.normalize(raw(spark, ALERT, SYSMON, CANONICAL, {"x": 1}, "[1]", "{broken"))
    got = {r.format: (r.raw_count, r.success_count) for r in normalize.accounting(rows, ["format"]).collect()}
    assert got == {"wazuh": (1, 1), "sysmon": (1, 1), "canonical": (1, 1), "unknown": (3, 0)}
    assert normalize.quarantine(rows).count() == 3 and normalize.valid(rows).count() == 3


def test_documents_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([CANONICAL, CANONICAL]))
    (tmp_path / "b.json").write_text(json.dumps({"events": [CANONICAL]}))
    (tmp_path / "c.json").write_text(json.dumps(CANONICAL, indent=1))
    (tmp_path / "d.json").write_text(json.dumps(CANONICAL) + "\n\n" + json.dumps({**CANONICAL, "severity": 500}))
    rows = normalize.canonical_events(normalize.read_documents(spark, str(tmp_path)))
    assert rows.count() == 6
    assert normalize.valid(rows).count() == 5 and normalize.whole_files_only(rows).count() == 4
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "p.json").write_text(json.dumps({"data": {"affected_items": [ALERT, {**ALERT, "id": "18"}]}}))
    alerts = normalize.read_alert_pages(spark, str(pages))
    assert sorted(r.alert_id for r in alerts.collect()) == ["17", "18"]
    events = normalize.poll_ids(normalize.wazuh_events(alerts.select("raw")))
    seen = spark.createDataFrame([("wazuh-17",)], "event_id string")
    assert [r.event_id for r in normalize.unseen(events, seen).collect()] == ["wazuh-18"]


def test_store(spark, make_events, tmp_path):
    def events(case, host, user="kim"):
        rows = [
            {"event_id": f"{case}{i}", "timestamp": f"2026-01-01T00:00:0{i}Z", "host": host, "user": user, "tenant_id": "t",
             "process": {"name": "a.exe", "pid": 1}, "mitre_techniques": ["T1105"]} for i in range(2)
        ]
        return make_events(rows, case_id=case)

    store = Store(spark, str(tmp_path), buckets=4)
    save_cases(store, investigate(events("A", "h")))
    save_cases(store, investigate(events("B", "h", "lee")))
    count = lambda table: store.load(table).count()
    before = {t: count(t) for t in ("cases", "evidence", "entities", "relationships", "hypotheses")}
    assert before == {"cases": 2, "evidence": 4, "entities": 5, "relationships": 2, "hypotheses": 6}
    save_cases(store, investigate(events("A", "h")))  # the same again
    assert {t: count(t) for t in before} == before
    save_cases(store, investigate(events("A", "h").limit(1)))  # one child is gone
    assert count("evidence") == 3
    assert set(load_cases(store)) >= {"cases", "evidence", "hypotheses"}
    delete_cases(store, spark.createDataFrame([("B",)], "case_id string"))
    # only the user of B belonged to no other case
    assert (count("cases"), count("evidence"), count("entities"), count("relationships")) == (1, 1, 4, 1)
    delete_tenant(store, "t")
    assert count("entities") == 0


def test_int_and_time_forms(spark):
    frame = spark.createDataFrame([("0x1F",), ("12",), ("x",), (None,)], "v string")
    from casewright.functions.text import to_int

    assert [r.i for r in frame.select(to_int(F.col("v")).alias("i")).collect()] == [31, 12, None, None]
    times = ["2026-01-01T00:00:00Z", "2026-01-01 00:00:00", "2026-01-01T02:00:00+0200", "2026-01-01T02:00:00+02:00"]
    frame = spark.createDataFrame([(t,) for t in times], "v string")
    assert frame.select(normalize.timestamp(F.col("v")).alias("t")).distinct().count() == 1
