import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions import ordered
from casewright.operators import cases, detect, hypotheses, intel, ledger, risk, timeline

T0 = "2026-01-01T00:00:00Z"


# -- ordered helpers ------------------------------------------------------------------------


def test_previous_and_index_over_blocks(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", rng.randrange(50), i) for i in range(3000)] + [(None, 1, -1), (None, 2, -2)]
    frame = spark.createDataFrame(rows, "k string, t int, id int").repartition(5)
    got = ordered.with_previous(frame, ["k"], ["t", "id"], ["id"])
    index = ordered.with_row_index(frame, ["k"], ["t", "id"])
    by_key = {}
    for k, t, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        by_key.setdefault(k, []).append(i)
    before = {i: (ids[n - 1] if n else None, n) for ids in by_key.values() for n, i in enumerate(ids)}
    assert {r.id: r.prev_id for r in got.collect()} == {i: p for i, (p, _) in before.items()}
    assert {r.id: r.row_index for r in index.collect()} == {i: n for i, (_, n) in before.items()}


# -- timeline -------------------------------------------------------------------------------


def test_timeline(make_events):
    rows = [
        {"event_id": " a ", "timestamp": T0, "host": "h", "severity": 70, "process": {"name": " x ", "pid": 5, "parent_pid": 1}},
        {"event_id": "b", "timestamp": "2026-01-01T00:00:10Z", "host": "H", "severity": 69, "process": {"name": "y", "pid": 6, "parent_pid": 5}},
        {"event_id": "c", "timestamp": None, "event_type": " ", "severity": 101, "category": "file"},
    ]
    t = timeline.project(make_events(rows))
    ids = lambda f: sorted(r.event_id for r in f.collect())
    assert t.filter("event_id = 'a'").first().summary == "process_creation: x (PID 5)"
    assert ids(timeline.for_host(t, "h")) == ["a"] and ids(timeline.for_host(t, " ")) == []
    assert ids(timeline.for_process(t, 5)) == ["a"] and ids(timeline.for_process(t, None)) == []
    assert ids(timeline.related_to_process(t, 5)) == ["a", "b"]
    assert ids(timeline.high_severity(t)) == ["a", "c"]
    assert ids(timeline.between(t, "2026-01-01", "2026-01-01 00:00:10")) == ["a", "b"]
    assert ids(timeline.since(t, "2026-01-01 00:00:01")) == ["b"] and ids(timeline.until(t, "2026-01-01")) == ["a"]
    with pytest.raises(ValueError):
        timeline.between(t, "2026-01-02", "2026-01-01")
    with pytest.raises(ValueError):
        timeline.high_severity(t, 101)
    errors = {r.event_id: r.e for r in t.select("event_id", timeline.row_errors().alias("e")).collect()}
    assert errors["a"] == [] and len(errors["c"]) == 2
    assert timeline.to_json(t).filter("event_id = 'b'").first().json.startswith('{"category":"process","event_id":"b"')


def test_timeline_dedup(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "event_id string, n int, v string")
    assert {r.event_id: r.v for r in timeline.dedup(rows, ["n"]).collect()} == {"a": "x", "b": "z"}
    assert {r.event_id: r.v for r in timeline.dedup(rows, ["n"], "last").collect()} == {"a": "y", "b": "z"}
    with pytest.raises(Exception, match="duplicate event_id: a"):
        timeline.dedup(rows, ["n"], "error").collect()


# -- detection --------------------------------------------------------------------------------


def test_lolbins(make_events, spark):
    rows = [
        {"event_id": "1", "timestamp": T0, "process": {"name": "C:/Windows/CertUtil.EXE", "command_line": "-urlcache"}},
        {"event_id": "2", "timestamp": T0, "process": {"name": "expand.exe"}},
        {"event_id": "3", "timestamp": T0, "process": {"name": "mshta.exe"}, "category": "network"},
    ]
    events = make_events(rows)
    found = {r.event_id: r for r in detect.lolbins(events).collect()}
    assert set(found) == {"1", "2"} and found["1"].rule_id == "lolbin.certutil.exe" and found["1"].severity == 70
    assert found["1"].matched_fields["process.command_line"] == "-urlcache"
    assert [r.event_id for r in detect.lolbins(events, min_severity="MEDIUM").collect()] == ["1"]
    assert detect.lolbins(events, detect.registry(spark, [])).count() == 0


@pytest.mark.parametrize(
    "condition, expected",
    [
        ("Sel_A", {"1"}), ("sel_a AND sel_b", set()), ("sel_a or sel_b", {"1", "2"}), ("1 of sel*", {"1", "2"}),
        ("all of sel*", set()), ("1 of sel* and other", {"1"}), ("sel_b or sel_a and nothing", {"2"}), ("missing", set()), ("", set()),
    ],
)
def test_conditions(make_events, condition, expected):
    rows = [
        {"event_id": "1", "timestamp": T0, "process": {"name": "PowerShell.exe", "command_line": "iex (New-Object)"}, "metadata": {"zone": "dmz"}},
        {"event_id": "2", "timestamp": T0, "process": {"name": "cmd.exe"}},
    ]
    rule = {
        "id": "r", "title": "t", "tags": ["attack.t1059.001", "attack.ta0002", "other"],
        "detection": {
            "Sel_A": {"process.name": "power*", "process.command_line": "NEW-object"}, "sel_b": {"process.name": ["x", "cmd.ex?"]},
            "other": {"zone": "DMZ"}, "nothing": {"process.unknown": "x"}, "condition": condition,
        },
    }
    found = detect.apply_rules(make_events(rows), [rule]).collect()
    assert {r.event_id for r in found} == expected
    assert all(r.mitre_techniques == ["T1059.001"] and r.severity == 50 for r in found)


def test_rule_files_and_column_rules(make_events, spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "level": "high", "detection": {"s": {"host": "h"}, "condition": "s"}}]')
    (tmp_path / "b.json").write_text('{"id": "2", "level": "odd", "detection": {"s": {"host": "x"}, "condition": "s"}}')
    rules = detect.read_rules(spark, str(tmp_path))
    events = make_events([{"event_id": "1", "timestamp": T0, "host": "H"}])
    assert [(r.rule_id, r.severity_name) for r in detect.run(events, rules).collect()] == [("1", "HIGH")]
    own = detect.apply_columns(events, [("mine", "LOW", F.col("severity") > 10)])
    assert own.first().rule_id == "mine"
    stats = {(r.dimension, r.value): r.findings for r in detect.stats(own).collect()}
    assert stats == {("total", "all"): 1, ("rule", "mine"): 1, ("severity", "LOW"): 1}


# -- intel --------------------------------------------------------------------------------------


def test_intel(make_events, spark):
    rows = [{
        "event_id": "1", "timestamp": T0, "process": {"hashes": {"sha256": "AB"}}, "file": {"hashes": {"md5": "ab"}},
        "network": {"source_ip": "1.1.1.1", "destination_ip": "1.1.1.1", "url": "http://x"}, "dns": {"query": "Evil.com."},
    }]
    found = intel.indicators(make_events(rows))
    assert found.count() == 6
    distinct = intel.distinct_indicators(found)
    assert {(r.indicator_type, r.indicator, r.sightings) for r in distinct.collect()} == {
        ("hash", "ab", 2), ("ip", "1.1.1.1", 2), ("url", "http://x", 1), ("domain", "evil.com", 1)
    }
    feed = spark.createDataFrame(
        [("otx", "domain", "evil.com", True, 2, 4, None, ["x"], None), ("misp", "url", "http://x", True, 0, 0, None, [], None)],
        "provider string, indicator_type string, indicator string, found boolean, malicious_count int, total_count int, "
        "reputation int, tags array<string>, error string",
    )
    results = intel.with_verdict(intel.enrich(distinct, feed, intel.provider_support(spark)))
    row = results.filter("provider = 'otx' AND indicator_type = 'domain'").first()
    assert (row.is_malicious, row.detection_ratio) == (True, 0.5)
    total = intel.summary(results).first()
    # otx and virustotal do not know urls
    assert (total.indicator_count, total.malicious, total.suspicious, total.clean, total.errors) == (4, 1, 1, 8, 2)


# -- ledger --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chain(spark):
    rows = [("L" if i % 3 else "K", f"e{i}", f"hash{i}", "append", dt.datetime(2026, 1, 1, 0, 0, i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "ledger_id string, evidence_id string, evidence_hash string, operation string, timestamp timestamp")
    whole, blocks = ledger.append(frame), ledger.append(frame, block_rows=7)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocks.collect()))
    return whole


def status(entries, name="L"):
    return ledger.verify(entries).filter(F.col("ledger_id") == name).first()


def test_ledger_is_valid_and_continues(chain, spark):
    assert {r.status for r in ledger.verify(chain).collect()} == {"valid"}
    more = spark.createDataFrame(
        [("L", "late", "h", "attach", dt.datetime(2026, 1, 2))],
        "ledger_id string, evidence_id string, evidence_hash string, operation string, timestamp timestamp",
    )
    longer = chain.unionByName(ledger.append(more, ledger.heads(chain)))
    assert status(longer).status == "valid" and status(longer).total_entries == 21
    assert ledger.entry_at(chain, 0).filter("previous_hash = 'GENESIS'").count() == 2


@pytest.mark.parametrize(
    "column, value, at, expected",
    [
        ("evidence_hash", "x", 7, "hash_mismatch"), ("evidence_id", "x", 7, "hash_mismatch"), ("operation", "derive", 7, "hash_mismatch"),
        ("previous_hash", "x", 7, "broken_chain"), ("previous_hash", "x", 0, "genesis_anomaly"), ("entry_hash", "f" * 64, 7, "hash_mismatch"),
    ],
)
def test_ledger_tampering(chain, column, value, at, expected):
    hit = (F.col("ledger_id") == "L") & (F.col("sequence") == at)
    changed = chain.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)))
    row = status(changed)
    assert (row.status, row.verified_entries, row.failed_sequence) == (expected, at, at)
    assert status(changed, "K").valid


def test_ledger_missing_entry(chain):
    row = status(chain.filter("NOT (ledger_id = 'L' AND sequence = 4)"))
    assert (row.status, row.verified_entries, row.failed_sequence) == ("sequence_anomaly", 4, 5)


def test_ledger_against_evidence(chain, spark):
    now = spark.createDataFrame([("e1", "hash1"), ("e2", "other"), ("zz", "h")], "evidence_id string, content_hash string")
    got = {r.evidence_id: r.matches for r in ledger.against_evidence(chain, now).collect()}
    assert got == {"e1": True, "e2": False, "zz": False}


# -- status logs and cases ---------------------------------------------------------------------------


def test_status_machine(spark):
    log = spark.createDataFrame(
        [("c", 1, "1", "detected"), ("c", 2, "2", "triaged"), ("c", 3, "3", "confirmed"), ("c", 4, "4", "resolved"), ("d", 1, "5", "triaged")],
        "case_id string, ts int, step_id string, status string",
    )
    assert [(r.prev_status, r.status) for r in cases.transitions(log).collect()] == [("triaged", "confirmed")]
    done = log.withColumns({"outcome": F.lit("benign"), "closed_at": F.lit(None).cast("timestamp")})
    assert cases.incomplete_resolutions(done).count() == 1
    assert hypotheses.allowed_steps(spark, vocab.HYPOTHESIS_TRANSITIONS).count() == 7


def test_risk_evolution(spark):
    rows = spark.createDataFrame(
        [("c", 1, "a", 40, 0.5), ("c", 2, "b", 25, 0.4), ("d", 1, "a", 10, 0.1)],
        "case_id string, ts int, update_id string, risk_score int, confidence double",
    )
    got = {(r.case_id, r.ts): (r.previous_risk_score, r.delta) for r in risk.evolution(rows).collect()}
    assert got == {("c", 1): (0, 40), ("c", 2): (40, -15), ("d", 1): (0, 10)}


def test_listing(spark):
    rows = spark.createDataFrame(
        [("a", "t1", "triaged", "high", "kim", 50, dt.datetime(2026, 1, 1)), ("b", "t1", "resolved", "low", None, 10, dt.datetime(2026, 1, 2))],
        "case_id string, tenant_id string, status string, priority string, analyst string, risk_score int, created_at timestamp",
    )
    ids = lambda f: [r.case_id for r in f.collect()]
    assert ids(cases.listing(rows, tenant_id="t1", min_risk=20)) == ["a"]
    assert ids(cases.listing(rows, since=dt.datetime(2026, 1, 2))) == ["b"]
    assert ids(cases.page(rows, 1, 1)) == ["a"]
    with pytest.raises(ValueError):
        cases.tenant_scope(rows, "")


def test_provider_lookup_keeps_going(spark):
    def ask(kind, value):
        if value == "bad":
            raise RuntimeError("quota")
        return {"found": True, "malicious_count": 3, "total_count": 9, "tags": [kind]}

    distinct = spark.createDataFrame([("ip", "1.1.1.1"), ("ip", "bad")], "indicator_type string, indicator string")
    feed = intel.lookup(distinct, "mine", ask)
    got = {r.indicator: (r.found, r.malicious_count, r.error) for r in intel.enrich(distinct, feed).collect()}
    assert got == {"1.1.1.1": (True, 3, None), "bad": (False, 0, "quota")}
