"""Smaller functions of the library, each on a few rows."""

import json

from pyspark.sql import functions as F

from casewright.operators import cases, correlate, evidence, export, graph, hypotheses, ledger, report, risk, tree
from casewright.plans.investigate import investigate
from casewright.sources import normalize
from casewright.sources.store import Store, load_snapshot, save_graph, snapshot, stored_stats
from casewright.streaming import stream

T0 = "2026-01-01T00:00:00Z"
ROWS = [
    {"event_id": "1", "timestamp": T0, "tenant_id": "t", "host": "h", "user": "kim", "process": {"name": "a", "pid": 1, "parent_pid": 9}, "rule_id": "R"},
    {"event_id": "2", "timestamp": "2026-01-01T00:00:05Z", "tenant_id": "t", "host": "h", "user": "kim", "process": {"name": "a", "pid": 1},
     "mitre_techniques": ["T1059", "T1105"], "dns": {"query": "x.com"}},
]


def test_order_and_flags(make_events):
    g = graph.build(make_events(ROWS))
    kinds = [r.entity_type for r in g["entities"].orderBy(*graph.entity_sort_key()).collect()]
    assert kinds == ["host", "user", "process", "domain", "mitre_technique", "mitre_technique"]
    flagged = {r.entity_type: (r.is_global, r.is_host_scoped, r.is_substantive) for r in graph.entity_flags(g["entities"]).collect()}
    assert flagged["user"] == (False, True, True) and flagged["domain"] == (True, False, True)
    assert g["relationships"].select(graph.relationship_errors().alias("e")).filter("size(e) > 0").count() == 0
    loop = g["relationships"].withColumn("target_id", F.col("source_id"))
    assert loop.select(graph.relationship_errors().alias("e")).first().e == ["an edge must not join a node to itself"]


def test_extend_relationships(make_events):
    early, late = (graph.build(make_events([row]))["relationships"] for row in ROWS)
    both = graph.build(make_events(ROWS))["relationships"]
    key = lambda f: sorted(map(str, f.select(*sorted(f.columns)).collect()))
    assert key(graph.extend_relationships(early, late)) == key(both)


def test_evidence_by_hand_and_edges(make_events, spark):
    events = make_events(ROWS, case_id="C")
    rows = evidence.from_event(events, "analyst", "strong", "Seen by hand", confidence=0.9)
    row = rows.filter("event_id = '1'").first()
    assert (row.evidence_id, row.evidence_type, row.strength, row.title, row.confidence) == ("E-1", "analyst", "strong", "Seen by hand", 0.9)
    assert evidence.verify_hash(rows).filter("NOT hash_ok").count() == 0
    assert evidence.flags(rows).filter("is_strong AND NOT is_critical AND is_high_confidence").count() == 2
    links = spark.createDataFrame([("E-1", "H", "supports", 1.0)], "evidence_id string, hypothesis_id string, assessment string, weight double")
    assert {r.relationship for r in evidence.reference_edges(rows, links).collect()} == {"REFERENCES", "SUPPORTS"}


def test_tables_of_a_case(make_events, spark):
    t = investigate(make_events(ROWS, case_id="C"), analyst="lee")
    made = t["hypotheses"].orderBy(*hypotheses.sort_key()).collect()
    assert [r.hypothesis_type for r in made][:4] == ["main", "main", "counter", "counter"]
    assert hypotheses.with_fingerprint_check(t["hypotheses"]).filter("NOT fingerprint_ok").count() == 0
    assert hypotheses.flags(t["hypotheses"]).filter("is_active").count() == len(made)
    assert cases.list_columns(t["cases"]).columns[:3] == ["case_id", "tenant_id", "title"]
    assert cases.flags(t["cases"]).first().age_seconds == 5.0
    assert risk.by_weight(t["risk_factors"]).first().contribution == -12.0
    assert risk.flags(t["risk"]).first().is_high_risk is False
    assert correlate.flags(t["correlations"]).filter("is_strong OR is_weak").count() == 0
    assert t["correlations"].select(correlate.row_errors().alias("e")).filter("size(e) > 0").count() == 0
    nodes = {r.type for r in export.nodes(t).collect()}
    assert nodes == {"Event", "Evidence", "Entity", "Correlation", "Hypothesis", "InvestigationCase"}
    edges = {r.relationship for r in export.edges(t).collect()}
    assert edges >= {"RUN_AS", "OBSERVED_IN", "SUPPORTS", "CORRELATES_SOURCE", "TRIGGERED_BY", "OWNED_BY", "INVOLVES"}
    columns = ["case_id", "severity", "priority"]
    saved = snapshot(t["cases"], columns)
    assert load_snapshot(saved, t["cases"].select("severity", "priority").schema).first().priority == "medium"
    findings = {r.finding for r in report.case_findings(t["evidence"], t["hypotheses"], t["correlation_totals"], t["risk"]).collect()}
    assert findings == {"repeated_observations"}


def test_reasons(spark):
    rows = correlate.reason_table(spark, "network").collect()
    assert [r.reason for r in rows] == ["same_destination_ip", "same_dns_query", "same_source_ip"]


def test_orphans_and_entries(make_events, spark):
    rows = tree.with_parent(tree.nodes(make_events(ROWS[:1])))
    assert tree.orphans(rows).first().event_id == "1"
    assert tree.find(rows, "h", pid=1).count() == 1 and tree.children(rows, "h|pid:1").count() == 0
    entries = ledger.append(
        make_events(ROWS).select(
            F.lit("L").alias("ledger_id"), F.col("event_id").alias("evidence_id"), F.lit("x").alias("evidence_hash"),
            F.lit("append").alias("operation"), "timestamp",
        )
    )
    assert ledger.entries_of(entries, "2").first().sequence == 1


def test_event_predicates(make_events):
    row = normalize.predicates(make_events([{**ROWS[0], "category": "dns", "severity": 70}])).first()
    assert (row.is_network_event, row.is_process_event, row.is_windows, row.is_high_severity) == (True, False, True, True)


def test_stored_graph_numbers(make_events, spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=2)
    save_graph(store, graph.build(make_events(ROWS, case_id="C"), ["case_id"]))
    row = stored_stats(store, "t").first()
    assert (row.entities, row.entity_types, row.hosts, row.relationships) == (6, 5, 1, 1)


ALERT = {"id": "5", "timestamp": T0, "rule": {"id": "1", "level": 3, "description": "x"}, "agent": {"name": "h"}}


def test_files_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([json.dumps(ALERT), json.dumps(ALERT), json.dumps({**ALERT, "id": "6"}), ""]))
    assert normalize.read_lines(spark, str(folder)).count() == 3
    events = stream.poll_files(spark, str(folder))
    run = (
        events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(str(tmp_path / "rows"))
    )
    run.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == ["wazuh-5", "wazuh-6"]
    assert stream.backlog(run)[0]["rows"] >= 0
    messages = spark.readStream.text(str(folder)).filter("value <> ''")
    bad = stream.quarantine_stream(stream.observed(stream.decode(messages)), str(tmp_path / "bad"), str(tmp_path / "bad-state"))
    bad.processAllAvailable()
    bad.stop()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3
