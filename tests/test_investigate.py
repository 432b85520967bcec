import pytest
from pyspark.sql import functions as F

from casewright.operators import evidence, graph, hypotheses, pair_counts, report, risk
from casewright.plans.investigate import Stages, investigate

SHIM = {
    "host": "WIN-01", "user": "SYSTEM", "severity": 85, "mitre_techniques": ["T1546.011"],
    "process": {"name": "sdbinst.exe", "pid": 4821, "parent_name": "svchost.exe", "parent_pid": 812},
}
EXAMPLE = [
    {"event_id": "E-1", "timestamp": "2026-09-26T10:00:00Z", "rule_id": "92058", **SHIM},
    {"event_id": "E-2", "timestamp": "2026-09-26T10:00:05Z", **SHIM},
]


@pytest.fixture(scope="module")
def tables(make_events):
    return investigate(make_events(EXAMPLE, case_id="C1"))


def test_published_example(tables):
    row = tables["risk"].first()
    assert (row.risk_score, round(row.confidence, 6)) == (45, 0.545)
    assert (row.evidence_score, row.correlation_score, row.hypothesis_score, row.penalty_score) == (40.0, 3.28, 13.75, -12.0)
    kinds = {r.entity_type: r.n for r in graph.type_counts(tables["entities"], "entity_type").collect()}
    assert kinds == {"host": 1, "user": 1, "process": 2, "mitre_technique": 1}
    edges = {r.relationship_type: r.n for r in graph.type_counts(tables["relationships"], "relationship_type").collect()}
    assert edges == {"run_as": 1, "spawned": 1}
    pair = tables["correlations"].first()
    assert pair.reasons == ["same_host", "same_user", "same_process_name", "same_process_id", "same_mitre_technique"]
    made = {r.hypothesis_type: r for r in tables["hypotheses"].collect()}
    assert (made["main"].status, made["main"].confidence, made["main"].support_count) == ("supported", 0.55, 2)
    assert (made["counter"].status, made["counter"].confidence) == ("proposed", 0.0)
    assert set(made) == {"main", "counter", "sub"}
    case = tables["cases"].first()
    assert (case.priority, case.status, case.severity, case.entity_count, case.relationship_count) == ("critical", "triaged", 85, 5, 2)


def test_summary_and_report(tables):
    top = risk.top_factors(tables["risk_factors"])
    text = risk.with_summary(tables["risk"], top).first().summary
    assert text.startswith("Risk 45/100 (confidence 0.54). Breakdown: evidence=+40.0, correlation=+3.3, hypothesis=+13.8, penalty=-12.0.")
    actions = report.recommended_actions(tables["hypotheses"], tables["cases"]).orderBy("position").collect()
    assert actions[0].action == "Inspect sdbinst.exe command line and parent process"
    assert actions[3].action == "Collect missing evidence: shim database modification"
    types = tables["entities"].groupBy("case_id", "entity_type").agg(F.count("*").alias("n"))
    edges = tables["relationships"].groupBy("case_id", "relationship_type").agg(F.count("*").alias("n"))
    rows = report.sections(
        tables["cases"], top, tables["hypotheses"], evidence.summary(tables["evidence"], ["case_id"]),
        report.recommended_actions(tables["hypotheses"], tables["cases"]), types, edges,
    )
    assert {r.section for r in rows.select("section").distinct().collect()} >= {"case", "risk", "hypotheses", "recommended_actions"}


def test_second_run_gives_the_same_rows(make_events, tables):
    again = investigate(make_events(list(reversed(EXAMPLE)), case_id="C1"))
    for name in ("evidence", "entities", "relationships", "hypotheses", "risk"):
        assert sorted(map(str, tables[name].collect())) == sorted(map(str, again[name].collect()))


def test_cases_do_not_mix(make_events):
    rows = make_events(EXAMPLE, case_id="C1").unionByName(make_events(EXAMPLE[:1], case_id="C2"))
    t = investigate(rows, Stages(min_evidence=2))
    scores = {r.case_id: (r.correlation_count, r.hypothesis_count) for r in t["risk"].collect()}
    assert scores == {"C1": (1, 3), "C2": (0, 0)}


def test_contradicting_evidence_and_verified_bonus(spark, make_events):
    events = make_events(EXAMPLE[:1], case_id="C1")
    found = evidence.from_events(events)
    made = hypotheses.main_and_counter(found)
    main = made.filter("hypothesis_type = 'main'").first().hypothesis_id
    links = spark.createDataFrame([("E-E-1", main, "contradicts")], "evidence_id string, hypothesis_id string, assessment string")
    against = hypotheses.with_contradictions(made, links)
    none = spark.createDataFrame([], "case_id string, confidence double, score double, reasons array<string>, source_event_id string, related_event_id string")
    row = risk.assess(found, pair_counts.of_pairs(none), against, links=links).first()
    # 30 + 0 + 5 * .3, minus 12 for six missing items and 3 for one contradiction
    assert (row.evidence_score, row.hypothesis_score, row.penalty_score, row.risk_score) == (30.0, 1.5, -15.0, 16)
    log = events.select(
        F.lit("E-E-1").alias("evidence_id"), F.lit(True).alias("verified"), F.lit("kim").alias("verified_by"),
        F.col("timestamp").alias("verified_at"), F.lit("review").alias("method"), F.lit("").alias("notes"),
    )
    verified = evidence.with_verification(found, log)
    assert risk.assess(verified, pair_counts.of_pairs(none), made).first().evidence_score == 33.0


def test_half_scores_round_to_even(spark):
    evidence_rows = spark.createDataFrame([("C", "strong", 1.0)], "case_id string, strength string, confidence double")
    pairs = spark.createDataFrame([("C", 0.7)], "case_id string, confidence double")
    made = spark.createDataFrame(
        [("C", "supported", 0.8, "main", "f", 1, [], "H", "s")],
        "case_id string, status string, confidence double, hypothesis_type string, fingerprint string, support_count long, "
        "missing_evidence array<string>, hypothesis_id string, statement string",
    )
    assert risk.assess(evidence_rows, pair_counts.of_pairs(pairs, 5.0), made).first().risk_score == 44  # 43.5


def test_risk_config_is_checked():
    with pytest.raises(ValueError):
        risk.RiskConfig(evidence_weight=0.5)
    with pytest.raises(ValueError):
        risk.RiskConfig(verified_bonus=-1.0)


def test_evidence_titles_and_bands(make_events):
    rows = [
        {"event_id": "1", "timestamp": "2026-01-01T00:00:00Z", "severity": 39, "process": {"name": None}},
        {"event_id": "2", "timestamp": "2026-01-01T00:00:00Z", "severity": 40, "category": "http", "network": {"destination_port": 80}},
        {"event_id": "3", "timestamp": "2026-01-01T00:00:00Z", "severity": 70, "category": "authentication", "user": "kim"},
        {"event_id": "4", "timestamp": "2026-01-01T00:00:00Z", "severity": 85, "category": "file", "file": {"name": "a.txt"}},
        {"event_id": "5", "timestamp": "2026-01-01T00:00:00Z", "severity": 0, "category": "other", "source_reliability": None},
    ]
    events = make_events(rows, case_id="C")
    got = {r.event_id: (r.title, r.strength, r.confidence) for r in evidence.from_events(events).collect()}
    assert got["1"] == ("process_creation: unknown", "weak", 0.7)
    assert got["2"] == ("process_creation: ? → ?:80", "moderate", 0.7)
    assert got["3"] == ("process_creation: kim @ ?", "strong", 0.7)
    assert got["4"] == ("process_creation: a.txt", "critical", 0.7)
    assert got["5"] == ("process_creation", "weak", 0.5)
    assert evidence.from_events(events, keep_empty=False).count() == 4


def test_evidence_tampering_shows(make_events):
    rows = evidence.from_events(make_events(EXAMPLE, case_id="C"))
    assert evidence.verify_hash(rows).filter("NOT hash_ok").count() == 0
    assert evidence.verify_hash(rows.withColumn("title", F.lit("x"))).filter("hash_ok").count() == 0
    assert evidence.verify_hash(rows.withColumn("case_id", F.lit("other"))).filter("NOT hash_ok").count() == 0


def test_hypothesis_merge_and_errors(spark):
    versions = spark.createDataFrame(
        [("f", "main", "s", "weakened", 0.9), ("f", "main", "s", "supported", 0.4)],
        "fingerprint string, hypothesis_type string, statement string, status string, confidence double",
    )
    ids = lambda *e: spark.createDataFrame([("f", x) for x in e], "fingerprint string, evidence_id string")
    row = hypotheses.merge(versions, ids("a", "b"), ids("b"), on_overlap="report").first()
    assert (row.confidence, row.status, row.support_count, row.overlap_count) == (0.9, "supported", 2, 1)
    with pytest.raises(Exception, match="both sides"):
        hypotheses.merge(versions, ids("a"), ids("a", "c")).select("status").collect()
    full = spark.createDataFrame(
        [("f", "main", "s", "confirmed", 0.2, ["T2", "T1"], ["log"], " ", 2, "2024-01-02"), ("f", "main", "s", "rejected", 0.1, ["T3", "T1"], [], "late", 3, "2024-01-05"),
         ("f", "main", "s", "proposed", 0.3, None, ["disk", "log"], "first", 2, "2024-01-01")],
        "fingerprint string, hypothesis_type string, statement string, status string, confidence double, mitre_techniques array<string>, "
        "missing_evidence array<string>, rationale string, version int, first_seen string",
    ).withColumn("last_seen", F.col("first_seen"))
    row = hypotheses.merge(full, ids("a", "b", "a"), ids("c")).first()
    assert (row.status, row.confidence, row.mitre_techniques, row.missing_evidence, row.rationale) == ("confirmed", 0.3, ["T1", "T2", "T3"], ["disk", "log"], "first")
    assert (row.first_seen, row.last_seen, row.support_count, row.contradict_count, row.overlap_count) == ("2024-01-01", "2024-01-05", 2, 1, 0)
    bad = spark.createDataFrame(
        [("counter", "ab", ["X1"], ["e"], ["e"], "p", "confirmed", "", 1.2)],
        "hypothesis_type string, statement string, mitre_techniques array<string>, supporting_evidence_ids array<string>, "
        "contradicting_evidence_ids array<string>, parent_hypothesis_id string, status string, rationale string, confidence double",
    )
    assert len(bad.select(hypotheses.row_errors().alias("e")).first().e) == 6


def test_hypothesis_updates(spark, make_events):
    made = hypotheses.main_and_counter(evidence.from_events(make_events(EXAMPLE, case_id="C")))
    main = made.filter("hypothesis_type = 'main'").first()
    updates = spark.createDataFrame(
        [(main.hypothesis_id, 1, "confidence", "0.2"), (main.hypothesis_id, 2, "confidence", "7"), (main.hypothesis_id, 3, "support", "E-9")],
        "hypothesis_id string, ts long, action string, value string",
    )
    row = hypotheses.apply_updates(made, updates).filter("hypothesis_type = 'main'").first()
    assert (row.confidence, row.support_count) == (1.0, 3)


def test_alerts_take_the_first_rule(spark):
    cases = spark.createDataFrame([("a", 90), ("b", 70), ("c", 40), ("d", 39)], "case_id string, risk_score int")
    got = {r.case_id: r.alert_level for r in report.with_alert_level(cases).collect()}
    assert got == {"a": "critical", "b": "warning", "c": "info", "d": None}
    own = [("odd", F.col("case_id") == "d", "info")]
    assert report.with_alert_level(cases, own).filter("alert_level IS NOT NULL").first().case_id == "d"
    assert spark.range(1).select(report.verdict(F.lit(55)).alias("v")).first().v == "medium priority"
