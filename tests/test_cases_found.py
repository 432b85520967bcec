"""Inputs that once lost rows, values or failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casewright.operators import correlate, graph, hypotheses, ledger, tree
from casewright.sources import normalize


def file_event(event_id, second, sha, **more):
    return {
        "event_id": event_id, "timestamp": f"2024-03-01T10:00:{second:02d}Z", "category": "file", "event_type": "file_created",
        "file": {"path": f"C:/{event_id}.bin", "hashes": {"sha256": sha}}, **more,
    }


def test_copies_of_one_event_hide_no_pair(make_events):
    copies = [file_event("X", 1, "other", host="H", user="u", rule_id="r") for _ in range(40)]
    events = make_events([*copies, file_event("A", 2, "same"), file_event("B", 3, "same")], tenant_id="t")
    for per_scope in (None, 500, 1):
        rows = correlate.correlate_all(events, per_scope=per_scope).collect()
        assert [(r["source_event_id"], r["related_event_id"]) for r in rows] == [("A", "B")]


def test_repeated_ids_make_one_pair_in_every_form(spark, make_events):
    events = make_events([file_event(i, s, "same") for i, s in (("A", 1), ("A", 9), ("B", 2), ("B", 2))], tenant_id="t")
    seeds = spark.createDataFrame([("A",)], "event_id string")
    forms = [
        correlate.correlate_all(events), correlate.correlate_all(events, per_scope=500), correlate.correlate_all(events, per_scope=1),
        correlate.correlate_seeds(events, seeds),
    ]
    for form in forms:
        assert [(r["source_event_id"], r["related_event_id"], r["time_delta_seconds"]) for r in form.collect()] == [("A", "B", 1.0)]


def test_properties_of_all_mentions_stay(make_events):
    child = {"name": "p.exe", "pid": 7, "parent_pid": 3, "image_path": "C:/p.exe"}
    later = {"name": "q.exe", "pid": 8, "parent_name": "p.exe", "parent_pid": 7}
    base = {"host": "H", "category": "process", "event_type": "process_creation"}
    events = make_events(
        [{"event_id": "1", "timestamp": "2024-03-01T10:00:00Z", "process": child, **base},
         {"event_id": "2", "timestamp": "2024-03-01T11:00:00Z", "process": later, **base}], tenant_id="t",
    )

    def properties(entities):
        return {r["value"]: r["properties"] for r in entities.filter("entity_type = 'process'").collect()}

    whole = properties(graph.build(events)["entities"])
    assert whole["p.exe"] == {"identity_quality": "pid", "pid": "7", "parent_pid": "3", "image_path": "C:/p.exe"}
    halves = [graph.build(events.filter(F.col("event_id") == i))["entities"] for i in ("1", "2")]
    assert properties(graph.extend_entities(*halves)) == whole


def test_maps_and_tags_are_merged_by_policy(spark):
    rows = spark.createDataFrame(
        [("f", 1, {"os": "11", "ip": "a"}, ["critical"]), ("f", 2, {"os": "10", "cpu": "i"}, ["soc", "critical"])],
        "fingerprint string, n int, properties map<string,string>, tags array<string>",
    )
    merged = lambda c, policy: graph.merged_column(rows, ["fingerprint"], c, ["n"], policy).first()[c]
    assert merged("properties", "right") == {"os": "10", "ip": "a", "cpu": "i"}
    assert merged("properties", "left") == {"os": "11", "ip": "a", "cpu": "i"}
    assert merged("tags", "right") == ["critical", "soc"]
    with pytest.raises(Exception, match="property conflict"):
        merged("properties", "raise")


def test_strict_fails_whatever_is_selected(spark):
    bad = normalize.canonical_events(spark.createDataFrame([('{"event_id": "x"}',)], "raw string"))
    for action in (lambda f: f.count(), lambda f: f.select("host").collect(), lambda f: f.collect()):
        with pytest.raises(Exception, match="timestamp"):
            action(normalize.strict(bad))


def test_descendants_end_on_a_cycle(spark):
    cycle = spark.createDataFrame([("a", "c", 1, "1"), ("b", "a", 2, "2"), ("c", "b", 3, "3")], "node string, parent string, pid int, event_id string")
    assert {r["node"] for r in tree.descendants(cycle, "a").collect()} == {"b", "c"}
    with pytest.raises(tree.CycleError):
        tree.descendants(cycle, "elsewhere")
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, i, str(i)) for i in range(70)], cycle.schema)
    assert [r["pid"] for r in tree.descendants(chain, "n40").collect()] == list(range(41, 70))


def test_evidence_stands_on_one_side(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    updates = spark.createDataFrame(
        [("h", t(1), "support", "e1"), ("h", t(2), "contradict", "e1"), ("h", t(3), "contradict", "e2"), ("h", t(4), "support", "e0"),
         ("h", t(5), "missing", "memory"), ("h", t(6), "confidence", "0.9"), ("h", t(6), "confidence", "bad")],
        "hypothesis_id string, ts timestamp, action string, value string",
    )
    links = spark.createDataFrame([("h", "e2", "support"), ("h", "e0", "support")], "hypothesis_id string, evidence_id string, side string")
    made = spark.createDataFrame(
        [("h", 2, 0, ["disk"], 0.1)], "hypothesis_id string, support_count long, contradict_count long, missing_evidence array<string>, confidence double"
    )
    row = hypotheses.apply_updates(made, updates, links).first()
    assert (row["support_count"], row["contradict_count"], row["missing_evidence"], row["confidence"]) == (3, 0, ["disk", "memory"], 0.9)
    refused = hypotheses.placed_evidence(updates, links).filter("refused").collect()
    assert sorted((r["evidence_id"], r["side"]) for r in refused) == [("e1", "contradict"), ("e2", "contradict")]


def test_times_do_not_depend_on_the_session(spark):
    rows = spark.createDataFrame([(0,), (-1,), (1709287445000001,), (1709287445000000,)], "us long").select(
        F.timestamp_micros("us").alias("timestamp")
    )
    want = ["1969-12-31T23:59:59.999999+00:00", "1970-01-01T00:00:00+00:00", "2024-03-01T10:04:05+00:00", "2024-03-01T10:04:05.000001+00:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/St_Johns"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(r["t"] for r in rows.select(ledger.iso_time("timestamp").alias("t")).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_deleting_a_case_leaves_nothing_of_it(spark, make_events, tmp_path):
    from casewright.plans.investigate import investigate
    from casewright.sources.store import Store, delete_cases, save_cases

    def events(case, user, parent):
        process = {"name": "a.exe", "pid": 5, "parent_name": parent, "parent_pid": 4}
        base = {"host": "H", "user": user, "category": "process", "event_type": "process_creation", "process": process}
        rows = [{"event_id": f"{case}{i}", "timestamp": f"2024-03-01T10:0{i}:00Z", **base} for i in range(2)]
        return make_events(rows, tenant_id="t", case_id=case)

    store = Store(spark, str(tmp_path / "store"), buckets=4)
    for case, user, parent in (("A", "ann", "p.exe"), ("B", "bob", "p.exe")):
        save_cases(store, investigate(events(case, user, parent)))
    delete_cases(store, spark.createDataFrame([("B",)], "case_id string"))
    for table in ("cases", "evidence", "case_relationships", "case_entities", "case_links"):
        assert {r["case_id"] for r in store.load(table).collect()} == {"A"}, table
    left = {r["fingerprint"] for r in store.load("relationships").collect()}
    assert left == {r["fingerprint"] for r in store.load("case_relationships").collect()}
    assert "bob" not in {r["value"] for r in store.load("entities").collect()}
    process = store.load("entities").filter("value = 'a.exe'").first()
    assert process["properties"]["parent_pid"] == "4"
    wanted = spark.createDataFrame([("A",)], "case_id string")
    plan = store._touched("cases", "case_id", wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
