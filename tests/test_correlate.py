import datetime as dt
import itertools
import random

import pytest

from casewright import vocab
from casewright.operators import correlate
from casewright.operators.correlate import Rules

BASE = dt.datetime(2026, 9, 26, 10, 0, 0)


def at(seconds):
    return (BASE + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def norm(value):
    value = (value or "").strip()
    return value.lower() or None


def brute(rows, rules, k=None):
    """Every pair by comparing all of them, as the definition says."""
    def get(row, *path):
        for name in path:
            row = (row or {}).get(name)
        return row

    def reasons(a, b):
        eq = lambda *path: norm(get(a, *path)) is not None and norm(get(a, *path)) == norm(get(b, *path))
        host = eq("host")
        pid = lambda r: get(r, "process", "pid")
        ppid = lambda r: get(r, "process", "parent_pid")
        family = (ppid(a) is not None and ppid(a) == pid(b)) or (ppid(b) is not None and ppid(b) == pid(a))
        tests = [
            host, eq("user"), host and eq("process", "name"), host and pid(a) is not None and pid(a) == pid(b),
            host and family, eq("file", "hashes", "sha256"), eq("file", "path"), eq("network", "source_ip"),
            eq("network", "destination_ip"), eq("dns", "query"), eq("registry", "key"),
            bool(set(a.get("mitre_techniques") or []) & set(b.get("mitre_techniques") or [])), eq("rule_id"),
        ]
        return [n for n, ok in zip(vocab.REASON_NAMES, tests) if ok]

    ordered = sorted(rows, key=lambda r: (r["timestamp"], r["event_id"]))
    found = []
    for a, b in itertools.combinations(ordered, 2):
        if a.get("tenant_id") != b.get("tenant_id"):
            continue
        delta = (dt.datetime.fromisoformat(b["timestamp"]) - dt.datetime.fromisoformat(a["timestamp"])).total_seconds()
        names = reasons(a, b)
        if delta > rules.window_seconds or len(names) < rules.min_reasons:
            continue
        weights = sorted((rules.weights[n] for n in names), reverse=True)
        confidence = correlate.combine(weights, rules.confidence_mode)
        score = correlate.combine(weights, rules.score_mode)
        if confidence >= rules.min_confidence - 1e-9:
            found.append((-round(confidence, 9), -round(score, 9), a["event_id"], b["event_id"], tuple(names)))
    out = []
    for tenant in {r.get("tenant_id") for r in rows}:
        ids = {r["event_id"] for r in rows if r.get("tenant_id") == tenant}
        mine = sorted(f for f in found if f[2] in ids)
        out += mine if k is None else mine[:k]
    return sorted(f[2:] for f in out)


def result(frame):
    return sorted((r.source_event_id, r.related_event_id, tuple(r.reasons)) for r in frame.collect())


def mixed_rows(n, seed, spread=4000, **ranges):
    rng = random.Random(seed)
    hosts, users, pids = ranges.get("hosts", 3), ranges.get("users", 3), ranges.get("pids", 4)
    maybe = lambda value, p=0.7: value if rng.random() < p else None
    rows = []
    for i in range(n):
        rows.append({
            "event_id": f"E{rng.randrange(10**6):06d}-{i}", "timestamp": at(rng.randrange(spread * 10) / 10),
            "tenant_id": rng.choice(["a", "b", None]), "host": maybe(rng.choice(["H", "h "]) + str(rng.randrange(hosts)), 0.9),
            "user": maybe(f"u{rng.randrange(users)}"),
            "process": maybe({
                "name": maybe(f"P{rng.randrange(3)}.exe"), "pid": maybe(rng.randrange(pids)),
                "parent_pid": maybe(rng.randrange(pids)),
            }),
            "file": maybe({"path": maybe(f"c:/f{rng.randrange(3)}"), "hashes": {"sha256": f"aa{rng.randrange(4)}"}}, 0.3),
            "network": maybe({"source_ip": f"10.0.0.{rng.randrange(3)}", "destination_ip": maybe(f"9.9.9.{rng.randrange(3)}")}, 0.4),
            "dns": maybe({"query": f"d{rng.randrange(3)}.com"}, 0.3),
            "registry": maybe({"key": f"HKLM\\k{rng.randrange(3)}"}, 0.2),
            "mitre_techniques": rng.sample(["T1", "T2", "T3"], rng.randrange(3)),
            "rule_id": maybe(f"R{rng.randrange(3)}", 0.4),
        })
    return rows


@pytest.mark.parametrize(
    "rules",
    [
        Rules(), Rules(min_confidence=0.1), Rules(min_confidence=0.6, window_seconds=30), Rules(min_reasons=3, min_confidence=0.0),
        Rules(confidence_mode="max", min_confidence=0.3), Rules(confidence_mode="additive", weights={"same_host": 0.0}),
        Rules(window_seconds=0),
    ],
)
def test_all_pairs_equal_brute_force(make_events, rules):
    rows = mixed_rows(300, 7)
    assert result(correlate.correlate_all(make_events(rows), rules=rules, per_scope=None)) == brute(rows, rules)


def test_small_groups_top_k(make_events):
    rows = mixed_rows(300, 8)
    assert result(correlate.correlate_all(make_events(rows), per_scope=10)) == brute(rows, Rules(), 10)


def copies(n, seed, **fields):
    rng = random.Random(seed)
    ids = list(range(n))
    rng.shuffle(ids)
    return [
        {"event_id": f"C{i:04d}", "timestamp": at(rng.randrange(20000) / 10), "tenant_id": "a", "host": "BIG", **fields}
        for i in ids
    ]


def test_hot_copies(make_events):
    """One group of equal events holds most rows; only its first pairs by id are made."""
    same = {"user": "svc", "process": {"name": "x.exe", "pid": 7, "parent_pid": 3}, "mitre_techniques": ["T1", "T2"]}
    rows = copies(250, 1, **same) + mixed_rows(120, 2)
    for k in (3, 25):
        assert result(correlate.correlate_all(make_events(rows), per_scope=k)) == brute(rows, Rules(), k)


def test_hot_process_with_distinct_details(make_events):
    """Every event of a busy process differs, a few share more than the process."""
    rng = random.Random(5)
    rows = copies(220, 3, process={"name": "svchost.exe", "pid": 9})
    for i, row in enumerate(rows):
        row["dns"] = {"query": f"d{rng.randrange(90)}.com"}
        row["user"] = f"u{rng.randrange(40)}"
        row["rule_id"] = f"r{i}"
    for k in (12,):
        assert result(correlate.correlate_all(make_events(rows), per_scope=k)) == brute(rows, Rules(), k)


def test_hot_parents_and_children(make_events):
    """Many events of one parent and many of its children, in the same and in the next cell."""
    parents = copies(60, 11, process={"pid": 50})
    children = copies(60, 12, process={"parent_pid": 50})
    for i, row in enumerate(children):
        row["event_id"] = f"D{i:04d}"
        row["process"] = {"parent_pid": 50, "pid": 1000 + i}
    for i, row in enumerate(parents):
        row["process"] = {"pid": 50, "parent_pid": 3000 + i}
    rows = parents + children
    for k in (10,):
        assert result(correlate.correlate_all(make_events(rows), per_scope=k)) == brute(rows, Rules(), k)
    sides = copies(50, 13, process={"parent_pid": 50}) + copies(50, 14, process={"pid": 50})
    for i, row in enumerate(sides):
        row["event_id"] = f"S{i:04d}"
        row["timestamp"] = at(250 + (i % 50) / 100 if i < 50 else 310 + (i % 50) / 100)
        row["user"] = f"u{i}"
    assert result(correlate.correlate_all(make_events(sides), per_scope=6)) == brute(sides, Rules(), 6)


def test_hot_with_ties_in_max_mode(make_events):
    rules = Rules(confidence_mode="max", score_mode="max", min_confidence=0.3)
    rows = copies(150, 21, user="svc", process={"name": "x.exe", "pid": 7}) + mixed_rows(60, 22)
    assert result(correlate.correlate_all(make_events(rows), rules=rules, per_scope=8)) == brute(rows, rules, 8)


def test_input_order_does_not_matter(make_events):
    rows = mixed_rows(200, 9)
    once = result(correlate.correlate_all(make_events(rows), per_scope=20))
    random.Random(1).shuffle(rows)
    assert result(correlate.correlate_all(make_events(rows).repartition(7), per_scope=20)) == once


def test_seeds_both_directions(make_events, spark):
    rows = [
        {"event_id": "A", "timestamp": at(0), "host": "h", "process": {"pid": 1}},
        {"event_id": "B", "timestamp": at(100), "host": "H", "process": {"pid": 1}},
        {"event_id": "C", "timestamp": at(300), "host": "h", "process": {"pid": 1}},
        {"event_id": "D", "timestamp": at(900), "host": "h", "process": {"pid": 1}},
    ]
    seeds = spark.createDataFrame([("B",)], "event_id string")
    found = correlate.correlate_seeds(make_events(rows), seeds, per_seed=10).orderBy("rank").collect()
    assert [(r.related_event_id, r.time_delta_seconds) for r in found] == [("A", 100.0), ("C", 200.0)]


def test_lone_file_hash_reaches_the_threshold(make_events):
    rows = [
        {"event_id": i, "timestamp": at(t), "host": f"h{i}", "file": {"hashes": {"sha256": "AB "}}}
        for i, t in (("A", 0), ("B", 300))
    ]
    row = correlate.correlate_all(make_events(rows)).first()
    assert row.reasons == ["same_file_hash"] and row.confidence == pytest.approx(0.4)


def test_rationale_and_breakdown(make_events):
    rows = [
        {"event_id": i, "timestamp": at(t), "host": "WIN-01", "process": {"pid": p, "parent_pid": q}}
        for i, t, p, q in (("A", 0, 5, 1), ("B", 5, 6, 5))
    ]
    events = make_events(rows)
    pairs = correlate.breakdown(correlate.with_rationale(correlate.correlate_all(events), events))
    row = pairs.first()
    assert row.rationale == ["same host: WIN-01", "parent-child process relation (pid=5/6, ppid=1/5)"]
    assert [b.reason for b in row.breakdown] == ["parent_child", "same_host"]


def test_rules_are_checked():
    for bad in (
        {"window_seconds": -1}, {"min_confidence": 1.5}, {"min_reasons": 0}, {"score_mode": "mean"},
        {"weights": {"no_such": 0.1}}, {"weights": {"same_host": 2.0}}, {"weights": {"same_host": float("nan")}},
    ):
        with pytest.raises(ValueError):
            Rules(**bad)
    assert correlate.combine([], "additive") == 0.0
    assert correlate.combine([0.7, 0.6], "additive") == 1.0


def test_plan_is_an_equi_join(make_events):
    pairs = correlate.correlate_all(make_events(mixed_rows(20, 3)), per_scope=None)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
