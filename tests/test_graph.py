import random
import uuid

import pytest
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions import identity
from casewright.operators import graph, tree
from casewright.plans import presets

T0 = "2026-01-01T00:00:00Z"


def test_uuid5_equals_python(spark):
    names = ["", "abc", "f" * 64, "ä→"]
    frame = spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.uuid5(vocab.ENTITY_NAMESPACE, "n").alias("u"))
    for row in frame.collect():
        assert row.u == str(uuid.uuid5(uuid.UUID(vocab.ENTITY_NAMESPACE), row.n))


def test_entities_of_one_event(make_events):
    rows = [{
        "event_id": "1", "timestamp": T0, "host": " WIN-1 ", "user": "Kim", "user_context": {"domain": "CORP"},
        "process": {"name": "A.exe", "guid": "{G}", "parent_name": "b.exe"}, "domain": "Evil.COM.",
        "file": {"path": "C:\\X", "hashes": {"MD5": "AB", "sha256": ""}},
        "network": {"source_ip": "1.1.1.1", "destination_ip": "2.2.2.2"}, "dns": {"query": "evil.com"},
        "registry": {"key": "HKLM\\Run"}, "mitre_techniques": ["t1059"], "category": "network",
    }]
    events = make_events(rows, case_id="C")
    got = {(r.entity_type, r.normalized_value, r.host) for r in graph.mentions(events).collect()}
    assert got == {
        ("host", "win-1", None), ("user", "kim", None), ("process", "a.exe|guid:{g}", "win-1"), ("process", "b.exe", "win-1"),
        ("file", "c:\\x", "win-1"), ("hash", "ab", None), ("ip", "1.1.1.1", None), ("ip", "2.2.2.2", None),
        ("domain", "evil.com", None), ("mitre_technique", "T1059", None),
    }
    entities = graph.resolve_entities(graph.mentions(events, registry_keys=True))
    assert entities.filter("entity_type = 'registry'").count() == 1
    assert entities.filter("entity_type = 'domain'").first().mention_count == 2
    assert graph.with_entity_fingerprint_check(entities).filter("NOT fingerprint_ok").count() == 0
    assert entities.select(graph.entity_errors().alias("e")).filter("size(e) > 0").count() == 0
    kinds = {r.relationship_type for r in graph.edges(events).collect()}
    assert kinds == {"spawned", "run_as", "has_hash", "connected_to"}
    ids = {r.entity_id for r in entities.collect()}
    assert all({r.source_id, r.target_id} <= ids for r in graph.edges(events).collect())


def test_no_host_means_no_process_and_no_local_user(make_events):
    rows = [{"event_id": "1", "timestamp": T0, "user": "kim", "process": {"name": "a", "pid": 1, "parent_name": "a", "parent_pid": 1}}]
    assert graph.mentions(make_events(rows)).count() == 0
    self_parent = [{**rows[0], "host": "h"}]
    assert {r.relationship_type for r in graph.edges(make_events(self_parent)).collect()} == {"run_as"}


def test_merge_takes_first_value_and_last_properties(make_events):
    rows = [
        {"event_id": "2", "timestamp": "2026-01-02T00:00:00Z", "host": "h", "file": {"path": "/A", "size": 2}, "platform": "windows"},
        {"event_id": "1", "timestamp": T0, "host": "H", "file": {"path": "/a", "size": 1}, "platform": "windows"},
    ]
    row = graph.resolve_entities(graph.mentions(make_events(rows))).filter("entity_type = 'file'").first()
    assert (row.value, row.properties["size"], row.mention_count) == ("/a", "2", 2)


def edges(spark, rows):
    return spark.createDataFrame(
        [(None, "entity", s, k, "entity", t, w, w, ts, e) for s, k, t, w, ts, e in rows],
        "tenant_id string, source_type string, source_id string, relationship_type string, target_type string, target_id string, "
        "weight double, confidence double, timestamp long, event_id string",
    )


@pytest.mark.parametrize("policy, wanted", [("max", 0.9), ("left", 0.2), ("right", 0.4), ("avg", ((0.2 + 0.9) / 2 + 0.4) / 2)])
def test_strength_policies(spark, policy, wanted):
    rows = edges(spark, [("a", "spawned", "b", 0.9, 2, "2"), ("a", "spawned", "b", 0.2, 1, "1"), ("a", "spawned", "b", 0.4, 3, "3")])
    out = graph.resolve_relationships(graph.with_relationship_fingerprint(rows), on_strength=policy).first()
    assert out.weight == pytest.approx(wanted) and out.event_count == 3


def test_reverse_needs_an_inverse(spark):
    rows = graph.with_relationship_fingerprint(edges(spark, [("a", "parent_of", "b", 1.0, 1, "1"), ("a", "executed", "b", 1.0, 1, "1")]))
    out = graph.reverse(rows).collect()
    assert [(r.source_id, r.relationship_type, r.target_id) for r in out] == [("b", "child_of", "a")]


def test_map_merge(spark):
    frame = spark.sql("SELECT map('a', 1, 'b', 2) AS l, map('b', 3, 'c', 4) AS r")
    merged = lambda p: frame.select(graph.merge_maps(F.col("l"), F.col("r"), p).alias("m")).first().m
    assert merged("left") == {"a": 1, "b": 2, "c": 4} and merged("right") == {"a": 1, "b": 3, "c": 4}
    with pytest.raises(Exception, match="property conflict"):
        merged("raise")


def walk_fixture(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("d", "e"), ("p", "q")]
    return edges(spark, [(s, "spawned", t, 1.0, 1, "1") for s, t in links])


def test_walks(spark):
    rows = walk_fixture(spark)
    seeds = spark.createDataFrame([("a",)], "entity_id string")
    near = {r.node: r.depth for r in graph.reach(rows, seeds, 2).collect()}
    assert near == {"a": 0, "b": 1, "x": 1, "c": 2, "d": 2}
    assert {r.node for r in graph.reach(rows, seeds, 0).collect()} == {"a"}
    path = [r.entity_id for r in graph.shortest_path(rows, "a", "e").orderBy("position").collect()]
    assert path == ["a", "x", "d", "e"]
    assert graph.shortest_path(rows, "a", "q").count() == 0
    assert graph.shortest_path(rows, "a", "e", max_depth=2).count() == 0
    up = [r.entity_id for r in graph.longest_lineage(rows, "e").orderBy("position").collect()]
    assert up == ["e", "d", "c", "b", "a"]
    below = {r.root: r.n for r in graph.descendant_pairs(rows).groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert below == {"a": 5, "b": 3, "c": 2, "x": 2, "d": 1, "p": 1}
    counts = {r.root: r.descendants for r in graph.descendant_counts(rows).collect()}
    assert counts == below
    near = presets.process_lineage(
        spark.createDataFrame([(x, "process") for x in "abcdexpq"], "entity_id string, entity_type string"), rows, "e", max_depth=2
    )
    assert {r.entity_id for r in near.collect()} == {"e", "d", "c", "x"}


def process(i, host, pid, parent=None, guid=None, parent_guid=None):
    return {
        "event_id": f"E{i}", "timestamp": T0, "host": host,
        "process": {"name": f"p{pid}", "pid": pid, "parent_pid": parent, "guid": guid, "parent_guid": parent_guid},
    }


def build(make_events, rows):
    return tree.with_parent(tree.nodes(make_events(rows)))


def test_tree_parents(make_events):
    rows = [
        process(1, "h", 1), process(2, "h", 2, 1), process(3, "h", 3, 99), process(4, "g", 2, 1),
        process(5, "h", 7, guid="G1"), process(6, "h", 7, guid="G2"), process(7, "h", 8, 7), process(8, "h", 9, 1, parent_guid="G2"),
    ]
    got = {r.event_id: (r.parent, r.is_orphan) for r in build(make_events, rows).collect()}
    assert got["E1"] == (None, False) and got["E2"] == ("h|pid:1", False) and got["E3"] == (None, True)
    assert got["E4"] == (None, True)  # the parent is on another host
    assert got["E7"] == (None, True)  # pid 7 is not unique
    assert got["E8"] == ("h|guid:G2", False)


def test_tree_walks(make_events, spark):
    rng = random.Random(3)
    parent = {0: None}
    for i in range(1, 120):
        parent[i] = rng.randrange(max(0, i - 3), i)
    rows = build(make_events, [process(i, "h", i, p) for i, p in parent.items()])

    def way(i):
        return [i] if parent[i] is None else way(parent[i]) + [i]

    got = {int(r.node.split(":")[1]): (r.root, r.depth, r.descendants) for r in tree.depths(rows).collect()}
    for i in parent:
        assert got[i] == ("h|pid:0", len(way(i)) - 1, sum(i in way(j) for j in parent) - 1)
    assert [r.node for r in tree.lineage(rows, "h|pid:119").collect()] == [f"h|pid:{i}" for i in way(119)]
    below = {r.pid for r in tree.descendants(rows, "h|pid:60").collect()}
    assert below == {j for j in parent if 60 in way(j)} - {60}


@pytest.mark.parametrize("seed", range(2))
def test_shortest_paths_of_many_asks(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(45)]
    pairs = [rng.sample(names, 2) for _ in range(60)]
    near = {n: set() for n in names}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def path(a, b, most):
        """Breadth first from the source; back from the target by the smallest id."""
        depth, layer = {a: 0}, [a]
        while layer:
            layer = sorted({y for x in layer for y in near[x]} - set(depth))
            depth |= {y: max(depth.values()) + 1 for y in layer}
        if depth.get(b, most + 1) > most:
            return None
        way = [b]
        while way[-1] != a:
            way.append(min(y for y in near[way[-1]] if depth.get(y) == depth[way[-1]] - 1))
        return way[::-1]

    asks = [tuple(rng.sample(names, 2)) for _ in range(60)] + [("n01", "n01"), ("n02", "missing"), ("n03", None)]
    rows = spark.createDataFrame([("spawned", a, b, 1.0, 1.0) for a, b in pairs], "relationship_type string, source_id string, target_id string, weight double, confidence double")
    got = {}
    for r in graph.shortest_paths(rows, spark.createDataFrame([*asks, asks[0]], "source_id string, target_id string"), 6).orderBy("position").collect():
        got.setdefault((r.source_id, r.target_id), []).append((r.position, r.entity_id))
    near["missing"] = set()
    want = {(a, b): path(a, b, 6) for a, b in asks if b}
    assert got == {k: list(enumerate(w)) for k, w in want.items() if w}
    assert sum(w is None for w in want.values()) > 3 and max(len(w) for w in want.values() if w) > 5


def test_two_sides_leave_a_hub_alone(spark, monkeypatch):
    """The source is beside a node with ten thousand others: the target's side, which is small, is grown instead."""
    n = 10_000
    rows = spark.range(n).select(F.lit("hub").alias("source_id"), F.concat(F.lit("leaf"), "id").alias("target_id"))
    rows = rows.unionByName(spark.createDataFrame([("s", "hub"), ("hub", "a"), ("a", "b"), ("b", "t")], "source_id string, target_id string"))
    rows = rows.withColumns({"relationship_type": F.lit("spawned"), "weight": F.lit(1.0), "confidence": F.lit(1.0)})
    seen = []
    whole = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: seen.append(out := whole(df)) or out)
    path = [r.entity_id for r in graph.shortest_path(rows, "s", "t").orderBy("position").collect()]
    assert path == ["s", "hub", "a", "b", "t"]
    assert max(df.count() for df in seen) <= 2 * int(n**0.5)


def test_intervals(make_events):
    rng = random.Random(4)
    parent = {i: None if i % 40 == 0 else rng.randrange(i - i % 40, i) for i in range(160)}
    rows = build(make_events, [process(i, "h", i, p) for i, p in parent.items()])
    labels = tree.intervals(rows).cache()
    got = {int(r.node.split(":")[1]): r for r in labels.collect()}
    children = {i: sorted(j for j in parent if parent[j] == i) for i in parent}

    def walk(i, number, depth, root):
        """The number after the subtree of i."""
        assert (got[i].enter, got[i].depth, got[i].root) == (number, depth, f"h|pid:{root}")
        after = number + 1
        for child in children[i]:
            after = walk(child, after, depth + 1, root)
        assert got[i].leave == after - 1 and got[i].descendants == after - 1 - number
        return after

    for root in range(0, 160, 40):
        walk(root, 0, 0, root)
    below = {r.node for r in tree.descendants(rows, "h|pid:41").collect()}
    assert {r.node for r in tree.inside(labels, "h|pid:41").collect()} == below
    way = [r.node for r in tree.lineage(rows, "h|pid:79").collect()]
    assert [r.node for r in tree.around(labels, "h|pid:79").orderBy("depth").collect()] == way
    with pytest.raises(tree.CycleError):
        tree.intervals(build(make_events, [process(1, "h", 1, 2), process(2, "h", 2, 1)]))
    assert tree.intervals(rows.filter("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_descendant_counts_equal_pairs(spark, seed):
    """Trees, merging ways and loops, in several scopes, one of them null."""
    rng = random.Random(seed)
    rows = []
    for scope in ("a", "b", None):
        for i in range(1, 40):
            rows.append((scope, f"n{rng.randrange(max(0, i - 4), i)}", f"n{i}"))
        if scope == "b":
            rows += [(scope, f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(4)]
        rows += [(scope, f"l{i}", f"l{(i + 1) % 5}") for i in range(5)] + [(scope, "l0", "tail")]
    edges_ = spark.createDataFrame([(*r, "spawned") for r in rows if r[1] != r[2]], "case_id string, source_id string, target_id string, relationship_type string")
    pairs = graph.descendant_pairs(edges_, ["case_id"]).groupBy("case_id", "root").agg(F.count("*").alias("descendants"))
    counts = graph.descendant_counts(edges_, ["case_id"])
    assert sorted(map(tuple, counts.collect()), key=str) == sorted(map(tuple, pairs.collect()), key=str)


def test_tree_errors(make_events):
    cycle = build(make_events, [process(1, "h", 1, 3), process(2, "h", 2, 1), process(3, "h", 3, 2)])
    with pytest.raises(tree.CycleError):
        tree.depths(cycle)
    rows = [process(1, "h", 1), process(2, "h", 1), {"event_id": "E3", "timestamp": T0, "host": "h"}, process(4, "h", None)]
    bad = {(r.event_id, r.error) for r in tree.violations(tree.nodes(make_events(rows))).collect()}
    assert bad == {("E1", "duplicate process node"), ("E3", "missing process context"), ("E4", "missing valid pid")}


def test_lookups_and_checks(make_events):
    rows = [
        {"event_id": "1", "timestamp": T0, "host": "h1", "process": {"name": "a", "pid": 1}, "user": "kim"},
        {"event_id": "2", "timestamp": T0, "host": "h2", "process": {"name": "a", "pid": 1}, "user": "kim"},
    ]
    g = graph.build(make_events(rows))
    entities, edges_ = g["entities"], g["relationships"]
    assert graph.find_entities(entities, "process").count() == 2
    assert graph.find_unique(entities, "process", "a|pid:1").count() == 0
    one = graph.find_unique(entities, "process", "a|pid:1", "H2").first()
    assert one.host == "h2"
    assert graph.find_relationships(edges_, "run_as", source_id=one.entity_id).count() == 1
    assert graph.with_relationship_fingerprint_check(edges_).filter("NOT fingerprint_ok").count() == 0
    assert graph.same_identity(entities, entities.limit(2)).count() == 2
    log = entities.limit(1).select("fingerprint", F.lit("2020-01-01").cast("timestamp").alias("timestamp"), F.lit("x").alias("event_id"))
    assert graph.add_provenance(entities, log).filter("first_seen < '2021-01-01' AND mention_count = 2").count() == 1


def test_graph_built_in_one_pass_equals_merged_mentions_and_hashes_once_per_entity(make_events):
    events = make_events(
        [
            {"event_id": "E-2", "timestamp": "2024-01-01T00:00:00Z", "tenant_id": "t", "host": "H1", "user": "Ann",
             "process": {"name": "CMD.exe", "pid": 7, "parent_pid": 3, "parent_name": "sh", "image_path": "b"}},
            {"event_id": "E-1", "timestamp": "2024-01-01T00:00:00Z", "tenant_id": "t", "host": "h1", "user": "ann",
             "process": {"name": "cmd.exe", "pid": 7, "parent_pid": 4, "image_path": "a"}},
            {"event_id": "E-3", "timestamp": "2024-01-02T00:00:00Z", "host": "h1", "category": "file", "mitre_techniques": ["T1105"],
             "file": {"path": "/x", "hashes": {"SHA256": "AB"}, "size": 3}},
        ]
    )
    built = graph.build(events, ["tenant_id"])
    entities = graph.resolve_entities(graph.mentions(events, ["tenant_id"]), ["tenant_id"], unite_lists=False)
    relationships = graph.resolve_relationships(graph.edges(events, ["tenant_id"]), ["tenant_id"])
    for made, merged in ((built["entities"], entities), (built["relationships"], relationships)):
        assert made.columns == merged.columns
        assert sorted(made.collect(), key=repr) == sorted(merged.collect(), key=repr)
    command = built["entities"].filter("entity_type = 'process' AND value = 'cmd.exe'").first()
    assert command["properties"] == {"identity_quality": "pid", "pid": "7", "parent_pid": "3", "image_path": "b"}
    plan = built["entities"].filter("entity_type = 'ip'").select("entity_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1  # properties were a second pass over the events
