"""Registered queries: every operator on the whole given tables.

Column names and rounding match ``oracle.py``. Lists are joined to text and times are
microseconds, so that both engines print them alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions import identity
from casewright.operators import (
    cases, correlate, detect, evidence, export, graph, hypotheses, intel, ledger, pair_counts, report, risk, timeline, tree,
)
from casewright.plans import derived, presets
from casewright.plans.investigate import investigate
from casewright.plans.testview import read, sec_events, sec_processes
from casewright.session import cut_lineage
from casewright.sources import normalize
from casewright.streaming import batches, stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def us(name: str) -> Column:
    return F.unix_micros(name).alias(name)


def text(col: str) -> Column:
    return F.array_join(col, ",").alias(col)


def six(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


# -- evidence and events -----------------------------------------------------------------------


@query
def evidence_from_events(spark, sf):
    return evidence.from_events(sec_events(spark, sf)).select(
        "case_id", "evidence_id", "evidence_type", "strength", "title", "description", "confidence", us("observed_at"),
        "has_context",
    )


@query
def evidence_hash_check(spark, sf):
    rows = evidence.verify_hash(evidence.from_events(sec_events(spark, sf)))
    return rows.groupBy("tenant_id").agg(
        F.count("*").alias("n"), F.count_if("hash_ok").alias("ok"), F.count_distinct("content_hash").alias("hashes")
    )


@query
def evidence_summary(spark, sf):
    return evidence.summary(evidence.from_events(sec_events(spark, sf)), ["tenant_id"])


@query
def evidence_highlighted(spark, sf):
    return evidence.highlighted(evidence.from_events(sec_events(spark, sf))).select(
        "case_id", "rank", "evidence_id", "strength", "title"
    )


@query
def evidence_verified(spark, sf):
    events = sec_events(spark, sf)
    rows = evidence.with_verification(evidence.from_events(events), derived.verifications(events))
    return rows.select("evidence_id", "strength", "verified", F.col("verification.verified_by").alias("verified_by"), F.col("verification.method").alias("method"))


@query
def evidence_flag_rows(spark, sf):
    events = sec_events(spark, sf)
    rows = evidence.with_verification(evidence.from_events(events), derived.verifications(events))
    links = derived.contradictions(rows, hypotheses.main_and_counter(rows))
    names = ["is_strong", "is_critical", "is_high_confidence", "is_derived", "is_verified", "supports_hypotheses", "contradicts_hypotheses"]
    return evidence.flags(rows, links).select("evidence_id", *names)


@query
def evidence_edges(spark, sf):
    """A seventh of the evidence is derived from that of the event before."""
    events = sec_events(spark, sf)
    rows = evidence.from_events(events)
    number = F.expr("CAST(replace(event_id, 'E-', '') AS BIGINT)")
    parents = rows.filter("event_severity % 7 = 0").select("evidence_id", F.concat(F.lit("E-E-"), number - 1).alias("parent_id"))
    seen = graph.build(events, ["tenant_id"])["entity_events"].select("entity_id", "event_id")
    about = rows.select("evidence_id", "event_id").join(seen, "event_id").select("evidence_id", "entity_id")
    edges = evidence.reference_edges(rows, derived.contradictions(rows, hypotheses.main_and_counter(rows)), parents, about)
    return edges.select("source", "source_type", "target", "target_type", "relationship")


@query
def category_inference(spark, sf):
    events = sec_events(spark, sf)
    inferred = events.select(
        F.col("category").alias("given"), F.expr(normalize.infer_category_sql("'other'")).alias("inferred")
    )
    return inferred.groupBy("given", "inferred").agg(F.count("*").alias("n"))


@query
def event_fingerprint_dups(spark, sf):
    rows = sec_events(spark, sf).select(identity.event_fingerprint().alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("copies")).filter("copies > 1")


# -- timeline ------------------------------------------------------------------------------------


@query
def timeline_window(spark, sf):
    rows = timeline.project(sec_events(spark, sf))
    rows = timeline.between(rows, "2024-01-10 00:00:00", "2024-01-20 12:00:00")
    return rows.select("event_id", us("timestamp"), "category", "severity", "host", "process_name", text("mitre_techniques"), "summary")


@query
def timeline_high_severity(spark, sf):
    rows = timeline.high_severity(timeline.project(sec_events(spark, sf)))
    return rows.groupBy("host", "category").agg(F.count("*").alias("n"), F.max("severity").alias("top"))


@query
def timeline_related_process(spark, sf):
    rows = timeline.related_to_process(timeline.project(sec_events(spark, sf)), 1042)
    return rows.select("event_id", "host", "process_pid", "parent_pid")


@query
def timeline_dedup_first(spark, sf):
    rows = derived.with_copies(timeline.project(sec_events(spark, sf)))
    return timeline.dedup(rows, ["timestamp", "copy"]).select("event_id", us("timestamp"), "copy")


@query
def timeline_bounds_by_host(spark, sf):
    rows = timeline.bounds(timeline.project(sec_events(spark, sf)), ["host"])
    return rows.select("host", "first_event", "last_event", us("earliest"), us("latest"), six("duration_seconds"), "events")


# -- correlation -----------------------------------------------------------------------------------


def _pairs(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        *more, "source_event_id", "related_event_id", text("reasons"), "reason_count",
        six("time_delta_seconds"), six("score"), six("confidence"),
    )


@query
def pair_correlation(spark, sf):
    return _pairs(correlate.correlate_all(sec_events(spark, sf), per_scope=None), "tenant_id")


def _packed(events: DataFrame) -> DataFrame:
    return events.withColumn("timestamp", F.timestamp_micros(F.expr("unix_micros(timestamp) DIV 1000")))


def _counted(events: DataFrame) -> DataFrame:
    rows = pair_counts.by_case(pair_counts.Pairs(events, ["case_id", "tenant_id"]))
    total = F.round(F.col("confidence_sum").cast("decimal(30,12)"), 6).cast("double")
    return rows.select("case_id", "pairs", total.alias("confidence_sum"), "weak_pairs")


@query
def pair_counts_by_case(spark, sf):
    """Counted, not made; the SQL makes all pairs."""
    return _counted(sec_events(spark, sf))


@query
def pair_counts_dense(spark, sf):
    """A thousand times denser, so that most events of a case pair with each other."""
    return _counted(_packed(sec_events(spark, sf)))


@query
def best_pair_dense(spark, sf):
    rows = pair_counts.Pairs(_packed(sec_events(spark, sf)), ["case_id", "tenant_id"]).best()
    return rows.select("case_id", "tenant_id", "source_event_id", "related_event_id", text("reasons"), six("confidence"))


@query
def pair_correlation_max_mode(spark, sf):
    rules = correlate.Rules(confidence_mode="max", min_confidence=0.3)
    return _pairs(correlate.correlate_all(sec_events(spark, sf), rules=rules, per_scope=None), "tenant_id")


@query
def correlation_top500(spark, sf):
    return _pairs(correlate.correlate_all(sec_events(spark, sf), per_scope=500), "tenant_id", "rank")


@query
def pair_correlation_repeated_ids(spark, sf):
    """A quarter of the events delivered four times, the copies later and on another host."""
    events = sec_events(spark, sf)
    again = events.filter("CAST(replace(event_id, 'E-', '') AS BIGINT) % 4 = 0")
    for seconds in (0, 1, 60):
        later = again.withColumns(
            {"timestamp": F.col("timestamp") + F.expr(f"INTERVAL {seconds} SECONDS"), "host": F.lit("HOST-5") if seconds else F.col("host")}
        )
        events = events.unionByName(later)
    return _pairs(correlate.correlate_all(events), "tenant_id")


@query
def correlation_top_dense(spark, sf):
    """Times divided by a thousand, so that hundreds of events share a cell."""
    return _pairs(correlate.correlate_all(_packed(sec_events(spark, sf)), per_scope=50), "tenant_id", "rank")


@query
def correlation_topk_per_host(spark, sf):
    rules = correlate.Rules(window_seconds=3600)
    return _pairs(correlate.correlate_all(sec_events(spark, sf), ["host"], rules, per_scope=5), "host", "rank")


@query
def correlate_seed_events(spark, sf):
    events = sec_events(spark, sf)
    seeds = events.filter("registry.is_persistence_key").select("event_id")
    rules = correlate.Rules(window_seconds=3600)
    return _pairs(correlate.correlate_seeds(events, seeds, rules=rules, per_seed=3), "rank")


@query
def correlation_reason_counts(spark, sf):
    """Counted, not made; the SQL makes all pairs."""
    rows = pair_counts.by_reason(pair_counts.Pairs(sec_events(spark, sf), ["tenant_id"]))
    return rows.groupBy("reason", "category").agg(F.sum("pairs").alias("pairs"))


# -- graph -----------------------------------------------------------------------------------------


def _graph(spark, sf, registry_keys=False):
    events = sec_events(spark, sf)
    return events, graph.build(events, ["tenant_id"], registry_keys)


def _listed(name: str) -> Column:
    """A map as ``key=value`` pairs in order of keys; empty text for none."""
    pairs = F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(pairs, ","), F.lit("")).alias(name)


@query
def entities_resolved(spark, sf):
    _, g = _graph(spark, sf)
    return g["entities"].select(
        "fingerprint", "entity_id", "tenant_id", "entity_type", "value", "normalized_value", "host", us("first_seen"),
        us("last_seen"), "mention_count", _listed("properties"),
    )


@query
def entity_type_counts(spark, sf):
    return graph.type_counts(_graph(spark, sf)[1]["entities"], "entity_type")


@query
def entity_provenance(spark, sf):
    _, g = _graph(spark, sf)
    return g["entity_events"].groupBy("entity_id").agg(F.count("*").alias("events"))


@query
def relationships_resolved(spark, sf):
    rows = _graph(spark, sf)[1]["relationships"]
    return rows.select("fingerprint", "relationship_type", "source_id", "target_id", "event_count", us("first_seen"), us("last_seen"))


@query
def relationships_merged(spark, sf):
    """Edges with properties of their own: merged key by key, the first value counts; sorted by type and ends."""
    merged = graph.resolve_relationships(_own_edges(sec_events(spark, sf)), ["tenant_id"])
    return merged.orderBy(*graph.relationship_sort_key()).select("fingerprint", _listed("properties"))


def _own_edges(events: DataFrame) -> DataFrame:
    """Edges with strengths, properties, metadata and tags of their event's number."""
    number = F.expr("CAST(replace(event_id, 'E-', '') AS BIGINT)")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    own = F.map_from_entries(F.array(entry("seen_by", number % 5), F.when(number % 3 == 0, entry("third", number)).otherwise(entry("other", F.lit(1)))))
    return graph.edges(events, ["tenant_id"]).withColumns(
        {
            "weight": (number % 7) / 8, "confidence": (number % 5) / 4, "properties": own,
            "metadata": F.map_from_entries(F.array(entry("noted", number % 4))), "tags": F.array(F.concat(F.lit("t"), number % 6)),
        }
    )


@query
def relationships_merge_policies(spark, sf):
    """Every policy of strength and conflict; null for a third of the tenants."""
    rows = cut_lineage(_own_edges(_some_tenants(sec_events(spark, sf))))
    out = None
    for strength, on_property, on_metadata in (("max", "left", "left"), ("avg", "right", "left"), ("left", "left", "right"), ("right", "right", "right"), ("max", "raise", "raise")):
        own = rows if on_property != "raise" else rows.withColumns(
            {c: F.map_from_entries(F.array(F.struct(F.lit("rel").alias("key"), F.col("relationship_type").alias("value")))) for c in ("properties", "metadata")}
        )
        merged = graph.resolve_relationships(own, ["tenant_id"], strength, on_property, on_metadata).select(
            F.lit(f"{strength}/{on_property}/{on_metadata}").alias("policy"), "tenant_id", "fingerprint", six("weight"), six("confidence"),
            _listed("properties"), _listed("metadata"), text("tags"), "event_count", us("first_seen"), us("last_seen"),
        )
        out = merged if out is None else out.unionByName(merged)
    return out


@query
def relationships_extended(spark, sf):
    """The later half is the stored table, the earlier one comes after: sides count, not times."""
    rows = _own_edges(_some_tenants(sec_events(spark, sf)))
    stored, fresh = (
        cut_lineage(graph.resolve_relationships(rows.filter(f"timestamp {side} '2024-01-16'"), ["tenant_id"], "left")) for side in (">=", "<")
    )
    out = None
    for strength, conflict in (("left", "left"), ("right", "right"), ("avg", "left"), ("max", "right")):
        merged = graph.extend_relationships(stored, fresh, ["tenant_id"], strength, conflict, conflict).select(
            F.lit(f"{strength}/{conflict}").alias("policy"), "tenant_id", "fingerprint", six("weight"), six("confidence"),
            _listed("properties"), _listed("metadata"), text("tags"), "event_count",
        )
        out = merged if out is None else out.unionByName(merged)
    return out


def _some_tenants(events: DataFrame) -> DataFrame:
    return events.withColumn("tenant_id", F.when(F.col("tenant_id") != "tenant-0", F.col("tenant_id")))


@query
def entities_null_tenant(spark, sf):
    """A third of the events have no tenant."""
    g = graph.build(_some_tenants(sec_events(spark, sf)), ["tenant_id"])
    return g["entities"].select(
        "fingerprint", "entity_id", "tenant_id", "entity_type", "value", "normalized_value", "host", us("first_seen"),
        us("last_seen"), "mention_count", _listed("properties"),
    )


@query
def entity_lists_united(spark, sf):
    """A property that is a list for most events, and a plain text for a few, after which lists begin anew; metadata keeps the first value."""
    number = F.expr("CAST(replace(event_id, 'E-', '') AS BIGINT)")
    some = F.concat(F.lit("["), number % 3, F.lit(',"x'), number % 4, F.lit('"]'))
    entry = lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    rows = graph.mentions(_some_tenants(sec_events(spark, sf)), ["tenant_id"]).filter("entity_type IN ('domain', 'ip')").withColumns(
        {"properties": entry("seen", F.when(number % 37 == 0, "plain").otherwise(some)), "metadata": entry("noted", number % 4)}
    )
    merged = graph.resolve_entities(rows, ["tenant_id"])
    return merged.select("tenant_id", "fingerprint", F.element_at("properties", "seen").alias("seen"), F.element_at("metadata", "noted").alias("noted"))


@query
def relationship_type_counts(spark, sf):
    rows = graph.relationship_flags(_graph(spark, sf)[1]["relationships"])
    return rows.groupBy("relationship_type", "category").agg(F.count("*").alias("n"))


@query
def relationships_reversed(spark, sf):
    rows = graph.reverse(_graph(spark, sf)[1]["relationships"])
    return rows.select("fingerprint", "source_id", "relationship_type", "target_id")


@query
def graph_stats(spark, sf):
    _, g = _graph(spark, sf)
    return graph.stats(g["entities"], g["relationships"], "tenant-1")


@query
def graph_extend(spark, sf):
    """Old half and new half built apart, then merged: equals the graph of all events."""
    events = sec_events(spark, sf)
    early, late = events.filter("timestamp < '2024-01-16'"), events.filter("timestamp >= '2024-01-16'")
    a, b = graph.build(early, ["tenant_id"]), graph.build(late, ["tenant_id"])
    rows = graph.extend_entities(a["entities"], b["entities"], ["tenant_id"])
    return rows.select(
        "fingerprint", "entity_type", "value", us("first_seen"), us("last_seen"), "mention_count", _listed("properties")
    )


@query
def neighbors(spark, sf):
    _, g = _graph(spark, sf)
    return graph.neighbors(g["relationships"], g["entities"]).select(
        "node", "entity_id", "entity_type", "value", "host", "relationship_type"
    )


@query
def subgraph_2hop(spark, sf):
    _, g = _graph(spark, sf)
    seeds = g["entities"].filter("entity_type = 'ip' AND value = '203.0.113.7'")
    inside = graph.subgraph(g["entities"], g["relationships"], seeds, 2)
    return inside["entities"].select("entity_id", "entity_type", "depth").unionByName(
        inside["relationships"].select(
            F.col("fingerprint").alias("entity_id"), F.col("relationship_type").alias("entity_type"), F.lit(-1).alias("depth")
        )
    )


def _a_child(relationships: DataFrame) -> str:
    """The process with the smallest id that another one of tenant-1 has spawned."""
    return relationships.filter("relationship_type = 'spawned' AND tenant_id = 'tenant-1'").agg(F.min("target_id")).first()[0] or ""


@query
def lineage_of_entity(spark, sf):
    relationships = cut_lineage(_graph(spark, sf)[1]["relationships"])
    return graph.longest_lineage(relationships, _a_child(relationships), 4)


@query
def process_lineage_preset(spark, sf):
    _, g = _graph(spark, sf)
    relationships = cut_lineage(g["relationships"])
    return presets.process_lineage(g["entities"], relationships, _a_child(relationships)).select("entity_id", "value", "host", "depth")


@query
def shortest_path(spark, sf):
    _, g = _graph(spark, sf)
    ends = derived.address_ids("tenant-1", "203.0.113.7", "203.0.113.21")
    return graph.shortest_path(cut_lineage(g["relationships"]), *ends)


@query
def shortest_paths_many(spark, sf):
    """From each of three addresses to all processes of a host, in one run."""
    _, g = _graph(spark, sf)
    entities = cut_lineage(g["entities"].filter("tenant_id = 'tenant-1'"))
    sources = entities.filter("entity_type = 'ip' AND value IN ('203.0.113.7', '203.0.113.8', '10.0.1.1')").select(F.col("entity_id").alias("source_id"), F.lit(1).alias("k"))
    targets = entities.filter("entity_type = 'process' AND host = 'host-4'").select(F.col("entity_id").alias("target_id"), F.lit(1).alias("k"))
    asks = sources.join(targets, "k").drop("k")
    return graph.shortest_paths(cut_lineage(g["relationships"]), asks, 4)


@query
def process_spawn_reach(spark, sf):
    """Processes below each process of a case within ten spawning steps, counted."""
    edges = graph.resolve_relationships(graph.edges(sec_events(spark, sf), ["case_id"]), ["case_id"])
    return graph.descendant_counts(edges, ["case_id"]).withColumnRenamed("descendants", "below")


@query
def cross_host_entities(spark, sf):
    return presets.cross_host_entities(_graph(spark, sf)[1]["entities"]).select("value", "entity_type", text("hosts"), "host_count")


@query
def shared_hashes_across_hosts(spark, sf):
    _, g = _graph(spark, sf)
    return presets.shared_hashes_across_hosts(g["entities"], g["relationships"]).select("hash_value", "algo", text("hosts"), "host_count")


@query
def top_connected_entities(spark, sf):
    _, g = _graph(spark, sf)
    return presets.top_connected_entities(g["entities"], g["relationships"])


@query
def recent_entities(spark, sf):
    rows = presets.recent_entities(_graph(spark, sf)[1]["entities"])
    return rows.select("entity_id", "entity_type", "value", us("first_seen"))


@query
def lateral_movement_edges(spark, sf):
    events, g = _graph(spark, sf)
    edges = derived.first_copy_edges(g["entities"], g["relationships"])
    return presets.lateral_movement(g["entities"], edges, "tenant-1").select(
        "source_id", "source_host", "target_id", "target_host", "relationship_type"
    )


@query
def entities_by_technique(spark, sf):
    events, g = _graph(spark, sf)
    rows = presets.entities_by_technique(g["entities"], g["entity_events"], events, "T1105", "tenant-0")
    return rows.select("entity_id", "entity_type", "value", "host")


@query
def persistence_artifacts(spark, sf):
    events, g = _graph(spark, sf, registry_keys=True)
    rows = presets.persistence_artifacts(g["entities"], g["entity_events"], events)
    return rows.select("entity_id", "entity_type", "value", "host")


@query
def high_severity_entities(spark, sf):
    events, g = _graph(spark, sf)
    rows = presets.high_severity_entities(g["entities"], g["entity_events"], events)
    return rows.select("entity_id", "entity_type", "value", "severity")


@query
def case_graph(spark, sf):
    events, g = _graph(spark, sf)
    bridge = graph.mentions(events, ["case_id"]).select("case_id", "entity_id")
    return presets.case_graph(bridge, g["entities"], g["relationships"], "HOST-7/2024-01-15").select(
        "entity_id", "value", "relationship_type", "other_id"
    )


# -- process tree ------------------------------------------------------------------------------------


def _named(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.array_join(name, "; "))


@query
def timeline_for_host(spark, sf):
    rows = timeline.ordered(timeline.for_host(timeline.project(sec_events(spark, sf)), " HOST-4 "))
    return rows.select("event_id", us("timestamp"), "category", "severity")


@query
def timeline_since_until(spark, sf):
    rows = timeline.until(timeline.since(timeline.project(sec_events(spark, sf)), "2024-01-05"), "2024-01-09 12:00:00")
    return rows.select("event_id", us("timestamp"))


@query
def entity_lookup(spark, sf):
    _, g = _graph(spark, sf)
    found = graph.find_entities(g["entities"], "ip", "203.0.113.7").unionByName(graph.find_entities(g["entities"], "file", host="HOST-3"))
    return found.select("entity_id", "entity_type", "value", "host")


@query
def relationship_lookup(spark, sf):
    _, g = _graph(spark, sf)
    rows = graph.find_relationships(g["relationships"], "connected_to")
    return graph.with_relationship_fingerprint_check(rows).select("fingerprint", "source_id", "target_id", "fingerprint_ok")


@query
def entity_flag_rows(spark, sf):
    _, g = _graph(spark, sf)
    rows = graph.entity_flags(graph.with_entity_fingerprint_check(g["entities"])).withColumn("errors", graph.entity_errors())
    return _named(rows, "errors").select(
        "entity_id", "is_occurrence", "is_substantive", "is_global", "is_host_scoped", "fingerprint_ok", "errors"
    )


@query
def relationship_flag_rows(spark, sf):
    rows = graph.relationship_flags(_graph(spark, sf)[1]["relationships"]).withColumn("errors", graph.relationship_errors())
    return _named(rows, "errors").select("fingerprint", "category", "is_symmetric", "is_investigation", "errors")


@query
def entity_provenance_added(spark, sf):
    """Entities of the first half widened by the sightings of the second."""
    events = sec_events(spark, sf)
    early, late = events.filter("timestamp < '2024-01-16'"), events.filter("timestamp >= '2024-01-16'")
    log = graph.mentions(late, ["tenant_id"]).select("tenant_id", "fingerprint", "timestamp", "event_id")
    rows = graph.add_provenance(graph.build(early, ["tenant_id"])["entities"], log, ["tenant_id"])
    return rows.select("fingerprint", us("first_seen"), us("last_seen"), "mention_count")


@query
def process_descendants(spark, sf):
    return tree.descendants(_tree(spark, sf), "HOST-3|pid:4").select("node", "event_id")


@query
def process_children(spark, sf):
    rows = _tree(spark, sf)
    return tree.children(rows, "HOST-5|pid:2").select("node", "event_id", "parent")


@query
def risk_summaries(spark, sf):
    tables = investigate(sec_events(spark, sf))
    rows = risk.flags(risk.with_summary(tables["risk"], tables["top_factors"]))
    return rows.select(
        "case_id", "is_high_risk", "is_critical_risk", F.regexp_extract("summary", r"^(Risk \d+/100)", 1).alias("head"),
        F.regexp_extract("summary", r"Top contributors: (.*)[.]$", 1).alias("top"),
    )


@query
def verdict_bands(spark, sf):
    events = sec_events(spark, sf)
    return events.select("event_id", report.verdict(F.col("severity")).alias("verdict"))


@query
def hypothesis_updates(spark, sf):
    """Updates put evidence on both sides; the first side keeps it."""
    events = sec_events(spark, sf)
    made = hypotheses.main_and_counter(evidence.from_events(events))
    n = F.expr("CAST(replace(event_id, 'E-', '') AS BIGINT)")
    steps = events.withColumn("n", n).select("case_id", "timestamp", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    log = made.select("hypothesis_id", "case_id").join(steps, "case_id").select(
        "hypothesis_id", (F.col("timestamp") + F.make_dt_interval(secs=F.col("i"))).alias("ts"),
        F.when((F.col("n") + F.col("i")) % 2 == 0, "support").otherwise("contradict").alias("action"), (F.col("n") % 50).cast("string").alias("value"),
    )
    extra = made.select("hypothesis_id", F.lit("2024-02-01").cast("timestamp").alias("ts"), F.lit("missing").alias("action"), F.lit("zz-memory-image").alias("value"))
    rows = hypotheses.apply_updates(made.withColumns({"support_count": F.lit(0), "contradict_count": F.lit(0)}), log.unionByName(extra))
    return rows.select("hypothesis_id", "support_count", "contradict_count", F.element_at("missing_evidence", -1).alias("last_missing"))


def _tree(spark, sf):
    return tree.with_parent(tree.nodes(sec_processes(spark, sf)))


@query
def process_roots_orphans(spark, sf):
    rows = _tree(spark, sf)
    return tree.roots(rows).select("node", "event_id", "is_orphan")


@query
def process_lineage(spark, sf):
    return tree.ancestors(_tree(spark, sf)).select("node", "ancestor", "distance")


@query
def process_intervals(spark, sf):
    return tree.intervals(_tree(spark, sf))


@query
def process_subtree(spark, sf):
    """What is below a node, and the way from it to the root, by ranges."""
    labels = cut_lineage(tree.intervals(_tree(spark, sf)))
    below = tree.inside(labels, "HOST-3|pid:4").select("node", "depth", F.lit("below").alias("side"))
    return below.unionByName(tree.around(labels, "HOST-3|pid:4").select("node", F.col("distance").alias("depth"), F.lit("above").alias("side")))


@query
def process_descendant_counts(spark, sf):
    return tree.depths(_tree(spark, sf)).select("node", "root", "depth", "descendants")


# -- detection and intel ------------------------------------------------------------------------------


def _finding_columns(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "rule_id", "rule_name", "severity", "severity_name", "description", text("mitre_techniques"))


@query
def lolbin_findings(spark, sf):
    return _finding_columns(detect.lolbins(sec_events(spark, sf)))


@query
def sigma_many_rules(spark, sf):
    """Two thousand rules by index."""
    rows = detect.apply_rules(sec_events(spark, sf), derived.many_rules(2000))
    return rows.select("case_id", "event_id", "rule_id", "rule_name", "severity", "severity_name", "description")


@query
def sigma_findings(spark, sf):
    return _finding_columns(detect.apply_rules(sec_events(spark, sf), derived.RULES))


@query
def detection_stats(spark, sf):
    return detect.stats(detect.run(sec_events(spark, sf), derived.RULES))


@query
def indicators_distinct(spark, sf):
    return intel.distinct_indicators(intel.indicators(sec_events(spark, sf)))


def _intel(spark, sf):
    found = intel.distinct_indicators(intel.indicators(sec_events(spark, sf)))
    return intel.with_verdict(intel.enrich(found, derived.intel_feed(found), intel.provider_support(spark)))


@query
def intel_enrichment(spark, sf):
    return _intel(spark, sf).select(
        "indicator_type", "indicator", "provider", "found", "malicious_count", "total_count", six("detection_ratio"),
        "is_malicious", "error",
    )


@query
def intel_first_answers(spark, sf):
    """Every provider answers once more later, more malicious: the first answer stays."""
    found = intel.distinct_indicators(intel.indicators(sec_events(spark, sf)))
    feed = derived.intel_feed(found).withColumn("answered_at", F.lit("2024-02-01").cast("timestamp"))
    later = feed.withColumns({"answered_at": F.lit("2024-02-02").cast("timestamp"), "malicious_count": F.col("malicious_count") + 1, "found": F.lit(True)})
    return intel.with_verdict(intel.enrich(found, later.unionByName(feed), intel.provider_support(spark))).select(
        "indicator_type", "indicator", "provider", "found", "malicious_count", "total_count", six("detection_ratio"),
        "is_malicious", "error",
    )


@query
def intel_summary(spark, sf):
    return intel.summary(_intel(spark, sf))


@query
def intel_events(spark, sf):
    events = sec_events(spark, sf)
    sightings = intel.indicators(events)
    bad = _intel(spark, sf).filter("is_malicious")
    hits = intel.enrich_events(sightings, bad)
    return hits.groupBy("event_id").agg(F.count("*").alias("hits"), F.max("malicious_count").alias("worst"))


@query
def intel_url_pages(spark, sf):
    events = derived.url_events(read(spark, sf, "pages"))
    found = intel.distinct_indicators(intel.indicators(events))
    return intel.enrich(found, derived.url_feed(found), intel.provider_support(spark)).select(
        "indicator_type", "indicator", "provider", "found", "malicious_count", "error"
    )


@query
def intel_responses(spark, sf):
    found = intel.distinct_indicators(intel.indicators(sec_events(spark, sf)))
    rows = intel.parse_responses(derived.provider_responses(found))
    return rows.select("provider", "indicator_type", "indicator", "found", "malicious_count", "total_count", "reputation", text("tags"))


# -- hypotheses, risk, cases ----------------------------------------------------------------------------


@query
def hypothesis_main_counter(spark, sf):
    rows = hypotheses.main_and_counter(evidence.from_events(sec_events(spark, sf)))
    return rows.select(
        "case_id", "hypothesis_type", "statement", text("mitre_techniques"), "status", "confidence", "support_count",
        text("missing_evidence"), "fingerprint", "hypothesis_id",
    )


@query
def hypothesis_support(spark, sf):
    rows = evidence.from_events(sec_events(spark, sf))
    return hypotheses.support_links(rows, hypotheses.main_and_counter(rows)).select("case_id", "hypothesis_id", "evidence_id")


@query
def hypotheses_merged(spark, sf):
    """One hypothesis of many cases has one fingerprint: its versions merged, with their evidence of both sides."""
    rows = evidence.from_events(sec_events(spark, sf))
    made = cut_lineage(hypotheses.main_and_counter(rows))
    prints = made.select("hypothesis_id", "fingerprint")
    support = hypotheses.support_links(rows, made).join(prints, "hypothesis_id")
    merged = hypotheses.merge(made, support, derived.contradictions(rows, made).join(prints, "hypothesis_id"), on_overlap="report")
    return merged.select(
        "fingerprint", "hypothesis_type", "statement", "status", "confidence", text("mitre_techniques"), text("missing_evidence"),
        "support_count", "contradict_count", "overlap_count",
    )


@query
def hypothesis_contradictions(spark, sf):
    rows = evidence.from_events(sec_events(spark, sf))
    made = hypotheses.main_and_counter(rows)
    return hypotheses.with_contradictions(made, derived.contradictions(rows, made)).select(
        "hypothesis_id", "support_count", "contradict_count"
    )


@query
def hypothesis_sub_correlation(spark, sf):
    rows = pair_counts.Pairs(sec_events(spark, sf), ["case_id", "tenant_id"]).best()
    return hypotheses.correlation_sub(rows).select("case_id", "statement", "rationale", "hypothesis_id")


@query
def hypothesis_sub_chain(spark, sf):
    g = graph.build(sec_events(spark, sf), ["case_id"])
    rows = hypotheses.chain_sub(g["entities"], graph.descendant_counts(g["relationships"], ["case_id"]))
    return rows.select("case_id", "statement", "rationale", text("mitre_techniques"), "hypothesis_id")


@query
def hypothesis_sub_shared_hash(spark, sf):
    """One case per tenant, so that its files lie on several hosts."""
    events = sec_events(spark, sf).withColumn("case_id", F.col("tenant_id"))
    g = graph.build(events, ["case_id"])
    return hypotheses.shared_hash_sub(g["entities"], g["relationships"]).select("case_id", "statement", "rationale")


@query
def hypothesis_findings(spark, sf):
    rows = hypotheses.main_and_counter(evidence.from_events(sec_events(spark, sf)))
    return report.hypothesis_findings(rows).select("case_id", "statement", "finding")


@query
def counter_findings(spark, sf):
    rows = hypotheses.main_and_counter(evidence.from_events(sec_events(spark, sf)))
    return report.counter_findings(rows).select("case_id", "statement", "finding", text("needed"))


@query
def hypothesis_status_violations(spark, sf):
    log = derived.status_log(sec_events(spark, sf), "hypothesis")
    return hypotheses.status_violations(log, "case_id", vocab.HYPOTHESIS_TRANSITIONS).select(
        "case_id", "step_id", "prev_status", "status"
    )


@query
def risk_by_case(spark, sf):
    rows = investigate(sec_events(spark, sf))["risk"]
    return rows.select(
        "case_id", "risk_score", six("confidence"), "evidence_score", "correlation_score", "hypothesis_score",
        "penalty_score", "evidence_count", "correlation_count", "hypothesis_count",
    )


@query
def risk_factors_top5(spark, sf):
    rows = investigate(sec_events(spark, sf))["top_factors"]
    return rows.select("case_id", "rank", "name", "category", "contribution")


@query
def risk_evolution(spark, sf):
    rows = risk.evolution(derived.risk_updates(sec_events(spark, sf)), "host")
    return rows.select("host", us("ts"), "risk_score", "previous_risk_score", "delta")


@query
def case_summary(spark, sf):
    rows = investigate(sec_events(spark, sf))["cases"]
    return rows.select(
        "case_id", "tenant_id", "severity", "priority", "status", "event_count", "evidence_count", "correlation_count",
        "hypothesis_count", "entity_count", "relationship_count",
    )


@query
def case_links(spark, sf):
    events = sec_events(spark, sf)
    rows = evidence.from_events(events)
    entities = graph.build(events, ["case_id"])["entities"]
    made = hypotheses.main_and_counter(rows)
    return cases.links(events, rows, made, entities, cases.assemble(events, analyst="alex"))


@query
def case_list_page(spark, sf):
    rows = cases.assemble(sec_events(spark, sf)).withColumn("created_at", F.col("first_event_at"))
    rows = cases.listing(rows, tenant_id="tenant-1", priority="critical")
    return cases.page(rows, 20, 20).select("case_id", "severity", us("created_at"))


@query
def case_count(spark, sf):
    return cases.count(cases.assemble(sec_events(spark, sf)), "tenant-2", "triaged")


@query
def case_status_violations(spark, sf):
    log = derived.status_log(sec_events(spark, sf), "case")
    return cases.transitions(log).select("case_id", "step_id", "prev_status", "status")


@query
def case_current_state(spark, sf):
    log = derived.status_log(sec_events(spark, sf), "case")
    return cases.current_state(log, ["status", "analyst"], ["ts", "step_id"])


# -- reports and alerts ------------------------------------------------------------------------------------


@query
def report_timeline(spark, sf):
    rows = report.timeline(evidence.from_events(sec_events(spark, sf)))
    return rows.select("case_id", "evidence_id", us("observed_at"), "category", "severity", "strength", "title")


@query
def recommended_actions(spark, sf):
    events = sec_events(spark, sf)
    made = hypotheses.main_and_counter(evidence.from_events(events))
    return report.recommended_actions(made, cases.assemble(events).select("case_id"))


@query
def repeated_observations(spark, sf):
    return report.repeated_observations(evidence.from_events(sec_events(spark, sf)))


@query
def case_quality_findings(spark, sf):
    t = investigate(sec_events(spark, sf))
    return report.case_findings(t["evidence"], t["hypotheses"], t["correlation_totals"], t["risk"])


@query
def alert_levels(spark, sf):
    t = investigate(sec_events(spark, sf))
    rows = report.alerts(t["cases"], t["hypotheses"])
    return rows.select("case_id", "priority", "risk_score", "alert_level", "alert_rule", F.size("top_hypotheses").alias("shown"))


# -- ledger --------------------------------------------------------------------------------------------------


@query
def ledger_verify(spark, sf):
    return ledger.verify(derived.altered(ledger.append(derived.ledger_rows(sec_events(spark, sf)))))


@query
def ledger_build(spark, sf):
    """Every entry of the chained ledgers, one for each case."""
    return ledger.append(derived.ledger_rows(sec_events(spark, sf))).select(
        "ledger_id", "sequence", "evidence_id", "previous_hash", "entry_hash"
    )


@query
def ledger_against_evidence(spark, sf):
    events = sec_events(spark, sf)
    entries = derived.altered(ledger.append(derived.ledger_rows(events)))
    now = derived.ledger_rows(events).select("evidence_id", F.col("evidence_hash").alias("content_hash"))
    return ledger.against_evidence(entries, now).select("evidence_id", "matches")


# -- sources ----------------------------------------------------------------------------------------------------


def _normal_columns(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        *more,
        "event_id", us("timestamp"), "source", "platform", "category", "event_type", "severity", "host", "user",
        F.col("process.name").alias("pname"), F.col("process.pid").alias("pid"),
        F.col("process.parent_pid").alias("ppid"), F.col("process.parent_name").alias("parent_name"), "rule_id",
        text("mitre_techniques"), text("mitre_tactics"), text("tags"), F.size("errors").alias("errors"),
    )


@query
def wazuh_normalized(spark, sf):
    return _normal_columns(normalize.wazuh_events(derived.wazuh_records(sec_events(spark, sf))))


@query
def sysmon_normalized(spark, sf):
    rows = normalize.sysmon_events(derived.sysmon_records(sec_events(spark, sf)))
    # the id is a hash of the record, so the comparison takes its form; the hashes are compared as parsed
    return _normal_columns(rows.withColumn("_h", _listed("process.hashes")), "_h").withColumnRenamed("_h", "hashes").withColumn(
        "event_id", F.regexp_extract("event_id", "^sysmon-[0-9a-f]+-([0-9]+)$", 1)
    )


@query
def mixed_accounting(spark, sf):
    rows = normalize.normalize(derived.mixed_records(sec_events(spark, sf)))
    return normalize.accounting(rows, ["format"]).select(
        "format", "raw_count", "success_count", "error_count", six("success_rate")
    )


@query
def poll_new_only(spark, sf):
    events = sec_events(spark, sf)
    seen = events.filter("timestamp < '2024-01-10'").select("event_id")
    return normalize.poll_ids(normalize.unseen(events, seen)).select("event_id", "host", us("timestamp"))


# -- export -----------------------------------------------------------------------------------------------------------


@query
def graph_export_nodes(spark, sf):
    events = sec_events(spark, sf)
    rows = evidence.from_events(events)
    tables = {
        "events": events, "evidence": rows, "entities": graph.build(events, ["tenant_id"])["entities"],
        "hypotheses": hypotheses.main_and_counter(rows), "ledger": ledger.append(derived.ledger_rows(events)),
    }
    return export.nodes(tables).groupBy("type").agg(F.count("*").alias("n"))


@query
def graph_export_edges(spark, sf):
    events = sec_events(spark, sf)
    rows = evidence.from_events(events)
    g = graph.build(events, ["tenant_id"])
    tables = {
        "evidence": rows, "relationships": g["relationships"], "entity_events": g["entity_events"],
        "hypothesis_support": hypotheses.support_links(rows, hypotheses.main_and_counter(rows)),
        "correlations": correlate.correlate_all(events),
    }
    return export.edges(tables).groupBy("relationship", "target_type").agg(F.count("*").alias("n"))


# -- streaming ------------------------------------------------------------------------------------------------------


def _arrivals(spark, sf, streaming=False):
    """Events by host, arriving in fast motion."""
    events = sec_events(spark, sf, streaming)
    return events.select(
        batches.group_key("host").alias("batch_group"), F.expr("unix_micros(timestamp) DIV 2000").alias("arrival"),
        "event_id", "tenant_id", "host",
    )


@query
def event_batches_replay(spark, sf):
    rows = batches.summarize(batches.replay(_arrivals(spark, sf)))
    return rows.select("batch_group", "batch_start", "size", "first_at", "last_at", "title", "tenant_id")


def _stream_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    cut_lineage(spark.range(1))  # makes sure the checkpoint folder is set
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


#: Rows of a stream that one run gets: what a task and the state hold grows with them, not with the table.
SLICE_ROWS = 1_000_000


def _in_slices(rows: DataFrame, time: str, folder: str, run: Callable[[], DataFrame]) -> DataFrame:
    """Hand rows to a stream over ``{folder}/in`` in order of ``time``, a slice a run; what the last run gives.

    No slice begins before the end of the one before, so the watermark drops none of its rows. Rows of one time stay together.
    """
    at, parts = F.unix_micros(time), -(-rows.count() // SLICE_ROWS)
    bounds = rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    number = F.lit(0)
    for bound in bounds or []:
        number = number + F.coalesce((at > bound).cast("int"), F.lit(0))
    rows.withColumn("_slice", number).write.partitionBy("_slice").parquet(f"{folder}/slices")
    stored, out = rows.sparkSession.read.parquet(f"{folder}/slices"), None
    for i in range(max(parts, 1)):
        stored.filter(F.col("_slice") == i).select(*rows.columns).write.mode("append").parquet(f"{folder}/in")
        out = run()
    return out


def _stream_result(spark: SparkSession, rows: DataFrame, folder: str | None = None) -> DataFrame:
    folder = folder or _stream_folder(spark)
    run = (
        rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start(f"{folder}/rows")
    )
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query
def event_batches_stream(spark, sf):
    """The stream form of the batches: runs over the events in slices of time, and a last one that gets the flush."""
    folder = _stream_folder(spark)
    rows = _arrivals(spark, sf).select(
        "batch_group", F.timestamp_micros("arrival").alias("arrived_at"), "event_id", F.lit("{}").alias("body")
    )
    rows.limit(0).write.parquet(f"{folder}/in")
    events = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    _in_slices(rows, "arrived_at", folder, lambda: _stream_result(spark, batches.stream_batches(events), folder))
    last = rows.agg(F.unix_micros(F.max("arrived_at"))).first()[0] or 0
    groups = rows.select("batch_group").distinct()
    batches.flush_rows(groups, F.timestamp_micros(F.lit(last + 1))).write.mode("append").parquet(f"{folder}/in")
    closed = _stream_result(spark, batches.stream_batches(events), folder)
    return closed.groupBy("batch_group", "batch_no").agg(F.count("*").alias("size"))


@query
def stream_pair_correlation(spark, sf):
    """The stream form of ``pair_correlation``; a trigger's events meet the kept ones, no key is held as state."""
    folder = _stream_folder(spark)
    events = sec_events(spark, sf, streaming=True)
    run = (
        events.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        .foreachBatch(correlate.pair_writer(folder, 3600)).start()
    )
    run.awaitTermination()
    return _pairs(correlate.written_pairs(spark, folder), "tenant_id")


@query
def stream_dedup(spark, sf):
    """Every event sent twice, taken in once."""
    events = sec_events(spark, sf, streaming=True).select("event_id", "timestamp", "host")
    twice = events.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    return _stream_result(spark, stream.dedup(twice, "1 hour")).select("event_id", "host", us("timestamp"))
