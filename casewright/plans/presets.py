"""Named graph queries over the stored tables.

``entities``, ``entity_events``, ``relationships`` and ``events`` are the tables
``graph.build`` gives. What a preset needs from the events (severity, techniques,
persistence) is read from them through ``entity_events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators import graph


def _first(rows: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """All rows, or the first ``limit`` in order."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def _tenant(rows: DataFrame, tenant_id: str | None) -> DataFrame:
    return rows if tenant_id is None else rows.filter(F.col("tenant_id") == tenant_id)


def process_lineage(entities: DataFrame, relationships: DataFrame, entity_id: str, max_depth: int = 5, limit: int | None = None) -> DataFrame:
    """Processes within ``max_depth`` spawning steps of one, in any direction."""
    spark = entities.sparkSession
    spawned = relationships.filter("relationship_type = 'spawned'")
    near = graph.reach(spawned, spark.createDataFrame([(entity_id,)], "entity_id string"), max_depth)
    rows = entities.filter("entity_type = 'process'").join(near.withColumnRenamed("node", "entity_id"), "entity_id")
    return _first(rows, limit, "depth", "entity_id")


def entities_by_technique(
    entities: DataFrame, entity_events: DataFrame, events: DataFrame, technique: str,
    tenant_id: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Entities seen by events with the technique."""
    seen = events.filter(F.array_contains("mitre_techniques", technique)).select("event_id")
    ids = entity_events.join(seen, "event_id", "left_semi").select("entity_id").distinct()
    rows = _tenant(entities, tenant_id).join(ids, "entity_id", "left_semi")
    return _first(rows, limit, F.asc_nulls_last("host"), "value", "entity_id")


def case_graph(case_entities: DataFrame, entities: DataFrame, relationships: DataFrame, case_id: str, limit: int | None = None) -> DataFrame:
    """Entities of a case with their edges and the other ends."""
    mine = case_entities.filter(F.col("case_id") == case_id).select("entity_id").distinct()
    inside = entities.join(mine, "entity_id", "left_semi").select("entity_id", "entity_type", "value")
    edges = graph.both_directions(relationships).select(
        F.col("node").alias("entity_id"), F.col("other").alias("other_id"), "relationship_type"
    )
    rows = inside.join(edges, "entity_id", "left")
    return _first(rows, limit, "entity_id", F.asc_nulls_first("relationship_type"), F.asc_nulls_first("other_id"))


def lateral_movement(entities: DataFrame, relationships: DataFrame, tenant_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Edges between entities of two different hosts."""
    hosts = entities.filter(F.col("host").isNotNull()).select("entity_id", "host", "value")
    side = lambda name: hosts.select(
        F.col("entity_id").alias(f"{name}_id"), F.col("host").alias(f"{name}_host"), F.col("value").alias(f"{name}_value")
    )
    rows = _tenant(relationships, tenant_id).join(side("source"), "source_id").join(side("target"), "target_id")
    crossing = rows.filter(F.col("source_host") != F.col("target_host"))
    return _first(crossing, limit, "source_id", "target_id", "relationship_type")


def _from_events(
    entities: DataFrame, entity_events: DataFrame, events: DataFrame, wanted: Column, tenant_id: str | None
) -> DataFrame:
    ids = entity_events.join(events.filter(wanted).select("event_id"), "event_id", "left_semi")
    return _tenant(entities, tenant_id).join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def persistence_artifacts(
    entities: DataFrame, entity_events: DataFrame, events: DataFrame, tenant_id: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Registry keys and files of events marked as persistence.

    Needs a graph built with ``registry_keys=True``.
    """
    marked = F.coalesce(F.col("registry.is_persistence_key"), F.lit(False)) | F.coalesce(
        F.array_contains("tags", "persistence"), F.lit(False)
    )
    things = entities.filter(F.col("entity_type").isin("registry", "file"))
    return _first(_from_events(things, entity_events, events, marked, tenant_id), limit, "value", "entity_id")


def shared_hashes_across_hosts(
    entities: DataFrame, relationships: DataFrame, tenant_id: str | None = None, min_hosts: int = 2, limit: int | None = None,
) -> DataFrame:
    """Hashes whose files lie on several hosts, the widest spread first."""
    files = _tenant(entities, tenant_id).filter("entity_type = 'file' AND host IS NOT NULL").select(
        F.col("entity_id").alias("source_id"), "host"
    )
    hashes = _tenant(entities, tenant_id).filter("entity_type = 'hash'").select(
        F.col("entity_id").alias("target_id"), F.col("normalized_value").alias("hash_value"), F.col("hash_algorithm").alias("algo")
    )
    links = relationships.filter("relationship_type = 'has_hash'").select("source_id", "target_id")
    spread = links.join(files, "source_id").join(hashes, "target_id").select("hash_value", "algo", "host")
    return _widest(spread, ["hash_value", "algo"], min_hosts, limit)


def cross_host_entities(entities: DataFrame, tenant_id: str | None = None, min_hosts: int = 2, limit: int | None = None) -> DataFrame:
    """Values of one type that appear on several hosts."""
    rows = _tenant(entities, tenant_id).filter(F.col("host").isNotNull()).select("value", "entity_type", "host")
    return _widest(rows, ["value", "entity_type"], min_hosts, limit)


def _widest(rows: DataFrame, keys: list[str], min_hosts: int, limit: int | None) -> DataFrame:
    """Groups on several hosts. With ``limit`` the widest of them, and only their host lists are made."""
    pairs = rows.distinct()
    if limit is not None:
        counted = pairs.groupBy(*keys).agg(F.count("*").alias("host_count")).filter(F.col("host_count") >= min_hosts)
        pairs = pairs.join(F.broadcast(_first(counted, limit, F.desc("host_count"), *keys).select(*keys)), keys)
    # a list holds each host once: as many texts as there are hosts
    hosts = pairs.groupBy(*keys).agg(F.count("*").alias("host_count"), F.array_sort(F.collect_list("host")).alias("hosts"))
    return hosts.filter(F.col("host_count") >= min_hosts)


def top_connected_entities(
    entities: DataFrame, relationships: DataFrame, tenant_id: str | None = None, min_degree: int = 3, limit: int = 20,
) -> DataFrame:
    """Entities with the most edges, in either direction."""
    degree = graph.both_directions(relationships).groupBy(F.col("node").alias("entity_id")).agg(F.count("*").alias("degree"))
    rows = _tenant(entities, tenant_id).join(degree.filter(F.col("degree") >= min_degree), "entity_id")
    return rows.select("entity_id", "entity_type", "value", "host", "degree").orderBy(F.desc("degree"), "entity_id").limit(limit)


def recent_entities(entities: DataFrame, tenant_id: str | None = None, limit: int = 50) -> DataFrame:
    rows = _tenant(entities, tenant_id).filter(F.col("first_seen").isNotNull())
    return rows.orderBy(F.desc("first_seen"), "entity_id").limit(limit)


def high_severity_entities(
    entities: DataFrame, entity_events: DataFrame, events: DataFrame, tenant_id: str | None = None,
    min_severity: int = 70, limit: int | None = None,
) -> DataFrame:
    """Entities by the highest severity among their events."""
    severe = events.filter(F.col("severity") >= min_severity).select("event_id", "severity")
    worst = entity_events.join(severe, "event_id").groupBy("entity_id").agg(F.max("severity").alias("severity"))
    rows = _tenant(entities, tenant_id).join(worst, "entity_id")
    return _first(rows, limit, F.desc("severity"), "entity_id")


#: Preset name -> function.
PRESETS: dict[str, Callable[..., DataFrame]] = {
    "process_lineage": process_lineage,
    "entities_by_mitre": entities_by_technique,
    "case_graph": case_graph,
    "lateral_movement": lateral_movement,
    "persistence_artifacts": persistence_artifacts,
    "shared_hashes_across_hosts": shared_hashes_across_hosts,
    "top_connected_entities": top_connected_entities,
    "recent_entities": recent_entities,
    "high_severity_events": high_severity_entities,
}
