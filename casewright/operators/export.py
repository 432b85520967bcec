"""All results as one property graph: nodes and edges with one schema each.

Nodes: id, type, properties (JSON). Edges: source, source_type, target, target_type,
relationship, properties (JSON). Every part is a projection, so an export is one pass
per table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.hypotheses import pair_id

_ENTITY = [
    "entity_type", "value", "normalized_value", "identity_scope", "identity_domain", "hash_algorithm", "host",
    "fingerprint", "first_seen", "last_seen",
]
_EVENT = [
    "source", "platform", "category", "event_type", "timestamp", "host", "user", "severity", "mitre_techniques",
    "mitre_tactics", "tags",
]
_HYPOTHESIS = [
    "tenant_id", "hypothesis_type", "statement", "status", "confidence", "source", "support_count", "contradict_count",
    "mitre_techniques", "missing_evidence", "fingerprint",
]
_CASE = ["tenant_id", "title", "status", "priority", "category", "severity", "risk_score", "confidence", "analyst"]


def _nodes(rows: DataFrame, key: Column, kind: str, fields: list) -> DataFrame:
    return rows.select(key.alias("id"), F.lit(kind).alias("type"), F.to_json(F.struct(*fields)).alias("properties"))


def nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """Nodes of events, evidence, entities, correlations, hypotheses, cases and ledgers."""
    parts = []
    for name, key, kind, fields in (
        ("events", F.col("event_id"), "Event", _EVENT),
        ("evidence", F.col("evidence_id"), "Evidence", ["evidence_type", "strength", "title", "confidence", "tags"]),
        ("entities", F.col("entity_id"), "Entity", _ENTITY),
        ("correlations", pair_id(), "Correlation", ["score", "confidence", "reason_count"]),
        ("hypotheses", F.col("hypothesis_id"), "Hypothesis", _HYPOTHESIS),
        ("cases", F.col("case_id"), "InvestigationCase", _CASE),
    ):
        if name in tables:
            parts.append(_nodes(tables[name], key, kind, fields))
    if "ledger" in tables:
        sized = tables["ledger"].groupBy("ledger_id").agg(
            F.count("*").alias("size"), F.max_by("entry_hash", "sequence").alias("head_hash")
        )
        parts.append(_nodes(sized, F.col("ledger_id"), "EvidenceLedger", ["size", "head_hash"]))
    # an entity of several cases is one node
    return reduce(DataFrame.unionByName, parts).groupBy("id", "type").agg(F.min("properties").alias("properties"))


def _edges(
    rows: DataFrame, source: Column, source_type: str, target: Column, target_type: str, relationship: Column | str,
    fields: list | None = None,
) -> DataFrame:
    relationship = F.lit(relationship) if isinstance(relationship, str) else relationship
    return rows.select(
        source.alias("source"), F.lit(source_type).alias("source_type"), target.alias("target"),
        F.lit(target_type).alias("target_type"), relationship.alias("relationship"),
        (F.to_json(F.struct(*fields)) if fields else F.lit("{}")).alias("properties"),
    )


def edges(tables: dict[str, DataFrame]) -> DataFrame:
    """Edges between the nodes of ``nodes``."""
    c, t, parts = F.col, tables, []
    if "relationships" in t:
        parts.append(
            _edges(
                t["relationships"], c("source_id"), "Entity", c("target_id"), "Entity", F.upper("relationship_type"),
                ["weight", "confidence", "fingerprint", "first_seen", "last_seen"],
            )
        )
    if "entity_events" in t:
        parts.append(_edges(t["entity_events"], c("entity_id"), "Entity", c("event_id"), "Event", "OBSERVED_IN"))
    if "evidence" in t:
        parts.append(_edges(t["evidence"], c("evidence_id"), "Evidence", c("event_id"), "Event", "REFERENCES"))
    if "hypothesis_support" in t:
        parts.append(
            _edges(t["hypothesis_support"], c("evidence_id"), "Evidence", c("hypothesis_id"), "Hypothesis", "SUPPORTS")
        )
    if "correlations" in t:
        for column, name in (("source_event_id", "CORRELATES_SOURCE"), ("related_event_id", "CORRELATES_RELATED")):
            parts.append(_edges(t["correlations"], pair_id(), "Correlation", c(column), "Event", name))
    if "case_links" in t:
        parts.append(
            t["case_links"].select(
                c("case_id").alias("source"), F.lit("InvestigationCase").alias("source_type"), "target", "target_type",
                "relationship", F.lit("{}").alias("properties"),
            )
        )
    if "ledger" in t:
        recorded = ["sequence", "entry_hash", "operation"]
        parts.append(_edges(t["ledger"], c("ledger_id"), "EvidenceLedger", c("evidence_id"), "Evidence", "RECORDS", recorded))
        chained = t["ledger"].filter("sequence > 0")
        parts.append(
            _edges(chained, c("entry_hash"), "LedgerEntry", c("previous_hash"), "LedgerEntry", "PREVIOUS", ["previous_hash"])
        )
    return reduce(DataFrame.unionByName, parts).distinct()
