"""Cases: assembly, links, listing, status log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.text import band
from casewright.operators.hypotheses import status_violations


def assemble(
    events: DataFrame, title: Column | None = None, category: str = "unknown",
    priority: str | None = None, analyst: str | None = None,
) -> DataFrame:
    """One row per case: severity, priority, counts, status after triage."""
    if category not in vocab.CASE_CATEGORIES:
        raise ValueError(f"unknown case category {category!r}")
    derived = band(F.col("severity"), "critical", "high", "medium", "low")
    rows = events.groupBy("case_id").agg(
        F.first("tenant_id").alias("tenant_id"), F.max("severity").alias("severity"),
        F.count("*").alias("event_count"),
        F.min("timestamp").alias("first_event_at"), F.max("timestamp").alias("last_event_at"),
    )
    return rows.withColumns(
        {
            "title": F.concat(F.lit("Investigation "), F.col("case_id")) if title is None else title,
            "category": F.lit(category),
            "priority": derived if priority is None else F.lit(priority),
            "status": F.lit("triaged"),
            "analyst": F.lit(analyst).cast("string"),
        }
    )


def links(
    events: DataFrame, evidence: DataFrame, hypotheses: DataFrame, entities: DataFrame, cases: DataFrame,
) -> DataFrame:
    """Edges from a case to everything in it: (case_id, target, target_type, relationship)."""
    def edge(rows: DataFrame, target: str, kind: str, rel: str) -> DataFrame:
        return rows.select(
            "case_id", F.col(target).alias("target"), F.lit(kind).alias("target_type"), F.lit(rel).alias("relationship")
        )

    alerts = events.filter(F.coalesce(F.col("rule_id"), F.lit("")) != "").select("case_id", "rule_id").distinct()
    return (
        edge(alerts, "rule_id", "Alert", "TRIGGERED_BY")
        .unionByName(edge(events, "event_id", "Event", "OBSERVED"))
        .unionByName(edge(evidence, "evidence_id", "Evidence", "CONTAINS"))
        .unionByName(edge(hypotheses, "hypothesis_id", "Hypothesis", "EXPLORES"))
        .unionByName(edge(entities, "entity_id", "Entity", "INVOLVES"))
        .unionByName(edge(cases.filter(F.col("analyst").isNotNull()), "analyst", "Analyst", "OWNED_BY"))
    )


def summary(cases: DataFrame, assessed: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Case rows with risk and the number of entities and relationships."""
    count = lambda rows, name: rows.groupBy("case_id").agg(F.count("*").alias(name))
    out = cases.join(assessed, "case_id", "left")
    for rows, name in ((entities, "entity_count"), (relationships, "relationship_count")):
        out = out.join(count(rows, name), "case_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def listing(
    cases: DataFrame, tenant_id: str | None = None, status: str | None = None, priority: str | None = None,
    analyst: str | None = None, min_risk: int | None = None, since: datetime | None = None,
) -> DataFrame:
    """Cases that meet every given filter; plain predicates, so stored tables prune on them."""
    rows = cases
    for name, value in (("tenant_id", tenant_id), ("status", status), ("priority", priority), ("analyst", analyst)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if min_risk is not None:
        rows = rows.filter(F.col("risk_score") >= min_risk)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(since))
    return rows


def page(cases: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page, newest first; equal times are ordered by case id."""
    return cases.orderBy(F.desc("created_at"), F.asc("case_id")).offset(offset).limit(limit)


def list_columns(cases: DataFrame) -> DataFrame:
    return cases.select(
        "case_id", "tenant_id", "title", "category", "severity", "priority", "status", "analyst",
        "risk_score", "confidence", "evidence_count", "hypothesis_count",
    )


def tenant_scope(rows: DataFrame, tenant_id: str) -> DataFrame:
    """The rows a caller of this tenant may see."""
    if not tenant_id:
        raise ValueError("a tenant is required")
    return rows.filter(F.col("tenant_id") == tenant_id)


def flags(cases: DataFrame) -> DataFrame:
    closed = F.col("status") == "resolved"
    end = F.coalesce("closed_at", F.col("updated_at")) if "closed_at" in cases.columns else F.col("last_event_at")
    start = F.col("created_at") if "created_at" in cases.columns else F.col("first_event_at")
    return cases.withColumns(
        {
            "is_closed": closed, "is_open": ~closed,
            "is_high_risk": F.col("risk_score") >= 70,
            "is_high_confidence": F.col("confidence") >= 0.75,
            "is_critical": F.col("priority") == "critical",
            "age_seconds": (F.unix_micros(end) - F.unix_micros(start)) / 1e6,
        }
    )


def transitions(log: DataFrame) -> DataFrame:
    """Steps of the case status log that are not allowed."""
    return status_violations(log, "case_id", vocab.CASE_TRANSITIONS)


def incomplete_resolutions(log: DataFrame) -> DataFrame:
    """Resolved steps without an outcome or a close time."""
    return log.filter(
        (F.col("status") == "resolved")
        & (
            ~F.coalesce(F.col("outcome").isin(vocab.RESOLUTION_OUTCOMES), F.lit(False))
            | F.col("closed_at").isNull()
        )
    )


def current_state(log: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Last non-null value of each column per case."""
    key = F.struct(*order)
    return log.groupBy("case_id").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns]
    )


def count(cases: DataFrame, tenant_id: str | None = None, status: str | None = None) -> DataFrame:
    return listing(cases, tenant_id=tenant_id, status=status).agg(F.count("*").alias("cases"))
