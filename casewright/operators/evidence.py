"""Evidence from events: one row per event, with a content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.identity import json_sql
from casewright.functions.ordered import top_k
from casewright.functions.text import utc_text_sql

CONTEXT_COLUMNS = ["process", "network", "file", "registry", "dns"]


def _case_sql(column: str, table: dict, default: str) -> str:
    """Lookup in a small fixed table as SQL text."""
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


STRENGTH_SQL = (
    f"CASE WHEN severity >= {vocab.BAND_CRITICAL} THEN 'critical' WHEN severity >= {vocab.BAND_HIGH} THEN 'strong' "
    f"WHEN severity >= {vocab.BAND_MEDIUM} THEN 'moderate' ELSE 'weak' END"
)
CONFIDENCE_SQL = "CAST(" + _case_sql(
    "source_reliability", vocab.RELIABILITY_CONFIDENCE, str(vocab.RELIABILITY_UNKNOWN_CONFIDENCE)
) + " AS DOUBLE)"
TYPE_SQL = _case_sql("category", {k: f"'{v}'" for k, v in vocab.CATEGORY_EVIDENCE_TYPE.items()}, "'event'")


def _known(column: str, default: str = "?") -> str:
    return f"coalesce(nullif({column}, ''), '{default}')"


#: Human-readable title; the template depends on the category.
TITLE_SQL = f"""concat({_known('event_type', 'event')}, CASE
  WHEN category = 'process' AND process IS NOT NULL THEN concat(': ', {_known('process.name', 'unknown')},
    CASE WHEN process.pid IS NOT NULL THEN concat(' (PID ', process.pid, ')') ELSE '' END)
  WHEN category IN ('network', 'http') AND network IS NOT NULL THEN concat(': ', {_known('network.source_ip')}, ' → ',
    {_known('network.destination_ip')},
    CASE WHEN coalesce(network.destination_port, 0) <> 0 THEN concat(':', network.destination_port) ELSE '' END)
  WHEN category = 'dns' AND dns IS NOT NULL THEN concat(': DNS ', {_known('dns.query')})
  WHEN category = 'file' AND file IS NOT NULL THEN
    concat(': ', coalesce(nullif(file.path, ''), nullif(file.name, ''), '?'))
  WHEN category = 'registry' AND registry IS NOT NULL THEN concat(': ', {_known('registry.key')})
  WHEN category = 'authentication' THEN concat(': ', {_known('`user`')}, ' @ ', {_known('host')})
  ELSE '' END)"""

#: Event content as JSON; nulls and empty lists are left out.
DATA_SQL = """to_json(named_struct(
  'event_id', event_id, 'event_type', event_type, 'category', category, 'severity', severity, 'source', source,
  'platform', platform, 'host', host, 'user', `user`, 'domain', domain, 'process', process, 'network', network,
  'file', file, 'registry', registry, 'dns', dns, 'rule_id', nullif(rule_id, ''), 'rule_name', nullif(rule_name, ''),
  'rule_level', rule_level, 'mitre_techniques', CASE WHEN size(mitre_techniques) > 0 THEN mitre_techniques END,
  'mitre_tactics', CASE WHEN size(mitre_tactics) > 0 THEN mitre_tactics END,
  'event_tags', CASE WHEN size(tags) > 0 THEN tags END))"""

PROVENANCE_SQL = """named_struct('source', source, 'source_reliability', source_reliability,
  'collector', 'event_to_evidence', 'collector_version', '1.0', 'parent_event_id', event_id,
  'transformation', 'Event to Evidence', 'collected_at', timestamp)"""

_ANY_CONTEXT_SQL = "(" + " OR ".join(f"{c} IS NOT NULL" for c in CONTEXT_COLUMNS) + ")"


def has_content() -> Column:
    """Does the event carry anything beyond its envelope?"""
    return F.expr(
        "coalesce(severity, 0) > 0 OR coalesce(rule_id, '') <> '' OR coalesce(size(mitre_techniques), 0) > 0 "
        f"OR {_ANY_CONTEXT_SQL}"
    )


def from_events(events: DataFrame, keep_empty: bool = True) -> DataFrame:
    """One evidence row per event.

    The id is derived from the event id, so a second run gives the same rows.
    """
    source = events if keep_empty else events.filter(has_content())
    keep = [c for c in ("case_id",) if c in events.columns]
    rows = source.selectExpr(
        *keep, "tenant_id", "concat('E-', event_id) AS evidence_id", "event_id", "CAST(NULL AS STRING) AS alert_id",
        f"{TYPE_SQL} AS evidence_type", f"{STRENGTH_SQL} AS strength", f"{TITLE_SQL} AS title",
        f"concat(event_type, ' detected on ', {_known('host', 'unknown host')}, ' (severity ', severity, ').') AS description",
        "timestamp AS observed_at", f"{CONFIDENCE_SQL} AS confidence", f"{DATA_SQL} AS data",
        f"{PROVENANCE_SQL} AS provenance", "mitre_techniques", "category AS event_category", "event_type", "host",
        "severity AS event_severity", f"{_ANY_CONTEXT_SQL} AS has_context", "coalesce(tags, array()) AS tags",
    )
    return rows.withColumn("content_hash", evidence_hash())


def evidence_hash() -> Column:
    """SHA-256 over the content; ids of routing, verification and tags take no part."""
    provenance = json_sql(**{
        n: f"provenance.{n}" for n in (
            "source", "source_reliability", "collector", "collector_version", "parent_event_id", "transformation",
        )
    })
    same = ("evidence_type", "strength", "title", "description", "confidence", "data", "event_id", "alert_id")
    json = json_sql(
        schema_version=f"'{vocab.SCHEMA_VERSION}'", provenance=provenance,
        observed_at=f"concat({utc_text_sql('observed_at')}, 'Z')", **{n: n for n in same},
    )
    return F.expr(f"sha2({json}, 256)")


def verify_hash(evidence: DataFrame) -> DataFrame:
    """Add ``hash_ok``: does the stored hash match the content?"""
    return evidence.withColumn("hash_ok", F.col("content_hash") == evidence_hash())


def from_event(
    events: DataFrame, evidence_type: str, evidence_strength: str, evidence_title: str,
    confidence: float = 0.5, description: str | None = None,
) -> DataFrame:
    """Evidence whose type, strength and title the caller decides."""
    if evidence_type not in vocab.EVIDENCE_TYPES:
        raise ValueError(f"unknown evidence type {evidence_type!r}")
    if evidence_strength not in vocab.EVIDENCE_STRENGTHS:
        raise ValueError(f"unknown strength {evidence_strength!r}")
    rows = from_events(events).withColumns(
        {
            "evidence_type": F.lit(evidence_type),
            "strength": F.lit(evidence_strength),
            "title": F.lit(evidence_title),
            "confidence": F.lit(confidence),
            "description": F.lit(description).cast("string"),
        }
    )
    return rows.withColumn("content_hash", evidence_hash())


def flags(evidence: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Boolean views of strength, confidence, origin and verification.

    With ``links`` (evidence_id, hypothesis_id, assessment) also how many hypotheses it supports and contradicts.
    """
    out = evidence.withColumns(
        {
            "is_strong": F.col("strength").isin("strong", "critical"),
            "is_critical": F.col("strength") == "critical",
            "is_high_confidence": F.col("confidence") >= 0.75,
            "is_derived": F.col("evidence_type") == "derived",
            "is_verified": F.coalesce(F.col("verified"), F.lit(False)) if "verified" in evidence.columns else F.lit(False),
        }
    )
    if links is None:
        return out
    sides = {"supports_hypotheses": "supports", "contradicts_hypotheses": "contradicts"}
    counted = links.select("evidence_id", "hypothesis_id", "assessment").distinct().groupBy("evidence_id").agg(
        *[F.count_if(F.col("assessment") == side).alias(name) for name, side in sides.items()]
    )
    return out.join(counted, "evidence_id", "left").na.fill(0, list(sides))


def latest_verification(verifications: DataFrame) -> DataFrame:
    """The last complete entry per evidence; an entry needs an analyst and a time."""
    complete = verifications.filter(
        ~F.col("verified") | (F.col("verified_by").isNotNull() & F.col("verified_at").isNotNull())
    )
    return complete.groupBy("evidence_id").agg(
        F.max_by(
            F.struct("verified", "verified_by", "verified_at", "method", "notes"),
            F.struct("verified_at", "verified_by"),
        ).alias("verification")
    )


def with_verification(evidence: DataFrame, verifications: DataFrame) -> DataFrame:
    """Add ``verification`` and ``verified`` from the verification log."""
    latest = latest_verification(verifications)
    joined = evidence.join(latest, "evidence_id", "left")
    return joined.withColumn("verified", F.coalesce("verification.verified", F.lit(False)))


def reference_edges(
    evidence: DataFrame, links: DataFrame | None = None, parents: DataFrame | None = None, about: DataFrame | None = None,
) -> DataFrame:
    """Edges from evidence to its event and alert, the hypotheses it speaks for or against, its parents and entities.

    ``links``: evidence_id, hypothesis_id, assessment, weight, rationale; ``parents``: evidence_id, parent_id, what it was derived
    from; ``about``: evidence_id, entity_id. A blank target has no edge.
    """
    edge = lambda target, kind, rel: F.struct(
        target.alias("target"), F.lit(kind).alias("target_type"), F.lit(rel).alias("relationship")
    )
    references = evidence.select(
        F.col("evidence_id").alias("source"),
        F.lit("Evidence").alias("source_type"),
        F.explode(
            F.filter(
                F.array(
                    edge(F.col("event_id"), "Event", "REFERENCES"),
                    edge(F.col("alert_id"), "Alert", "REFERENCES"),
                ),
                lambda e: e["target"].isNotNull(),
            )
        ).alias("e"),
    ).select("source", "source_type", "e.*", F.lit(None).cast("double").alias("weight"))
    for rows, column, kind, relationship in ((parents, "parent_id", "Evidence", "DERIVED_FROM"), (about, "entity_id", "Entity", "ABOUT")):
        if rows is not None:
            more = rows.select(F.col("evidence_id").alias("source"), F.nullif(F.trim(column), F.lit("")).alias("target")).distinct()
            more = more.filter("target IS NOT NULL").select(
                "source", F.lit("Evidence").alias("source_type"), "target", F.lit(kind).alias("target_type"),
                F.lit(relationship).alias("relationship"), F.lit(None).cast("double").alias("weight"),
            )
            references = references.unionByName(more)
    if links is None:
        return references
    assessed = links.select(
        F.col("evidence_id").alias("source"), F.lit("Evidence").alias("source_type"),
        F.col("hypothesis_id").alias("target"), F.lit("Hypothesis").alias("target_type"),
        F.upper("assessment").alias("relationship"), F.col("weight").cast("double").alias("weight"),
    )
    return references.unionByName(assessed)


def summary(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Counts by strength and by type, with the total, in one pass."""
    keyed = evidence.select(*by, "strength", "evidence_type")
    counted = keyed.groupBy(*by, "strength", "evidence_type").agg(F.count("*").alias("n"))
    cells = counted.select(
        *by, "n",
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
                F.struct(F.lit("strength").alias("dimension"), F.col("strength").alias("value")),
                F.struct(F.lit("type").alias("dimension"), F.col("evidence_type").alias("value")),
            )
        ).alias("d"),
    )
    return cells.groupBy(*by, "d.dimension", "d.value").agg(F.sum("n").alias("items"))


def highlighted(evidence: DataFrame, per_case: int = 3) -> DataFrame:
    """First strong or critical items of a case; other items only if it has none."""
    ranked = evidence.withColumn(
        "tier", F.when(F.col("strength").isin("strong", "critical"), 0).otherwise(1)
    )
    first = top_k(
        ranked.select("case_id", "evidence_id", "strength", "title", "observed_at", "tier"),
        ["case_id"], ["tier", "observed_at", "evidence_id"], per_case,
    )
    # at most per_case rows per case are left here
    best = first.groupBy("case_id").agg(F.min("tier").alias("best_tier"))
    return first.join(best, "case_id").filter("tier = best_tier").drop("tier", "best_tier")
