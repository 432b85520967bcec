"""Report tables, recommended actions, quality checks and alerts.

A report is a set of tables keyed by case, not one document per case: a case may
hold a third of all events, and its timeline then is a table like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.ordered import top_k


def timeline(evidence: DataFrame) -> DataFrame:
    """Evidence in order of time within each case; rows without a time come first."""
    return evidence.select(
        "case_id", "evidence_id", "event_id", "observed_at", F.col("event_category").alias("category"), "event_type",
        "host", F.col("event_severity").alias("severity"), "strength", "title",
    ).orderBy("case_id", F.asc_nulls_first("observed_at"), "evidence_id")


def technique_actions(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(
        vocab.TECHNIQUE_ACTIONS if rows is None else rows, "technique string, actions array<string>"
    )


def recommended_actions(hypotheses: DataFrame, cases: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(case_id, position, action): technique actions, then missing evidence, else generic ones.

    Order: hypotheses by type and fingerprint, actions as listed; each action once.
    The number of actions of a case is bounded by the templates, not by its events.
    """
    spark = hypotheses.sparkSession
    # the built-in table is a few dozen rows; adaptive execution decides about a caller's
    table = F.broadcast(technique_actions(spark)) if table is None else table
    rank = F.array_position(F.array(*[F.lit(t) for t in vocab.HYPOTHESIS_TYPES]), F.col("hypothesis_type"))
    ranked = hypotheses.withColumn("type_rank", rank)
    active = ~F.col("status").isin("confirmed", "rejected")
    from_technique = (
        ranked.filter((F.col("hypothesis_type") == "main") & active)
        .select("case_id", "type_rank", "fingerprint", F.posexplode("mitre_techniques").alias("t", "technique"))
        .join(table, "technique")
        .select("case_id", F.lit(0).alias("part"), "type_rank", "fingerprint", "t", F.posexplode("actions").alias("i", "action"))
    )
    from_missing = ranked.select(
        "case_id", F.lit(1).alias("part"), "type_rank", "fingerprint", F.lit(0).alias("t"),
        F.posexplode("missing_evidence").alias("i", "item"),
    ).withColumn("action", F.concat(F.lit(vocab.MISSING_ACTION_PREFIX), F.col("item"))).drop("item")
    specific = from_technique.unionByName(from_missing).groupBy("case_id", "action").agg(
        F.min(F.struct("part", "type_rank", "fingerprint", "t", "i")).alias("place")
    )
    without = cases.select("case_id").join(specific.select("case_id").distinct(), "case_id", "left_anti")
    generic = without.select(
        "case_id", F.posexplode(F.array(*[F.lit(a) for a in vocab.GENERIC_ACTIONS])).alias("i", "action")
    ).select(
        "case_id", "action",
        F.struct(
            F.lit(2).alias("part"), F.lit(0).cast("long").alias("type_rank"), F.lit("").alias("fingerprint"),
            F.lit(0).alias("t"), "i",
        ).alias("place"),
    )
    every = specific.unionByName(generic)
    # a few dozen distinct actions per case at most, so they fit in one array
    placed = every.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("place", "action"))).alias("a"))
    return placed.select("case_id", F.posexplode(F.transform("a", lambda x: x["action"])).alias("position", "action"))


# -- quality checks ---------------------------------------------------------------------------


def repeated_observations(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("case_id", "title").agg(F.count("*").alias("times")).filter("times > 1")


def case_findings(
    evidence: DataFrame, hypotheses: DataFrame, totals: DataFrame, assessed: DataFrame,
) -> DataFrame:
    """(case_id, finding, items): gaps of an investigation, or ``none``. ``totals``: case_id, weak_pairs."""
    e = evidence.groupBy("case_id").agg(F.count_if(~F.col("has_context")).alias("no_context"))
    r = repeated_observations(evidence).groupBy("case_id").agg(F.count("*").alias("repeated"))
    main, counter = F.col("hypothesis_type") == "main", F.col("hypothesis_type") == "counter"
    h = hypotheses.groupBy("case_id").agg(
        F.count_if(main).alias("mains"), F.count_if(counter).alias("counters"),
        F.count_if(main & (F.col("support_count") == 0)).alias("unsupported"),
    )
    c = totals.select("case_id", F.col("weak_pairs").alias("weak"))
    joined = assessed.select("case_id", "risk_score")
    for rows in (e, r, h, c):
        joined = joined.join(rows, "case_id", "left")
    joined = joined.na.fill(0)
    n = F.col
    checks = [
        ("repeated_observations", n("repeated") > 0, n("repeated")),
        ("evidence_without_context", n("no_context") > 0, n("no_context")),
        ("main_without_counter", (n("mains") > 0) & (n("counters") == 0), n("mains")),
        ("main_without_support", n("unsupported") > 0, n("unsupported")),
        ("weak_correlations", n("weak") > 0, n("weak")),
        ("high_risk_without_main", (n("risk_score") >= 70) & (n("mains") == 0), F.lit(1).cast("long")),
    ]
    found = F.array_compact(
        F.array(*[
            F.when(ok, F.struct(F.lit(name).alias("finding"), items.cast("long").alias("items")))
            for name, ok, items in checks
        ])
    )
    none = F.array(F.struct(F.lit("none").alias("finding"), F.lit(0).cast("long").alias("items")))
    return joined.select("case_id", F.inline(F.when(F.size(found) > 0, found).otherwise(none)))


def hypothesis_findings(hypotheses: DataFrame) -> DataFrame:
    """Support band, contradictions and readiness of each MAIN hypothesis, one row per finding."""
    s, status = F.col("support_count"), F.col("status")
    support = (
        F.when(s >= 3, "strong_support").when(s >= 2, "supported").when(s == 1, "single_support").otherwise("no_support")
    )
    found = F.array_compact(
        F.array(
            support,
            F.when(F.col("contradict_count") > 0, "contradicted"),
            F.when((status == "proposed") & (s >= 2), "ready_for_supported")
            .when((status == "supported") & (F.col("confidence") >= 0.7), "ready_for_confirmed"),
            F.when(F.size("missing_evidence") > 0, "missing_evidence"),
        )
    )
    return hypotheses.filter("hypothesis_type = 'main'").select(
        "case_id", "hypothesis_id", "statement", F.explode(found).alias("finding")
    )


def counter_findings(hypotheses: DataFrame, most_needed: int | None = None) -> DataFrame:
    """COUNTER hypotheses with or without support and what would prove them, or the first ``most_needed`` of it."""
    needed = F.col("missing_evidence") if most_needed is None else F.slice("missing_evidence", 1, most_needed)
    return hypotheses.filter("hypothesis_type = 'counter'").select(
        "case_id", "hypothesis_id", "statement",
        F.when(F.col("support_count") > 0, "has_support").otherwise("no_support").alias("finding"),
        needed.alias("needed"),
    )


# -- alerts -----------------------------------------------------------------------------------


def default_alert_rules() -> list[tuple[str, Column, str]]:
    return [(name, F.col("risk_score") >= least, level) for name, least, level in vocab.ALERT_RULES]


def with_alert_level(cases: DataFrame, rules: list[tuple[str, Column, str]] | None = None) -> DataFrame:
    """Level of the first rule that holds; null when none does."""
    rules = default_alert_rules() if rules is None else rules
    level, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, predicate, value in reversed(rules):
        level = F.when(predicate, value).otherwise(level)
        name = F.when(predicate, rule).otherwise(name)
    return cases.withColumns({"alert_level": level, "alert_rule": name})


def alerts(
    cases: DataFrame, hypotheses: DataFrame, rules: list[tuple[str, Column, str]] | None = None, shown: int = 3,
) -> DataFrame:
    """Payload of every case that reaches an alert level, with its first ``shown`` hypotheses."""
    rank = F.array_position(F.array(*[F.lit(t) for t in vocab.HYPOTHESIS_TYPES]), F.col("hypothesis_type"))
    first = top_k(hypotheses.withColumn("type_rank", rank), ["case_id"], ["type_rank", "fingerprint"], shown)
    # ``shown`` rows per case
    named = first.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "statement"))), lambda x: x["statement"]).alias("top_hypotheses")
    )
    levelled = with_alert_level(cases, rules).filter(F.col("alert_level").isNotNull())
    return levelled.join(named, "case_id", "left").select(
        "case_id", "title", "status", "priority", "risk_score", "confidence", "evidence_count", "hypothesis_count",
        "alert_level", "alert_rule", F.coalesce("top_hypotheses", F.array().cast("array<string>")).alias("top_hypotheses"),
    )


def verdict(score: Column) -> Column:
    return F.when(score >= vocab.BAND_HIGH, "high priority").when(
        score >= vocab.BAND_MEDIUM, "medium priority"
    ).otherwise("low priority")


# -- structured report --------------------------------------------------------------------------


def sections(
    cases: DataFrame, top_factors: DataFrame, hypotheses: DataFrame, evidence_summary: DataFrame,
    actions: DataFrame, entity_types: DataFrame, relationship_types: DataFrame,
) -> DataFrame:
    """(case_id, section, position, body): the structured report as JSON rows.

    Every section here is bounded by vocabularies and templates; timeline and risk
    factors stay tables of their own.
    """
    def rows(frame: DataFrame, section: str, position: Column, columns: list[str]) -> DataFrame:
        return frame.select(
            "case_id", F.lit(section).alias("section"), position.cast("string").alias("position"),
            F.to_json(F.struct(*columns)).alias("body"),
        )

    rank = F.array_position(F.array(*[F.lit(t) for t in vocab.HYPOTHESIS_TYPES]), F.col("hypothesis_type"))
    parts = [
        rows(cases, "case", F.lit(0), ["case_id", "title", "status", "priority", "category", "severity", "analyst", "tenant_id"]),
        rows(
            cases, "risk", F.lit(0),
            ["risk_score", "confidence", "evidence_score", "correlation_score", "hypothesis_score", "penalty_score"],
        ),
        rows(cases, "graph", F.lit(0), ["entity_count", "relationship_count", "event_count"]),
        rows(entity_types, "entity_types", F.col("entity_type"), ["entity_type", "n"]),
        rows(relationship_types, "relationship_types", F.col("relationship_type"), ["relationship_type", "n"]),
        rows(top_factors, "top_contributors", F.col("rank"), ["name", "category", "contribution", "rationale"]),
        rows(
            hypotheses, "hypotheses", F.concat_ws("-", rank.cast("string"), F.col("fingerprint")),
            ["hypothesis_id", "hypothesis_type", "statement", "status", "confidence", "support_count", "contradict_count", "missing_evidence", "rationale"],
        ),
        rows(evidence_summary, "evidence_summary", F.concat_ws("-", "dimension", "value"), ["dimension", "value", "items"]),
        rows(actions, "recommended_actions", F.lpad(F.col("position").cast("string"), 4, "0"), ["action"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
