"""Explained risk score of a case: evidence, correlation, hypothesis, penalties."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.ordered import top_k, with_previous
from casewright.functions.text import lookup
from casewright.operators.hypotheses import pair_id

#: Sums of fractions are made in decimal, so their value does not depend on row order.
_EXACT = "decimal(30,12)"


@dataclass(frozen=True)
class RiskConfig:
    evidence_max: float = 40.0
    verified_bonus: float = 3.0
    correlation_max: float = 20.0
    correlation_per_pair: float = 5.0
    hypothesis_max: float = 40.0
    missing_per_item: float = 2.0
    missing_max: float = 15.0
    contradicting_per_item: float = 3.0
    contradicting_max: float = 20.0
    evidence_weight: float = 0.4
    coverage_weight: float = 0.3
    hypothesis_weight: float = 0.3

    def __post_init__(self) -> None:
        total = self.evidence_weight + self.coverage_weight + self.hypothesis_weight
        if abs(total - 1.0) > 1e-6:
            raise ValueError(f"confidence weights must sum to 1, got {total:.4f}")
        if any(getattr(self, f) < 0 for f in self.__dataclass_fields__):
            raise ValueError("risk settings must not be negative")


def _unit(col: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(col)))


def _evidence_value(evidence: DataFrame, config: RiskConfig) -> Column:
    base = F.coalesce(lookup(F.col("strength"), vocab.STRENGTH_SCORES), F.lit(0.0))
    if "verified" not in evidence.columns:
        return base
    return base + F.when(F.col("verified"), config.verified_bonus).otherwise(0.0)


def factors(
    evidence: DataFrame, pairs: DataFrame | None, hypotheses: DataFrame, config: RiskConfig | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """One row per contribution: (case_id, name, category, contribution, rationale, source_id). Without ``pairs``, all others."""
    config = config or RiskConfig()
    from_evidence = evidence.select(
        "case_id", F.concat(F.lit("evidence:"), F.col("evidence_id")).alias("name"),
        F.lit("evidence").alias("category"), F.bround(_evidence_value(evidence, config), 3).alias("contribution"),
        F.concat("strength", F.lit(" "), "evidence_type", F.lit(": "), "title").alias("rationale"),
        F.col("evidence_id").alias("source_id"),
    )
    best = _best_hypothesis(hypotheses).filter(F.col("value") > 0).select(
        "case_id", F.concat(F.lit("hypothesis:"), F.col("h.hypothesis_id")).alias("name"),
        F.lit("hypothesis").alias("category"), F.bround("value", 3).alias("contribution"),
        F.concat(
            F.col("h.status"), F.lit(" hypothesis (confidence "), F.format_number("h.confidence", 2),
            F.lit("): "), F.col("h.statement"),
        ).alias("rationale"),
        F.col("h.hypothesis_id").alias("source_id"),
    )
    penalties = _penalties(hypotheses, evidence, links, config).select(
        "case_id",
        F.explode(
            F.filter(
                F.array(
                    F.struct(
                        F.lit("penalty:missing_evidence").alias("name"), (-F.col("missing_penalty")).alias("contribution"),
                        F.concat(F.col("missing").cast("string"), F.lit(" missing evidence item(s) across hypotheses")).alias("rationale"),
                    ),
                    F.struct(
                        F.lit("penalty:contradicting_evidence").alias("name"), (-F.col("contradicting_penalty")).alias("contribution"),
                        F.concat(F.col("contradicting").cast("string"), F.lit(" contradicting evidence item(s)")).alias("rationale"),
                    ),
                ),
                lambda p: p["contribution"] < 0,
            )
        ).alias("p"),
    ).select(
        "case_id", "p.name", F.lit("penalty").alias("category"), "p.contribution", "p.rationale",
        F.lit(None).cast("string").alias("source_id"),
    )
    rows = from_evidence.unionByName(best).unionByName(penalties)
    return rows if pairs is None else rows.unionByName(_pair_factors(pairs, config))


def _pair_factors(pairs: DataFrame, config: RiskConfig) -> DataFrame:
    conf = _unit("confidence")
    return pairs.select(
        "case_id", F.concat(F.lit("correlation:"), pair_id()).alias("name"), F.lit("correlation").alias("category"),
        F.bround(conf * config.correlation_per_pair, 3).alias("contribution"),
        F.concat(
            F.lit("correlation confidence "), F.format_number(conf, 2), F.lit(" (reasons: "),
            F.concat_ws(",", "reasons"), F.lit(")"),
        ).alias("rationale"),
        pair_id().alias("source_id"),
    )


def _best_hypothesis(hypotheses: DataFrame) -> DataFrame:
    value = F.coalesce(lookup(F.col("status"), vocab.STATUS_SCORES), F.lit(0.0)) * _unit("confidence")
    rows = hypotheses.withColumn("value", value)
    rank = F.array_position(F.array(*[F.lit(t) for t in vocab.HYPOTHESIS_TYPES]), F.col("hypothesis_type"))
    key = F.struct(-F.col("value"), rank, F.col("fingerprint"))
    return rows.groupBy("case_id").agg(
        F.max("value").alias("value"),
        F.min_by(F.struct("hypothesis_id", "status", "confidence", "statement"), key).alias("h"),
    )


def _penalties(hypotheses: DataFrame, evidence: DataFrame, links: DataFrame | None, config: RiskConfig) -> DataFrame:
    rows = hypotheses.groupBy("case_id").agg(F.sum(F.size("missing_evidence")).alias("missing"))
    if links is None:
        rows = rows.withColumn("contradicting", F.lit(0).cast("long"))
    else:
        against = links.filter("assessment = 'contradicts'").select("evidence_id").distinct()
        counted = evidence.select("case_id", "evidence_id").join(against, "evidence_id").groupBy("case_id").agg(
            F.count("*").alias("contradicting")
        )
        rows = rows.join(counted, "case_id", "full").select(
            "case_id", F.coalesce("missing", F.lit(0)).alias("missing"),
            F.coalesce("contradicting", F.lit(0)).alias("contradicting"),
        )
    capped = lambda n, each, most: F.least(F.col(n) * F.lit(each), F.lit(most))
    return rows.withColumns(
        {
            "missing_penalty": capped("missing", config.missing_per_item, config.missing_max),
            "contradicting_penalty": capped("contradicting", config.contradicting_per_item, config.contradicting_max),
        }
    )


def assess(
    evidence: DataFrame, totals: DataFrame, hypotheses: DataFrame, config: RiskConfig | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """Score, confidence and breakdown per case; one shuffle per input, all with partial sums.

    ``totals`` (case_id, pairs, confidence_sum) are those of ``pair_counts`` with ``config.correlation_per_pair``.
    ``links`` (evidence_id, hypothesis_id, assessment) bring in contradicting evidence.
    """
    config = config or RiskConfig()
    by_evidence = evidence.groupBy("case_id").agg(
        F.sum(_evidence_value(evidence, config)).alias("evidence_raw"),
        F.sum(_unit("confidence").cast(_EXACT)).alias("confidence_sum"),
        F.count("*").alias("evidence_count"),
    )
    by_pairs = totals.select("case_id", F.col("confidence_sum").alias("correlation_raw"), F.col("pairs").alias("correlation_count"))
    by_hypothesis = hypotheses.groupBy("case_id").agg(
        F.max(_unit("confidence")).alias("top_confidence"),
        F.avg(F.when(F.col("support_count") > 0, 1.0).otherwise(0.0)).alias("coverage"),
        F.count("*").alias("hypothesis_count"),
    )
    best = _best_hypothesis(hypotheses).select("case_id", F.col("value").alias("hypothesis_raw"))
    penalties = _penalties(hypotheses, evidence, links, config)
    joined = (
        by_evidence.join(by_pairs, "case_id", "full").join(by_hypothesis, "case_id", "full")
        .join(best, "case_id", "left").join(penalties, "case_id", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = joined.select(
        "case_id",
        F.least(zero("evidence_raw"), F.lit(config.evidence_max)).alias("evidence"),
        F.least(zero("correlation_raw"), F.lit(config.correlation_max)).alias("correlation"),
        F.least(zero("hypothesis_raw"), F.lit(config.hypothesis_max)).alias("hypothesis"),
        (-(zero("missing_penalty") + zero("contradicting_penalty"))).alias("penalty"),
        F.coalesce(F.col("confidence_sum").cast("double") / F.col("evidence_count"), F.lit(0.0)).alias("e"),
        zero("coverage").alias("c"), zero("top_confidence").alias("h"),
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.coalesce("correlation_count", F.lit(0)).alias("correlation_count"),
        F.coalesce("hypothesis_count", F.lit(0)).alias("hypothesis_count"),
    )
    total = F.col("evidence") + F.col("correlation") + F.col("hypothesis") + F.col("penalty")
    confidence = (
        F.lit(config.evidence_weight) * F.col("e") + F.lit(config.coverage_weight) * F.col("c")
        + F.lit(config.hypothesis_weight) * F.col("h")
    )
    return scored.select(
        "case_id",
        F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total, 0).cast("int"))).alias("risk_score"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        *[F.bround(c, 2).alias(f"{c}_score") for c in ("evidence", "correlation", "hypothesis", "penalty")],
        "evidence_count", "correlation_count", "hypothesis_count",
    )


def flags(assessed: DataFrame) -> DataFrame:
    return assessed.withColumns(
        {"is_high_risk": F.col("risk_score") >= 70, "is_critical_risk": F.col("risk_score") >= 85}
    )


def top_factors(rows: DataFrame, per_case: int = 5) -> DataFrame:
    """The largest positive contributions of each case."""
    positive = rows.filter(F.col("contribution") > 0)
    return top_k(positive, ["case_id"], [F.desc("contribution"), F.asc("category"), F.asc("name")], per_case)


def top_factors_of(
    evidence: DataFrame, pairs: Callable[[DataFrame], DataFrame], hypotheses: DataFrame, config: RiskConfig | None = None,
    links: DataFrame | None = None, per_case: int = 5,
) -> DataFrame:
    """``top_factors`` of all factors; ``pairs`` gives the pairs of all cases but those of a table of ``case_id``.

    A pair contributes ``correlation_per_pair`` at most, so a case with enough larger factors needs none of its pairs.
    """
    config = config or RiskConfig()
    others = top_factors(factors(evidence, None, hypotheses, config, links), per_case).drop("rank")
    large = others.groupBy("case_id").agg(F.count("*").alias("n"), F.min("contribution").alias("least"))
    settled = large.filter((F.col("n") >= per_case) & (F.col("least") > F.bround(F.lit(config.correlation_per_pair), 3))).select("case_id")
    return top_factors(others.unionByName(_pair_factors(pairs(settled), config)), per_case)


def by_weight(rows: DataFrame) -> DataFrame:
    """Factors of each case, the largest absolute contribution first."""
    return rows.orderBy("case_id", F.desc(F.abs("contribution")), "name")


def with_summary(assessed: DataFrame, top: DataFrame) -> DataFrame:
    """Add the one-line summary with the first three contributors.

    ``top`` holds at most a few ranked rows per case (``top_factors``).
    """
    names = top.filter("rank <= 3").groupBy("case_id").agg(
        F.concat_ws(
            ", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"])
        ).alias("names")
    )
    part = lambda label, c: F.concat(F.lit(f"{label}="), F.format_string("%+.1f", F.col(c)))
    text = F.concat(
        F.lit("Risk "), F.col("risk_score").cast("string"), F.lit("/100 (confidence "),
        F.format_string("%.2f", F.col("confidence")), F.lit("). Breakdown: "),
        part("evidence", "evidence_score"), F.lit(", "), part("correlation", "correlation_score"), F.lit(", "),
        part("hypothesis", "hypothesis_score"), F.lit(", "), part("penalty", "penalty_score"),
        F.lit(". Top contributors: "), F.coalesce("names", F.lit("none")), F.lit("."),
    )
    return assessed.join(names, "case_id", "left").withColumn("summary", text).drop("names")


def evolution(updates: DataFrame, key: str = "case_id") -> DataFrame:
    """Risk history: each update with the score before it and the change.

    ``updates``: key, ts, update_id, risk_score, confidence. The first one starts from 0.
    """
    rows = with_previous(updates, [key], ["ts", "update_id"], ["risk_score", "confidence"])
    return rows.select(
        *updates.columns,
        F.coalesce("prev_risk_score", F.lit(0)).alias("previous_risk_score"),
        F.coalesce("prev_confidence", F.lit(0.0)).alias("previous_confidence"),
        (F.col("risk_score") - F.coalesce("prev_risk_score", F.lit(0))).alias("delta"),
    )
