"""The whole investigation of many cases at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from casewright.operators import cases as case_ops
from casewright.operators import correlate, evidence, graph, hypotheses, pair_counts, risk
from casewright.session import cut_lineage


@dataclass(frozen=True)
class Stages:
    """Replaceable steps; each takes and returns DataFrames."""

    to_evidence: Callable[[DataFrame], DataFrame] = evidence.from_events
    build_graph: Callable[..., dict[str, DataFrame]] = graph.build
    correlate_all: Callable[..., DataFrame] = correlate.correlate_all
    rules: correlate.Rules = field(default_factory=correlate.Rules)
    risk_config: risk.RiskConfig = field(default_factory=risk.RiskConfig)
    max_pairs: int | None = None
    min_evidence: int = 1


def investigate(
    events: DataFrame, stages: Stages | None = None, templates: DataFrame | None = None,
    links: DataFrame | None = None, verifications: DataFrame | None = None, analyst: str | None = None,
) -> dict[str, DataFrame]:
    """Evidence, graph, pairs, hypotheses, risk and cases of events with a ``case_id``.

    Returns the tables by name. What several tables are built from is written to the
    checkpoint folder once, so later steps neither recompute it nor depend on an
    executor that made it.
    """
    stages = stages or Stages()
    tables: dict[str, DataFrame] = {"events": events}
    found = stages.to_evidence(events)
    if verifications is not None:
        found = evidence.with_verification(found, verifications)
    tables["evidence"] = found
    tables.update(stages.build_graph(events, ["case_id"]))

    # score, checks and hypotheses need counts and the best pair; where pairs may outnumber events they are not made for it
    scope = ["case_id", "tenant_id"]
    counted = stages.correlate_all is correlate.correlate_all and stages.max_pairs is None
    found_pairs = pair_counts.Pairs(events, scope, stages.rules) if counted else None
    if found_pairs is not None and not found_pairs.few:
        pairs, best, pairs_without = found_pairs.all(), found_pairs.best(), found_pairs.all
        totals = pair_counts.by_case(found_pairs, stages.risk_config.correlation_per_pair)
    else:
        pairs = found_pairs.all() if found_pairs else stages.correlate_all(events, scope, stages.rules, stages.max_pairs)
        pairs = best = cut_lineage(pairs)
        pairs_without = lambda cases: pairs.join(cases, "case_id", "left_anti").select(*pairs.columns)
        totals = pair_counts.of_pairs(pairs, stages.risk_config.correlation_per_pair)
    tables["correlations"] = pairs
    totals = tables["correlation_totals"] = totals if found_pairs is None or found_pairs.few else cut_lineage(totals)
    entities = tables["entities"] = cut_lineage(tables["entities"])
    relationships = tables["relationships"] = cut_lineage(tables["relationships"])
    below = graph.descendant_counts(relationships, ["case_id"])
    made = hypotheses.all_kinds(
        found, best, entities, relationships, below, templates, stages.min_evidence
    )
    if links is not None:
        made = hypotheses.with_contradictions(made, links)
    made = cut_lineage(made)
    tables["hypotheses"] = made
    tables["hypothesis_support"] = hypotheses.support_links(found, made)
    tables["risk"] = risk.assess(found, totals, made, stages.risk_config, links)
    tables["risk_factors"] = risk.factors(found, pairs, made, stages.risk_config, links)
    tables["top_factors"] = risk.top_factors_of(found, pairs_without, made, stages.risk_config, links)
    tables["cases"] = case_ops.summary(
        case_ops.assemble(events, analyst=analyst), tables["risk"], entities, relationships
    )
    tables["case_links"] = case_ops.links(events, found, made, entities, tables["cases"])
    return tables
