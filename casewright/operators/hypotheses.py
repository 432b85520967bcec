"""Competing hypotheses per case: MAIN and COUNTER per technique, SUB per signal.

Which evidence supports a hypothesis is a table of its own
(case, hypothesis, evidence), so a technique seen in a third of all events is
counted with partial sums instead of being gathered into one list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.identity import hypothesis_fingerprint
from casewright.functions.joins import null_safe
from casewright.functions.text import TECHNIQUE_PATTERN, lookup

COLUMNS = [
    "case_id", "tenant_id", "hypothesis_id", "hypothesis_type", "statement", "mitre_techniques",
    "status", "confidence", "support_count", "contradict_count", "missing_evidence", "source",
    "rationale", "fingerprint",
]


def templates(spark: SparkSession, rows: list | None = None) -> DataFrame:
    schema = "technique string, main_statement string, counter_statement string, missing array<string>"
    return spark.createDataFrame(vocab.HYPOTHESIS_TEMPLATES if rows is None else rows, schema)


def support_confidence(count: Column) -> Column:
    steps = F.when(count <= 0, 0.0)
    for n, value in vocab.SUPPORT_CONFIDENCE.items():
        steps = steps.when(count == n, value)
    return steps.otherwise(vocab.SUPPORT_CONFIDENCE_MAX)


def support_status(count: Column) -> Column:
    return F.when(count >= vocab.MIN_SUPPORT_FOR_STATUS, "supported").otherwise("proposed")


def technique_evidence(evidence: DataFrame) -> DataFrame:
    """(case, technique, evidence): from the data and from tags that look like technique ids."""
    texts = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    cleaned = F.transform(F.concat(texts("mitre_techniques"), texts("tags")), lambda t: F.upper(F.trim(t)))
    wanted = F.array_distinct(F.filter(cleaned, lambda t: t.rlike(TECHNIQUE_PATTERN)))
    return evidence.select("case_id", "tenant_id", "evidence_id", F.explode(wanted).alias("technique"))


def _identified(rows: DataFrame) -> DataFrame:
    fingerprint = hypothesis_fingerprint(F.col("tenant_id"), F.col("hypothesis_type"), F.col("statement"))
    return rows.withColumn("fingerprint", fingerprint).withColumn(
        "hypothesis_id", hypothesis_id(F.col("case_id"), F.col("fingerprint"))
    )


def with_fingerprint_check(hypotheses: DataFrame) -> DataFrame:
    """Add ``fingerprint_ok``: does the stored identity hash match tenant, type and statement?"""
    recomputed = hypothesis_fingerprint(F.col("tenant_id"), F.col("hypothesis_type"), F.col("statement"))
    return hypotheses.withColumn("fingerprint_ok", F.col("fingerprint") == recomputed)


def hypothesis_id(case_id: Column, fingerprint: Column) -> Column:
    """Id from case and content, so a second run gives the same one."""
    return F.concat(F.lit("H-"), F.substring(F.sha2(F.concat_ws("|", case_id, fingerprint), 256), 1, 12))


def main_and_counter(
    evidence: DataFrame, table: DataFrame | None = None, min_evidence: int = 1
) -> DataFrame:
    """One MAIN per technique with enough evidence, and its COUNTER."""
    if min_evidence < 1:
        raise ValueError("min_evidence must be at least 1")
    # the built-in table is a few dozen rows; adaptive execution decides about a caller's
    table = F.broadcast(templates(evidence.sparkSession)) if table is None else table
    counted = (
        technique_evidence(evidence).groupBy("case_id", "technique")
        .agg(F.first("tenant_id").alias("tenant_id"), F.count("*").alias("n"))
        .filter(F.col("n") >= min_evidence)
    )
    known = counted.join(table, "technique", "left")
    technique, n = F.col("technique"), F.col("n")
    main_text = F.coalesce("main_statement", F.concat(F.lit(vocab.GENERIC_MAIN_PREFIX), technique))
    counter_text = F.coalesce("counter_statement", F.concat(F.lit(vocab.GENERIC_COUNTER_PREFIX), technique))
    missing = F.coalesce("missing", F.array(*[F.lit(x) for x in vocab.GENERIC_MISSING]))

    def form(kind: str, statement: Column, status: Column, confidence: Column, support: Column, why: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("hypothesis_type"), statement.alias("statement"), status.alias("status"),
            confidence.cast("double").alias("confidence"), support.cast("long").alias("support_count"),
            why.alias("rationale"),
        )

    both = F.array(
        form(
            "main", main_text, support_status(n), support_confidence(n), n,
            F.concat(
                F.lit("MITRE technique "), technique, F.lit(" detected across "), n.cast("string"),
                F.lit(" evidence item(s)."),
            ),
        ),
        form(
            "counter", counter_text, F.lit("proposed"), F.lit(0.0), F.lit(0),
            F.concat(F.lit("Counter to MAIN hypothesis: "), main_text, F.lit(".")),
        ),
    )
    rows = known.select(
        "case_id", "tenant_id", F.array("technique").alias("mitre_techniques"),
        missing.alias("missing_evidence"), F.explode(both).alias("h"),
    ).select("case_id", "tenant_id", "mitre_techniques", "missing_evidence", "h.*")
    return _finished(rows)


def _finished(rows: DataFrame) -> DataFrame:
    return _identified(
        rows.withColumns({"source": F.lit("deterministic"), "contradict_count": F.lit(0).cast("long")})
    ).select(*COLUMNS)


def _sub(rows: DataFrame, statement: str, techniques: list[str]) -> DataFrame:
    """SUB hypotheses from (case_id, tenant_id, rationale)."""
    texts = F.array(*[F.lit(t) for t in techniques]).cast("array<string>")
    return _finished(
        rows.select(
            "case_id", "tenant_id", F.lit("sub").alias("hypothesis_type"), F.lit(statement).alias("statement"),
            texts.alias("mitre_techniques"), F.array().cast("array<string>").alias("missing_evidence"),
            F.lit("proposed").alias("status"), F.lit(0.0).alias("confidence"),
            F.lit(0).cast("long").alias("support_count"), "rationale",
        )
    )


def pair_id() -> Column:
    return F.concat(
        F.lit("PAIR-"),
        F.substring(F.sha2(F.concat_ws("|", "source_event_id", "related_event_id"), 256), 1, 10),
    )


def correlation_sub(pairs: DataFrame) -> DataFrame:
    """SUB for the best pair of a case, when it is confident enough. ``pairs`` carry tenant_id."""
    key = F.struct(-F.col("confidence"), -F.col("score"), F.col("source_event_id"), F.col("related_event_id"))
    best = pairs.groupBy("case_id").agg(
        F.min_by(F.struct(pair_id().alias("id"), "reasons", "confidence", "tenant_id"), key).alias("b")
    ).filter(F.col("b.confidence") >= vocab.MIN_CORRELATION_FOR_SUB)
    why = F.concat(F.lit("Correlation "), F.col("b.id"), F.lit(" (reasons: "), F.concat_ws(", ", "b.reasons"), F.lit(")."))
    return _sub(
        best.select("case_id", F.col("b.tenant_id").alias("tenant_id"), why.alias("rationale")),
        vocab.SUB_CORRELATION_STATEMENT, [],
    )


def chain_sub(entities: DataFrame, descendants: DataFrame) -> DataFrame:
    """SUB for the process with the most spawned descendants, from two upwards.

    ``descendants``: (case_id, root, descendants) as ``graph.descendant_counts`` gives them.
    """
    counted = descendants.select("case_id", F.col("root").alias("entity_id"), F.col("descendants").alias("descendant_count"))
    counted = counted.filter(F.col("descendant_count") >= vocab.MIN_CHAIN_DESCENDANTS)
    named = null_safe(
        counted, entities.select("case_id", "entity_id", "tenant_id", "value", "normalized_value", "host"), ["case_id", "entity_id"]
    )
    key = F.struct(-F.col("descendant_count"), F.col("normalized_value"), F.coalesce("host", F.lit("")))
    best = named.groupBy("case_id").agg(F.min_by(F.struct("tenant_id", "value", "descendant_count"), key).alias("b"))
    why = F.concat(
        F.lit("Process chain from "), F.col("b.value"), F.lit(" reaches depth "),
        (F.col("b.descendant_count") + 1).cast("string"), F.lit("."),
    )
    return _sub(
        best.select("case_id", F.col("b.tenant_id").alias("tenant_id"), why.alias("rationale")),
        vocab.SUB_CHAIN_STATEMENT, [vocab.SUB_CHAIN_TECHNIQUE],
    )


def shared_hash_sub(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """SUB for a hash whose files lie on more than one host of the case."""
    links = relationships.filter("relationship_type = 'has_hash'").select(
        "case_id", F.col("source_id").alias("file_id"), F.col("target_id").alias("entity_id")
    )
    files = entities.filter("entity_type = 'file'").select("case_id", F.col("entity_id").alias("file_id"), "host")
    spread = links.join(files, ["case_id", "file_id"]).filter(F.col("host").isNotNull()).groupBy("case_id", "entity_id").agg(
        F.count_distinct("host").alias("hosts")
    ).filter("hosts > 1")
    hashes = entities.filter("entity_type = 'hash'").select("case_id", "entity_id", "tenant_id", "value", "normalized_value", "hash_algorithm")
    best = spread.join(hashes, ["case_id", "entity_id"]).groupBy("case_id").agg(
        F.min_by(F.struct("tenant_id", "value", "hosts"), F.struct("normalized_value", "hash_algorithm")).alias("b")
    )
    why = F.concat(F.lit("Hash "), F.col("b.value"), F.lit(" observed across "), F.col("b.hosts").cast("string"), F.lit(" hosts."))
    return _sub(
        best.select("case_id", F.col("b.tenant_id").alias("tenant_id"), why.alias("rationale")),
        vocab.SUB_HASH_STATEMENT, [vocab.SUB_HASH_TECHNIQUE],
    )


def support_links(evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(case, hypothesis, evidence) for MAIN hypotheses."""
    mains = hypotheses.filter("hypothesis_type = 'main'").select(
        "case_id", "hypothesis_id", F.explode("mitre_techniques").alias("technique")
    )
    return technique_evidence(evidence).join(mains, ["case_id", "technique"]).select(
        "case_id", "hypothesis_id", "evidence_id"
    )


def with_contradictions(hypotheses: DataFrame, links: DataFrame) -> DataFrame:
    """Count contradicting evidence. ``links``: evidence_id, hypothesis_id, assessment."""
    against = links.filter(F.col("assessment") == "contradicts").groupBy("hypothesis_id").agg(
        F.count_distinct("evidence_id").alias("_against")
    )
    joined = hypotheses.join(against, "hypothesis_id", "left")
    return joined.withColumn("contradict_count", F.coalesce("_against", "contradict_count")).select(*hypotheses.columns)


def _united(rows: DataFrame, column: str) -> DataFrame:
    """(fingerprint, column): the lists of all versions united and sorted; each item is sent once a task."""
    items = rows.select("fingerprint", F.explode(column).alias("_v")).groupBy("fingerprint", "_v").agg(F.lit(1).alias("_n"))
    return items.groupBy("fingerprint").agg(F.array_sort(F.collect_list("_v")).alias(column))


#: Lists of hypotheses that are united where versions are merged.
UNITED = ("mitre_techniques", "mitre_tactics", "missing_evidence", "tags")


def merge(versions: DataFrame, support: DataFrame, contradict: DataFrame, on_overlap: str = "raise") -> DataFrame:
    """Merge versions of one hypothesis: highest confidence, most advanced status, united lists, widest time.

    ``versions``: fingerprint, confidence, status, statement, hypothesis_type, the lists of ``UNITED``, and as far as they have them
    rationale, first_seen, last_seen and version (their order: the first rationale that is not blank stays).
    ``support`` and ``contradict`` hold (fingerprint, evidence_id); ``merged_links`` has them united. Evidence on both
    sides of one hypothesis fails the job, unless ``on_overlap`` is ``report``; ``overlap_count`` tells how much.
    """
    if on_overlap not in ("raise", "report"):
        raise ValueError("on_overlap must be raise or report")
    rank = lookup(F.col("status"), {s: i for i, s in enumerate(vocab.HYPOTHESIS_STATUS_ADVANCE)})
    has = set(versions.columns)
    times = {"first_seen", "last_seen"} <= has
    more = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")] if times else []
    if "rationale" in has:
        said = F.when(F.trim("rationale") != "", F.col("rationale"))
        order = F.struct(*(["version"] if "version" in has else []), "rationale")
        more.append(F.min_by(said, F.when(said.isNotNull(), order)).alias("rationale"))
    merged = versions.groupBy("fingerprint").agg(
        F.max("confidence").alias("confidence"), F.max_by("status", rank).alias("status"),
        F.min("statement").alias("statement"), F.min("hypothesis_type").alias("hypothesis_type"), *more,
    )
    for column in UNITED:
        if column in has:
            merged = merged.join(_united(versions, column), "fingerprint", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    links = merged_links(support, contradict).groupBy("fingerprint").agg(
        F.count_if("supports").alias("support_count"), F.count_if("contradicts").alias("contradict_count"),
        F.count_if(F.col("supports") & F.col("contradicts")).alias("overlap_count"),
    )
    out = merged.join(links, "fingerprint", "left").na.fill(0, ["support_count", "contradict_count", "overlap_count"])
    if on_overlap == "raise":
        clash = F.raise_error(F.concat(F.lit("evidence on both sides of hypothesis "), "fingerprint"))
        out = out.filter(F.when(F.col("overlap_count") > 0, clash.cast("boolean")).otherwise(True))
    return out


def merged_links(support: DataFrame, contradict: DataFrame) -> DataFrame:
    """(fingerprint, evidence_id, supports, contradicts): the evidence of all versions, each once."""
    side = lambda rows, ok: rows.select("fingerprint", "evidence_id", F.lit(ok).alias("supports"), F.lit(not ok).alias("contradicts"))
    both = side(support, True).unionByName(side(contradict, False))
    return both.groupBy("fingerprint", "evidence_id").agg(F.bool_or("supports").alias("supports"), F.bool_or("contradicts").alias("contradicts"))


def row_errors(support: str = "supporting_evidence_ids", contradict: str = "contradicting_evidence_ids") -> Column:
    """Rules a hypothesis row with id lists breaks; an empty list means valid."""
    length = F.length(F.trim("statement"))
    closed = F.col("status").isin("confirmed", "rejected")
    checks = [
        (~F.col("hypothesis_type").isin(vocab.HYPOTHESIS_TYPES), "unknown hypothesis type"),
        (~length.between(3, 2000), "statement must have 3 to 2000 characters"),
        (F.exists("mitre_techniques", lambda t: ~t.rlike(r"^T[0-9.]*[0-9][0-9.]*$")), "invalid technique id"),
        (F.arrays_overlap(support, contradict), "evidence both supports and contradicts"),
        ((F.col("hypothesis_type") == "counter") & F.col("parent_hypothesis_id").isNotNull(), "counter must not have a parent"),
        (closed & F.coalesce(F.trim("rationale") == "", F.lit(True)), "closed hypotheses need a rationale"),
        (~F.col("confidence").between(0.0, 1.0), "confidence must be between 0 and 1"),
    ]
    return F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks]))


def flags(hypotheses: DataFrame) -> DataFrame:
    status = F.col("status")
    return hypotheses.withColumns(
        {
            "is_terminal": status.isin("confirmed", "rejected"),
            "is_active": ~status.isin("confirmed", "rejected"),
            "is_supported": status.isin("supported", "confirmed"),
            "is_high_confidence": F.col("confidence") >= 0.75,
            "evidence_balance": F.col("support_count") - F.col("contradict_count"),
        }
    )


def placed_evidence(updates: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(hypothesis_id, evidence_id, side, known, refused) of the evidence that links and updates name.

    ``links``: hypothesis_id, evidence_id, side (support or contradict), as stored. An evidence stands
    on one side only: a stored link counts first, then the earliest update (support before
    contradict at one time). ``refused`` marks the other side, ``known`` what was stored before.
    """
    named = updates.filter(F.col("action").isin("support", "contradict")).select(
        "hypothesis_id", F.col("value").alias("evidence_id"), F.col("action").alias("side"), F.col("ts"), F.lit(False).alias("known")
    )
    if links is not None:
        named = named.unionByName(
            links.select("hypothesis_id", "evidence_id", "side", F.lit(None).cast("timestamp").alias("ts"), F.lit(True).alias("known"))
        )
    sides = named.groupBy("hypothesis_id", "evidence_id", "side").agg(F.min("ts").alias("ts"), F.max("known").alias("known"))
    rank = F.struct(~F.col("known"), "ts", F.col("side") != "support", "side")
    first = sides.groupBy("hypothesis_id", "evidence_id").agg(F.min(rank).alias("_first"))
    return sides.join(first, ["hypothesis_id", "evidence_id"]).select(
        "hypothesis_id", "evidence_id", "side", "known", (F.col("side") != F.col("_first.side")).alias("refused")
    )


def apply_updates(hypotheses: DataFrame, updates: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Fold an update log into the hypotheses.

    ``updates``: hypothesis_id, ts, action (support, contradict, missing, confidence), value.
    Evidence counts once and on one side (``placed_evidence``, which also lists what was refused);
    stored ``links`` are not counted again. ``missing`` adds to the missing evidence. The last
    confidence wins; of one time the highest.
    """
    new = placed_evidence(updates, links).filter("NOT refused AND NOT known").groupBy("hypothesis_id").agg(
        F.count_if(F.col("side") == "support").alias("_support"), F.count_if(F.col("side") == "contradict").alias("_contradict")
    )
    is_confidence = F.col("action") == "confidence"
    value = F.when(is_confidence, F.col("value").try_cast("double"))
    folded = updates.groupBy("hypothesis_id").agg(
        # as many texts as a hypothesis has kinds of missing evidence
        F.array_sort(F.collect_set(F.when(F.col("action") == "missing", F.col("value")))).alias("_missing"),
        F.max(F.when(value.isNotNull(), F.struct("ts", value.alias("value")))).alias("_confidence"),
    )
    joined = hypotheses.join(folded, "hypothesis_id", "left").join(new, "hypothesis_id", "left")
    given = F.col("_confidence.value")
    return joined.withColumns(
        {
            "support_count": F.col("support_count") + F.coalesce("_support", F.lit(0)),
            "contradict_count": F.col("contradict_count") + F.coalesce("_contradict", F.lit(0)),
            "missing_evidence": F.array_union(
                F.coalesce("missing_evidence", F.array().cast("array<string>")), F.coalesce("_missing", F.array().cast("array<string>"))
            ),
            "confidence": F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), given)), "confidence"),
        }
    ).select(*hypotheses.columns)


def sort_key() -> list[Column]:
    rank = F.array_position(F.array(*[F.lit(t) for t in vocab.HYPOTHESIS_TYPES]), F.col("hypothesis_type"))
    return [rank, F.coalesce("fingerprint", F.lit(""))]


def all_kinds(
    evidence: DataFrame, pairs: DataFrame | None = None, entities: DataFrame | None = None,
    relationships: DataFrame | None = None, descendants: DataFrame | None = None,
    table: DataFrame | None = None, min_evidence: int = 1,
) -> DataFrame:
    out = main_and_counter(evidence, table, min_evidence)
    if entities is not None and descendants is not None:
        out = out.unionByName(chain_sub(entities, descendants))
    if entities is not None and relationships is not None:
        out = out.unionByName(shared_hash_sub(entities, relationships))
    if pairs is not None:
        out = out.unionByName(correlation_sub(pairs))
    return out


def allowed_steps(spark: SparkSession, table: dict[str, Sequence[str]]) -> DataFrame:
    rows = [(a, b) for a, targets in table.items() for b in targets]
    return spark.createDataFrame(rows, "prev_status string, status string")


def status_violations(log: DataFrame, key: str, table: dict[str, Sequence[str]], order: Sequence[str] = ("ts", "step_id")) -> DataFrame:
    """Steps of a status log the state machine does not allow.

    ``log``: key, ts, step_id, status. The previous status is found without putting a
    whole log into one task.
    """
    from casewright.functions.ordered import with_previous

    steps = with_previous(log, [key], list(order), ["status"])
    allowed = allowed_steps(log.sparkSession, table)
    moved = steps.filter(F.col("prev_status").isNotNull())
    return moved.join(F.broadcast(allowed), ["prev_status", "status"], "left_anti").select(
        key, *order, "prev_status", "status"
    )

