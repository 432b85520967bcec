"""Hash-chained evidence ledger: append, verify, compare with the evidence."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.identity import content_hash
from casewright.functions.ordered import with_row_index
from casewright.functions.text import utc_text_sql
from casewright.session import cut_lineage

ENTRY_COLUMNS = [
    "ledger_id", "sequence", "evidence_id", "evidence_hash", "previous_hash", "entry_hash", "operation", "timestamp",
]
_SCHEMA = (
    "ledger_id string, sequence long, evidence_id string, evidence_hash string, previous_hash string, "
    "entry_hash string, operation string, timestamp timestamp"
)


def iso_time(ts: str) -> Column:
    """UTC time of a column as text, microseconds only when there are any; the same in every time zone."""
    return F.expr(f"concat(regexp_replace({utc_text_sql(ts)}, '[.]000000$', ''), '+00:00')")


def entry_hash() -> Column:
    """SHA-256 over the seven chained fields of an entry."""
    return content_hash(
        schema_version=F.lit(vocab.SCHEMA_VERSION), sequence=F.col("sequence"), operation=F.col("operation"),
        evidence_id=F.col("evidence_id"), evidence_hash=F.col("evidence_hash"),
        previous_hash=F.col("previous_hash"), timestamp=iso_time("timestamp"),
    )


#: Entries of one ledger that one task chains before the head is handed on.
BLOCK_ROWS = 2_000_000


def append(rows: DataFrame, heads: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """New entries for (ledger_id, evidence_id, evidence_hash, operation, timestamp).

    Each hash covers the one before it, so one ledger is sequential by definition.
    Entries are numbered in parallel and cut into blocks of ``block_rows``; round by
    round the same block of all ledgers is chained and only the last hash goes on to
    the next round. A task streams its sorted rows and keeps one hash, and a finished
    round is written out, so a lost executor costs one block. ``heads`` (ledger_id,
    sequence, entry_hash) continues stored ledgers.
    """
    numbered = with_row_index(rows, ["ledger_id"], ["timestamp", "evidence_id"], "_n")
    numbered = numbered.withColumn("_block", F.floor(F.col("_n") / block_rows))
    last = numbered.agg(F.max("_block")).first()[0]
    spark = rows.sparkSession
    known = spark.createDataFrame([], "ledger_id string, sequence long, entry_hash string") if heads is None else heads
    out = None
    if last is None:
        return spark.createDataFrame([], _SCHEMA)
    if last > 0:
        numbered = cut_lineage(numbered)
    for block in range(last + 1):
        part = _append_block(numbered.filter(F.col("_block") == block), known)
        if last > 0:
            part = cut_lineage(part)
            known = heads_of(part, known)
        out = part if out is None else out.unionByName(part)
    return out


def _append_block(rows: DataFrame, known: DataFrame) -> DataFrame:
    start = known.select("ledger_id", (F.col("sequence") + 1).alias("_base"), F.col("entry_hash").alias("_head"))
    joined = rows.join(start, "ledger_id", "left")
    narrow = joined.select(
        "ledger_id", "evidence_id", "evidence_hash", "operation", "timestamp",
        F.coalesce("_base", F.lit(0).cast("long")).alias("_base"),
        F.coalesce("_head", F.lit(vocab.GENESIS_HASH)).alias("_head"), iso_time("timestamp").alias("_iso"),
    )
    ordered = narrow.repartition("ledger_id").sortWithinPartitions("ledger_id", "timestamp", "evidence_id")
    return ordered.mapInPandas(_chain, _SCHEMA)


def heads_of(entries: DataFrame, before: DataFrame) -> DataFrame:
    """Heads after ``entries``; ledgers without new entries keep theirs."""
    rows = before.select("ledger_id", "sequence", "entry_hash").unionByName(
        entries.select("ledger_id", "sequence", "entry_hash")
    )
    return cut_lineage(heads(rows))


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ledger, head, sequence = None, "", 0
    for batch in batches:
        numbers, befores, hashes = [], [], []
        for row in batch.itertuples(index=False, name=None):
            ledger_id, evidence_id, evidence_hash, operation, _, base, first, iso = row
            if ledger_id != ledger:
                ledger, head, sequence = ledger_id, first, base
            text = json.dumps(
                {
                    "evidence_hash": evidence_hash, "evidence_id": evidence_id, "operation": operation,
                    "previous_hash": head, "schema_version": vocab.SCHEMA_VERSION, "sequence": sequence,
                    "timestamp": iso,
                },
                separators=(",", ":"), ensure_ascii=False,
            )
            numbers.append(sequence)
            befores.append(head)
            head = hashlib.sha256(text.encode()).hexdigest()
            hashes.append(head)
            sequence += 1
        yield pd.DataFrame(
            {
                "ledger_id": batch["ledger_id"], "sequence": numbers, "evidence_id": batch["evidence_id"],
                "evidence_hash": batch["evidence_hash"], "previous_hash": befores, "entry_hash": hashes,
                "operation": batch["operation"], "timestamp": batch["timestamp"],
            }
        )


def check(entries: DataFrame) -> DataFrame:
    """Entries with ``failure``: the first rule each one breaks, null when none.

    Every entry is compared with its predecessor by an equi-join on
    (ledger, position), so one huge ledger is spread over all tasks.
    """
    indexed = with_row_index(entries, ["ledger_id"], ["sequence", "entry_hash"], "position")
    before = indexed.select(
        "ledger_id", (F.col("position") + 1).alias("position"), F.col("entry_hash").alias("expected")
    )
    joined = indexed.join(before, ["ledger_id", "position"], "left")
    failure = (
        F.when(F.col("sequence") != F.col("position"), "sequence_anomaly")
        .when((F.col("position") == 0) & (F.col("previous_hash") != vocab.GENESIS_HASH), "genesis_anomaly")
        .when((F.col("position") > 0) & ~F.col("previous_hash").eqNullSafe(F.col("expected")), "broken_chain")
        .when(F.col("entry_hash") != entry_hash(), "hash_mismatch")
    )
    return joined.select(*entries.columns, "position", failure.alias("failure"))


def verify(entries: DataFrame) -> DataFrame:
    """One row per ledger: valid or the first failure, and how many entries were good before it."""
    checked = check(entries)
    failed = F.col("failure").isNotNull()
    first = F.struct("failure", "sequence", "evidence_id", "position")
    rows = checked.groupBy("ledger_id").agg(
        F.count("*").alias("total_entries"),
        F.min_by(F.when(failed, first), F.when(failed, F.col("position"))).alias("f"),
    )
    return rows.select(
        "ledger_id", F.coalesce("f.failure", F.lit("valid")).alias("status"), F.col("f").isNull().alias("valid"),
        "total_entries", F.coalesce("f.position", "total_entries").alias("verified_entries"),
        F.col("f.sequence").alias("failed_sequence"), F.col("f.evidence_id").alias("failed_evidence_id"),
    )


def heads(entries: DataFrame) -> DataFrame:
    return entries.groupBy("ledger_id").agg(
        F.max("sequence").alias("sequence"), F.max_by("entry_hash", "sequence").alias("entry_hash")
    )


def entries_of(entries: DataFrame, evidence_id: str) -> DataFrame:
    return entries.filter(F.col("evidence_id") == evidence_id)


def entry_at(entries: DataFrame, sequence: int) -> DataFrame:
    return entries.filter(F.col("sequence") == sequence)


def against_evidence(entries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence whose current hash differs from, or is not in, its latest ledger entry."""
    latest = entries.groupBy("evidence_id").agg(F.max_by("evidence_hash", "sequence").alias("recorded_hash"))
    joined = evidence.select("evidence_id", "content_hash").join(latest, "evidence_id", "left")
    return joined.withColumn("matches", F.coalesce(F.col("content_hash") == F.col("recorded_hash"), F.lit(False)))
