"""Timeline rows and the filters over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import clean, sorted_set

TIMELINE_COLUMNS = [
    "event_id", "timestamp", "category", "event_type", "severity", "host", "user",
    "process_name", "process_pid", "parent_pid", "mitre_techniques", "rule_id", "rule_name", "summary",
]


def summary() -> Column:
    kind, name, pid = F.col("event_type"), F.col("process_name"), F.col("process_pid")
    named = F.concat(kind, F.lit(": "), name)
    return F.when(
        (F.col("category") == "process") & name.isNotNull(),
        F.when(pid.isNotNull(), F.concat(named, F.lit(" (PID "), pid.cast("string"), F.lit(")")))
        .otherwise(named),
    ).otherwise(kind)


def project(events: DataFrame) -> DataFrame:
    """Snapshot row per event: trimmed text, sorted techniques, summary."""
    extra = [c for c in ("tenant_id", "case_id") if c in events.columns]
    rows = events.select(
        *extra,
        clean(F.col("event_id")).alias("event_id"),
        "timestamp",
        F.coalesce(F.col("category"), F.lit("other")).alias("category"),
        F.coalesce(clean(F.col("event_type")), F.lit("unknown")).alias("event_type"),
        F.coalesce(F.col("severity"), F.lit(0)).alias("severity"),
        clean(F.col("host")).alias("host"),
        clean(F.col("user")).alias("user"),
        clean(F.col("process.name")).alias("process_name"),
        F.col("process.pid").alias("process_pid"),
        F.col("process.parent_pid").alias("parent_pid"),
        sorted_set(F.col("mitre_techniques")).alias("mitre_techniques"),
        clean(F.col("rule_id")).alias("rule_id"),
        clean(F.col("rule_name")).alias("rule_name"),
    )
    return rows.withColumn("summary", summary())


def row_errors() -> Column:
    """Reasons why a timeline row is not valid; an empty list means valid."""
    checks = [
        (F.col("event_id").isNull(), "event_id must be a non-empty string"),
        (F.col("timestamp").isNull(), "timestamp is required"),
        (~F.col("severity").between(0, 100), "severity must be between 0 and 100"),
    ]
    return F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks]))


def dedup(rows: DataFrame, order: list[str], keep: str = "first") -> DataFrame:
    """One row per event id: the first or last by ``order``, or fail on duplicates.

    An aggregate, not a window: copies of one id are reduced before the shuffle. It sorts, because whole rows are carried.
    """
    if keep not in ("first", "last", "error"):
        raise ValueError("keep must be first, last or error")
    pick = F.max_by if keep == "last" else F.min_by
    others = [c for c in rows.columns if c != "event_id"]
    picked = rows.groupBy("event_id").agg(
        pick(F.struct(*others), F.struct(*order)).alias("r"), F.count("*").alias("copies")
    )
    if keep == "error":
        picked = picked.withColumn(
            "r",
            F.when(F.col("copies") == 1, F.col("r")).otherwise(
                F.raise_error(F.concat(F.lit("duplicate event_id: "), F.col("event_id")))
            ),
        )
    return picked.select("event_id", "r.*").select(*rows.columns)


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("timestamp", "event_id")


def between(rows: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    if end < start:
        raise ValueError("end must not be before start")
    return rows.filter(F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def since(rows: DataFrame, start: datetime | str) -> DataFrame:
    return rows.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))


def until(rows: DataFrame, end: datetime | str) -> DataFrame:
    return rows.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))


def for_host(rows: DataFrame, host: str | None) -> DataFrame:
    """Exact, case-sensitive host; no host gives no rows."""
    wanted = (host or "").strip()
    return rows.filter(F.col("host") == wanted) if wanted else rows.limit(0)


def for_process(rows: DataFrame, pid: int | None) -> DataFrame:
    return rows.filter(F.col("process_pid") == F.lit(pid).cast("int"))


def related_to_process(rows: DataFrame, pid: int | None) -> DataFrame:
    """Rows of the process itself or of its children."""
    wanted = F.lit(pid).cast("int")
    return rows.filter((F.col("process_pid") == wanted) | (F.col("parent_pid") == wanted))


def high_severity(rows: DataFrame, minimum: int = 70) -> DataFrame:
    if not 0 <= minimum <= 100:
        raise ValueError("minimum must be between 0 and 100")
    return rows.filter(F.col("severity") >= minimum)


def bounds(rows: DataFrame, by: list[str]) -> DataFrame:
    """First and last event, duration in seconds and size, per group."""
    key = F.struct("timestamp", "event_id")
    return rows.groupBy(*by).agg(
        F.min_by("event_id", key).alias("first_event"),
        F.max_by("event_id", key).alias("last_event"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
        ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6).alias("duration_seconds"),
        F.count("*").alias("events"),
    )


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row, keys sorted."""
    return rows.select("event_id", F.to_json(F.struct(*sorted(rows.columns))).alias("json"))
