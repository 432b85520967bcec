"""Stream sources and sinks, and the investigation worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casewright.plans.investigate import Stages, investigate
from casewright.sources import normalize
from casewright.sources.store import Store, save_cases
from casewright.streaming.batches import BatchRules, group_key, stream_batches


def encode(events: DataFrame) -> DataFrame:
    """Events as (key, value) rows for a Kafka or file sink; nulls are left out of the JSON."""
    carried = [c for c in events.columns if c != "errors"]
    return events.select(F.col("event_id").alias("key"), F.to_json(F.struct(*carried)).alias("value"))


def decode(messages: DataFrame) -> DataFrame:
    """Events from ``value`` texts, with ``errors``; empty texts become nulls."""
    return normalize.canonical_events(messages.select(F.col("value").cast("string").alias("raw")))


def dedup(events: DataFrame, lateness: str) -> DataFrame:
    """Each event id once; ids are remembered as long as the watermark allows late rows."""
    return events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])


def poll_files(spark: SparkSession, path: str, lateness: str = "5 minutes", files_per_trigger: int = 100) -> DataFrame:
    """New alert files as canonical events; the file source remembers what it has read."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
        .select(F.col("value").alias("raw")).filter(F.trim("raw") != "")
    )
    return dedup(normalize.poll_ids(normalize.valid(normalize.wazuh_events(lines))), lateness)


def observed(events: DataFrame, name: str = "worker") -> DataFrame:
    """Consumed and failed counts as metrics of the query progress."""
    return events.observe(
        name, F.count("*").alias("consumed"), F.count_if(F.size("errors") > 0).alias("failed")
    )


def backlog(query: StreamingQuery) -> list[dict]:
    """Per source: rows of the last trigger and the offsets read and available."""
    progress = query.lastProgress
    if not progress:
        return []
    return [
        {
            "source": s["description"], "rows": s["numInputRows"], "read": s["endOffset"],
            "available": s.get("latestOffset"),
        }
        for s in progress["sources"]
    ]


def quarantine_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write messages that are not valid events to a folder of their own."""
    bad = normalize.quarantine(events).select("event_id", "raw", "errors")
    return bad.writeStream.format("parquet").option("checkpointLocation", checkpoint).start(path)


def to_batches(events: DataFrame, group_by: str | None = None, rules: BatchRules | None = None, lateness: str = "10 seconds") -> DataFrame:
    """Valid events of a stream in closed batches; ``arrived_at`` is the arrival time."""
    good = normalize.valid(events) if "errors" in events.columns else events
    body = [c for c in good.columns if c not in ("errors", "raw", "arrived_at")]
    rows = good.select(
        group_key(group_by).alias("batch_group"), "arrived_at", "event_id", F.to_json(F.struct(*body)).alias("body")
    )
    return stream_batches(rows, rules, lateness)


def investigate_batches(closed: DataFrame, store: Store, stages: Stages | None = None) -> DataFrame | None:
    """Investigate closed batches, one case each, and store them; the stored cases of these batches.

    The case id comes from group and batch number, so a repeated trigger after a
    failure writes the same cases again.
    """
    rows = normalize.canonical_events(
        closed.select(F.col("body").alias("raw"), F.concat_ws("/", "batch_group", F.col("batch_no").cast("string")).alias("case_id"))
    )
    events = normalize.valid(rows).drop("raw", "errors")
    if events.isEmpty():
        return None
    save_cases(store, investigate(events, stages))
    return store.load("cases").join(events.select("case_id").distinct(), "case_id", "left_semi")


def start_worker(
    batches: DataFrame, store: Store, checkpoint: str, stages: Stages | None = None,
    on_cases: Callable[[DataFrame], None] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Investigate, store and report closed batches of a stream.

    ``on_cases`` sees the cases of the trigger's batches (for alerts) and is not called
    when a trigger closed none. Its errors are raised after the
    cases are stored; the trigger is then repeated and stores the same rows.
    """
    def handle(closed: DataFrame, number: int) -> None:
        cases = investigate_batches(closed, store, stages)
        if on_cases is not None and cases is not None:
            on_cases(cases)

    writer = batches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
