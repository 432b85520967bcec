"""Threat-intel indicators, feeds and verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import vocab

RESULT_COLUMNS = [
    "indicator_type", "indicator", "provider", "found", "malicious_count", "total_count",
    "reputation", "tags", "error",
]


def indicators(events: DataFrame) -> DataFrame:
    """Every indicator an event carries, with the field it came from. Not yet distinct."""
    carried = [c for c in ("tenant_id", "case_id") if c in events.columns]

    def one(kind: str, value: Column, source: Column) -> Column:
        return F.struct(F.lit(kind).alias("indicator_type"), value.alias("indicator"), source.alias("source"))

    def hashes(context: str) -> Column:
        entries = F.coalesce(F.map_entries(f"{context}.hashes"), F.array())
        return F.transform(
            entries,
            lambda e: one("hash", F.lower(e["value"]), F.concat(F.lit(f"{context}.hashes."), e["key"])),
        )

    scalar = F.array(
        one("ip", F.col("network.source_ip"), F.lit("network.source_ip")),
        one("ip", F.col("network.destination_ip"), F.lit("network.destination_ip")),
        one("url", F.col("network.url"), F.lit("network.url")),
        one("domain", F.regexp_replace(F.lower("dns.query"), r"\.+$", ""), F.lit("dns.query")),
    )
    every = F.concat(hashes("process"), hashes("file"), scalar)
    some = F.filter(every, lambda i: F.coalesce(i["indicator"], F.lit("")) != "")
    return events.select(*carried, "event_id", F.explode(some).alias("i")).select(*carried, "event_id", "i.*")


def distinct_indicators(found: DataFrame) -> DataFrame:
    """Indicators once each; a popular one is reduced before the shuffle."""
    return found.groupBy("indicator_type", "indicator").agg(F.count("*").alias("sightings"))


def provider_support(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.PROVIDER_SUPPORT, "provider string, types array<string>")


def enrich(distinct: DataFrame, feed: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """One result per (indicator, provider).

    ``feed``: provider, indicator_type, indicator, found, malicious_count, total_count,
    reputation, tags, error and, where it tells the time, answered_at. Of several answers of one provider the first in time
    counts; without times, or at one time, the most malicious. With ``providers`` (provider, types) every distinct
    indicator gets a row for every provider: an error row where the provider does not
    know the type, and a not-found row where its feed is silent.
    """
    if providers is not None:
        asked = distinct.select(
            "indicator_type", "indicator",
            F.explode(F.array(*[
                F.struct(
                    F.lit(r["provider"]).alias("provider"),
                    F.array(*[F.lit(t) for t in r["types"]]).alias("types"),
                )
                for r in providers.collect()  # a handful of configured providers
            ])).alias("p"),
        ).select("indicator_type", "indicator", "p.provider", F.array_contains("p.types", F.col("indicator_type")).alias("ok"))
    else:
        names = [r[0] for r in feed.select("provider").distinct().collect()]  # configured feeds
        asked = distinct.select(
            "indicator_type", "indicator",
            F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("provider"),
            F.lit(True).alias("ok"),
        )
    keys = ["provider", "indicator_type", "indicator"]
    never = F.lit("9999-12-31").cast("timestamp")
    first = [F.coalesce("answered_at", never)] if "answered_at" in feed.columns else []
    answers = feed.groupBy(*keys).agg(
        F.min_by(
            F.struct("found", "malicious_count", "total_count", "reputation", "tags", "error"),
            F.struct(*first, -F.col("malicious_count"), "total_count", F.coalesce("reputation", F.lit(0)), F.coalesce("error", F.lit(""))),
        ).alias("a")
    )
    joined = asked.join(answers, keys, "left")
    unsupported = F.when(~F.col("ok"), F.lit("unsupported indicator type"))
    return joined.select(
        "indicator_type", "indicator", "provider",
        F.coalesce(F.col("ok") & F.col("a.found"), F.lit(False)).alias("found"),
        F.coalesce(F.when(F.col("ok"), F.col("a.malicious_count")), F.lit(0)).alias("malicious_count"),
        F.coalesce(F.when(F.col("ok"), F.col("a.total_count")), F.lit(0)).alias("total_count"),
        F.col("a.reputation").alias("reputation"),
        F.coalesce("a.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce(unsupported, F.col("a.error")).alias("error"),
    )


_LOOKUP_SCHEMA = (
    "provider string, indicator_type string, indicator string, found boolean, malicious_count int, total_count int, "
    "reputation int, tags array<string>, error string"
)


def lookup(distinct: DataFrame, provider: str, ask: Callable[[str, str], dict]) -> DataFrame:
    """Feed rows from a provider function, asked once per distinct indicator.

    ``ask(type, value)`` returns found, malicious_count, total_count, reputation and tags,
    or raises: a failure becomes an error row and the others go on.
    """
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, value in zip(batch["indicator_type"], batch["indicator"]):
                answer, error = {}, None
                try:
                    answer = ask(kind, value)
                except Exception as problem:  # the provider's own errors
                    error = str(problem)
                rows.append(
                    (
                        provider, kind, value, bool(answer.get("found")), answer.get("malicious_count", 0),
                        answer.get("total_count", 0), answer.get("reputation"), list(answer.get("tags", [])), error,
                    )
                )
            names = [part.split()[0] for part in _LOOKUP_SCHEMA.split(", ")]
            out = pd.DataFrame(rows, columns=names)
            out["reputation"] = out["reputation"].astype("Int32")
            yield out

    return distinct.select("indicator_type", "indicator").mapInPandas(step, _LOOKUP_SCHEMA)


def with_verdict(results: DataFrame) -> DataFrame:
    """Add the malicious flag, the detection ratio and the success flag."""
    ratio = F.when(F.col("total_count") > 0, F.col("malicious_count") / F.col("total_count")).otherwise(0.0)
    return results.withColumns(
        {
            "is_malicious": F.col("malicious_count") > 0,
            "detection_ratio": ratio,
            "is_success": F.col("error").isNull(),
        }
    )


def enrich_events(found: DataFrame, results: DataFrame) -> DataFrame:
    """Sightings with the results for their indicator."""
    return found.join(results, ["indicator_type", "indicator"])


def summary(results: DataFrame) -> DataFrame:
    """One row: distinct indicators and the results per class."""
    failed, bad = F.col("error").isNotNull(), F.col("malicious_count") > 0
    return results.agg(
        F.count_distinct("indicator").alias("indicator_count"),
        F.count_if(~failed & bad).alias("malicious"),
        F.count_if(~failed & ~bad & F.col("found")).alias("suspicious"),
        F.count_if(~failed & ~bad & ~F.col("found")).alias("clean"),
        F.count_if(failed).alias("errors"),
    )


# -- landed provider responses -------------------------------------------------------------

_VT_SCHEMA = (
    "data struct<attributes:struct<last_analysis_stats:struct<malicious:int,suspicious:int,harmless:int,"
    "undetected:int>,reputation:int,tags:array<string>,"
    "popular_threat_classification:struct<suggested_threat_label:string>>>"
)
_OTX_SCHEMA = "pulse_info struct<count:int,pulses:array<struct<tags:array<string>>>>"
_MISP_SCHEMA = "response struct<Attribute:array<struct<Tag:array<struct<name:string>>>>>"


def _tags(col: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(col, F.array().cast("array<string>")))))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Feed rows from raw provider answers.

    ``responses``: provider, indicator_type, indicator, body (JSON text), error. Counts
    follow each provider: analysis verdicts, pulses, or attributes.
    """
    vt = F.from_json("body", _VT_SCHEMA)["data"]["attributes"]
    votes = vt["last_analysis_stats"]
    n = lambda name: F.coalesce(votes[name], F.lit(0))
    otx = F.from_json("body", _OTX_SCHEMA)["pulse_info"]
    misp = F.coalesce(F.from_json("body", _MISP_SCHEMA)["response"]["Attribute"], F.array())
    pulses = F.coalesce(otx["count"], F.lit(0))
    label = vt["popular_threat_classification"]["suggested_threat_label"]
    by = lambda v, o, m: (
        F.when(F.col("provider") == "virustotal", v).when(F.col("provider") == "otx", o)
        .when(F.col("provider") == "misp", m)
    )
    return responses.select(
        "provider", "indicator_type", "indicator",
        (F.col("error").isNull() & by(F.lit(True), pulses > 0, F.size(misp) > 0)).alias("found"),
        by(n("malicious") + n("suspicious"), pulses, F.size(misp)).alias("malicious_count"),
        by(n("malicious") + n("suspicious") + n("harmless") + n("undetected"), pulses, F.size(misp)).alias("total_count"),
        by(vt["reputation"], F.lit(None).cast("int"), F.lit(None).cast("int")).alias("reputation"),
        by(
            _tags(F.concat(F.coalesce(vt["tags"], F.array().cast("array<string>")), F.array(label))),
            _tags(F.flatten(F.transform(otx["pulses"], lambda p: p["tags"]))),
            _tags(F.flatten(F.transform(misp, lambda a: F.transform(a["Tag"], lambda t: t["name"])))),
        ).alias("tags"),
        "error",
    )
