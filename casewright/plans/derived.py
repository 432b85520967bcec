"""Inputs of the registered queries that Spark derives from the given tables."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright import vocab
from casewright.schemas import EVENT, NETWORK

CASE_STEPS = [
    "detected", "triaged", "correlating", "investigating", "evidence_required", "reassessing", "confirmed", "resolved",
]
HYPOTHESIS_STEPS = ["proposed", "supported", "weakened", "confirmed", "rejected"]

RULES = [
    {
        "id": "S-1", "title": "Shell from explorer", "level": "high", "tags": ["attack.t1059.001", "attack.ta0002"],
        "detection": {
            "Shell": {"process.name": ["powershell.exe", "cmd*"]},
            "severe": {"event.type": "click", "host": "HOST-?"},
            "condition": "shell and severe",
        },
    },
    {
        "id": "S-2", "title": "Persistence key", "level": "critical", "description": "Autorun key touched",
        "detection": {
            "sel_key": {"registry.key": "software\\k1"}, "sel_path": {"file.path": "f7.bin"},
            "condition": "1 of sel*",
        },
    },
    {
        "id": "S-3", "title": "Odd domain", "level": "low", "tags": ["attack.t1071"],
        "detection": {
            "sel_a": {"dns.query": "EXAMPLE.com"}, "sel_b": {"user": "user1*"}, "other": {"rule.id": "R-5"},
            "condition": "all of sel* or other",
        },
    },
]


def many_rules(n: int) -> list[dict]:
    """Rules made by number: equal, contained and wildcard texts, lists, two selections."""

    def detection(i: int) -> dict:
        user = f"user{i % 40}"
        return [
            {"a": {"host": f"HOST-{i % 12}", "user": user}, "b": {"event.type": ["click", "VIEW"]}, "condition": "a and b"},
            {"a": {"dns.query": f"d{i % 20}.ex", "user": user}, "b": {"process.name": ["mshta.exe", "cmd*"]}, "condition": "a and b"},
            {"a": {"registry.key": f"*k{i % 15}", "user": user}, "b": {"file.path": f"f{i % 25}.bin", "user": user}, "condition": "a or b"},
            {"a1": {"rule.id": f"R-{i % 11}"}, "a2": {"network.source_ip": f"10.?.{i % 4}.*", "user": user}, "condition": "all of a*"},
        ][i % 4]

    return [{"id": f"M-{i}", "title": f"Rule {i}", "level": ["low", "high"][i % 2], "detection": detection(i)} for i in range(n)]


def verifications(events: DataFrame) -> DataFrame:
    return events.filter("severity % 6 = 0").select(
        F.concat(F.lit("E-"), "event_id").alias("evidence_id"), F.lit(True).alias("verified"),
        F.lit("analyst").alias("verified_by"), F.col("timestamp").alias("verified_at"),
        F.lit("review").alias("method"), F.lit(None).cast("string").alias("notes"),
    )


def contradictions(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Evidence of severity ..3 speaks against the tool transfer hypothesis of its case."""
    target = made.filter("hypothesis_type = 'main' AND statement = 'Possible ingress tool transfer'")
    against = rows.filter("event_severity % 10 = 3").select("case_id", "evidence_id")
    return against.join(target.select("case_id", "hypothesis_id"), "case_id").select(
        "evidence_id", "hypothesis_id", F.lit("contradicts").alias("assessment"), F.lit(1.0).alias("weight"),
        F.lit(None).cast("string").alias("rationale"),
    )


def with_copies(rows: DataFrame) -> DataFrame:
    """Every row twice, the copy one hour later."""
    later = rows.withColumns({"timestamp": F.col("timestamp") + F.expr("INTERVAL 1 HOUR"), "copy": F.lit(1)})
    return rows.withColumn("copy", F.lit(0)).unionByName(later)


def address_ids(tenant: str, *addresses: str) -> list[str]:
    out = []
    for address in addresses:
        payload = {
            "entity_type": "ip", "normalized_value": address, "schema_version": vocab.SCHEMA_VERSION, "tenant_id": tenant,
        }
        digest = hashlib.sha256(json.dumps(payload, separators=(",", ":")).encode()).hexdigest()
        out.append(str(uuid.uuid5(uuid.UUID(vocab.ENTITY_NAMESPACE), digest)))
    return out


def first_copy_edges(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """An edge from every file to the first file seen with the same hash."""
    files = entities.filter("entity_type = 'file'").select(F.col("entity_id").alias("source_id"), "first_seen")
    links = relationships.filter("relationship_type = 'has_hash'").select(
        "tenant_id", "source_id", F.col("target_id").alias("hash_id")
    ).join(files, "source_id")
    first = links.groupBy("hash_id").agg(F.min_by("source_id", F.struct("first_seen", "source_id")).alias("target_id"))
    return links.join(first, "hash_id").filter("source_id <> target_id").select(
        "tenant_id", "source_id", "target_id", F.lit("matches_hash").alias("relationship_type")
    )


def _number(col: str) -> "F.Column":
    """Last number in a text."""
    return F.regexp_extract(col, r"(\d+)(?:\.example\.com)?$", 1).cast("int")


def intel_feed(found: DataFrame) -> DataFrame:
    """Feed rows about some addresses and domains, and failures for some hashes."""
    x = _number("indicator")
    ip = found.filter((F.col("indicator_type") == "ip") & F.col("indicator").startswith("203.") & (x % 3 == 0))
    domain = found.filter((F.col("indicator_type") == "domain") & (x % 4 == 0))
    hashes = found.filter((F.col("indicator_type") == "hash") & (F.substring("indicator", 1, 1) < "4"))

    def rows(source: DataFrame, provider: str, malicious, total: int, ok: bool) -> DataFrame:
        return source.select(
            F.lit(provider).alias("provider"), "indicator_type", "indicator", F.lit(ok).alias("found"),
            malicious.cast("int").alias("malicious_count"), F.lit(total).alias("total_count"),
            F.lit(None).cast("int").alias("reputation"), F.array().cast("array<string>").alias("tags"),
            F.lit(None if ok else "timeout").cast("string").alias("error"),
        )

    return (
        rows(ip, "virustotal", x % 5, 10, True).unionByName(rows(domain, "otx", x % 5, 10, True))
        .unionByName(rows(hashes, "misp", F.lit(0), 0, False))
    )


def url_events(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url")
    given = {
        "event_id": F.concat(F.lit("P-"), F.col("page_id").cast("string")),
        "network": F.struct(*[
            (F.col("url") if f.name == "url" else F.lit(None).cast(f.dataType)).alias(f.name) for f in NETWORK.fields
        ]),
    }
    return pages.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields])


def url_feed(found: DataFrame) -> DataFrame:
    size = F.length("indicator")
    return found.filter((F.col("indicator_type") == "url") & (size % 3 == 0)).select(
        F.lit("misp").alias("provider"), "indicator_type", "indicator", F.lit(True).alias("found"),
        (size % 4).cast("int").alias("malicious_count"), F.lit(4).alias("total_count"),
        F.lit(None).cast("int").alias("reputation"), F.array().cast("array<string>").alias("tags"),
        F.lit(None).cast("string").alias("error"),
    )


def provider_responses(found: DataFrame) -> DataFrame:
    """Answers of three providers as they land: one JSON body per indicator and provider."""
    n = F.length("indicator")
    ints = lambda **kw: F.struct(*[v.cast("int").alias(k) for k, v in kw.items()])
    vt = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    ints(malicious=n % 4, suspicious=n % 2, harmless=F.lit(5), undetected=F.lit(1)).alias("last_analysis_stats"),
                    (n - 20).cast("int").alias("reputation"),
                    F.array(F.lit("zeta"), F.lit("alpha")).alias("tags"),
                    F.struct(F.lit("trojan").alias("suggested_threat_label")).alias("popular_threat_classification"),
                ).alias("attributes")
            ).alias("data")
        )
    )
    pulse = F.struct(F.array(F.lit("b"), F.lit("a")).alias("tags"))
    otx = F.to_json(F.struct(F.struct((n % 3).cast("int").alias("count"), F.array(pulse, pulse).alias("pulses")).alias("pulse_info")))
    attribute = F.struct(F.array(F.struct(F.lit("tlp:red").alias("name"))).alias("Tag"))
    misp = F.to_json(
        F.struct(F.struct(F.when(n % 2 == 0, F.array(attribute, attribute)).otherwise(F.array()).alias("Attribute")).alias("response"))
    )
    bodies = F.array(*[
        F.struct(F.lit(p).alias("provider"), b.alias("body")) for p, b in (("virustotal", vt), ("otx", otx), ("misp", misp))
    ])
    return found.select("indicator_type", "indicator", F.inline(bodies)).withColumn("error", F.lit(None).cast("string"))


def status_log(events: DataFrame, kind: str) -> DataFrame:
    """One status step per event, most of them in disorder."""
    steps = CASE_STEPS if kind == "case" else HYPOTHESIS_STEPS
    k = F.col("severity")
    return events.select(
        "case_id", F.col("timestamp").alias("ts"), F.col("event_id").alias("step_id"),
        F.element_at(F.array(*[F.lit(s) for s in steps]), (k % len(steps) + 1).cast("int")).alias("status"),
        F.when(k % 3 == 0, F.concat(F.lit("analyst"), (k % 5).cast("string"))).alias("analyst"),
    )


def risk_updates(events: DataFrame) -> DataFrame:
    daily = events.groupBy("host", F.date_trunc("day", "timestamp").alias("ts")).agg(
        F.bround(F.avg("severity"), 0).cast("int").alias("risk_score")
    )
    return daily.withColumns({"update_id": F.col("host"), "confidence": F.col("risk_score") / 100.0})


def ledger_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("case_id").alias("ledger_id"), F.concat(F.lit("E-"), "event_id").alias("evidence_id"),
        F.sha2("event_id", 256).alias("evidence_hash"), F.lit("append").alias("operation"), "timestamp",
    )


def altered(entries: DataFrame) -> DataFrame:
    """Every 20th entry changed after it was hashed."""
    changed = F.when(F.col("sequence") % 20 == 19, F.sha2(F.lit("altered"), 256)).otherwise(F.col("evidence_hash"))
    return entries.withColumn("evidence_hash", changed)


# -- raw records ---------------------------------------------------------------------------------

_SYSMON_ID = {"process": "1", "network": "3", "file": "11", "registry": "13", "dns": "22"}


def _sysmon_id() -> "F.Column":
    out = F.lit(None).cast("string")
    for category, number in _SYSMON_ID.items():
        out = F.when(F.col("category") == category, number).otherwise(out)
    return out


def wazuh_records(events: DataFrame) -> DataFrame:
    k = F.col("severity")
    image = F.concat(F.lit("C:\\Windows/System32\\"), F.col("process.name"))
    parent = F.concat(F.lit("C:\\Windows\\"), F.col("process.parent_name"))
    pid = F.col("process.pid")
    body = F.struct(
        F.col("event_id").alias("id"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'").alias("timestamp"),
        F.lit("(agent) windows-eventchannel").alias("location"),
        F.struct(
            F.concat(F.lit("R"), (k % 11).cast("string")).alias("id"), (k % 17).alias("level"),
            F.concat(F.lit("Rule Alert "), (k % 11).cast("string")).alias("description"),
            F.array(F.lit("Sysmon"), F.col("event_type"), F.lit("sysmon")).alias("groups"),
            F.struct(
                F.concat(F.coalesce("mitre_techniques", F.array()), F.array(F.lit("bad"))).alias("id"),
                F.array(F.lit("Execution"), F.lit("ta0003"), F.lit("Lateral_Movement"), F.lit("nonsense")).alias("tactic"),
            ).alias("mitre"),
        ).alias("rule"),
        F.struct(F.lit("007").alias("id"), F.col("host").alias("name")).alias("agent"),
        F.struct(
            F.struct(
                F.struct(_sysmon_id().alias("eventID")).alias("system"),
                F.struct(
                    image.alias("Image"),
                    F.when(k % 2 == 0, F.concat(F.lit("0x"), F.hex(pid))).otherwise(pid.cast("string")).alias("ProcessId"),
                    F.col("process.parent_pid").cast("string").alias("ParentProcessId"), parent.alias("ParentImage"),
                    F.col("user").alias("User"),
                ).alias("eventdata"),
            ).alias("win")
        ).alias("data"),
    )
    return events.select(F.to_json(body).alias("raw"))


def sysmon_records(events: DataFrame) -> DataFrame:
    body = F.struct(
        _sysmon_id().cast("int").alias("EventID"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("UtcTime"),
        F.col("host").alias("Computer"), F.col("user").alias("User"),
        F.concat(F.lit("C:/Windows/"), F.col("process.name")).alias("Image"),
        F.col("process.pid").alias("ProcessId"), F.col("process.parent_pid").alias("ParentProcessId"),
        F.concat(F.lit("C:\\Windows\\"), F.col("process.parent_name")).alias("ParentImage"),
        F.lit("MD5=AB,broken,SHA256=CD").alias("Hashes"),
    )
    return events.select(F.to_json(body).alias("raw"))


def mixed_records(events: DataFrame) -> DataFrame:
    """Canonical, Wazuh, Sysmon, unknown and broken records; some canonical ones not valid."""
    k = F.col("severity")
    part = lambda i: events.filter(k % 5 == i)
    plain = F.to_json(
        F.struct(
            "event_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "source",
            "category", "event_type", F.when(k % 4 == 0, k + 100).otherwise(k).alias("severity"), "host",
        )
    )
    return (
        part(0).select(plain.alias("raw")).unionByName(wazuh_records(part(1))).unionByName(sysmon_records(part(2)))
        .unionByName(part(3).select(F.to_json(F.struct("host", "severity")).alias("raw")))
        .unionByName(part(4).select(F.concat(F.lit("{broken "), "event_id").alias("raw")))
    )
