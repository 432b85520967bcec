"""Raw records to canonical events, with an ``errors`` column instead of exceptions.

Every normaliser takes rows with a ``raw`` column (one JSON object as text) and
returns the canonical columns, ``errors`` and whatever else the input carried. Rows with errors go to quarantine; they are never dropped silently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.text import basename, lookup, to_int, valid_technique
from casewright.schemas import EVENT, EVENT_COLUMNS, PROCESS

# -- reading ------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON: one record per line, large files are split over tasks."""
    rows = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_file"))
    return rows.filter(F.trim("raw") != "")


def read_documents(spark: SparkSession, path: str, list_key: str = "events") -> DataFrame:
    """JSON documents: a list, an object with a list under ``list_key``, or one record.

    A document is one JSON value and so is parsed by one task; use NDJSON for large
    inputs. Text that is neither becomes its lines (NDJSON in a ``.json`` file).
    """
    texts = spark.read.text(path, wholetext=True).select(
        F.trim("value").alias("doc"), F.col("_metadata.file_path").alias("source_file")
    )
    return explode_documents(texts, list_key)


def explode_documents(texts: DataFrame, list_key: str) -> DataFrame:
    """Records of the documents in ``doc``."""
    doc = F.col("doc")
    listed = F.from_json(F.get_json_object(doc, f"$.{list_key}"), "array<string>")
    whole = F.try_parse_json(doc).isNotNull()
    first = F.split(doc, "\r?\n", 2)
    lines = (F.size(first) > 1) & first[0].startswith("{") & F.try_parse_json(first[0]).isNotNull()
    items = (
        F.when(lines, F.filter(F.split(doc, "\r?\n"), lambda line: F.trim(line) != ""))
        .when(whole & doc.startswith("["), F.from_json(doc, "array<string>"))
        .when(whole & listed.isNotNull(), listed)
        .when(whole, F.array(doc))
        .otherwise(F.filter(F.split(doc, "\r?\n"), lambda line: F.trim(line) != ""))
    )
    others = [c for c in texts.columns if c != "doc"]
    return texts.filter(doc != "").select(*others, F.explode(items).alias("raw"))


def read_alert_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed alert API answers: ``data.affected_items`` as records with id and time."""
    texts = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("source_file"))
    items = F.from_json(F.get_json_object("doc", "$.data.affected_items"), "array<string>")
    rows = texts.select("source_file", F.explode(items).alias("raw"))
    return rows.select(
        "source_file", "raw", F.get_json_object("raw", "$.id").alias("alert_id"),
        timestamp(F.get_json_object("raw", "$.timestamp")).alias("alert_time"),
    )


# -- shared pieces ----------------------------------------------------------------------------


def timestamp(text: Column) -> Column:
    """ISO time with T or space, Z, +0000 or +00:00; null when it is none of these."""
    zoned = F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return zoned.try_cast("timestamp")


def is_object(raw: Column) -> Column:
    return F.trim(raw).startswith("{") & F.try_parse_json(raw).isNotNull()


def wazuh_severity(level: Column) -> Column:
    return (
        F.when(level <= 0, 0).when(level >= 15, 100)
        .otherwise(F.coalesce(lookup(level, vocab.WAZUH_LEVEL_SEVERITY), F.lit(0)))
    )


def tactic_id(text: Column) -> Column:
    """Tactic name or id to its TA id; null when it is neither."""
    value = F.trim(text)
    named = lookup(F.trim(F.replace(F.lower(value), F.lit("_"), F.lit(" "))), vocab.TACTIC_IDS)
    return F.when(F.upper(value).rlike(r"^TA\d+$"), F.upper(value)).otherwise(named)


def infer_category_sql(category: str) -> str:
    """For ``other``: the category of the first context there is. SQL text."""
    web = "(coalesce(network.url, '') <> '' OR coalesce(network.user_agent, '') <> '')"
    return (
        f"CASE WHEN {category} <> 'other' THEN {category} WHEN process IS NOT NULL THEN 'process' "
        f"WHEN registry IS NOT NULL THEN 'registry' WHEN dns IS NOT NULL THEN 'dns' "
        f"WHEN network IS NOT NULL AND {web} THEN 'http' WHEN file IS NOT NULL THEN 'file' "
        "WHEN network IS NOT NULL THEN 'network' ELSE 'other' END"
    )


def predicates(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "is_process_event": F.col("category") == "process",
            "is_network_event": F.col("category").isin("network", "dns", "http"),
            "is_windows": F.col("platform") == "windows",
            "is_linux": F.col("platform") == "linux",
            "is_high_severity": F.col("severity") >= 70,
        }
    )


def _strings(col: Column) -> Column:
    """JSON text of a list or of one string, as an array."""
    listed = F.from_json(col, "array<string>")
    return F.when(F.trim(col).startswith("["), listed).when(F.coalesce(F.trim(col), F.lit("")) != "", F.array(col))


def _typed(given: dict[str, Column], field) -> Column:
    """A given value in the type of its field; null when it is not given."""
    kind = field.dataType.simpleString()
    value = given.get(field.name)
    return (F.expr(f"CAST(NULL AS {kind})") if value is None else value.cast(kind)).alias(field.name)


def _context(schema, **given: Column) -> Column:
    return F.struct(*[_typed(given, f) for f in schema.fields])


def _finish(rows: DataFrame, given: dict[str, Column], errors: list[Column]) -> DataFrame:
    """Canonical columns, the carried ones, and the errors of normalising and validating."""
    carried = [c for c in rows.columns if not c.startswith("_") and c not in EVENT_COLUMNS]
    columns = [_typed(given, f) for f in EVENT.fields]
    out = rows.select(*columns, *carried, F.array_compact(F.array(*errors)).alias("_early"))
    out = with_errors(canonical(out))
    return out.selectExpr(*[f"`{c}`" for c in out.columns if c not in ("_early", "errors")], "concat(_early, errors) AS errors")


_SORTED_SET = (
    "array_sort(array_distinct(filter(transform(coalesce({0}, array()), x -> {1}), x -> x IS NOT NULL AND x <> '')))"
)
_LOWERED_HASHES = (
    "map_from_entries(transform(filter(map_entries({0}.hashes), e -> coalesce(e.value, '') <> ''), "
    "e -> named_struct('key', lower(e.key), 'value', lower(e.value))))"
)


def canonical(events: DataFrame) -> DataFrame:
    """Trim texts, sort and deduplicate lists, lower hash keys, infer the category."""
    given = {
        c: f"trim(`{c}`)" for c in ("event_id", "tenant_id", "event_type", "host", "user", "domain", "rule_id", "rule_name")
    }
    given |= {
        "schema_version": f"coalesce(schema_version, '{vocab.SCHEMA_VERSION}')",
        "platform": "coalesce(platform, 'unknown')",
        "category": infer_category_sql("coalesce(category, 'other')"),
        "source_reliability": "coalesce(source_reliability, 'fairly_reliable')",
        "severity": "coalesce(severity, 0)",
        "tags": _SORTED_SET.format("tags", "lower(trim(x))"),
        "mitre_techniques": _SORTED_SET.format("mitre_techniques", "trim(x)"),
        "mitre_tactics": _SORTED_SET.format("mitre_tactics", "trim(x)"),
    }
    for context, field, value in (
        ("process", "hashes", _LOWERED_HASHES.format("process")), ("file", "hashes", _LOWERED_HASHES.format("file")),
        ("network", "protocol", "upper(network.protocol)"),
    ):
        parts = ", ".join(
            f"'{f.name}', {value if f.name == field else f'{context}.{f.name}'}" for f in EVENT[context].dataType.fields
        )
        given[context] = f"CASE WHEN {context} IS NOT NULL THEN named_struct({parts}) END"
    return events.selectExpr(*[f"{given.get(c, f'`{c}`')} AS `{c}`" for c in events.columns])


def with_errors(events: DataFrame) -> DataFrame:
    """Add ``errors``: the rules of the event model a row breaks."""
    known = lambda c, values: f"NOT coalesce({c} IN ({', '.join(repr(v) for v in values)}), false)"
    checks = [
        ("coalesce(event_id, '') = ''", "event_id is required"),
        ("timestamp IS NULL", "timestamp is missing or not a time"),
        (known("source", vocab.EVENT_SOURCES), "unknown source"),
        (known("platform", vocab.PLATFORMS), "unknown platform"),
        (known("category", vocab.EVENT_CATEGORIES), "unknown category"),
        ("coalesce(event_type, '') = ''", "event_type is required"),
        (known("source_reliability", [value for _, value, _ in vocab.RELIABILITY]), "unknown source reliability"),
        ("NOT coalesce(severity BETWEEN 0 AND 100, false)", "severity must be between 0 and 100"),
        ("exists(mitre_techniques, t -> NOT t rlike '^T[0-9.]*[0-9][0-9.]*$')", "invalid technique id"),
        ("exists(mitre_tactics, t -> NOT t rlike '^TA[0-9]+$')", "invalid tactic id"),
    ]
    arms = ", ".join(f"CASE WHEN {bad} THEN '{text}' END" for bad, text in checks)
    return events.withColumn("errors", F.expr(f"array_compact(array({arms}))"))


def valid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("errors") == 0)


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("errors") > 0)


def strict(rows: DataFrame) -> DataFrame:
    """The rows, or a failed job at the first invalid one."""
    # in a filter, which no column selection prunes away
    failed = F.raise_error(F.concat_ws("; ", "errors")).cast("boolean")
    return rows.filter(F.when(F.size("errors") > 0, failed).otherwise(F.lit(True)))


def whole_files_only(rows: DataFrame) -> DataFrame:
    """Rows of files without a single invalid record."""
    bad = quarantine(rows).select("source_file").distinct()
    return rows.join(bad, "source_file", "left_anti").select(*rows.columns)


def accounting(rows: DataFrame, by: list[str]) -> DataFrame:
    """Raw, success and error counts and the success rate per group."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("raw_count"),
        F.count_if(F.size("errors") == 0).alias("success_count"),
        F.count_if(F.size("errors") > 0).alias("error_count"),
        (F.count_if(F.size("errors") == 0) / F.count("*")).alias("success_rate"),
    )


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose event id was not taken in before."""
    return rows.join(seen.select("event_id").distinct(), "event_id", "left_anti").select(*rows.columns)


# -- canonical records -----------------------------------------------------------------------


#: Canonical records as read: times as text, so that every accepted form is parsed alike.
def _loose_schema():
    from pyspark.sql import types as T

    swap = {"timestamp": T.StringType(), "ingested_at": T.StringType(), "metadata": EVENT["metadata"].dataType}
    return T.StructType([T.StructField(f.name, swap.get(f.name, f.dataType)) for f in EVENT.fields])


def canonical_events(rows: DataFrame) -> DataFrame:
    """Canonical JSON records; unknown top-level keys are errors."""
    parsed = rows.withColumn("_e", F.from_json("raw", _loose_schema()))
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    unknown = F.array_except(keys, F.array(*[F.lit(c) for c in EVENT_COLUMNS]))
    given = {c: F.col(f"_e.{c}") for c in EVENT_COLUMNS}
    given["timestamp"] = timestamp(F.col("_e.timestamp"))
    given["ingested_at"] = timestamp(F.col("_e.ingested_at"))
    errors = [
        F.when(~is_object(F.col("raw")), "not an object"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), F.array_join(unknown, ", "))),
    ]
    return _finish(parsed, given, errors)


# -- Wazuh alerts --------------------------------------------------------------------------------

_WAZUH = (
    "id string, timestamp string, location string, "
    "rule struct<id:string,level:string,description:string,groups:array<string>,"
    "mitre:struct<id:string,tactic:string>>, "
    "agent struct<id:string,name:string>, data map<string,string>"
)


def wazuh_events(rows: DataFrame) -> DataFrame:
    """Wazuh alerts: level to severity, rule text to event type, Windows event data to a process."""
    parsed = rows.withColumn("_a", F.from_json("raw", _WAZUH))
    parsed = parsed.withColumn("_win", F.from_json(F.col("_a.data")["win"], "system struct<eventID:string>, eventdata map<string,string>"))
    lower_keys = F.map_from_entries(
        F.transform(
            F.array_sort(F.map_entries(F.col("_win.eventdata"))),
            lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
        )
    )
    parsed = parsed.withColumn("_data", lower_keys)
    rule, agent = F.col("_a.rule"), F.col("_a.agent")
    some = lambda col: F.nullif(col, F.lit(""))
    level = to_int(rule["level"])
    rule_id, rule_name = some(rule["id"]), some(rule["description"])
    kind = F.coalesce(rule_name, F.concat(F.lit("wazuh_event_"), F.coalesce(rule_id, F.lit("unknown"))))
    techniques = F.filter(
        F.transform(_strings(rule["mitre"]["id"]), lambda t: F.upper(F.trim(t))), lambda t: valid_technique(t)
    )
    tactics = F.filter(F.transform(_strings(rule["mitre"]["tactic"]), tactic_id), lambda t: t.isNotNull())
    process = wazuh_process()
    given = {
        "event_id": F.coalesce(some(F.col("_a.id")), F.concat(F.lit("wazuh-"), record_hash())),
        "timestamp": timestamp(F.col("_a.timestamp")),
        "source": F.lit("wazuh"), "source_reliability": F.lit("usually_reliable"),
        "platform": wazuh_platform(), "category": wazuh_category(),
        "event_type": F.replace(F.lower(kind), F.lit(" "), F.lit("_")),
        "severity": wazuh_severity(F.coalesce(level, F.lit(0))),
        "host": F.coalesce(some(agent["name"]), some(agent["id"])),
        "user": some(process["user"]), "process": process,
        "rule_id": rule_id, "rule_name": rule_name, "rule_level": level,
        "mitre_techniques": techniques, "mitre_tactics": tactics,
        "tags": F.transform(rule["groups"], lambda g: F.lower(g)), "raw_data": F.col("raw"),
    }
    return _finish(parsed, given, [F.when(~is_object(F.col("raw")), "not an object")])


def record_hash() -> Column:
    """Short content hash, for records without an id of their own."""
    return F.substring(F.sha2("raw", 256), 1, 16)


def wazuh_platform() -> Column:
    has = lambda key: F.coalesce(F.map_contains_key(F.col("_a.data"), key), F.lit(False))
    place = F.lower(F.coalesce("_a.location", F.lit("")))
    return (
        F.when(has("win"), "windows").when(has("audit") | has("unix"), "linux")
        .when(place.contains("win"), "windows")
        .when(place.contains("linux") | place.contains("ubuntu"), "linux")
        .otherwise("unknown")
    )


def wazuh_category() -> Column:
    """Sysmon id, then an image key, then the rule groups."""
    number = F.col("_win.system.eventID")
    groups = F.coalesce(F.transform(F.col("_a.rule.groups"), lambda g: F.lower(g)), F.array().cast("array<string>"))
    any_of = lambda *names: F.arrays_overlap(groups, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(number == "1", "process").when(number == "3", "network").when(number == "11", "file")
        .when(number.isin("12", "13", "14"), "registry").when(number == "22", "dns")
        .when(F.coalesce(F.map_contains_key(F.col("_data"), "image"), F.lit(False)), "process")
        .when(any_of("process", "sysmon"), "process").when(any_of("network", "firewall"), "network")
        .when(any_of("authentication", "auth"), "authentication").when(any_of("registry"), "registry")
        .otherwise("other")
    )


def wazuh_process() -> Column:
    data = F.col("_data")
    first = lambda *keys: F.coalesce(*[data[k] for k in keys])
    some = lambda col: F.nullif(col, F.lit(""))
    image = some(first("image", "processname", "newprocessname"))
    return F.when(
        image.isNotNull(),
        _context(
            PROCESS, name=basename(image), image_path=image,
            pid=to_int(first("processid", "newprocessid", "pid")),
            parent_pid=to_int(first("parentprocessid", "parentpid", "ppid")),
            parent_name=some(basename(first("parentimage", "parentprocessname"))),
            command_line=some(first("commandline", "command_line")),
            user=some(first("user", "username")),
        ),
    )


def poll_ids(events: DataFrame) -> DataFrame:
    """Event ids as the incremental poll writes them."""
    return events.withColumn("event_id", F.concat(F.lit("wazuh-"), F.col("event_id")))


# -- Sysmon records --------------------------------------------------------------------------------

_SYSMON = (
    "EventID string, UtcTime string, TimeCreated string, Computer string, User string, Image string, "
    "ProcessId string, ParentProcessId string, ParentImage string, CommandLine string, Hashes string"
)


def parse_hashes(text: Column) -> Column:
    """``MD5=a,SHA256=b`` to a map; malformed parts are skipped."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    pairs = F.transform(
        F.filter(parts, lambda p: p.contains("=")),
        lambda p: F.struct(
            F.lower(F.trim(F.substring_index(p, "=", 1))).alias("key"),
            F.lower(F.trim(F.regexp_replace(p, "^[^=]*=", ""))).alias("value"),
        ),
    )
    good = F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != ""))
    # a repeated algorithm keeps its last value
    last = F.filter(
        F.transform(good, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.exists(F.slice(good, e["i"] + 2, F.size(good)), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def sysmon_events(rows: DataFrame) -> DataFrame:
    """Sysmon records: id to category and event type, process when there is one."""
    parsed = rows.withColumn("_s", F.from_json("raw", _SYSMON))
    s = lambda name: F.col(f"_s.{name}")
    some = lambda col: F.nullif(col, F.lit(""))
    number = to_int(s("EventID"))
    image = some(s("Image"))
    process = F.when(
        (number == 1) | image.isNotNull(),
        _context(
            PROCESS, name=basename(image), pid=to_int(s("ProcessId")), parent_pid=to_int(s("ParentProcessId")),
            parent_name=some(basename(s("ParentImage"))), command_line=s("CommandLine"), image_path=s("Image"),
            user=some(s("User")), hashes=parse_hashes(s("Hashes")),
        ),
    )
    given = {
        "event_id": F.concat(
            F.lit("sysmon-"), record_hash(), F.lit("-"), F.coalesce(number.cast("string"), F.lit("unknown"))
        ),
        "timestamp": timestamp(F.coalesce(some(s("UtcTime")), s("TimeCreated"))),
        "source": F.lit("sysmon"), "source_reliability": F.lit("completely_reliable"),
        "platform": F.lit("windows"),
        "category": F.coalesce(lookup(number, vocab.SYSMON_CATEGORY), F.lit("other")),
        "event_type": F.coalesce(lookup(number, vocab.SYSMON_EVENT_TYPE), F.lit("sysmon_event")),
        "severity": F.lit(vocab.SYSMON_SEVERITY), "host": some(s("Computer")), "user": some(s("User")),
        "process": process, "raw_data": F.col("raw"),
    }
    return _finish(parsed, given, [F.when(~is_object(F.col("raw")), "not an object")])


# -- mixed input -------------------------------------------------------------------------------------


def record_format(raw: Column) -> Column:
    """canonical, wazuh, sysmon or unknown, decided for every record by its keys."""
    keys = F.json_object_keys(raw)
    has = lambda *names: F.array_size(F.array_intersect(keys, F.array(*[F.lit(n) for n in names]))) == len(names)
    return (
        F.when(has("event_id", "source", "event_type"), "canonical")
        .when(has("rule", "agent") | has("rule", "manager") | has("rule", "id", "timestamp"), "wazuh")
        .when(has("EventID", "UtcTime") | has("EventID", "Image"), "sysmon")
        .otherwise("unknown")
    )


#: Normaliser per format; add to a copy of it for formats of your own.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "canonical": canonical_events,
    "wazuh": wazuh_events,
    "sysmon": sysmon_events,
}


def normalize(rows: DataFrame, normalizers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Records of any known format to canonical events; unknown ones carry an error."""
    normalizers = NORMALIZERS if normalizers is None else normalizers
    marked = rows.withColumn("format", record_format(F.col("raw")))
    unknown = marked.filter(~F.col("format").isin(list(normalizers)))
    out = _finish(unknown, {"raw_data": F.col("raw")}, [F.lit("unrecognized event format")])
    for name, normalizer in normalizers.items():
        out = out.unionByName(normalizer(marked.filter(F.col("format") == name)))
    return out

