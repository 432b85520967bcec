"""Content hashes and ids as column expressions.

Canonical JSON is ``to_json`` over a struct whose fields are declared in key
order, nulls kept, so equal content always gives equal text and equal hashes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.text import collapse_space


def canonical_json(**fields: Column) -> Column:
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def content_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def uuid5_digest_sql(namespace: str, name: str) -> str:
    """SHA-1 behind a version 5 UUID, as SQL text."""
    return f"sha1(concat(unhex('{namespace.replace('-', '')}'), encode({name}, 'UTF-8')))"


def uuid5_text_sql(digest: str) -> str:
    """Version 5 UUID text of a digest column."""
    variant = f"substring('89ab', CAST(conv(substring({digest}, 17, 1), 16, 10) AS INT) % 4 + 1, 1)"
    return (
        f"concat(substring({digest}, 1, 8), '-', substring({digest}, 9, 4), '-5', substring({digest}, 14, 3), "
        f"'-', {variant}, substring({digest}, 18, 3), '-', substring({digest}, 21, 12))"
    )


def uuid5(namespace: str, name: str) -> Column:
    """Name-based UUID, version 5, of a text expression."""
    return F.expr(uuid5_text_sql(uuid5_digest_sql(namespace, name)))


def json_sql(**fields: str) -> str:
    """Canonical JSON of SQL expressions: keys sorted, nulls kept."""
    pairs = ", ".join(f"'{name}', {fields[name]}" for name in sorted(fields))
    return f"to_json(named_struct({pairs}), map('ignoreNullFields', 'false'))"


def entity_json_sql(
    kind: str, value: str, tenant: str = "tenant_id", host: str = "host",
    scope: str = "identity_scope", domain: str = "identity_domain", algorithm: str = "hash_algorithm",
) -> str:
    """Canonical identity of an entity of one type; which fields take part depends on it."""
    common = {
        "entity_type": f"'{kind}'", "schema_version": f"'{vocab.SCHEMA_VERSION}'",
        "tenant_id": f"CAST({tenant} AS STRING)",
    }
    if kind in vocab.OCCURRENCE_ENTITY_TYPES:
        return json_sql(record_id=f"trim({value})", **common)
    common["normalized_value"] = value
    host = f"lower(coalesce({host}, ''))"
    if kind in vocab.HOST_SCOPED_ENTITY_TYPES:
        return json_sql(host=host, **common)
    if kind == "hash":
        return json_sql(hash_algorithm=f"coalesce({algorithm}, '')", **common)
    if kind == "user":
        local = json_sql(host=host, identity_scope="'local'", **common)
        in_domain = json_sql(identity_domain=f"coalesce({domain}, '')", identity_scope="'domain'", **common)
        return f"CASE WHEN {scope} = 'domain' THEN {in_domain} ELSE {local} END"
    return json_sql(**common)


def entity_fingerprint() -> Column:
    """Identity hash of entity rows, from their own columns."""
    cases = " ".join(
        f"WHEN '{kind}' THEN " + entity_json_sql(kind, "value" if kind in vocab.OCCURRENCE_ENTITY_TYPES else "normalized_value")
        for kind in vocab.ENTITY_TYPES
    )
    return F.expr(f"sha2(CASE entity_type {cases} END, 256)")


def relationship_fingerprint() -> Column:
    """Identity hash of edge rows, from their own columns."""
    names = ["tenant_id", "source_type", "source_id", "relationship_type", "target_type", "target_id"]
    json = json_sql(schema_version=f"'{vocab.SCHEMA_VERSION}'", **{n: n for n in names})
    return F.expr(f"sha2({json}, 256)")


def hypothesis_fingerprint(tenant: Column, kind: Column, statement: Column) -> Column:
    return content_hash(
        schema_version=F.lit(vocab.SCHEMA_VERSION), tenant_id=tenant, hypothesis_type=kind,
        statement=collapse_space(statement),
    )


def event_fingerprint() -> Column:
    """Content hash of an event without its ids and times."""
    json = json_sql(
        source="source", platform="platform", category="category", event_type="event_type", host="host", user="`user`",
        process_name="process.name", process_pid="process.pid", parent_name="process.parent_name",
        command_line="process.command_line", file_path="file.path", registry_key="registry.key",
        src_ip="network.source_ip", dst_ip="network.destination_ip", rule_id="rule_id",
    )
    return F.expr(f"sha2({json}, 256)")


def process_identity_sql(name: str, guid: str, pid: str) -> str:
    """Process identity: name with guid, else with pid, else the name alone."""
    return (
        f"concat(lower({name}), CASE WHEN {guid} IS NOT NULL THEN concat('|guid:', lower({guid})) "
        f"WHEN {pid} IS NOT NULL THEN concat('|pid:', {pid}) ELSE '' END)"
    )


def process_quality_sql(guid: str, pid: str) -> str:
    return f"CASE WHEN {guid} IS NOT NULL THEN 'guid' WHEN {pid} IS NOT NULL THEN 'pid' ELSE 'name_only' END"
