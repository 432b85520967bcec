"""Entities, relationships and walks over them.

Ids are content hashes computed where the row is made, so edges never need a
join to find their ends. Provenance (which event saw which entity) is a table of
its own instead of a list inside the entity: an entity seen by a third of all
events then costs one row in ``entities`` and is spread over all tasks in
``entity_events``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions import identity
from casewright.functions.joins import null_safe
from casewright.session import cut_lineage

#: Sort rank of the entity types in reports.
ENTITY_RANK = [
    "host", "user", "process", "file", "hash", "ip", "domain", "mitre_technique",
    "registry", "url", "alert", "event", "evidence",
]
#: Frontiers up to this many rows are broadcast; larger ones are shuffle-joined.
BROADCAST_ROWS = 100_000


# -- extraction ---------------------------------------------------------------------------


def _parts(events: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The cleaned event fields that entities and edges are made of."""
    clean = lambda x: f"nullif(trim({x}), '')"
    file_value = f"coalesce({clean('file.path')}, {clean('file.name')})"
    dns = f"nullif(regexp_replace(lower({clean('dns.query')}), '[.]+$', ''), '')"
    own_domain = f"nullif(regexp_replace(lower({clean('domain')}), '[.]+$', ''), '')"
    rows = events.selectExpr(
        *scope, *[c for c in ("tenant_id",) if c not in scope], "event_id", "timestamp", "category",
        f"{clean('host')} AS host_text", f"lower({clean('host')}) AS host_key", f"{clean('`user`')} AS user_text",
        f"lower({clean('user_context.domain')}) AS user_domain",
        f"{clean('process.name')} AS child_name", f"{clean('process.guid')} AS child_guid", "process.pid AS child_pid",
        f"{clean('process.parent_name')} AS parent_name", f"{clean('process.parent_guid')} AS parent_guid",
        "process.parent_pid AS parent_pid", f"{clean('process.image_path')} AS image_path",
        f"{file_value} AS file_text",
        f"CASE WHEN platform = 'windows' THEN lower({file_value}) ELSE {file_value} END AS file_key",
        "file.size AS file_size", "file.signed AS file_signed", "file.signer AS file_signer", "file.extension AS file_extension",
        "filter(transform(coalesce(map_entries(file.hashes), array()), e -> named_struct("
        "'algorithm', lower(nullif(trim(e.key), '')), 'value', nullif(trim(e.value), ''))), "
        "e -> e.algorithm IS NOT NULL AND e.value IS NOT NULL) AS hash_list",
        f"{clean('network.source_ip')} AS source_ip", f"{clean('network.destination_ip')} AS destination_ip",
        f"{clean('domain')} AS domain_text", f"{own_domain} AS domain_key",
        f"{clean('dns.query')} AS dns_text", f"{dns} AS dns_key",
        f"{clean('registry.key')} AS registry_text", "registry.is_persistence_key AS registry_flag",
        "coalesce(mitre_techniques, array()) AS technique_list",
    )
    child = identity.process_identity_sql("child_name", "child_guid", "child_pid")
    parent = identity.process_identity_sql("parent_name", "parent_guid", "parent_pid")
    return rows.selectExpr(
        "*", f"CASE WHEN host_key IS NOT NULL THEN {child} END AS child_key",
        f"CASE WHEN host_key IS NOT NULL THEN {parent} END AS parent_key",
        "CASE WHEN host_key IS NOT NULL OR user_domain IS NOT NULL THEN lower(user_text) END AS user_key",
        "CASE WHEN user_domain IS NOT NULL THEN 'domain' ELSE 'local' END AS user_scope",
    )


_ENTRIES = "array<struct<key:string,value:string>>"


def _properties(**values: str) -> str:
    """Keys and values as text, nulls among them."""
    entries = ", ".join(f"named_struct('key', '{k}', 'value', CAST({v} AS STRING))" for k, v in values.items())
    return f"array({entries})"


def _node(
    kind: str, value: str, normalized: str, host: str = "NULL", scope: str = "NULL", domain: str = "NULL",
    algorithm: str = "NULL", role: str = "", properties: str = "NULL", hashed: bool = True,
) -> str:
    """One mention as SQL text; null when the event has no such entity."""
    json = identity.entity_json_sql(kind, normalized, host=host, scope=scope, domain=domain, algorithm=algorithm)
    fingerprint = f", 'fingerprint', sha2({json}, 256)" if hashed else ""
    text = lambda x: f"CAST({x} AS STRING)"
    return (
        f"CASE WHEN {normalized} IS NOT NULL THEN named_struct('entity_type', '{kind}', 'value', {value}, "
        f"'normalized_value', {normalized}, 'host', {text(host)}, 'identity_scope', {text(scope)}, "
        f"'identity_domain', {text(domain)}, 'hash_algorithm', {text(algorithm)}, 'role', '{role}', "
        f"'_entries', CAST({properties} AS {_ENTRIES}){fingerprint}) END"
    )


def _raw_mentions(events: DataFrame, scope: Sequence[str], registry_keys: bool = False, hashed: bool = False) -> DataFrame:
    """One row per entity an event mentions; ``hashed`` adds its fingerprint."""
    node = partial(_node, hashed=hashed)
    local_host = "CASE WHEN user_domain IS NULL THEN host_key END"
    nodes = [
        node("host", "host_text", "host_key"),
        node("user", "user_text", "user_key", host=local_host, scope="user_scope", domain="user_domain"),
        node(
            "process", "child_name", "child_key", host="host_key", role="child",
            properties=_properties(
                identity_quality=identity.process_quality_sql("child_guid", "child_pid"), pid="child_pid",
                parent_pid="parent_pid", guid="child_guid", image_path="image_path",
            ),
        ),
        node(
            "process", "parent_name", "parent_key", host="host_key", role="parent",
            properties=_properties(
                identity_quality=identity.process_quality_sql("parent_guid", "parent_pid"), pid="parent_pid",
                guid="parent_guid",
            ),
        ),
        node(
            "file", "file_text", "file_key", host="host_key",
            properties=_properties(size="file_size", signed="file_signed", signer="file_signer", extension="file_extension"),
        ),
        node("ip", "source_ip", "source_ip", role="source"),
        node("ip", "destination_ip", "destination_ip", role="destination"),
        node("domain", "domain_text", "domain_key"),
        node("domain", "dns_text", "dns_key"),
    ]
    if registry_keys:
        nodes.append(
            node(
                "registry", "registry_text", "CASE WHEN host_key IS NOT NULL THEN lower(registry_text) END",
                host="host_key", properties=_properties(is_persistence_key="registry_flag"),
            )
        )
    hashes = f"transform(hash_list, e -> {node('hash', 'e.value', 'lower(e.value)', algorithm='e.algorithm')})"
    techniques = (
        "transform(filter(transform(technique_list, t -> nullif(trim(t), '')), t -> t IS NOT NULL), "
        f"t -> {node('mitre_technique', 't', 'upper(t)')})"
    )
    carried = [*scope, *[c for c in ("tenant_id",) if c not in scope], "event_id", "timestamp"]
    every = f"array_compact(concat(array({', '.join(nodes)}), {hashes}, {techniques}))"
    return _parts(events, scope).selectExpr(*carried, f"inline({every})")


#: What the identity of a mention is made of.
_IDENTITY = ["entity_type", "normalized_value", "host", "identity_scope", "identity_domain", "hash_algorithm"]
#: Types that events mention.
_MENTIONED = ["host", "user", "process", "file", "ip", "domain", "registry", "hash", "mitre_technique"]


def _with_ids(rows: DataFrame) -> DataFrame:
    """Add fingerprint and entity id of rows with the identity of a mention."""
    kinds = " ".join(f"WHEN '{k}' THEN {identity.entity_json_sql(k, 'normalized_value')}" for k in _MENTIONED)
    return _with_entity_id(rows.selectExpr("*", f"sha2(CASE entity_type {kinds} END, 256) AS fingerprint"))


def _with_entity_id(rows: DataFrame) -> DataFrame:
    digest = identity.uuid5_digest_sql(vocab.ENTITY_NAMESPACE, "fingerprint")
    return rows.selectExpr("*", f"{digest} AS _d").selectExpr(*rows.columns, f"{identity.uuid5_text_sql('_d')} AS entity_id")


_FILLED = "filter(_entries, e -> e.value IS NOT NULL)"


def mentions(events: DataFrame, scope: Sequence[str] = (), registry_keys: bool = False) -> DataFrame:
    """One row per entity an event mentions, with fingerprint and entity id.

    ``scope`` columns (for example ``case_id``) are carried along.
    ``registry_keys`` adds registry entities, which are off by default.
    """
    rows = _raw_mentions(events, scope, registry_keys, hashed=True)
    plain = [c for c in rows.columns if c not in ("_entries", "fingerprint")]
    return _with_entity_id(rows.selectExpr(*plain, f"map_from_entries({_FILLED}) AS properties", "fingerprint"))


def _entities(raw: DataFrame, scope: Sequence[str]) -> DataFrame:
    """``resolve_entities`` of what events mention, in one pass.

    Mentions that are equal but for event and time become one row before anything is hashed. The last value of
    every property is found beside the entity itself, which is the row without a key.
    """
    tenant = [c for c in ("tenant_id",) if c not in scope]
    same = [*scope, *tenant, *_IDENTITY, "value", "role", "_entries"]
    when = F.struct("timestamp", "event_id")
    # a number first: rows are sorted by it
    alike = raw.groupBy(F.xxhash64(*same).alias("_hash"), *same).agg(
        F.min(when).alias("_first"), F.max(when).alias("_last"), F.count("*").alias("_n"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    base = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    entries = F.concat(base, F.coalesce(F.expr(_FILLED), F.array().cast(_ENTRIES)))
    keys = [*scope, "fingerprint", "entity_type"]
    plain = ["entity_id", *tenant, *[c for c in _IDENTITY if c != "entity_type"]]
    each = _with_ids(alike).select("*", F.explode(entries).alias("_p")).groupBy(*keys, F.col("_p.key").alias("_k")).agg(
        *[F.first(c).alias(c) for c in plain], F.min_by("value", F.struct("_first", "role")).alias("value"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("_n").alias("mention_count"),
        F.max_by("_p.value", F.struct("_last", "role")).alias("_v"),
    )
    counts = [*plain, "value", "first_seen", "last_seen", "mention_count"]
    merged = each.groupBy(*keys).agg(
        *[F.first(F.when(F.col("_k").isNull(), F.col(c)), ignorenulls=True).alias(c) for c in counts],
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v"))))).alias("properties"),
    )
    return merged.select(
        *scope, "fingerprint", "entity_id", *tenant, "entity_type", "value", "normalized_value", "host", "identity_scope",
        "identity_domain", "hash_algorithm", "first_seen", "last_seen", "mention_count",
        F.when(F.size("properties") > 0, F.col("properties")).alias("properties"),
    )


STRENGTH_POLICIES = ("max", "avg", "left", "right")
CONFLICT_POLICIES = ("left", "right", "raise")


def _lists(value: Column) -> Column:
    """The items of a JSON list as JSON texts; null for any other text."""
    items = F.from_json(value, "array<variant>", {"mode": "PERMISSIVE"})
    return F.when(F.trim(value).rlike(r"(?s)^\[.*\]$"), F.transform(items, lambda v: F.to_json(v)))


def merged_column(
    rows: DataFrame, keys: Sequence[str], column: str, order: Sequence[str], on_conflict: str = "right", unite: bool = False,
) -> DataFrame:
    """(keys, column) with the maps of a group merged key by key, or its lists united.

    Of several values of one map key the last by ``order`` counts (``right``) or the first
    (``left``); ``raise`` fails the job on two different ones. With ``unite`` values that are JSON lists are
    united, items in order of their first appearance, unless a value that is no list came between. A group without any
    entry has no row. Entries are combined before the shuffle; a merged map holds each key once.
    """
    if on_conflict not in CONFLICT_POLICIES:
        raise ValueError(f"on_conflict must be one of {CONFLICT_POLICIES}")
    if rows.schema[column].dataType.typeName() == "array":
        return rows.select(*keys, F.explode(column).alias("_v")).groupBy(*keys).agg(F.array_sort(F.collect_set("_v")).alias(column))
    each = rows.select(*keys, F.struct(*order).alias("_o"), F.explode(column).alias("_k", "_v")).filter("_v IS NOT NULL")
    value = F.min_by("_v", "_o") if on_conflict == "left" else F.max_by("_v", "_o")
    if on_conflict == "raise":
        value = F.when(F.min("_v") == F.max("_v"), value).otherwise(F.raise_error(F.lit("property conflict")))
    if not unite:
        one = each.groupBy(*keys, "_k").agg(value.alias("_v"))
    else:
        each = each.withColumn("_items", _lists(F.col("_v")))
        plain = F.when(F.col("_items").isNull(), F.col("_o"))
        one = each.groupBy(*keys, "_k").agg(value.alias("_v"), F.max(plain).alias("_plain"), F.count("_items").alias("_n"))
        several = one.filter("_n > 1").select(*keys, "_k", "_plain")
        listed = null_safe(each.filter("_items IS NOT NULL").select(*keys, "_k", "_o", "_items"), several, [*keys, "_k"])
        after = listed.filter(F.col("_plain").isNull() | (F.col("_o") > F.col("_plain")))
        items = after.select(*keys, "_k", "_o", F.posexplode("_items").alias("_at", "_item"))
        first = items.groupBy(*keys, "_k", "_item").agg(F.min(F.struct("_o", "_at")).alias("_first"))
        united = first.groupBy(*keys, "_k").agg(F.array_sort(F.collect_list(F.struct("_first", "_item"))).alias("_all"))
        text = F.concat(F.lit("["), F.concat_ws(",", F.transform("_all", lambda x: x["_item"])), F.lit("]"))
        joined = null_safe(one, united.select(*keys, "_k", text.alias("_united")), [*keys, "_k"], "left")
        one = joined.withColumn("_v", F.coalesce("_united", "_v"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(column))


def _with_merged(
    out: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], on_properties: str, on_metadata: str, unite: bool = False,
) -> DataFrame:
    """``out`` (one row per group) with merged properties, metadata and tags, where ``rows`` have them."""
    for column, policy in (("properties", on_properties), ("metadata", on_metadata), ("tags", "right")):
        if column in rows.columns:
            merged = merged_column(rows, keys, column, order, policy, unite and column == "properties")
            out = null_safe(out, merged, keys, "left")
    return out


def resolve_entities(
    mentioned: DataFrame, scope: Sequence[str] = (), on_metadata_conflict: str = "left", unite_lists: bool = True,
) -> DataFrame:
    """Merge mentions with one identity into one entity.

    The value is that of the first mention by (timestamp, event_id). Of two values of one property the last
    counts, lists are united; of two values in the metadata the first counts, unless ``on_metadata_conflict`` says right or
    raise. Tags are united. A null scope is a scope of its own.
    """
    order = F.struct("timestamp", "event_id", "role")
    out = mentioned.groupBy(*scope, "fingerprint").agg(
        F.first("entity_id").alias("entity_id"),
        F.first("tenant_id").alias("tenant_id") if "tenant_id" not in scope else F.count("*").alias("_n"),
        F.first("entity_type").alias("entity_type"),
        F.min_by("value", order).alias("value"),
        F.first("normalized_value").alias("normalized_value"),
        F.first("host").alias("host"),
        F.first("identity_scope").alias("identity_scope"),
        F.first("identity_domain").alias("identity_domain"),
        F.first("hash_algorithm").alias("hash_algorithm"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count("*").alias("mention_count"),
    ).drop("_n")
    return _with_merged(
        out, mentioned, [*scope, "fingerprint"], ["timestamp", "event_id", "role"], "right", on_metadata_conflict, unite_lists
    )


def entity_events(mentioned: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Provenance: which event mentions which entity, once."""
    return mentioned.select(*scope, "entity_id", "event_id").distinct()


def entity_errors() -> Column:
    """Identity rules an entity row breaks; an empty list means valid."""
    kind, scope = F.col("entity_type"), F.col("identity_scope")
    is_user, is_hash = kind == "user", kind == "hash"
    checks = [
        (~kind.isin(vocab.ENTITY_TYPES), "unknown entity type"),
        (F.col("first_seen") > F.col("last_seen"), "first_seen is after last_seen"),
        (is_user & ~F.coalesce(scope.isin("local", "domain"), F.lit(False)), "user needs scope local or domain"),
        (is_user & (scope == "domain") & F.col("identity_domain").isNull(), "domain user needs a domain"),
        (is_user & (scope == "local") & F.col("host").isNull(), "local user needs a host"),
        (is_hash & F.col("hash_algorithm").isNull(), "hash needs an algorithm"),
        (~is_user & scope.isNotNull(), "only users have a scope"),
        (~is_user & F.col("identity_domain").isNotNull(), "only users have a domain"),
        (~is_hash & F.col("hash_algorithm").isNotNull(), "only hashes have an algorithm"),
    ]
    return F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks]))


def entity_flags(entities: DataFrame) -> DataFrame:
    kind = F.col("entity_type")
    return entities.withColumns(
        {
            "is_occurrence": kind.isin(vocab.OCCURRENCE_ENTITY_TYPES),
            "is_substantive": ~kind.isin(vocab.OCCURRENCE_ENTITY_TYPES),
            "is_global": kind.isin(vocab.GLOBAL_ENTITY_TYPES),
            "is_host_scoped": kind.isin(vocab.HOST_SCOPED_ENTITY_TYPES)
            | ((kind == "user") & F.coalesce(F.col("identity_scope") == "local", F.lit(False))),
        }
    )


def entity_sort_key() -> list[Column]:
    rank = F.array_position(F.array(*[F.lit(t) for t in ENTITY_RANK]), F.col("entity_type"))
    text = [
        F.coalesce(F.col(c), F.lit(""))
        for c in ("normalized_value", "hash_algorithm", "identity_scope", "identity_domain", "host", "fingerprint")
    ]
    return [rank, *text]


def with_entity_fingerprint_check(entities: DataFrame) -> DataFrame:
    """Add ``fingerprint_ok``: does the stored identity hash match the fields?"""
    return entities.withColumn("fingerprint_ok", F.col("fingerprint") == identity.entity_fingerprint())


# -- relationships ------------------------------------------------------------------------


def edges(events: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per relationship an event shows.

    spawned (parent to child), run_as (process to user), has_hash (file to hash),
    connected_to (process to destination address, network events only). Both ends
    are the event's own entities, so their ids are computed in the same row.
    """
    def digest(kind: str, value: str, **fields: str) -> str:
        fields = {"host": "NULL", "scope": "NULL", "domain": "NULL", "algorithm": "NULL", **fields}
        hashed = f"sha2({identity.entity_json_sql(kind, value, **fields)}, 256)"
        return f"CASE WHEN {value} IS NOT NULL THEN {identity.uuid5_digest_sql(vocab.ENTITY_NAMESPACE, hashed)} END"

    carried = [*scope, *[c for c in ("tenant_id",) if c not in scope], "event_id", "timestamp"]
    digests = _parts(events, scope).selectExpr(
        *carried, "category",
        f"{digest('process', 'child_key', host='host_key')} AS child",
        f"{digest('process', 'parent_key', host='host_key')} AS parent",
        f"{digest('user', 'user_key', host='host_key', scope='user_scope', domain='user_domain')} AS actor",
        f"{digest('ip', 'destination_ip')} AS address",
        f"{digest('file', 'file_key', host='host_key')} AS file_end",
        f"transform(hash_list, e -> {digest('hash', 'lower(e.value)', algorithm='e.algorithm')}) AS hash_ends",
    )

    def link(kind: str, source: str, target: str, also: str = "true") -> str:
        return (
            f"CASE WHEN {also} AND {source} <> {target} THEN named_struct('source_id', {identity.uuid5_text_sql(source)}, "
            f"'relationship_type', '{kind}', 'target_id', {identity.uuid5_text_sql(target)}) END"
        )

    made = [
        link("spawned", "parent", "child"), link("run_as", "child", "actor"),
        link("connected_to", "child", "address", "category IN ('network', 'http')"),
    ]
    hashes = f"transform(hash_ends, h -> {link('has_hash', 'file_end', 'h')})"
    rows = digests.selectExpr(
        *carried, f"inline(array_compact(concat(array({', '.join(made)}), {hashes})))",
    )
    return rows.selectExpr(
        "*", "'entity' AS source_type", "'entity' AS target_type", "1.0D AS weight", "1.0D AS confidence"
    ).withColumn("fingerprint", identity.relationship_fingerprint())


def _raw_edges(events: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per relationship an event shows, with what its ends are made of instead of their ids."""
    def link(kind: str, source: str, target: str, also: str = "true", algorithm: str = "NULL") -> str:
        return (
            f"CASE WHEN {also} AND {source} IS NOT NULL AND {target} IS NOT NULL THEN named_struct('relationship_type', '{kind}', "
            f"'_source', {source}, '_target', {target}, '_algorithm', CAST({algorithm} AS STRING)) END"
        )

    made = [
        link("spawned", "parent_key", "child_key", "parent_key <> child_key"), link("run_as", "child_key", "user_key"),
        link("connected_to", "child_key", "destination_ip", "category IN ('network', 'http')"),
    ]
    hashes = f"transform(hash_list, e -> {link('has_hash', 'file_key', 'lower(e.value)', algorithm='e.algorithm')})"
    carried = [*scope, *[c for c in ("tenant_id",) if c not in scope], "event_id", "timestamp", "host_key", "user_scope", "user_domain"]
    return _parts(events, scope).selectExpr(*carried, f"inline(array_compact(concat(array({', '.join(made)}), {hashes})))")


_ENDS = ["relationship_type", "_source", "_target", "_algorithm", "host_key", "user_scope", "user_domain"]


def _with_ends(raw: DataFrame) -> DataFrame:
    """Edges with the ids of their ends and their fingerprint."""
    def end(kinds: dict[str, str], value: str) -> str:
        fields = {"host": "host_key", "scope": "user_scope", "domain": "user_domain", "algorithm": "_algorithm"}
        arms = " ".join(f"WHEN '{name}' THEN {identity.entity_json_sql(kind, value, **fields)}" for name, kind in kinds.items())
        return identity.uuid5_digest_sql(vocab.ENTITY_NAMESPACE, f"sha2(CASE relationship_type {arms} END, 256)")

    sources = {"spawned": "process", "run_as": "process", "connected_to": "process", "has_hash": "file"}
    targets = {"spawned": "process", "run_as": "user", "connected_to": "ip", "has_hash": "hash"}
    others = [c for c in raw.columns if c not in _ENDS]
    rows = raw.selectExpr(*others, "relationship_type", f"{end(sources, '_source')} AS _s", f"{end(targets, '_target')} AS _t")
    return rows.selectExpr(
        *others, f"{identity.uuid5_text_sql('_s')} AS source_id", "relationship_type", f"{identity.uuid5_text_sql('_t')} AS target_id",
        "'entity' AS source_type", "'entity' AS target_type", "1.0D AS weight", "1.0D AS confidence",
    ).withColumn("fingerprint", identity.relationship_fingerprint())


def _relationships(raw: DataFrame, scope: Sequence[str]) -> DataFrame:
    """``resolve_relationships`` of what events show; equal edges become one row before anything is hashed."""
    tenant = [c for c in ("tenant_id",) if c not in scope]
    alike = raw.groupBy(*scope, *tenant, *_ENDS).agg(
        F.count("*").alias("_n"), F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to")
    )
    same = [*tenant, "source_type", "source_id", "relationship_type", "target_type", "target_id"]
    return _with_ends(alike).groupBy(*scope, "fingerprint").agg(
        *[F.first(c).alias(c) for c in same], F.max("weight").alias("weight"), F.max("confidence").alias("confidence"),
        F.min("_from").alias("first_seen"), F.max("_to").alias("last_seen"), F.sum("_n").alias("event_count"),
    )


def with_relationship_fingerprint(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fingerprint", identity.relationship_fingerprint())




def resolve_relationships(
    rows: DataFrame, scope: Sequence[str] = (), on_strength: str = "max", on_property_conflict: str = "left",
    on_metadata_conflict: str = "left",
) -> DataFrame:
    """Merge edges with one identity; first and last seen widen over all of them.

    Properties and metadata, where edges have them, are merged key by key (``merged_column``): of two values the first
    counts, unless a policy says right or raise. Tags are united. A null scope is a scope of its own.

    ``on_strength`` combines weight and confidence: the largest, the first, the last
    by (timestamp, event_id), or the running pairwise mean (``avg``), in which each
    later edge counts half of all that came before it.
    """
    if on_strength not in STRENGTH_POLICIES:
        raise ValueError(f"on_strength must be one of {STRENGTH_POLICIES}")
    order = F.struct("timestamp", "event_id")
    combine = {
        "max": lambda c: F.max(c),
        "left": lambda c: F.min_by(c, order),
        "right": lambda c: F.max_by(c, order),
    }
    keys, by_time = [*scope, "fingerprint"], ["timestamp", "event_id"]
    if on_strength == "avg":
        return _with_merged(_resolve_pairwise_mean(rows, scope), rows, keys, by_time, on_property_conflict, on_metadata_conflict)
    keep = [] if "tenant_id" in scope else [F.first("tenant_id").alias("tenant_id")]
    out = rows.groupBy(*keys).agg(
        *keep,
        F.first("source_type").alias("source_type"), F.first("source_id").alias("source_id"),
        F.first("relationship_type").alias("relationship_type"),
        F.first("target_type").alias("target_type"), F.first("target_id").alias("target_id"),
        combine[on_strength]("weight").alias("weight"),
        combine[on_strength]("confidence").alias("confidence"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count("*").alias("event_count"),
    )
    return _with_merged(out, rows, keys, by_time, on_property_conflict, on_metadata_conflict)


#: Past this many edges the oldest ones weigh less than the spacing of doubles.
_MEAN_TERMS = 1100


def _resolve_pairwise_mean(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """``avg`` policy without an ordered fold over the group.

    Folding (a + b) / 2 in order gives every edge the weight 2^-(edges after it + 1),
    and the first edge the weight of the second. With the row index that is a
    plain sum, so a group may be spread over many tasks.
    """
    from casewright.functions.ordered import with_row_index

    keys = [*scope, "fingerprint"]
    indexed = with_row_index(rows, keys, ["timestamp", "event_id"])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    behind = F.col("n") - 1 - F.col("row_index")
    share = F.pow(
        F.lit(2.0), -F.least(behind + F.when(F.col("row_index") == 0, 0).otherwise(1), F.lit(_MEAN_TERMS))
    )
    shared = null_safe(indexed, sizes, keys).withColumn("share", share)
    keep = [] if "tenant_id" in scope else [F.first("tenant_id").alias("tenant_id")]
    return shared.groupBy(*keys).agg(
        *keep,
        F.first("source_type").alias("source_type"), F.first("source_id").alias("source_id"),
        F.first("relationship_type").alias("relationship_type"),
        F.first("target_type").alias("target_type"), F.first("target_id").alias("target_id"),
        F.sum(F.col("weight") * F.col("share")).alias("weight"),
        F.sum(F.col("confidence") * F.col("share")).alias("confidence"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count("*").alias("event_count"),
    )


def merge_maps(left: Column, right: Column, policy: str = "left") -> Column:
    """Merge two maps; keys with two values follow the policy."""
    if policy not in CONFLICT_POLICIES:
        raise ValueError(f"policy must be one of {CONFLICT_POLICIES}")
    first, second = (left, right) if policy != "right" else (right, left)
    merged = F.map_concat(first, F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k)))
    if policy != "raise":
        return merged
    conflict = F.exists(
        F.map_keys(right), lambda k: F.map_contains_key(left, k) & ~left[k].eqNullSafe(right[k])
    )
    return F.when(conflict, F.raise_error(F.lit("property conflict"))).otherwise(merged)


def relationship_errors() -> Column:
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    checks = [
        (~filled("source_id") | ~filled("target_id"), "both ends are required"),
        (
            (F.col("source_id") == F.col("target_id")) & (F.col("source_type") == F.col("target_type")),
            "an edge must not join a node to itself",
        ),
        (F.col("first_seen") > F.col("last_seen"), "first_seen is after last_seen"),
        (~F.col("relationship_type").isin([t for t, _ in vocab.RELATIONSHIP_TYPES]), "unknown relationship type"),
    ]
    return F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks]))


def relationship_sort_key() -> list[Column]:
    """Order of edges: type, then both ends."""
    return [F.col(c) for c in ("relationship_type", "source_type", "source_id", "target_type", "target_id")]


def relationship_flags(relationships: DataFrame) -> DataFrame:
    from casewright.functions.text import lookup

    kind = F.col("relationship_type")
    symmetric = [k for k, v in vocab.INVERSE_RELATIONSHIP.items() if k == v]
    return relationships.withColumn("category", lookup(kind, dict(vocab.RELATIONSHIP_TYPES))).withColumns(
        {
            "is_symmetric": kind.isin(symmetric),
            "is_investigation": F.col("category") == "investigation",
            "is_high_weight": F.col("weight") >= 0.75,
            "is_high_confidence": F.col("confidence") >= 0.75,
        }
    )


def reverse(relationships: DataFrame) -> DataFrame:
    """Turned edges, only for types with a defined inverse."""
    from casewright.functions.text import lookup

    turned = relationships.withColumn(
        "_inverse", lookup(F.col("relationship_type"), vocab.INVERSE_RELATIONSHIP)
    ).filter(F.col("_inverse").isNotNull())
    out = turned.withColumns(
        {
            "source_id": F.col("target_id"), "source_type": F.col("target_type"),
            "target_id": F.col("source_id"), "target_type": F.col("source_type"),
            "relationship_type": F.col("_inverse"),
        }
    ).drop("_inverse")
    return with_relationship_fingerprint(out)


# -- whole graph --------------------------------------------------------------------------


def build(events: DataFrame, scope: Sequence[str] = (), registry_keys: bool = False) -> dict[str, DataFrame]:
    """Entities, their provenance and the relationships of a set of events."""
    return {
        # what events say of an entity is never a list
        "entities": _entities(_raw_mentions(events, scope, registry_keys), scope),
        "entity_events": entity_events(mentions(events, scope, registry_keys), scope),
        "relationships": _relationships(_raw_edges(events, scope), scope),
    }


def _sides(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both tables, ``_side`` telling the stored one (0) from the fresh one (1)."""
    return stored.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)))


def extend_entities(stored: DataFrame, fresh: DataFrame, scope: Sequence[str] = (), on_metadata_conflict: str = "left") -> DataFrame:
    """Merge two resolved entity tables; the same rules as for single mentions, the stored table coming first.

    So of two values of one property the fresh one counts, lists are united, and the stored metadata stays.

    The provenance tables must not overlap for ``mention_count`` to stay exact.
    """
    rows = _sides(stored, fresh)
    first = F.struct("first_seen", "value")
    keep = [] if "tenant_id" in scope else [F.first("tenant_id").alias("tenant_id")]
    same = ["entity_id", "entity_type", "normalized_value", "host", "identity_scope", "identity_domain", "hash_algorithm"]
    out = rows.groupBy(*scope, "fingerprint").agg(
        *keep,
        *[F.first(c).alias(c) for c in same],
        F.min_by("value", first).alias("value"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("mention_count").alias("mention_count"),
    )
    out = _with_merged(out, rows, [*scope, "fingerprint"], ["_side", "last_seen", "value"], "right", on_metadata_conflict, unite=True)
    return out.select(*stored.columns)


def extend_relationships(
    stored: DataFrame, fresh: DataFrame, scope: Sequence[str] = (), on_strength: str = "max", on_property_conflict: str = "left",
    on_metadata_conflict: str = "left",
) -> DataFrame:
    """Merge two resolved edge tables. Of two strengths the larger, the stored (left), the fresh (right) or the mean
    counts; of two values of a property or in the metadata the stored one, unless a policy says right or raise."""
    if on_strength not in STRENGTH_POLICIES:
        raise ValueError(f"on_strength must be one of {STRENGTH_POLICIES}")
    combine = {
        "max": F.max, "avg": F.avg, "left": lambda c: F.min_by(c, "_side"), "right": lambda c: F.max_by(c, "_side"),
    }[on_strength]
    rows = _sides(stored, fresh)
    keep = [] if "tenant_id" in scope else [F.first("tenant_id").alias("tenant_id")]
    same = ["source_type", "source_id", "relationship_type", "target_type", "target_id"]
    out = rows.groupBy(*scope, "fingerprint").agg(
        *keep,
        *[F.first(c).alias(c) for c in same],
        combine("weight").alias("weight"), combine("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("event_count").alias("event_count"),
    )
    out = _with_merged(out, rows, [*scope, "fingerprint"], ["_side", "last_seen", "source_id"], on_property_conflict, on_metadata_conflict)
    return out.select(*stored.columns)


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def stats(entities: DataFrame, relationships: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Entity, type, host and relationship counts as one row."""
    if tenant_id is not None:
        entities = entities.filter(F.col("tenant_id") == tenant_id)
        relationships = relationships.filter(F.col("tenant_id") == tenant_id)
    left = entities.agg(
        F.count("*").alias("entities"), F.count_distinct("entity_type").alias("entity_types"),
        F.count_distinct("host").alias("hosts"),
    )
    # one row each, so this is a join of two single rows
    right = relationships.agg(F.count("*").alias("relationships"))
    return left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k").drop("_k")


def both_directions(relationships: DataFrame) -> DataFrame:
    """Every edge as (node, other) from both of its ends."""
    cols = ["relationship_type", "weight", "confidence"]
    out = relationships.select(
        F.explode(
            F.array(
                F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("other"), F.lit("out").alias("direction")),
                F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("other"), F.lit("in").alias("direction")),
            )
        ).alias("e"),
        *cols,
    )
    return out.select("e.*", *cols)


def neighbors(
    relationships: DataFrame, entities: DataFrame, seeds: DataFrame | None = None,
    relationship_type: str | None = None, direction: str = "both",
) -> DataFrame:
    """Adjacent entities with the edge that joins them; of all nodes or of ``seeds``."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be out, in or both")
    rows = relationships
    if relationship_type is not None:
        rows = rows.filter(F.col("relationship_type") == relationship_type.lower())
    adjacent = both_directions(rows)
    if direction != "both":
        adjacent = adjacent.filter(F.col("direction") == direction)
    if seeds is not None:
        adjacent = adjacent.join(seeds.select(F.col("entity_id").alias("node")).distinct(), "node", "left_semi")
    found = adjacent.select("node", "other", "relationship_type", "weight", "confidence").distinct()
    named = entities.select(F.col("entity_id").alias("other"), "entity_type", "value", "host")
    return found.join(named, "other").select(
        "node", F.col("other").alias("entity_id"), "entity_type", "value", "host",
        "relationship_type", "weight", "confidence",
    )


def known_ends_only(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both in ``nodes``."""
    ids = nodes.select("entity_id").distinct()
    kept = relationships.join(ids.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi")
    kept = kept.join(ids.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    return kept.select(*relationships.columns)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint, only when the measured size allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Hops up to which a walk is one plan, without an action between its hops.
ONE_PLAN = 6


def reach(
    relationships: DataFrame, seeds: DataFrame, depth: int, directed: bool = False,
) -> DataFrame:
    """Nodes within ``depth`` hops of the seeds, with their distance.

    Up to ``ONE_PLAN`` hops are one plan: a hop's nodes are distinct, so none is larger than the graph, and a node's distance is the
    first hop that has it. Longer walks write each frontier out, so a lost executor costs one hop and the plan does not
    grow, and stop when a hop finds nothing new.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    if directed:
        adjacent = relationships.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"))
    else:
        adjacent = both_directions(relationships).select("node", "other")
    visited = seeds.select(F.col("entity_id").alias("node")).distinct().withColumn("depth", F.lit(0))
    if depth <= ONE_PLAN:
        layer = visited
        for hop in range(1, depth + 1):
            layer = adjacent.join(layer.select("node"), "node").select(F.col("other").alias("node")).distinct().withColumn("depth", F.lit(hop))
            visited = visited.unionByName(layer)
        return visited.groupBy("node").agg(F.min("depth").alias("depth"))
    frontier = visited = cut_lineage(visited)
    adjacent = cut_lineage(adjacent.distinct())
    for hop in range(1, depth + 1):
        size = frontier.count()
        if size == 0:
            break
        step = adjacent.join(_small(frontier.select("node"), size), "node").select(F.col("other").alias("node"))
        fresh = step.distinct().join(visited.select("node"), "node", "left_anti")
        frontier = cut_lineage(fresh.withColumn("depth", F.lit(hop)))
        visited = visited.unionByName(frontier)
    return visited


def subgraph(
    entities: DataFrame, relationships: DataFrame, seeds: DataFrame, depth: int = 1,
) -> dict[str, DataFrame]:
    """Entities within ``depth`` hops of the seeds and all edges among them."""
    nodes = reach(relationships, seeds, depth).withColumnRenamed("node", "entity_id")
    inside = entities.join(nodes, "entity_id")
    return {"entities": inside, "relationships": known_ends_only(relationships, inside)}


_ASK = ["source_id", "target_id"]


def shortest_paths(relationships: DataFrame, asks: DataFrame, max_depth: int = 5) -> DataFrame:
    """(source_id, target_id, position, entity_id): one shortest undirected path for each ask, none beyond ``max_depth`` steps.

    ``asks``: source_id, target_id; all are answered in one run. Every ask grows two frontiers, from its source and from its target, in each
    round the one with fewer edges, until they meet: an ask whose source is beside a busy node does not visit what that node reaches. Among equal ways
    the smallest node id before the target wins, then the one before that. ``relationships`` is read twice a round, to count and to follow, with the frontier
    sent to it where its counted size allows; give it as a table.
    """
    asks = asks.select(*_ASK).dropna().distinct()
    adjacent = both_directions(relationships).select("node", "other")
    none = F.lit(None).cast("string")
    ends = [asks.select(*_ASK, F.lit(i).alias("side"), F.col(c).alias("node"), F.lit(0).alias("depth"), none.alias("via")) for i, c in enumerate(_ASK)]
    visited = cut_lineage(ends[0].unionByName(ends[1]))
    frontier, met = visited, asks.filter("source_id = target_id").select(*_ASK, F.col("source_id").alias("node"))
    met, edges_ = cut_lineage(met), None
    for _ in range(max_depth):
        waiting = frontier.join(met.select(*_ASK).distinct(), _ASK, "left_anti")
        size = waiting.count()
        if size == 0:
            break
        # what growing a side costs is the edges at its nodes, counted before any is followed
        edges_at = adjacent.select("node").join(_small(waiting.select(*_ASK, "side", "node"), size), "node")
        turn = edges_at.groupBy(*_ASK, "side").agg(F.count("*").alias("n")).groupBy(*_ASK)
        # an ask with a frontier that leads nowhere has no path
        turn = cut_lineage(turn.agg(F.min_by("side", F.struct("n", "side")).alias("side"), F.count("*").alias("sides")).filter("sides = 2").drop("sides"))
        growing = waiting.join(turn, [*_ASK, "side"]).select(*_ASK, "side", "node", "depth")
        step = adjacent.join(_small(growing, size), "node").select(*_ASK, "side", F.col("other").alias("node"), F.col("node").alias("via"), (F.col("depth") + 1).alias("depth"))
        # every edge into a node that this side has not seen
        new = cut_lineage(step.distinct().join(visited, [*_ASK, "side", "node"], "left_anti"))
        fresh = cut_lineage(new.groupBy(*_ASK, "side", "node", "depth").agg(F.min("via").alias("via")).select(*visited.columns))
        other = visited.select(*_ASK, (1 - F.col("side")).alias("side"), "node")
        met = cut_lineage(met.unionByName(fresh.join(other, [*_ASK, "side", "node"], "left_semi").select(*_ASK, "node")))
        visited = visited.unionByName(fresh)
        frontier = cut_lineage(waiting.join(turn, [*_ASK, "side"], "left_anti").select(*visited.columns).unionByName(fresh))
        edges_ = new if edges_ is None else edges_.unionByName(new)
    if edges_ is None:
        return met.select(*_ASK, F.lit(0).alias("position"), F.col("node").alias("entity_id"))
    return _joined_paths(met, visited, edges_.filter("side = 1"), max_depth)


def _joined_paths(met: DataFrame, visited: DataFrame, edges_: DataFrame, max_depth: int) -> DataFrame:
    """Paths through the nodes where the two sides of ``shortest_paths`` met. ``edges_``: those that the targets' sides went."""
    near, far = (visited.filter(f"side = {i}").select(*_ASK, "node", "depth", "via") for i in (0, 1))
    meeting = met.join(far, [*_ASK, "node"]).select(*_ASK, "node", "depth")
    length = met.join(near, [*_ASK, "node"]).select(*_ASK, "node", F.col("depth").alias("_near")).join(meeting, [*_ASK, "node"])
    length = length.groupBy(*_ASK).agg(F.min(F.col("_near") + F.col("depth")).alias("length"))
    # what lies between the meeting nodes and the target
    on, layer = meeting, meeting
    for depth in range(max_depth, 0, -1):
        down = on.filter(F.col("depth") == depth).join(edges_, [*_ASK, "node", "depth"])
        layer = down.select(*_ASK, F.col("via").alias("node"), (F.col("depth") - 1).alias("depth")).distinct()
        on = on.unionByName(layer)
    on = cut_lineage(on.distinct())
    current = on.filter("depth = 0").select(*_ASK, "node")
    way = current.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        options = edges_.filter(F.col("depth") == depth).join(on, [*_ASK, "node", "depth"]).join(current.withColumnRenamed("node", "via"), [*_ASK, "via"])
        current = options.groupBy(*_ASK).agg(F.min("node").alias("node"))
        way = way.unionByName(current.withColumn("depth", F.lit(depth)))
    way = cut_lineage(way.join(length, _ASK).select(*_ASK, "node", (F.col("length") - F.col("depth")).alias("position")))
    out = way
    # from the last node of the target's side to the source
    current = way.groupBy(*_ASK).agg(F.min_by("node", "position").alias("node"))
    for _ in range(max_depth):
        back = current.join(near, [*_ASK, "node"]).filter("via IS NOT NULL")
        current = back.select(*_ASK, F.col("via").alias("node"))
        out = out.unionByName(back.select(*_ASK, F.col("via").alias("node"), (F.col("depth") - 1).alias("position")))
    return out.select(*_ASK, "position", F.col("node").alias("entity_id"))


def shortest_path(relationships: DataFrame, source_id: str, target_id: str, max_depth: int = 5) -> DataFrame:
    """Nodes on one shortest undirected path, in order; no rows when there is none. See ``shortest_paths``."""
    ask = relationships.sparkSession.createDataFrame([(source_id, target_id)], "source_id string, target_id string")
    return shortest_paths(relationships, ask, max_depth).select("position", "entity_id")


def descendant_pairs(
    relationships: DataFrame, scope: Sequence[str] = (), relationship_type: str = "spawned",
    max_depth: int = vocab.CHAIN_MAX_DEPTH, roots: DataFrame | None = None,
) -> DataFrame:
    """(scope, root, node): every node below a root (of ``roots``: scope, root) within ``max_depth`` directed hops."""
    keys = list(scope)
    step = cut_lineage(
        relationships.filter(F.col("relationship_type") == relationship_type)
        .select(*keys, F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct()
    )
    pairs = step.select(*keys, F.col("node").alias("root"), F.col("next").alias("node"))
    if roots is not None:
        pairs = cut_lineage(null_safe(pairs, roots, [*keys, "root"], "left_semi"))
    frontier = pairs
    for _ in range(1, max_depth):
        grown = null_safe(frontier, step, [*keys, "node"]).select(*keys, "root", F.col("next").alias("node"))
        fresh = cut_lineage(null_safe(grown.distinct(), pairs, [*keys, "root", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        pairs = pairs.unionByName(fresh)
        frontier = fresh
    return pairs


def descendant_counts(
    relationships: DataFrame, scope: Sequence[str] = (), relationship_type: str = "spawned",
    max_depth: int = vocab.CHAIN_MAX_DEPTH,
) -> DataFrame:
    """(scope, root, descendants): how many nodes are below each root within ``max_depth`` directed hops.

    Ways are counted hop by hop: those of a node are the sum over its children. Where no node in reach has two parents or
    reaches itself every node has one way, so ways are nodes; only the other roots make pairs.
    """
    keys = list(scope)
    step = cut_lineage(
        relationships.filter(F.col("relationship_type") == relationship_type)
        .select(*keys, F.col("source_id").alias("root"), F.col("target_id").alias("next")).distinct()
    )
    several = step.groupBy(*keys, "next").agg((F.count("*") > 1).alias("merged"))
    # a loop that nothing enters has one parent for each node: its nodes still have ways of full length
    edges_ = null_safe(step, several, [*keys, "next"]).withColumn("merged", F.col("merged").cast("double"))
    edges_ = cut_lineage(edges_)
    level = cut_lineage(edges_.groupBy(*keys, "root").agg(F.count("*").cast("double").alias("ways"), F.max("merged").alias("merged")))
    levels = [level]
    for _ in range(1, max_depth):
        below = level.withColumnsRenamed({"root": "next", "merged": "_below"})
        grown = null_safe(edges_.select(*keys, "root", "next", "merged"), below, [*keys, "next"])
        level = cut_lineage(grown.groupBy(*keys, "root").agg(F.sum("ways").alias("ways"), F.max(F.greatest("merged", "_below")).alias("merged")))
        if level.isEmpty():
            break
        levels.append(level)
    every = levels[0].withColumn("hops", F.lit(1))
    for hops, more in enumerate(levels[1:], 2):
        every = every.unionByName(more.withColumn("hops", F.lit(hops)))
    found = every.groupBy(*keys, "root").agg(F.sum("ways").alias("ways"), F.max("merged").alias("merged"), F.max("hops").alias("hops"))
    unsure = (F.col("merged") > 0) | (F.col("hops") == max_depth)
    exact = found.filter(~unsure).select(*keys, "root", F.col("ways").cast("long").alias("descendants"))
    pairs = descendant_pairs(relationships, keys, relationship_type, max_depth, cut_lineage(found.filter(unsure).select(*keys, "root")))
    return exact.unionByName(pairs.groupBy(*keys, "root").agg(F.count("*").alias("descendants")))


def longest_lineage(relationships: DataFrame, entity_id: str, max_depth: int = 10) -> DataFrame:
    """Longest chain of spawning ancestors of one node: (position, entity_id).

    Position 0 is the node itself. Layer by layer upwards; an edge is used once per
    path, and among equally long chains the smallest ids win.
    """
    spark = relationships.sparkSession
    up = relationships.filter("relationship_type = 'spawned'").select(F.col("target_id").alias("node"), F.col("source_id").alias("parent"))
    layer = spark.createDataFrame([(entity_id, [entity_id])], "node string, path array<string>")
    ways = layer
    for _ in range(max_depth):
        grown = up.join(layer, "node").filter(~F.array_contains("path", F.col("parent")))
        grown = grown.select(F.col("parent").alias("node"), F.concat("path", F.array("parent")).alias("path"))
        # one path per node and length is enough for the longest chain
        layer = grown.groupBy("node").agg(F.min("path").alias("path"))
        ways = ways.unionByName(layer)
    best = ways.agg(F.min_by("path", F.struct(-F.size("path"), "path")).alias("path"))
    return best.select(F.posexplode("path").alias("position", "entity_id"))


# -- lookups ------------------------------------------------------------------------------


def find_entities(
    entities: DataFrame, entity_type: str | None = None, value: str | None = None, host: str | None = None,
    fingerprint: str | None = None,
) -> DataFrame:
    """Entities by fingerprint, type, normalised value and host, as far as given."""
    rows = entities
    wanted = {"fingerprint": fingerprint, "entity_type": entity_type, "normalized_value": value}
    for name, text in wanted.items():
        if text is not None:
            rows = rows.filter(F.col(name) == text)
    return rows if host is None else rows.filter(F.col("host") == host.lower())


def find_unique(entities: DataFrame, entity_type: str, value: str, host: str | None = None) -> DataFrame:
    """The one matching entity, or no row when there are none or several."""
    rows = find_entities(entities, entity_type, value, host)
    total = rows.groupBy("entity_type", "normalized_value").agg(F.count("*").alias("_n")).filter("_n = 1")
    return rows.join(total, ["entity_type", "normalized_value"], "left_semi").select(*entities.columns)


def find_relationships(
    relationships: DataFrame, relationship_type: str | None = None, source_id: str | None = None,
    target_id: str | None = None, fingerprint: str | None = None,
) -> DataFrame:
    rows = relationships
    wanted = {
        "fingerprint": fingerprint, "relationship_type": relationship_type, "source_id": source_id, "target_id": target_id,
    }
    for name, text in wanted.items():
        if text is not None:
            rows = rows.filter(F.col(name) == text)
    return rows


def with_relationship_fingerprint_check(relationships: DataFrame) -> DataFrame:
    return relationships.withColumn("fingerprint_ok", F.col("fingerprint") == identity.relationship_fingerprint())


def same_identity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that also exist in ``right``, by identity."""
    return left.join(right.select("fingerprint").distinct(), "fingerprint", "left_semi").select(*left.columns)


def add_provenance(rows: DataFrame, log: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Widen entities or relationships by later sightings: first and last seen, how often, tags.

    ``log``: scope, fingerprint, timestamp, event_id and, where it tells of them, tag. Blank ids and tags are
    ignored, tags are in lower case. ``rows`` without tags get none.
    """
    keys = [*scope, "fingerprint"]
    count = "mention_count" if "mention_count" in rows.columns else "event_count"
    event = F.nullif(F.trim("event_id"), F.lit(""))
    seen = log.groupBy(*keys).agg(
        F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"), F.count(event).alias("_more"),
        *([F.collect_set(F.lower(F.nullif(F.trim("tag"), F.lit("")))).alias("_tags")] if "tag" in log.columns else []),
    )
    joined = null_safe(rows, seen, keys, "left").withColumns(
        {
            "first_seen": F.least("first_seen", "_first"), "last_seen": F.greatest("last_seen", "_last"),
            count: F.col(count) + F.coalesce("_more", F.lit(0)),
        }
    )
    if "tag" in log.columns and "tags" in rows.columns:
        none = F.array().cast("array<string>")
        joined = joined.withColumn("tags", F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("_tags", none))))
    return joined.select(*rows.columns)


def provenance_links(log: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, fingerprint, evidence_id): the evidence of entities or relationships, each once; blank ids are ignored."""
    evidence = F.nullif(F.trim("evidence_id"), F.lit("")).alias("evidence_id")
    return log.select(*scope, "fingerprint", evidence).filter("evidence_id IS NOT NULL").distinct()
