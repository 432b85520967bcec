"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _D, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType(),
)
_STRINGS = T.ArrayType(T.StringType())
_HASHES = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


USER_CONTEXT = _struct(
    name=_S, domain=_S, sid=_S, logon_id=_S, logon_type=_I, session_id=_I,
    integrity_level=_S, is_admin=_B, is_service_account=_B,
)
PROCESS = _struct(
    name=_S, pid=_I, ppid=_I, guid=_S, parent_name=_S, parent_pid=_I, parent_guid=_S,
    command_line=_S, image_path=_S, user=_S, integrity_level=_S, hashes=_HASHES, signed=_B,
    signer=_S, company=_S, product=_S, description=_S, is_lolbin=_B, is_elevated=_B,
)
NETWORK = _struct(
    source_ip=_S, source_port=_I, destination_ip=_S, destination_port=_I, protocol=_S,
    direction=_S, hostname=_S, url=_S, user_agent=_S, bytes_sent=_L, bytes_received=_L,
    geo_country=_S, asn=_S,
)
FILE = _struct(
    path=_S, name=_S, extension=_S, size=_L, hashes=_HASHES, signed=_B, signer=_S,
    created_at=_TS, modified_at=_TS, accessed_at=_TS, operation=_S,
)
REGISTRY = _struct(
    key=_S, value_name=_S, value_data=_S, value_type=_S, operation=_S, is_persistence_key=_B,
)
DNS = _struct(
    query=_S, query_type=_S, response=_STRINGS, response_code=_S, is_dga=_B, is_tunneling=_B,
)

#: The canonical event.
EVENT = _struct(
    event_id=_S, schema_version=_S, tenant_id=_S, investigation_id=_S, correlation_id=_S,
    timestamp=_TS, ingested_at=_TS,
    source=_S, platform=_S, category=_S, event_type=_S, tags=_STRINGS, source_reliability=_S,
    severity=_I, host=_S, user=_S, domain=_S,
    user_context=USER_CONTEXT, process=PROCESS, network=NETWORK, file=FILE,
    registry=REGISTRY, dns=DNS,
    rule_id=_S, rule_name=_S, rule_level=_I, mitre_techniques=_STRINGS, mitre_tactics=_STRINGS,
    raw_data=_S, metadata=T.MapType(T.StringType(), T.StringType()),
)
EVENT_COLUMNS = EVENT.fieldNames()
CONTEXTS = ["process", "network", "file", "registry", "dns"]
