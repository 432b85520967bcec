"""Fixed values.

Everything in this module is a constant that results depend on: closed
vocabularies, weights, thresholds and lookup tables. Operators take them as
arguments or join them as small tables, so a caller can override any of them.
"""

from __future__ import annotations

# -- fixed values: schema and identity ------------------------------------------------
SCHEMA_VERSION = "1.0"
GENESIS_HASH = "GENESIS"
ENTITY_NAMESPACE = "6b8f0d1e-4c2a-4e5b-9d3f-1a7c9e8b5f42"

# -- fixed values: closed vocabularies ------------------------------------------------
EVENT_SOURCES = [
    "wazuh", "sysmon", "edr", "cloud", "network", "identity", "application", "manual",
]
PLATFORMS = ["windows", "linux", "macos", "cloud", "network", "unknown"]
EVENT_CATEGORIES = [
    "process", "file", "registry", "network", "dns", "http",
    "authentication", "account", "configuration", "other",
]
ENTITY_TYPES = [
    "process", "file", "hash", "ip", "domain", "url", "user", "host", "registry",
    "mitre_technique", "alert", "event", "evidence",
]
OCCURRENCE_ENTITY_TYPES = ["event", "alert", "evidence"]
HOST_SCOPED_ENTITY_TYPES = ["process", "file", "registry"]
GLOBAL_ENTITY_TYPES = ["hash", "ip", "domain", "url", "mitre_technique"]
EVIDENCE_TYPES = [
    "event", "alert", "process", "network", "file", "registry", "dns", "authentication",
    "threat_intel", "enrichment", "analyst", "derived", "memory",
]
EVIDENCE_STRENGTHS = ["weak", "moderate", "strong", "critical"]
EVIDENCE_ASSESSMENTS = ["supports", "contradicts", "neutral"]
HYPOTHESIS_TYPES = ["main", "counter", "sub", "unknown"]
HYPOTHESIS_SOURCES = ["deterministic", "ai", "analyst", "imported"]
CASE_PRIORITIES = ["low", "medium", "high", "critical"]
CASE_CATEGORIES = [
    "malware", "phishing", "credential_access", "persistence", "execution",
    "defense_evasion", "lateral_movement", "command_and_control", "data_exfiltration",
    "policy_violation", "unknown",
]
RESOLUTION_OUTCOMES = [
    "true_positive", "false_positive", "benign", "duplicate", "inconclusive",
]
LEDGER_OPERATIONS = ["append", "verify", "attach", "derive", "analyst_verify"]

# -- fixed values: source reliability (letter, value, confidence) ----------------------
RELIABILITY = [
    ("A", "completely_reliable", 1.00),
    ("B", "usually_reliable", 0.85),
    ("C", "fairly_reliable", 0.70),
    ("D", "not_usually_reliable", 0.50),
    ("E", "unreliable", 0.30),
    ("F", "cannot_be_judged", 0.20),
]
RELIABILITY_CONFIDENCE = {value: conf for _, value, conf in RELIABILITY}
RELIABILITY_UNKNOWN_CONFIDENCE = 0.5

# -- fixed values: event category -> evidence type ---------------------------------------
CATEGORY_EVIDENCE_TYPE = {
    "process": "process",
    "file": "file",
    "registry": "registry",
    "network": "network",
    "http": "network",
    "dns": "dns",
    "authentication": "authentication",
    "account": "authentication",
    "configuration": "event",
    "other": "event",
}

# -- fixed values: severity bands (critical, strong / high, moderate / medium) ----------
BAND_CRITICAL = 85
BAND_HIGH = 70
BAND_MEDIUM = 40

# -- fixed values: correlation reasons (name, label, category, weight) -------------------
CORRELATION_REASONS = [
    ("same_host", "Same host", "identity", 0.15),
    ("same_user", "Same user", "identity", 0.15),
    ("same_process_name", "Same process name", "process", 0.20),
    ("same_process_id", "Same process ID", "process", 0.30),
    ("parent_child", "Parent-child process relation", "process", 0.35),
    ("same_file_hash", "Same file hash", "file", 0.40),
    ("same_file_path", "Same file path", "file", 0.20),
    ("same_source_ip", "Same source IP", "network", 0.25),
    ("same_destination_ip", "Same destination IP", "network", 0.30),
    ("same_dns_query", "Same DNS query", "network", 0.25),
    ("same_registry_key", "Same registry key", "registry", 0.30),
    ("same_mitre_technique", "Shared MITRE technique", "detection", 0.15),
    ("same_rule", "Same detection rule", "detection", 0.10),
]
REASON_NAMES = [name for name, _, _, _ in CORRELATION_REASONS]
REASON_WEIGHTS = {name: weight for name, _, _, weight in CORRELATION_REASONS}
CORRELATION_WINDOW_SECONDS = 300
CORRELATION_MIN_CONFIDENCE = 0.40
CORRELATION_MIN_REASONS = 1
CORRELATION_MAX_RESULTS = 500

# -- fixed values: relationship types (name, category) ------------------------------------
RELATIONSHIP_TYPES = [
    ("parent_of", "structure"), ("child_of", "structure"),
    ("part_of", "structure"), ("contains", "structure"),
    ("spawned", "process"), ("executed", "process"), ("accessed", "process"),
    ("modified", "process"), ("created", "process"), ("deleted", "process"),
    ("has_hash", "file"), ("matches_hash", "file"),
    ("connected_to", "network"), ("resolved_to", "network"),
    ("requested", "network"), ("bound_to", "network"),
    ("logged_on", "identity"), ("run_as", "identity"),
    ("owned_by", "identity"), ("member_of", "identity"),
    ("observed_in", "investigation"), ("cited_by", "investigation"),
    ("references", "investigation"), ("derived_from", "investigation"),
    ("supports", "investigation"), ("contradicts", "investigation"),
    ("triggered_by", "investigation"), ("investigates", "investigation"),
]
INVERSE_RELATIONSHIP = {
    "parent_of": "child_of",
    "child_of": "parent_of",
    "contains": "part_of",
    "part_of": "contains",
    "connected_to": "connected_to",
    "matches_hash": "matches_hash",
    "contradicts": "contradicts",
}

# -- fixed values: hypothesis support and status -------------------------------------------
SUPPORT_CONFIDENCE = {1: 0.30, 2: 0.55, 3: 0.70, 4: 0.80}
SUPPORT_CONFIDENCE_MAX = 0.90
MIN_SUPPORT_FOR_STATUS = 2
MIN_CORRELATION_FOR_SUB = 0.5
MIN_CHAIN_DESCENDANTS = 2
CHAIN_MAX_DEPTH = 10
HYPOTHESIS_STATUS_ADVANCE = ["proposed", "weakened", "supported", "rejected", "confirmed"]
HYPOTHESIS_TRANSITIONS = {
    "proposed": ["supported", "weakened", "rejected"],
    "supported": ["confirmed", "weakened"],
    "weakened": ["supported", "rejected"],
    "confirmed": [],
    "rejected": [],
}
CASE_TRANSITIONS = {
    "detected": ["triaged", "resolved"],
    "triaged": ["correlating", "investigating", "resolved"],
    "correlating": ["investigating", "evidence_required", "reassessing"],
    "investigating": ["evidence_required", "reassessing", "confirmed", "resolved"],
    "evidence_required": ["investigating", "reassessing", "resolved"],
    "reassessing": ["investigating", "confirmed", "resolved"],
    "confirmed": ["reassessing", "resolved"],
    "resolved": [],
}

# -- fixed values: hypothesis templates (technique, main, counter, missing evidence) -----
HYPOTHESIS_TEMPLATES = [
    (
        "T1546.011",
        "Possible persistence via Application Shimming",
        "Legitimate Windows compatibility activity via PcaSvc or installer framework",
        [
            "shim database modification",
            "initiating parent process lineage",
            "related registry modifications",
        ],
    ),
    (
        "T1059.001",
        "Possible execution via PowerShell",
        "Legitimate administrative or automation script",
        ["script content or command line", "user context and logon origin"],
    ),
    (
        "T1059.003",
        "Possible execution via Windows Command Shell",
        "Legitimate batch or administrative command execution",
        ["command line arguments", "parent process lineage"],
    ),
    (
        "T1105",
        "Possible ingress tool transfer",
        "Legitimate file download or software update",
        ["destination endpoint and protocol", "file hash and signature status"],
    ),
    (
        "T1055",
        "Possible process injection",
        "Legitimate use of process memory by debugging or accessibility tools",
        ["memory region modification details", "target process integrity level"],
    ),
    (
        "T1071",
        "Possible command and control via application layer protocol",
        "Legitimate outbound traffic via standard protocol",
        ["destination reputation", "beacon interval analysis"],
    ),
    (
        "T1003.001",
        "Possible credential access via LSASS memory dumping",
        "Legitimate diagnostic tool access to LSASS by authorized security software",
        [
            "LSASS handle access rights used",
            "caller process signature and reputation",
            "target credential store dump analysis",
        ],
    ),
]
GENERIC_MAIN_PREFIX = "Possible activity related to "
GENERIC_COUNTER_PREFIX = "Legitimate activity that could be misclassified as "
GENERIC_MISSING = ["additional corroborating evidence"]
SUB_CHAIN_STATEMENT = "Multi-process execution chain detected"
SUB_CHAIN_TECHNIQUE = "T1059"
SUB_HASH_STATEMENT = "Same file hash observed across multiple hosts"
SUB_HASH_TECHNIQUE = "T1570"
SUB_CORRELATION_STATEMENT = "Correlated event cluster indicates a single activity"

# -- fixed values: risk scores --------------------------------------------------------------
STRENGTH_SCORES = {"weak": 5.0, "moderate": 10.0, "strong": 20.0, "critical": 30.0}
STATUS_SCORES = {
    "proposed": 5.0, "supported": 25.0, "confirmed": 40.0, "weakened": 0.0, "rejected": 0.0,
}

# -- fixed values: recommended actions -------------------------------------------------------
TECHNIQUE_ACTIONS = [
    ("T1546.011", [
        "Inspect sdbinst.exe command line and parent process",
        "Review Shim Database modifications under HKLM\\...\\AppCompatFlags",
        "Check PcaSvc activity around the same time window",
    ]),
    ("T1059.001", [
        "Review PowerShell script block logs (event ID 4104)",
        "Check encoded commands and outbound connections",
        "Validate initiating user and logon origin",
    ]),
    ("T1059.003", [
        "Review cmd.exe command line history",
        "Check parent process lineage for suspicious spawning",
    ]),
    ("T1105", [
        "Identify downloaded file hash and signature",
        "Check destination endpoint reputation",
    ]),
    ("T1055", [
        "Inspect target process memory regions",
        "Correlate with Sysmon event ID 8 (CreateRemoteThread)",
    ]),
    ("T1071", [
        "Analyze beacon interval and destination reputation",
        "Check DNS resolution history for destination host",
    ]),
]
GENERIC_ACTIONS = [
    "Correlate with adjacent events within the same time window",
    "Validate evidence provenance and source reliability",
]
MISSING_ACTION_PREFIX = "Collect missing evidence: "

# -- fixed values: detection -------------------------------------------------------------------
FINDING_SEVERITY = {"INFO": 10, "LOW": 30, "MEDIUM": 50, "HIGH": 70, "CRITICAL": 90}
RULE_LEVELS = {
    "informational": "INFO", "info": "INFO", "low": "LOW",
    "medium": "MEDIUM", "high": "HIGH", "critical": "CRITICAL",
}
SUBSTRING_FIELDS = [
    "process.command_line", "process.image_path", "file.path",
    "registry.key", "dns.query", "network.url",
]
LOLBINS = [
    ("certutil.exe", "HIGH", "certutil can download files or decode payloads", ["T1140", "T1105"]),
    ("bitsadmin.exe", "HIGH", "bitsadmin can download files via BITS", ["T1197", "T1105"]),
    ("mshta.exe", "CRITICAL", "mshta executes HTA payloads", ["T1218.005"]),
    ("wscript.exe", "MEDIUM", "wscript executes VBS/JS scripts", ["T1059.005"]),
    ("cscript.exe", "MEDIUM", "cscript executes VBS/JS scripts via console", ["T1059.005"]),
    ("regsvr32.exe", "CRITICAL", "regsvr32 can bypass application whitelisting", ["T1218.010"]),
    ("rundll32.exe", "HIGH", "rundll32 can execute DLL exports", ["T1218.011"]),
    ("msiexec.exe", "HIGH", "msiexec can install MSI packages from remote", ["T1218.007"]),
    ("installutil.exe", "HIGH", "installutil can execute .NET assemblies", ["T1218.004"]),
    ("msbuild.exe", "HIGH", "msbuild can execute inline tasks", ["T1127.001"]),
    ("csc.exe", "MEDIUM", "csc compiles C# on target", ["T1027.004"]),
    ("regasm.exe", "HIGH", "regasm can execute .NET assemblies", ["T1218.009"]),
    ("regsvcs.exe", "HIGH", "regsvcs can execute .NET assemblies", ["T1218.009"]),
    ("forfiles.exe", "MEDIUM", "forfiles can execute arbitrary commands", ["T1202"]),
    ("pcalua.exe", "HIGH", "pcalua can launch executables via compatibility", ["T1202"]),
    ("wmic.exe", "HIGH", "wmic can execute and query WMI", ["T1047"]),
    ("at.exe", "MEDIUM", "at schedules commands", ["T1053.002"]),
    ("schtasks.exe", "MEDIUM", "schtasks schedules tasks", ["T1053.005"]),
    ("sdbinst.exe", "HIGH", "sdbinst installs shim databases", ["T1546.011"]),
    ("xwizard.exe", "MEDIUM", "xwizard can run custom class registration", ["T1218"]),
    ("expand.exe", "LOW", "expand decompresses CAB files", ["T1140"]),
    ("extrac32.exe", "MEDIUM", "extrac32 extracts CAB or downloads via IE", ["T1105", "T1140"]),
    ("findstr.exe", "LOW", "findstr can read files via regex", ["T1552.001"]),
    ("ftp.exe", "MEDIUM", "ftp can transfer files", ["T1105"]),
    ("replace.exe", "LOW", "replace can copy files", ["T1105"]),
]

# -- fixed values: Wazuh and Sysmon tables --------------------------------------------------------
WAZUH_LEVEL_SEVERITY = {
    0: 0, 1: 5, 2: 10, 3: 15, 4: 25, 5: 30, 6: 40, 7: 50,
    8: 60, 9: 65, 10: 75, 11: 80, 12: 85, 13: 90, 14: 95, 15: 100,
}
TACTIC_IDS = {
    "reconnaissance": "TA0043",
    "resource development": "TA0042",
    "initial access": "TA0001",
    "execution": "TA0002",
    "persistence": "TA0003",
    "privilege escalation": "TA0004",
    "defense evasion": "TA0005",
    "credential access": "TA0006",
    "discovery": "TA0007",
    "lateral movement": "TA0008",
    "collection": "TA0009",
    "command and control": "TA0011",
    "exfiltration": "TA0010",
    "impact": "TA0040",
}
SYSMON_CATEGORY = {
    1: "process", 2: "file", 3: "network", 5: "process", 6: "other", 7: "other",
    8: "process", 10: "process", 11: "file", 12: "registry", 13: "registry",
    14: "registry", 15: "file", 17: "network", 18: "network", 19: "other",
    20: "other", 21: "other", 22: "dns", 23: "file", 24: "other", 25: "process",
    26: "file",
}
SYSMON_EVENT_TYPE = {
    1: "process_creation",
    2: "file_creation_time_changed",
    3: "network_connection",
    5: "process_terminated",
    6: "driver_loaded",
    7: "image_loaded",
    8: "create_remote_thread",
    10: "process_access",
    11: "file_created",
    12: "registry_create_delete",
    13: "registry_set_value",
    14: "registry_rename",
    15: "file_create_stream_hash",
    22: "dns_query",
    23: "file_delete",
    25: "process_tampering",
    26: "file_delete_logged",
}
SYSMON_SEVERITY = 50

# -- fixed values: threat intel (provider, supported indicator types) --------------------------------
PROVIDER_SUPPORT = [
    ("virustotal", ["hash", "ip", "domain"]),
    ("otx", ["ip", "domain", "hash"]),
    ("misp", ["hash", "ip", "domain", "url"]),
]

# -- fixed values: alert levels and stream batching ---------------------------------------------------
ALERT_RULES = [("critical", 85, "critical"), ("high", 70, "warning"), ("medium", 40, "info")]
BATCH_WINDOW_SECONDS = 30
BATCH_IDLE_SECONDS = 5
BATCH_MAX_SIZE = 100
