"""Rule-based detection: living-off-the-land binaries and selection rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.text import basename, glob_regex
from casewright.operators import rule_index
from casewright.operators.rule_index import CONTAINS, EQUALS, GLOB, Atom, Tree, atoms

FINDING_COLUMNS = [
    "event_id", "rule_id", "rule_name", "severity", "severity_name", "description",
    "mitre_techniques", "matched_fields", "tags",
]
_REGISTRY_SCHEMA = "binary string, severity_name string, description string, techniques array<string>"


def registry(spark: SparkSession, rows: list | None = None) -> DataFrame:
    """Table of binaries; an empty list is respected and finds nothing."""
    return spark.createDataFrame(vocab.LOLBINS if rows is None else rows, _REGISTRY_SCHEMA)


def _severity_value(name: Column) -> Column:
    from casewright.functions.text import lookup

    return lookup(name, vocab.FINDING_SEVERITY)


def _carried(events: DataFrame) -> list[str]:
    return [c for c in ("tenant_id", "case_id") if c in events.columns]


def lolbins(events: DataFrame, table: DataFrame | None = None, min_severity: str = "LOW") -> DataFrame:
    """Process events whose binary is in the registry: the built-in one of a few dozen rows, or the caller's of any size."""
    table = F.broadcast(registry(events.sparkSession)) if table is None else table
    least = vocab.FINDING_SEVERITY[min_severity]
    wanted = table.withColumn("severity", _severity_value(F.col("severity_name"))).filter(F.col("severity") >= least)
    name = F.lower(basename(F.col("process.name")))
    starts = events.filter(F.col("category") == "process").select(
        *_carried(events), "event_id", name.alias("binary"), F.col("process.command_line").alias("command_line")
    )
    return starts.join(wanted, "binary").select(
        *_carried(events), "event_id",
        F.concat(F.lit("lolbin."), F.col("binary")).alias("rule_id"),
        F.concat(F.lit("LOLBin execution: "), F.col("binary")).alias("rule_name"),
        "severity", "severity_name", "description", F.col("techniques").alias("mitre_techniques"),
        F.create_map(
            F.lit("process.name"), F.col("binary"), F.lit("process.command_line"), F.col("command_line")
        ).alias("matched_fields"),
        F.array().cast("array<string>").alias("tags"),
    )


# -- selection rules ------------------------------------------------------------------------

_PLAIN_FIELDS = {
    "host": "host", "user": "user", "domain": "domain", "rule.id": "rule_id",
    "rule.name": "rule_name", "event.type": "event_type", "category": "category",
}


def field(events: DataFrame, name: str) -> Column:
    """Column a rule field stands for; unknown names are looked up in ``metadata``."""
    if name in _PLAIN_FIELDS:
        return F.col(_PLAIN_FIELDS[name])
    context, _, sub = name.partition(".")
    if sub and context in ("process", "network", "file", "registry", "dns"):
        known = events.schema[context].dataType.fieldNames()
        return F.col(f"{context}.{sub}") if sub in known else F.lit(None).cast("string")
    return F.col("metadata")[name]


def _atoms(name: str, expected) -> Tree | Atom:
    """Case-insensitive match: a list is OR, wildcards are globs, else equal or contained."""
    if isinstance(expected, (list, tuple)):
        return Tree(False, tuple(_atoms(name, e) for e in expected))
    wanted = str(expected).lower()
    if "*" in wanted or "?" in wanted:
        return Atom(name, GLOB, wanted)
    return Atom(name, CONTAINS if name in vocab.SUBSTRING_FIELDS else EQUALS, wanted)


def selection(spec: dict) -> Tree:
    """All fields of a selection must match."""
    if not isinstance(spec, dict):
        return Tree(False, ())
    return Tree(True, tuple(_atoms(n, e) for n, e in spec.items()))


def tree(detection: dict) -> Tree:
    """Rule condition as a tree of atoms.

    Operands: a selection name (any case), ``1 of prefix*``, ``all of prefix*``; ``and``
    binds tighter than ``or``. There is no ``not`` and there are no brackets.
    """
    selections = {k.lower(): v for k, v in detection.items() if k != "condition"}

    def operand(text: str) -> Tree:
        counted = re.fullmatch(r"(1|all) of (\S+)", text)
        if counted is None:
            return selection(selections.get(text))
        prefix = counted[2].rstrip("*")
        found = tuple(selection(spec) for name, spec in selections.items() if name.startswith(prefix))
        return Tree(counted[1] == "all" and bool(found), found)

    text = " ".join(str(detection.get("condition") or "").lower().split())
    if not text:
        return Tree(False, ())
    return Tree(False, tuple(Tree(True, tuple(operand(part) for part in branch.split(" and "))) for branch in text.split(" or ")))


def _column(events: DataFrame, node: Tree | Atom) -> Column:
    if isinstance(node, Tree):
        parts = [_column(events, p) for p in node.parts]
        return reduce(lambda x, y: x & y, parts, F.lit(True)) if node.every else reduce(lambda x, y: x | y, parts, F.lit(False))
    text = F.lower(field(events, node.field).cast("string"))
    tests = {GLOB: lambda: text.rlike(glob_regex(node.text)), CONTAINS: lambda: F.contains(text, F.lit(node.text)), EQUALS: lambda: text == node.text}
    return F.coalesce(tests[node.kind](), F.lit(False))


def condition(events: DataFrame, detection: dict) -> Column:
    """Rule condition as a column; see ``tree``."""
    return _column(events, tree(detection))


def rule_techniques(tags: list[str]) -> list[str]:
    """Technique ids in tags such as ``attack.t1059.001``."""
    found = {t[len("attack."):].upper() for t in tags if t.lower().startswith("attack.t")}
    return sorted(t for t in found if re.fullmatch(r"T\d{4}(\.\d{3})?", t))


def _rule_texts(rule: dict) -> tuple:
    """The columns of a rule's findings: id, name, severity and its name, description, techniques, matched fields, tags."""
    name_id = str(rule.get("id", "sigma-unknown"))
    title = str(rule.get("title", name_id))
    level = vocab.RULE_LEVELS.get(str(rule.get("level", "medium")).lower(), "MEDIUM")
    raw = rule.get("tags") or []
    tags = [raw] if isinstance(raw, str) else [str(t) for t in raw]
    description = str(rule.get("description") or "") or f"Rule {title} matched"
    return name_id, title, vocab.FINDING_SEVERITY[level], level, description, rule_techniques(tags), None, tags


def _rule_finding(rule: dict) -> Column:
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    columns = [F.lit(None).cast("map<string,string>") if v is None else texts(v) if isinstance(v, list) else F.lit(v) for v in _rule_texts(rule)]
    return F.struct(*[c.alias(n) for c, n in zip(columns, FINDING_COLUMNS[1:], strict=True)])


#: Rules up to which each is a column expression; more are found by index.
MOST_COLUMNS = 32


def apply_rules(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings of all rules in one scan of the events: as column expressions, or by index where there are many."""
    rules = [r for r in rules if isinstance(r.get("detection"), dict)]
    if len(rules) > MOST_COLUMNS:
        return apply_indexed(events, rules)
    hits = [F.when(condition(events, r["detection"]), _rule_finding(r)) for r in rules]
    carried = _carried(events)
    if not hits:
        return lolbins(events.limit(0))
    found = events.select(*carried, "event_id", F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return found.select(*carried, "event_id", "f.*")


#: Rules up to which their findings' texts are sent to every task.
BROADCAST_RULES = 50_000


def apply_indexed(events: DataFrame, rules: list[dict]) -> DataFrame:
    """The same findings by ``rule_index``; the plan is the same for any number of rules."""
    carried, trees = _carried(events), [tree(r["detection"]) for r in rules]
    named = {a.field for t in trees for a in atoms(t)}
    found = rule_index.find(events, [*carried, "event_id"], {n: field(events, n) for n in named}, trees)
    schema = (
        "rule_number int, rule_id string, rule_name string, severity int, severity_name string, description string, "
        "mitre_techniques array<string>, matched_fields map<string,string>, tags array<string>"
    )
    table = events.sparkSession.createDataFrame([(n, *_rule_texts(r)) for n, r in enumerate(rules)], schema)
    joined = found.join(F.broadcast(table) if len(rules) <= BROADCAST_RULES else table, "rule_number")
    return joined.select(*carried, "event_id", *table.columns[1:])


def apply_columns(events: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Findings of rules given as (id, severity name, condition column)."""
    specs = []
    for rule_id, level, column in rules:
        specs.append(F.when(column, _rule_finding({"id": rule_id, "level": level})))
    carried = _carried(events)
    found = events.select(*carried, "event_id", F.explode(F.array_compact(F.array(*specs))).alias("f"))
    return found.select(*carried, "event_id", "f.*")


def run(events: DataFrame, rules: list[dict] | None = None, table: DataFrame | None = None) -> DataFrame:
    """All findings: the binary detector and, when given, the selection rules."""
    found = lolbins(events, table)
    return found if not rules else found.unionByName(apply_rules(events, rules))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("severity"), "rule_id", "event_id")


def stats(findings: DataFrame) -> DataFrame:
    """Counts in total, by rule and by severity, in one pass."""
    counted = findings.groupBy("rule_id", "severity_name").agg(F.count("*").alias("n"))
    cells = counted.select(
        "n",
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
                F.struct(F.lit("rule").alias("dimension"), F.col("rule_id").alias("value")),
                F.struct(F.lit("severity").alias("dimension"), F.col("severity_name").alias("value")),
            )
        ).alias("d"),
    )
    return cells.groupBy("d.dimension", "d.value").agg(F.sum("n").alias("findings"))


def read_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules from JSON files: a list or one object per file. Rules are configuration,
    a few per file, and become column expressions, so they are parsed on the driver."""
    import json

    rules = []
    for row in spark.read.text(path, wholetext=True).orderBy(F.col("_metadata.file_path")).collect():
        parsed = json.loads(row.value)
        rules += parsed if isinstance(parsed, list) else [parsed]
    return rules
