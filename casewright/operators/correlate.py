"""Pair correlation: which events within a time window share enough.

Thirteen reasons, each with a weight; a pair counts when the combined weight
reaches ``min_confidence``. A reason is one bit of a mask, so score and confidence
of a pair are two lookups by mask.

How pairs are found. Comparing all events of a busy host with each other would be
quadratic, and most such pairs share only the host, which is far below the
threshold. So events are never joined on one weak reason. From the weights follow
the *smallest sets of reasons that reach the threshold* (host and pid; host, user and
process name; file hash alone; ...). An event gets one key per such set whose fields
it has, and events of one key meet within the window. Every such pair
is a result, and a rule on the mask lets exactly one of its keys emit it, so
no distinct is needed.

How events meet. For all pairs an event is not sent once for each key: a few reasons (host, destination address, file hash, ...) are
such that every smallest set holds one of them, and the event is sent once for each of these that it has, by token and
block of time. Its keys are made where it arrives, and a window frame over the times of a key holds the partners, so no pair is
sent either. For seeds key rows are joined on (key, time cell).

How many pairs are made. With ``per_scope`` set pairs are counted first (``pair_counts``). The counts tell which reason masks the
best pairs of a scope have; only groups of these are searched, and among pairs of equal
value only the first by id are made. The result is exact.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.ordered import top_k
from casewright.functions.text import clean
from casewright.session import cut_lineage

MODES = ("additive", "probabilistic_or", "max")
#: Windows in a block of time. Events are sent by block; only those of its last window also go to the next one.
BLOCK_WINDOWS = 8
_N = len(vocab.REASON_NAMES)
_BIT = {name: 1 << i for i, name in enumerate(vocab.REASON_NAMES)}
_POS = {name: i for i, name in enumerate(vocab.REASON_NAMES)}
_HOST, _PARENT, _TECHNIQUE = _BIT["same_host"], _BIT["parent_child"], _BIT["same_mitre_technique"]
#: These reasons mean something only on one host.
_HOST_GATED = _BIT["same_process_name"] | _BIT["same_process_id"] | _PARENT
_NO_ROLE, _AS_PARENT, _AS_CHILD = 0, 1, 2
_EPSILON = 1e-9
_SET_TYPE = "array<struct<mask:int,pos:array<int>>>"


def combine(weights: Sequence[float], mode: str) -> float:
    """Combined weight of some reasons, 0..1."""
    if not weights:
        return 0.0
    if mode == "max":
        value = max(weights)
    elif mode == "probabilistic_or":
        value = 1.0 - math.prod(1.0 - w for w in weights)
    else:
        value = sum(weights)
    return min(max(value, 0.0), 1.0)


def checked_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """Default weights with overrides; unknown reasons and bad numbers are errors."""
    out = dict(vocab.REASON_WEIGHTS)
    for name, weight in (weights or {}).items():
        if name not in _BIT:
            raise ValueError(f"unknown correlation reason {name!r}")
        value = float(weight)
        if not math.isfinite(value) or not 0.0 <= value <= 1.0:
            raise ValueError(f"weight of {name!r} must be between 0 and 1")
        out[name] = value
    return out


@dataclass(frozen=True)
class Rules:
    """Window, thresholds, weights and how weights combine."""

    window_seconds: float = vocab.CORRELATION_WINDOW_SECONDS
    min_confidence: float = vocab.CORRELATION_MIN_CONFIDENCE
    min_reasons: int = vocab.CORRELATION_MIN_REASONS
    weights: dict[str, float] = field(default_factory=dict)
    score_mode: str = "additive"
    confidence_mode: str = "probabilistic_or"

    def __post_init__(self) -> None:
        if self.window_seconds < 0:
            raise ValueError("window_seconds must not be negative")
        if not 0.0 <= self.min_confidence <= 1.0:
            raise ValueError("min_confidence must be between 0 and 1")
        if self.min_reasons < 1:
            raise ValueError("min_reasons must be at least 1")
        if self.score_mode not in MODES or self.confidence_mode not in MODES:
            raise ValueError(f"modes must be among {MODES}")
        object.__setattr__(self, "weights", checked_weights(self.weights))

    @property
    def window_micros(self) -> int:
        return int(round(self.window_seconds * 1_000_000))

    @cached_property
    def masks(self) -> list[int]:
        """All possible reason masks: process reasons only together with the host."""
        return [m for m in range(1, 1 << _N) if not m & _HOST_GATED or m & _HOST]

    @cached_property
    def values(self) -> dict[int, tuple[float, float]]:
        """(confidence, score) of every mask; the weights in descending order."""
        out = {}
        for mask in self.masks:
            names = sorted(
                (n for n in vocab.REASON_NAMES if mask & _BIT[n]), key=lambda n: (-self.weights[n], n)
            )
            weights = [self.weights[n] for n in names]
            out[mask] = (combine(weights, self.confidence_mode), combine(weights, self.score_mode))
        return out

    @cached_property
    def ranks(self) -> dict[int, int]:
        """Position of every mask in the order of (confidence, score); ties are equal."""
        levels = {v: i for i, v in enumerate(sorted(set(self.values.values())))}
        return {m: levels[v] for m, v in self.values.items()}

    def smallest_sets(self, min_rank: int = 0) -> list[int]:
        """Masks that qualify and have no smaller qualifying mask inside them."""
        good = [
            m for m in self.masks
            if self.values[m][0] >= self.min_confidence - _EPSILON
            and m.bit_count() >= self.min_reasons and self.ranks[m] >= min_rank
        ]
        good.sort(key=lambda m: (m.bit_count(), m))
        out: list[int] = []
        for mask in good:
            if not any(small & mask == small for small in out):
                out.append(mask)
        return out

    def places(self) -> list[tuple[int, list[int]]]:
        """Reasons by whose tokens events are sent, each with its smallest sets; every set is in one of the lists.

        Heavy reasons that many sets hold come first. Sets of parent or technique alone have no token and are under -1.
        """
        rest, out = self.smallest_sets(), []
        plain = [i for i in range(_N) if not (_PARENT | _TECHNIQUE) >> i & 1]
        worth = lambda i: sum(m >> i & 1 for m in rest) * self.weights[vocab.REASON_NAMES[i]]
        while any(m >> i & 1 for m in rest for i in plain):
            best = max((i for i in plain if any(m >> i & 1 for m in rest)), key=worth)
            out.append((best, [m for m in rest if m >> best & 1]))
            rest = [m for m in rest if not m >> best & 1]
        return [*out, (-1, rest)] if rest else out

    # -- lookups by mask, as columns ------------------------------------------------------

    def _table(self, values: list, kind: str, mask: Column) -> Column:
        return F.element_at(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), mask + 1)

    def confidence(self, mask: Column) -> Column:
        return self._table([self.values.get(m, (0.0, 0.0))[0] for m in range(1 << _N)], "double", mask)

    def score(self, mask: Column) -> Column:
        return self._table([self.values.get(m, (0.0, 0.0))[1] for m in range(1 << _N)], "double", mask)

    def rank(self, mask: Column) -> Column:
        return self._table([self.ranks.get(m, -1) for m in range(1 << _N)], "int", mask)

    def owner(self, mask: Column) -> Column:
        """The one smallest set that emits pairs with this mask."""
        sets = self.smallest_sets()
        first = [next((s for s in sets if s & m == s), -1) for m in range(1 << _N)]
        return self._table(first, "int", mask)


def _set_list(masks: Sequence[int]) -> list[dict]:
    return [{"mask": m, "pos": [i for i in range(_N) if m >> i & 1]} for m in masks]


def _set_literal(masks: Sequence[int]) -> Column:
    return F.from_json(F.lit(json.dumps(_set_list(masks))), _SET_TYPE)


# -- tokens and keys ------------------------------------------------------------------------


def _clean(column: str) -> str:
    return f"nullif(trim({column}), '')"


#: The strongest hash there is: sha256, else sha1, else md5, else a bare hash.
FILE_HASH_SQL = "coalesce(" + ", ".join(_clean(f"file.hashes['{n}']") for n in ("sha256", "sha1", "md5", "hash")) + ")"

#: Text each reason compares, trimmed and without case; the others compare numbers or lists.
_COMPARED = {
    "same_host": "host", "same_user": "`user`", "same_process_name": "process.name", "same_file_hash": FILE_HASH_SQL,
    "same_file_path": "file.path", "same_source_ip": "network.source_ip",
    "same_destination_ip": "network.destination_ip", "same_dns_query": "dns.query",
    "same_registry_key": "registry.key", "same_rule": "rule_id",
}


def tokens(events: DataFrame, scope: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Narrow event rows: one comparable 64-bit token per reason, null when absent."""
    texts = [f"lower({_clean(x)}) AS t_{name}" for name, x in _COMPARED.items()]
    scope_key = ", ".join(f"coalesce(CAST({c} AS STRING), '')" for c in scope)
    plain = events.selectExpr(
        *scope, *carry, f"xxhash64({scope_key}) AS scope_key", f"{_clean('event_id')} AS event_id", "unix_micros(timestamp) AS ts",
        *texts, "CAST(process.pid AS LONG) AS own_pid", "CAST(process.parent_pid AS LONG) AS own_ppid",
        "array_sort(array_distinct(filter(transform(coalesce(mitre_techniques, array()), t -> nullif(trim(t), '')), "
        "t -> t IS NOT NULL))) AS technique_list",
    ).filter("event_id IS NOT NULL AND ts IS NOT NULL")

    def token(name: str) -> str:
        if name in ("parent_child", "same_mitre_technique"):
            return "CAST(NULL AS LONG)"
        on_host = " AND t_same_host IS NOT NULL" if _BIT[name] & _HOST_GATED else ""
        if name == "same_process_id":
            return f"CASE WHEN own_pid IS NOT NULL{on_host} THEN own_pid END"
        return f"CASE WHEN t_{name} IS NOT NULL{on_host} THEN xxhash64(t_{name}) END"

    narrow = plain.selectExpr(
        *scope, *carry, "scope_key", "event_id", "ts", f"array({', '.join(token(n) for n in vocab.REASON_NAMES)}) AS tok",
        "CASE WHEN t_same_host IS NOT NULL THEN own_pid END AS pid",
        "CASE WHEN t_same_host IS NOT NULL THEN own_ppid END AS ppid",
        "transform(technique_list, t -> xxhash64(t)) AS techs",
    )
    held = " + ".join(f"CASE WHEN tok[{i}] IS NOT NULL THEN {1 << i} ELSE 0 END" for i in range(_N))
    return narrow.selectExpr("*", f"{held} AS held")


def one_per_id(narrow: DataFrame) -> DataFrame:
    """Of the deliveries of one event id in a scope the earliest counts; of equal times the smallest row.

    Every form (pairs, best pairs, seeds) starts from these rows, so copies neither pair nor
    count as members of a group.
    """
    mixed = narrow.withColumn("_mix", F.xxhash64("tok", "pid", "ppid", "techs"))
    return top_k(mixed, ["scope_key", "event_id"], ["ts", "_mix"], 1).select(*narrow.columns)


def _variants() -> Column:
    """Forms of an event: as itself, as parent, as child; with none or one technique."""
    none = F.lit(None).cast("long")

    def form(role: int, family: Column, technique: Column) -> Column:
        need = (_PARENT if role else 0) | (_TECHNIQUE if technique is not none else 0)
        return F.struct(
            F.lit(role).alias("role"), F.lit(need).alias("need"),
            family.alias("family"), technique.alias("technique"),
        )

    def with_technique(role: int, family: Column):
        return lambda technique: form(role, family, technique)

    out = []
    for role, family in ((_NO_ROLE, none), (_AS_PARENT, F.col("pid")), (_AS_CHILD, F.col("ppid"))):
        forms = F.concat(F.array(form(role, family, none)), F.transform("techs", with_technique(role, family)))
        out.append(forms if role == _NO_ROLE else F.when(family.isNotNull(), forms))
    return F.flatten(F.array_compact(F.array(*out)))


def _positions(mask: Column) -> Column:
    """Token positions of the reasons in a mask, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(_N - 1)), lambda i: F.getbit(mask, i) == 1)


def _group_key(mask: Column, positions: Column, family: Column, technique: Column) -> Column:
    """Key of a group: the tokens of the reasons in the mask, and the parties of the others."""
    tokens_of = F.transform(positions, lambda p: F.col("tok")[p])
    return F.xxhash64(F.col("scope_key"), mask, tokens_of, family, technique)


_WIDE = ["pid", "ppid", "techs", "tok"]


def key_rows(events: DataFrame, sets: Column, rules: Rules, carry: Sequence[str] = ()) -> DataFrame:
    """One row per event and smallest set it can take part in.

    Only ids and the key, unless ``carry`` asks for more: what the pair test needs is
    joined back to the few pairs that match.
    """
    forms = events.select("*", F.explode(_variants()).alias("v"))
    forms = forms.withColumn("have", F.col("held") + F.col("v.need"))
    # a form is for the sets that use it, so the forms of an event do not repeat each other
    special = F.lit(_PARENT | _TECHNIQUE)
    usable = F.filter(
        sets,
        lambda s: (s["mask"].bitwiseAND(F.col("have")) == s["mask"])
        & (s["mask"].bitwiseAND(special) == F.col("v.need")),
    )
    rows = forms.select("*", F.explode(usable).alias("s"))
    # window 0 still needs cells: events of one instant
    cell = F.floor(F.col("ts") / F.lit(max(rules.window_micros, 1))).cast("long")
    return rows.select(
        *carry, "scope_key", "event_id", "ts", F.col("v.family").alias("family"), F.col("v.technique").alias("technique"),
        F.col("v.role").alias("role"), F.col("s.mask").alias("mask"),
        _group_key(F.col("s.mask"), F.col("s.pos"), F.col("v.family"), F.col("v.technique")).alias("key"),
        cell.alias("cell"),
    )


# -- pairs ----------------------------------------------------------------------------------


def _pair_mask() -> Column:
    """Reason mask of a joined pair (a, b)."""
    host = f"coalesce(a.tok[{_POS['same_host']}] = b.tok[{_POS['same_host']}], false)"
    bits = []
    for name, bit in _BIT.items():
        if bit == _PARENT:
            test = f"{host} AND (coalesce(a.pid = b.ppid, false) OR coalesce(a.ppid = b.pid, false))"
        elif bit == _TECHNIQUE:
            test = "arrays_overlap(a.techs, b.techs)"
        else:
            test = f"coalesce(a.tok[{_POS[name]}] = b.tok[{_POS[name]}], false)"
            test += f" AND {host}" if bit & _HOST_GATED else ""
        bits.append(f"CASE WHEN {test} THEN {bit} ELSE 0 END")
    return F.expr(" + ".join(bits))


def _matched(
    left: DataFrame, right: DataFrame, scope: Sequence[str], rules: Rules, both_ways: bool = False,
    events: DataFrame | None = None,
) -> DataFrame:
    """Join key rows into pairs; ``left`` is the earlier event, or the seed.

    With ``events`` the key rows are narrow and the matches are completed from there.
    """
    reach = (-1, 0, 1) if both_ways else (0, 1)
    spread = left.withColumn(
        "cell", F.explode(F.array(*[F.col("cell") + F.lit(d).cast("long") for d in reach]))
    )
    a, b = spread.alias("a"), right.alias("b")
    delta = F.col("b.ts") - F.col("a.ts")
    c = F.col
    # the key is a hash over scope, set and tokens; scope and set are compared as well
    on = (c("a.key") == c("b.key")) & (c("a.cell") == c("b.cell"))
    on = on & (c("a.mask") == c("b.mask")) & (c("a.scope_key") == c("b.scope_key"))
    if both_ways:
        on = on & (c("a.event_id") != c("b.event_id")) & (F.abs(delta) <= rules.window_micros)
    else:
        later = (c("a.ts") < c("b.ts")) | ((c("a.ts") == c("b.ts")) & (c("a.event_id") < c("b.event_id")))
        on = on & later & (delta <= rules.window_micros)
    joined = a.join(b, on & _roles_fit())
    return _pair_rows(joined if events is None else _completed(joined, scope, events), scope)


def _blocks(narrow: DataFrame, rules: Rules) -> DataFrame:
    """Events sent to where they meet: one row for each of ``Rules.places`` whose sets they can take part in.

    ``_home`` is false for the copies of a block's last window in the next block; their partners there are all later.
    """
    window = max(rules.window_micros, 1)
    places = [{"reason": reason, "sets": _set_list(masks)} for reason, masks in rules.places()]
    listed = F.from_json(F.lit(json.dumps(places)), f"array<struct<reason:int,sets:{_SET_TYPE}>>")
    could = F.col("held") + F.expr(f"CASE WHEN pid IS NOT NULL OR ppid IS NOT NULL THEN {_PARENT} ELSE 0 END")
    could = could + F.expr(f"CASE WHEN size(techs) > 0 THEN {_TECHNIQUE} ELSE 0 END")
    usable = F.filter(listed, lambda p: F.exists(p["sets"], lambda s: s["mask"].bitwiseAND(F.col("_could")) == s["mask"]))
    rows = narrow.withColumn("_could", could).withColumn("_reason", F.explode(F.transform(usable, lambda p: p["reason"]))).drop("_could")
    rows = rows.withColumn("_token", F.when(F.col("_reason") >= 0, F.get("tok", F.col("_reason"))))
    first, last = (F.floor((F.col("ts") + more) / (window * BLOCK_WINDOWS)).cast("long") for more in (F.lit(0), F.lit(rules.window_micros)))
    rows = rows.withColumn("_own", first).withColumn("_block", F.explode(F.array_distinct(F.array(first, last))))
    rows = rows.withColumn("_home", F.col("_own") == F.col("_block")).drop("_own")
    return rows.repartition("scope_key", "_reason", "_token", "_block")


def _met(narrow: DataFrame, scope: Sequence[str], rules: Rules, fresh: str | None = None) -> DataFrame:
    """All qualifying pairs of ``narrow``, earlier event first, each once; with ``fresh`` those with an event of that flag."""
    place = ["scope_key", "_reason", "_token", "_block"]
    # the sets of a place by what a form of an event is for: a look instead of a search
    needs, masks = (0, _PARENT, _TECHNIQUE, _PARENT | _TECHNIQUE), dict(rules.places())
    by_need = [[_set_list([m for m in masks.get(r, ()) if m & needs[-1] == need]) for need in needs] for r in range(-1, _N)]
    listed = F.from_json(F.lit(json.dumps(by_need)), f"array<array<{_SET_TYPE}>>")
    need = F.col("v.need")
    own = F.get(F.get(listed, F.col("_reason") + 1), sum(F.when(need == n, i).otherwise(0) for i, n in enumerate(needs)))
    flag = [fresh] if fresh else []
    carry = [*place[1:], "_home", *[c for c in scope if c not in place], *_WIDE, *flag]
    rows = key_rows(_blocks(narrow, rules), own, rules, carry)
    frame = Window.partitionBy(*place, "mask", "key").orderBy("ts").rangeBetween(0, rules.window_micros)
    partner = F.struct("event_id", "ts", "role", *_WIDE, *flag)
    rows = rows.withColumn("_near", F.collect_list(F.when(F.col("_home"), partner)).over(frame))
    # a row at home is in its own frame
    rows = rows.filter(F.size("_near") > F.col("_home").cast("int"))
    first = F.struct(*scope, "event_id", "ts", "mask", "technique", "role", *_WIDE, *flag).alias("a")
    pairs = rows.select(first, F.explode("_near").alias("b"))
    c = F.col
    later = (c("a.ts") < c("b.ts")) | ((c("a.ts") == c("b.ts")) & (c("a.event_id") < c("b.event_id")))
    pairs = pairs.filter(later & _roles_fit())
    if fresh:
        pairs = pairs.filter(c(f"a.{fresh}") | c(f"b.{fresh}"))
    return _once(_pair_rows(pairs, scope), rules)


def _completed(joined: DataFrame, scope: Sequence[str], events: DataFrame) -> DataFrame:
    """Matches of narrow key rows with both events as structs ``a`` and ``b``."""
    c = F.col
    ids = joined.select(
        c("a.scope_key").alias("scope_key"), c("a.event_id").alias("a_id"), c("b.event_id").alias("b_id"),
        c("a.mask").alias("mask"), c("a.technique").alias("technique"), c("a.role").alias("role"),
    )
    fields = ["event_id", "ts", *_WIDE]
    first = events.select("scope_key", c("event_id").alias("a_id"), F.struct(*scope, *fields).alias("first"))
    second = events.select("scope_key", c("event_id").alias("b_id"), F.struct(*fields).alias("b"))
    both = ids.join(first, ["scope_key", "a_id"]).join(second, ["scope_key", "b_id"])
    return both.select(F.struct("first.*", "mask", "technique", "role").alias("a"), "b")


def _roles_fit() -> Column:
    """Both sides as themselves, or one as parent and one as child."""
    a, b = F.col("a.role"), F.col("b.role")
    return ((a == _NO_ROLE) & (b == _NO_ROLE)) | (a + b == _AS_PARENT + _AS_CHILD)


def _pair_rows(joined: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Pair columns of joined key rows (a, b)."""
    c = F.col
    delta = c("b.ts") - c("a.ts")
    return joined.select(
        *[c(f"a.{name}").alias(name) for name in scope],
        c("a.event_id").alias("source_event_id"), c("b.event_id").alias("related_event_id"),
        F.abs(delta).alias("delta_micros"),
        c("a.mask").alias("set_mask"),
        c("a.technique").alias("_technique"),
        F.array_intersect("a.techs", "b.techs").alias("_shared"),
        (c("a.role") == _AS_CHILD).alias("_as_child"),
        F.coalesce(c("a.pid") == c("b.ppid"), F.lit(False)).alias("_parent_too"),
        _pair_mask().alias("mask"),
    )


def _once(pairs: DataFrame, rules: Rules) -> DataFrame:
    """Keep one of the keys that found a pair: its owner set, first technique, parent role."""
    return _once_per_set(pairs).filter(F.col("set_mask") == rules.owner(F.col("mask")))


def _once_per_set(pairs: DataFrame) -> DataFrame:
    """Of the keys of one set that found a pair, keep first technique and parent role."""
    uses_technique = F.col("set_mask").bitwiseAND(F.lit(_TECHNIQUE)) != 0
    uses_parent = F.col("set_mask").bitwiseAND(F.lit(_PARENT)) != 0
    return pairs.filter(
        (~uses_technique | (F.col("_technique") == F.element_at("_shared", 1)))
        & (~uses_parent | ~F.col("_as_child") | ~F.col("_parent_too"))
    )


def _scored(pairs: DataFrame, scope: Sequence[str], rules: Rules) -> DataFrame:
    mask = F.col("mask")
    has = lambda name: f"mask & {_BIT[name]} <> 0"
    names = vocab.REASON_NAMES
    reasons = F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {has(n)} THEN '{n}' END" for n in names) + "))")
    raw = F.expr(" + ".join(f"CASE WHEN {has(n)} THEN {rules.weights[n]!r}D ELSE 0D END" for n in names))
    return pairs.select(
        *scope, "source_event_id", "related_event_id",
        (F.col("delta_micros") / 1e6).alias("time_delta_seconds"),
        mask.alias("reason_mask"), reasons.alias("reasons"), F.bit_count(mask).alias("reason_count"),
        rules.score(mask).alias("score"), rules.confidence(mask).alias("confidence"),
        raw.alias("total_raw"), F.lit(rules.score_mode).alias("weight_mode"),
    )


def pair_order() -> list[Column]:
    return [F.desc("confidence"), F.desc("score"), F.asc("source_event_id"), F.asc("related_event_id")]


def correlate_all(
    events: DataFrame, scope: Sequence[str] = ("tenant_id",), rules: Rules | None = None,
    per_scope: int | None = None,
) -> DataFrame:
    """All qualifying pairs of each scope, earlier event first; or the best ``per_scope``.

    An event id counts once in a scope (``one_per_id``). All pairs grow with the
    square of a group of equal events; the bounded form does not make those pairs.
    """
    rules = rules or Rules()
    scope = list(scope)
    if per_scope is not None and per_scope < 1:
        raise ValueError("per_scope must be at least 1")
    if per_scope is not None:
        from casewright.operators import pair_counts  # built on this module

        return pair_counts.Pairs(events, scope, rules).top(per_scope)
    return _scored(_met(one_per_id(tokens(events, scope)), scope, rules), scope, rules)


def correlate_seeds(
    events: DataFrame, seeds: DataFrame, scope: Sequence[str] = ("tenant_id",),
    rules: Rules | None = None, per_seed: int | None = None,
) -> DataFrame:
    """Partners of each seed event, before or after it, or its best ``per_seed``. ``seeds``: event_id."""
    rules = rules or Rules()
    scope = list(scope)
    narrow = cut_lineage(one_per_id(tokens(events, scope)))
    rows = key_rows(narrow, _set_literal(rules.smallest_sets()), rules)
    chosen = rows.join(seeds.select("event_id").distinct(), "event_id", "left_semi").select(*rows.columns)
    pairs = _matched(chosen, rows, scope, rules, both_ways=True, events=narrow)
    pairs = _scored(_once(pairs, rules), scope, rules)
    if per_seed is None:
        return pairs
    order = [F.desc("confidence"), F.desc("score"), F.asc("related_event_id")]
    return top_k(pairs, [*scope, "source_event_id"], order, per_seed)


# -- the streaming form --------------------------------------------------------------------------


def pair_writer(
    folder: str, lateness_seconds: float, scope: Sequence[str] = ("tenant_id",), rules: Rules | None = None,
) -> Callable[[DataFrame, int], None]:
    """Handler for ``foreachBatch`` that writes all qualifying pairs of a stream; read them with ``written_pairs``.

    A trigger's events meet each other and the kept ones, by the means of the batch form, so both give the same
    pairs. Kept are, as narrow rows below ``folder``, events of the last window and lateness; no key rows and no pairs are state.
    Of the deliveries of one event id the first to arrive counts. Events more than ``lateness_seconds`` older than the
    newest of earlier triggers are dropped. A repeated trigger writes the same files again.
    """
    rules, scope = rules or Rules(), list(scope)
    late = int(round(lateness_seconds * 1_000_000))
    reach = late + max(rules.window_micros, late)

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = one_per_id(tokens(batch, scope))
        # three places in turn: the one before is read, and a repeated trigger overwrites its own
        place = lambda n: f"{folder}/kept/{n % 3}"
        known = spark.read.schema(new.schema).parquet(place(number - 1)) if number else None
        newest = known.agg(F.max("ts")).first()[0] if number else None
        if newest is not None:
            new = new.filter(F.col("ts") >= newest - late).join(known.select("scope_key", "event_id"), ["scope_key", "event_id"], "left_anti")
        rows = new.select(*known.columns if number else new.columns).withColumn("_fresh", F.lit(True))
        if number:
            rows = rows.unionByName(known.withColumn("_fresh", F.lit(False)))
        pairs = _met(rows, scope, rules, "_fresh").select(*scope, "source_event_id", "related_event_id", "delta_micros", "mask")
        pairs.write.mode("overwrite").parquet(f"{folder}/pairs/batch={number}")
        times = [t for t in (newest, batch.agg(F.max(F.unix_micros("timestamp"))).first()[0]) if t is not None]
        kept = rows.drop("_fresh").filter(F.col("ts") >= (max(times) if times else 0) - reach)
        kept.write.mode("overwrite").parquet(place(number))

    return handle


def written_pairs(spark: SparkSession, folder: str, scope: Sequence[str] = ("tenant_id",), rules: Rules | None = None) -> DataFrame:
    """The pairs that ``pair_writer`` has written, scored; ids, time and reasons are stored, the rest follows from them."""
    return _scored(spark.read.parquet(f"{folder}/pairs"), list(scope), rules or Rules())


def correlate_stream(
    events: DataFrame, lateness: str, scope: Sequence[str] = ("tenant_id",), rules: Rules | None = None,
) -> DataFrame:
    """All qualifying pairs of a stream, by an interval join of the stream with itself.

    Keys and the once-only rule are those of the batch form, so both give the same
    pairs; of the deliveries of one event id the first to arrive counts. The time cell is among
    the keys, so a busy key is split over its cells. The watermark lets Spark drop rows older than window plus ``lateness``.
    State holds every key of a trigger's events: triggers must be small. ``pair_writer`` has no such bound.
    """
    rules = rules or Rules()
    scope = list(scope)

    def side(name: str) -> DataFrame:
        watched = events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark([*scope, "event_id"])
        narrow = tokens(watched, scope, ["timestamp"])
        sets = _set_literal(rules.smallest_sets())
        return key_rows(narrow, sets, rules, ["timestamp", *scope, *_WIDE]).alias(name)

    c = F.col
    a, b = side("a"), side("b")
    # a partner lies in the cell of the earlier event or in the next one
    a = a.withColumn("cell", F.explode(F.array(c("cell"), c("cell") + F.lit(1).cast("long")))).alias("a")
    on = (c("a.key") == c("b.key")) & (c("a.mask") == c("b.mask")) & (c("a.scope_key") == c("b.scope_key"))
    on = on & (c("a.cell") == c("b.cell")) & _roles_fit()
    window = F.expr(f"INTERVAL {rules.window_micros} MICROSECONDS")
    on = on & (c("b.timestamp") >= c("a.timestamp")) & (c("b.timestamp") <= c("a.timestamp") + window)
    later = (c("a.ts") < c("b.ts")) | ((c("a.ts") == c("b.ts")) & (c("a.event_id") < c("b.event_id")))
    return _scored(_once(_pair_rows(a.join(b, on & later), scope), rules), scope, rules)


# -- details of pairs ---------------------------------------------------------------------------


def reason_table(spark: SparkSession, category: str | None = None, rules: Rules | None = None) -> DataFrame:
    """Reasons with label, category and weight; of one category, in order of name."""
    rules = rules or Rules()
    rows = [
        (n, label, cat, rules.weights[n])
        for n, label, cat, _ in vocab.CORRELATION_REASONS if category is None or cat == category
    ]
    return spark.createDataFrame(sorted(rows), "reason string, label string, category string, weight double")


def breakdown(pairs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Reasons with label, category and weight, the heaviest first."""
    rules = rules or Rules()
    rows = [(n, label, cat, rules.weights[n]) for n, label, cat, _ in vocab.CORRELATION_REASONS]
    rows.sort(key=lambda r: (-r[3], r[0]))
    table = F.array(
        *[
            F.struct(
                F.lit(n).alias("reason"), F.lit(label).alias("label"),
                F.lit(cat).alias("category"), F.lit(w).alias("weight"),
            )
            for n, label, cat, w in rows
        ]
    )
    return pairs.withColumn("breakdown", F.filter(table, lambda r: F.array_contains("reasons", r["reason"])))


def flags(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(
        {"is_strong": F.col("confidence") >= 0.70, "is_weak": F.col("confidence") < 0.40}
    )


def row_errors() -> Column:
    """Rules a pair row breaks; an empty list means valid."""
    a, b = F.col("source_event_id"), F.col("related_event_id")
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    checks = [
        (~filled(a) | ~filled(b), "both event ids are required"),
        (a == b, "an event cannot correlate with itself"),
        (F.col("time_delta_seconds") < 0, "time delta must not be negative"),
        (F.size(F.array_distinct("reasons")) != F.size("reasons"), "reasons must be unique"),
    ]
    return F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks]))


def with_rationale(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Add one sentence per reason. Joins the events back, for these pairs only."""
    side = lambda name: events.select(
        clean(F.col("event_id")).alias(f"{name}_event_id"),
        F.struct(
            clean(F.col("host")).alias("host"), clean(F.col("user")).alias("user"),
            clean(F.col("process.name")).alias("pname"), F.col("process.pid").alias("pid"),
            F.col("process.parent_pid").alias("ppid"),
            F.lower(F.expr(FILE_HASH_SQL)).alias("file_hash"),
            clean(F.col("file.path")).alias("path"), clean(F.col("network.source_ip")).alias("src"),
            clean(F.col("network.destination_ip")).alias("dst"), clean(F.col("dns.query")).alias("dns"),
            clean(F.col("registry.key")).alias("reg"), clean(F.col("rule_id")).alias("rule"),
            F.col("mitre_techniques").alias("techs"),
        ).alias(f"_{name}"),
    )
    joined = pairs.join(side("source"), "source_event_id").join(side("related"), "related_event_id")
    a = lambda f: F.col(f"_source.{f}")
    b = lambda f: F.col(f"_related.{f}")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    sentences = {
        "same_host": F.concat(F.lit("same host: "), a("host")),
        "same_user": F.concat(F.lit("same user: "), a("user")),
        "same_process_name": F.concat(F.lit("same process name: "), a("pname")),
        "same_process_id": F.concat(F.lit("same process PID: "), text(a("pid"))),
        "parent_child": F.concat(
            F.lit("parent-child process relation (pid="), text(a("pid")), F.lit("/"), text(b("pid")),
            F.lit(", ppid="), text(a("ppid")), F.lit("/"), text(b("ppid")), F.lit(")"),
        ),
        "same_file_hash": F.concat(F.lit("same file hash: "), a("file_hash")),
        "same_file_path": F.concat(F.lit("same file path: "), a("path")),
        "same_source_ip": F.concat(F.lit("same source IP: "), a("src")),
        "same_destination_ip": F.concat(F.lit("same destination IP: "), a("dst")),
        "same_dns_query": F.concat(F.lit("same DNS query: "), a("dns")),
        "same_registry_key": F.concat(F.lit("same registry key: "), a("reg")),
        "same_mitre_technique": F.concat(
            F.lit("shared MITRE techniques: ["),
            F.concat_ws(
                ", ",
                F.transform(
                    F.array_sort(F.array_intersect(a("techs"), b("techs"))),
                    lambda t: F.concat(F.lit("'"), t, F.lit("'")),
                ),
            ),
            F.lit("]"),
        ),
        "same_rule": F.concat(F.lit("same rule: "), a("rule")),
    }
    said = F.array_compact(
        F.array(*[F.when(F.array_contains("reasons", n), sentences[n]) for n in vocab.REASON_NAMES])
    )
    return joined.withColumn("rationale", said).select(*pairs.columns, "rationale")
