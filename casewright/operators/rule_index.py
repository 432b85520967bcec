"""Selection rules by index: of thousands of rules only those are evaluated that an event can match.

A rule is a tree of ``all`` and ``any`` over atoms; an atom compares one field with one text. Every rule names a few atoms of which one must hold
wherever the rule does. Atoms of a field are found together: equal texts in a dictionary, contained texts and the longest fixed
parts of globs in one Aho-Corasick automaton. What an event's atoms point to is evaluated on the atoms alone, so neither the plan nor the
cost of an event grows with rules that have nothing to do with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EQUALS, CONTAINS, GLOB = "equals", "contains", "glob"
#: Answers for combinations of field values that a task remembers.
REMEMBERED = 100_000


@dataclass(frozen=True)
class Atom:
    """A test of one field's text in lower case; false for null."""

    field: str
    kind: str
    text: str


@dataclass(frozen=True)
class Tree:
    """All or any of some atoms and trees; all of nothing holds, any of nothing does not."""

    every: bool
    parts: tuple[Atom | Tree, ...]


def atoms(node: Atom | Tree) -> set[Atom]:
    return {node} if isinstance(node, Atom) else {a for p in node.parts for a in atoms(p)}


def _literal(atom: Atom) -> str:
    """The longest fixed part of an atom's text."""
    return max(re.split(r"[*?]+", atom.text), key=len) if atom.kind == GLOB else atom.text


def necessary(node: Atom | Tree) -> frozenset[Atom] | None:
    """Atoms of which at least one holds wherever the node does; None if there are none to be named."""
    if isinstance(node, Atom):
        return frozenset([node]) if _literal(node) else None
    named = [necessary(p) for p in node.parts]
    if node.every:
        known = [n for n in named if n is not None]
        # the fewest atoms, then the longest texts: they point to the rule most rarely
        return min(known, key=lambda n: (len(n), -min((len(_literal(a)) for a in n), default=0)), default=None)
    return None if None in named else frozenset().union(*named)


def holds(node: Atom | Tree, true: set[Atom]) -> bool:
    if isinstance(node, Atom):
        return node in true
    return (all if node.every else any)(holds(p, true) for p in node.parts)


class _Field:
    """The atoms of one field."""

    def __init__(self, found: Sequence[Atom]):
        import ahocorasick

        self.equal: dict[str, list[Atom]] = {}
        self.any_text: list[tuple[Atom, re.Pattern | None]] = []  # without a fixed part
        fragments: dict[str, list[tuple[Atom, re.Pattern | None]]] = {}
        for atom in found:
            if atom.kind == EQUALS:
                self.equal.setdefault(atom.text, []).append(atom)
                continue
            pattern = re.compile(glob(atom.text), re.DOTALL) if atom.kind == GLOB else None
            part = _literal(atom)
            (fragments.setdefault(part, []) if part else self.any_text).append((atom, pattern))
        self.automaton = None
        if fragments:
            self.automaton = ahocorasick.Automaton()
            for part, behind in fragments.items():
                self.automaton.add_word(part, behind)
            self.automaton.make_automaton()

    def true(self, text: str | None) -> frozenset[Atom]:
        if text is None:
            return frozenset()
        out = set(self.equal.get(text, ()))
        maybe = list(self.any_text)
        if self.automaton is not None:
            for _, behind in self.automaton.iter(text):
                maybe += behind
        out |= {atom for atom, pattern in maybe if pattern is None or pattern.fullmatch(text)}
        return frozenset(out)


def glob(text: str) -> str:
    return "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in text)


class Index:
    """Rules by the atoms that point to them."""

    def __init__(self, rules: Sequence[Tree]):
        self.rules = list(rules)
        every = sorted({a for r in rules for a in atoms(r)}, key=lambda a: (a.field, a.kind, a.text))
        self.fields = sorted({a.field for a in every})
        self._atoms = every
        self._tables: dict[str, _Field] | None = None
        self.pointed: dict[Atom, list[int]] = {}
        self.always: list[int] = []
        for number, rule in enumerate(rules):
            named = necessary(rule)
            if named is None:
                self.always.append(number)
            for atom in named or ():
                self.pointed.setdefault(atom, []).append(number)

    def tables(self) -> dict[str, _Field]:
        """Made where they are used: an automaton does not travel."""
        if self._tables is None:
            self._tables = {f: _Field([a for a in self._atoms if a.field == f]) for f in self.fields}
        return self._tables

    def matching(self, true: set[Atom]) -> list[int]:
        """Rules that hold, ascending; only those that a true atom points to are looked at."""
        some = {n for a in true for n in self.pointed.get(a, ())}
        return sorted(n for n in some.union(self.always) if holds(self.rules[n], true))


def _find(index: Index, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = index.tables(), {}
        for batch in batches:
            codes, sets = [], []
            for name, column in zip(index.fields, batch.columns[kept:], strict=True):
                coded = column.dictionary_encode()
                values = coded.dictionary.to_pylist()
                sets.append([tables[name].true(v) for v in values] + [frozenset()])
                codes.append(coded.indices.fill_null(len(values)).to_pylist())
            rows, rules = [], []
            places = zip(*codes, strict=True) if codes else ((),) * batch.num_rows
            for i, place in enumerate(places):
                held = tuple(s[c] for s, c in zip(sets, place, strict=True))
                if held not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[held] = index.matching(set().union(*held))
                rules += known[held]
                rows += [i] * len(known[held])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(take) for k in range(kept)], pa.array(rules, pa.int32())], names=[*batch.schema.names[:kept], "rule_number"]
            )

    return run


def find(events: DataFrame, keep: Sequence[str], fields: dict, rules: Sequence[Tree]) -> DataFrame:
    """(keep, rule_number) of every event and rule that holds. ``fields``: the column of each field name."""
    index = Index(rules)
    texts = [F.lower(fields[name].cast("string")).alias(f"_f{i}") for i, name in enumerate(index.fields)]
    kept = events.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return events.select(*keep, *texts).mapInArrow(_find(index, len(keep)), f"{schema}, rule_number int")
