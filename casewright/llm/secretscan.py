"""Secrets in whole texts: regular expressions, each tried only on texts that its trigrams allow.

Texts come in segments of about a megabyte. A segment gets an inverted index of the trigrams that the rules ask for;
every rule's Boolean query is answered from its postings, and only the texts that answer it are searched with the regular expression. A rule
that asks for no trigram searches all texts. Nothing is shuffled, and a task that is lost is run again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import trigrams
from casewright.llm import words as W
from casewright.llm.common import text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and how long its match (or one group of it) is at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{either_case('api')}_?{either_case('key')}"

BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)
#: Further kinds, by the forms in which their issuers publish them.
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login_url", r"://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/:@]{1,100}@"),
)
RULES = BASE + FURTHER

SPANS = "array<struct<start:int,rank:int,end:int>>"


def spans(rule: Rule, text: str, compiled: re.Pattern) -> Iterator[tuple[int, int]]:
    """(start, end) of the leftmost non-overlapping matches that are long enough; what fails is not tried again."""
    for m in compiled.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.start(), m.end()


def compiled(rule: Rule) -> re.Pattern:
    """A rule as it is run. A repetition of a class that only has to be long enough asks for the length at once.

    The result is the same: matches of a single class are maximal runs.
    """
    single = re.fullmatch(r"\[[^\[\]]+\]\+", rule.pattern)
    pattern = f"{rule.pattern[:-1]}{{{rule.least},}}" if single and rule.least > 1 else rule.pattern
    return re.compile(pattern, re.ASCII)


def _scan(rules: Sequence[Rule]):
    queries = [trigrams.query(r.pattern) for r in rules]
    asked = frozenset().union(*(q.trigrams() for q in queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, patterns = trigrams.Wanted(asked), [compiled(r) for r in rules]
        for batch in batches:
            content = batch.column(batch.num_columns - 1)
            for row, texts in W.slices(content):
                held = trigrams.Segment(texts, wanted)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
                read: dict[int, str] = {}
                for rank, (rule, asked_for, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
                    for i in held.answer(asked_for).tolist():
                        if i not in read:
                            read[i] = texts.data[texts.begins[i] : texts.begins[i + 1]].tobytes().decode("utf-8", "replace")
                        found[i] += [(start, rank, end) for start, end in spans(rule, read[i], pattern)]
                lists = [[dict(zip(("start", "rank", "end"), s, strict=True)) for s in sorted(f)] for f in found]
                kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "rank", "end")]))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(row, len(texts)) for i in range(batch.num_columns - 1)], pa.array(lists, kind)],
                    names=[*batch.schema.names[:-1], "spans"],
                )

    return run


def scan(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and ``spans`` of every row, by start and rule: (start, rank, end), ``rank`` counting through ``rules``.

    Offsets are code points, ends exclusive; matches of one rule do not overlap. Null and empty texts have no span; rows with equal
    texts have equal spans, each its own; an empty table gives an empty result; other columns are not read. Patterns are ASCII:
    letters outside have no case and are in no class by name.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("content"))
    return rows.mapInArrow(_scan(tuple(rules)), f"doc_id long, spans {SPANS}")


def spelled(found: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, found: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    kinds = F.array(*[F.lit(f"[{r.kind.upper()}]") for r in rules])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        name = F.when(s["start"] >= state["at"], F.get(kinds, s["rank"])).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, name).alias("out"))

    done = F.aggregate(found, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
