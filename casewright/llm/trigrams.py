"""Trigram inverted index over texts, and the Boolean trigram queries of regular expressions.

A trigram is three bytes of a text's UTF-8 with A-Z in lower case. Of a regular expression follows a query of ANDs and ORs of trigrams
that every text with a match answers: strings that must stand at its ends, or are all that it can match, are followed through
its parts, and where parts meet their strings give further trigrams.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import words as W
from casewright.llm.common import text_or_empty

#: Strings that are followed at a time; beyond, their trigrams are noted and they are let go.
MANY = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass(frozen=True)
class Query:
    """All or any of some trigrams and further queries; ``all`` of nothing holds for every text."""

    every: bool
    parts: frozenset[bytes | Query]

    @property
    def anything(self) -> bool:
        return self.every and not self.parts

    def trigrams(self) -> set[bytes]:
        return {t for p in self.parts for t in ([p] if isinstance(p, bytes) else p.trigrams())}


ANYTHING = Query(True, frozenset())


def _joined(every: bool, queries: Iterable[bytes | Query]) -> Query:
    parts: set[bytes | Query] = set()
    for q in queries:
        if isinstance(q, Query) and q.anything:
            if not every:
                return ANYTHING
        elif isinstance(q, Query) and (q.every == every or len(q.parts) == 1):
            parts |= q.parts
        else:
            parts.add(q)
    if len(parts) == 1:
        (one,) = parts
        return one if isinstance(one, Query) else Query(True, frozenset(parts))
    return Query(every, frozenset(parts))


def _all(*queries: bytes | Query) -> Query:
    return _joined(True, queries)


def _any(*queries: bytes | Query) -> Query:
    return _joined(False, queries)


def _of(strings: Iterable[bytes]) -> Query:
    """What a text answers that holds one of the strings."""
    return _any(*[_all(*{s[i : i + 3] for i in range(len(s) - 2)}) for s in strings])


@dataclass(frozen=True)
class Part:
    """What is known of a part's matches: all of them, or how they begin and end; and their query."""

    exact: frozenset[bytes] | None
    begins: frozenset[bytes] = frozenset([b""])
    ends: frozenset[bytes] = frozenset([b""])
    query: Query = ANYTHING

    def open(self) -> Part:
        """The same without its exact strings."""
        return self if self.exact is None else Part(None, self.exact, self.exact, _of(self.exact))


UNKNOWN = Part(None)
NOTHING = Part(frozenset([b""]))


def _cross(left: frozenset[bytes], right: frozenset[bytes]) -> frozenset[bytes] | None:
    return frozenset(a + b for a, b in product(left, right)) if len(left) * len(right) <= MANY else None


def _then(a: Part, b: Part) -> Part:
    both = _cross(a.exact, b.exact) if a.exact is not None and b.exact is not None else None
    if both is not None:
        return Part(both)
    x, y = a.open(), b.open()
    seam = _cross(x.ends, y.begins)
    begins = (_cross(a.exact, y.begins) if a.exact is not None else None) or x.begins
    ends = (_cross(x.ends, b.exact) if b.exact is not None else None) or y.ends
    return Part(None, begins, ends, _all(x.query, y.query, *([_of(seam)] if seam else [])))


def _or(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MANY:
        return Part(a.exact | b.exact)
    x, y = a.open(), b.open()
    begins, ends = x.begins | y.begins, x.ends | y.ends
    none = frozenset([b""])
    return Part(None, begins if len(begins) <= MANY else none, ends if len(ends) <= MANY else none, _any(x.query, y.query))


def _characters(items: list) -> Part:
    codes: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes.add(value)
        elif kind is op.RANGE and value[1] - value[0] < 256:
            codes |= set(range(value[0], value[1] + 1))
        else:
            return UNKNOWN
    return _strings(codes)


def _strings(codes: Iterable[int]) -> Part:
    found = frozenset((chr(c).lower() if c < 128 else chr(c)).encode("utf-8", "surrogatepass") for c in codes)
    return Part(found) if len(found) <= MANY else UNKNOWN


def _repeated(least: int, most: int, inner: Part) -> Part:
    if least == 0:
        return _or(inner, NOTHING) if most == 1 else UNKNOWN
    copies = min(least, 3)
    whole = reduce(_then, [inner] * copies)
    return whole if most == copies else _then(whole, UNKNOWN)


def _part(kind, value) -> Part:
    if kind is op.LITERAL:
        return _strings([value])
    if kind is op.IN:
        return _characters(value)
    if kind is op.BRANCH:
        return reduce(_or, [_sequence(b) for b in value[1]])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        return _repeated(value[0], value[1], _sequence(value[2]))
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.ATOMIC_GROUP:
        return _sequence(value)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return NOTHING
    return UNKNOWN


def _sequence(nodes) -> Part:
    return reduce(_then, [_part(*n) for n in nodes], NOTHING)


def query(pattern: str) -> Query:
    """The trigrams that every text with a match of ``pattern`` has; ``ANYTHING`` if it asks for none."""
    return _sequence(parser.parse(pattern)).open().query


def code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class Wanted:
    """A set of trigrams to index, as a table of all codes; None for all."""

    def __init__(self, trigrams: Iterable[bytes] | None):
        self.table = None
        if trigrams is not None:
            self.table = np.zeros(1 << 24, bool)
            self.table[[code(t) for t in trigrams]] = True


class Segment:
    """The postings of some texts: for each trigram the texts that hold it, ascending."""

    def __init__(self, texts: W.Texts, wanted: Wanted):
        data = _LOWER[texts.data].astype(np.uint32)
        codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:] if len(data) > 2 else np.zeros(0, np.uint32)
        places = np.arange(len(codes)) if wanted.table is None else np.flatnonzero(wanted.table[codes])
        text = np.searchsorted(texts.begins, places, "right") - 1
        inside = places + 2 < texts.begins[text + 1]  # not across the end of a text
        pairs = np.unique(codes[places[inside]].astype(np.int64) * len(texts) + text[inside])
        self.texts = len(texts)
        self.rows = pairs % max(len(texts), 1)
        self.codes, self.first = np.unique(pairs // max(len(texts), 1), return_index=True)
        self.first = np.append(self.first, len(pairs))

    def posting(self, trigram: bytes) -> np.ndarray:
        at = int(np.searchsorted(self.codes, code(trigram)))
        if at == len(self.codes) or self.codes[at] != code(trigram):
            return self.rows[:0]
        return self.rows[self.first[at] : self.first[at + 1]]

    def answer(self, asked: Query) -> np.ndarray:
        """The texts that answer a query: postings are intersected, the shortest first, or united."""
        if asked.anything:
            return np.arange(self.texts)
        found = [self.posting(p) if isinstance(p, bytes) else self.answer(p) for p in asked.parts]
        if not asked.every:
            return np.unique(np.concatenate(found))
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(found, key=len))


def _post(trigrams: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(trigrams)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, texts in W.slices(batch.column(1)):
                held = Segment(texts, wanted)
                lists = pa.ListArray.from_arrays(pa.array(held.first.astype(np.int32)), pa.array(ids[row + held.rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(held.codes, pa.int32()), lists], names=["trigram", "doc_ids"])

    return run


def postings(df: DataFrame, trigrams: Iterable[bytes] | None = None) -> DataFrame:
    """The inverted index as a table: (trigram, doc_ids), one row for each trigram of a megabyte of texts.

    Written once (sorted by trigram, so that a search reads few row groups), it answers any rule. ``trigrams`` leaves out all others. Rows
    without an id are left out; null and short texts have no trigram; other columns are not read.
    """
    rows = df.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("content"))
    return rows.mapInArrow(_post(None if trigrams is None else frozenset(trigrams)), "trigram int, doc_ids array<bigint>")


def search(index: DataFrame, asked: Query) -> DataFrame:
    """doc_id of all documents of ``postings`` that answer a query; candidates, to be verified.

    Postings meet by document, so a trigram that a third of all documents hold is no single task's.
    """
    if asked.anything:
        raise ValueError("a query without a mandatory trigram is answered by every text: scan them")
    names = sorted(asked.trigrams())
    held = index.filter(F.col("trigram").isin([code(t) for t in names])).select("trigram", F.explode("doc_ids").alias("doc_id"))
    has = {t: F.max(F.col("trigram") == code(t)).alias(f"_{i}") for i, t in enumerate(names)}
    met = held.groupBy("doc_id").agg(*has.values())

    def holds(q: Query) -> Column:
        parts = [F.col(f"_{names.index(p)}") if isinstance(p, bytes) else holds(p) for p in q.parts]
        return reduce(lambda a, b: a & b if q.every else a | b, parts)

    return met.filter(holds(asked)).select("doc_id")
