"""Counts and sums over correlated pairs without making a pair.

A pair's value depends on its reason mask alone, so the sum of a value over all pairs follows from how many pairs share *at least* each
set of reasons: with Möbius inversion over the subsets, sum f(mask) = sum over sets T of g(T) * pairs(T). Events that share T
have one key, so pairs(T) is counted in groups of equal keys by time alone.

Two reasons are no equality of one field. Of technique lists the non-empty subsets are keys with alternating signs. For parent and
child one side's process id is the other's parent id: pairs one way and the other, less those that are both.

Every set that matters contains one of the smallest sets of reasons that qualify, and is counted under the first of them. So an event is
sent once for each smallest set that it has, to the others with the same key in the same stretch of time (``_members``); the larger sets are
counted where these meet, by sorting, and only among events that still share the set before (``_Cells``). A stretch is many windows long; an
event at its end is sent to the next one as well, where it pairs only with events of that one.

Of more than ``MOST_ROWS`` events that meet in one place none is held back. Their pairs come from running counts: every event stands in
the group as a point at its own time and as a probe at the end of its window, and a probe adds the points up to it. Rows are sorted over
all tasks by group and time; a group may begin in one task and end in another, and then one small row per task is joined. So the work grows
with the events, not with the square of a group, and no large group is in one task. There an event has a row for each set of its reasons
that matters, at worst 2 to their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.ordered import top_k
from casewright.operators import correlate
from casewright.operators.correlate import Rules
from casewright.session import cut_lineage

_N = len(vocab.REASON_NAMES)
_HOST, _PARENT, _TECHNIQUE = correlate._HOST, correlate._PARENT, correlate._TECHNIQUE
_GATED = correlate._HOST_GATED
#: Technique lists up to which subsets are counted; pairs of events with longer ones are made.
MOST_TECHNIQUES = 10
#: Events of one place up to which they are counted there, and how many rows are counted at once.
MOST_ROWS, ROWS_AT_ONCE = 1 << 19, 1 << 17
#: Windows in a stretch of time.
STRETCH = 16
#: How a group counts: equal fields, one side parent of the other, each side parent of the other.
_EQUAL, _ONE_WAY, _BOTH_WAYS = 0, 1, 2
#: Bit of a code whose pairs are taken off: subsets of an even number of techniques.
_EVEN = 1 << 15
#: What a row is, in the order that equal times need: points before the probes that reach them.
_POINT, _ADDS, _ADDS_NOT_ITSELF, _TAKES = 0, 1, 2, 3
#: Rows with a number of pairs instead.
_COUNTS = -1
#: Bit of ``info``: the event is of the stretch before.
_BEFORE = 1 << 15
_ORDER = ["scope_key", "code", "key", "t", "kind"]
_ROWS = "scope_key long, code int, key long, t long, kind int, pairs long"
_SPREAD = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
_COUNTED = "scope_key long, code int, key long, part int, points long, probes long, reached long, itself long, whole boolean"

Measure = Callable[[int], int]


def inversion(values: Sequence[int]) -> np.ndarray:
    """g with values[m] = sum of g over the subsets of m."""
    g = np.array(values, np.int64)
    for bit in range(_N):
        at = np.flatnonzero(np.arange(1 << _N) >> bit & 1)
        g[at] -= g[at ^ 1 << bit]
    return g


def qualifies(rules: Rules, mask: int) -> bool:
    return mask in rules.values and rules.values[mask][0] >= rules.min_confidence - 1e-9 and mask.bit_count() >= rules.min_reasons


def coefficients(rules: Rules, measure: Measure) -> np.ndarray:
    """g of a measure of qualifying masks; a mask without the host counts without the reasons that need it."""
    masks = [m if m & _HOST else m & ~_GATED for m in range(1 << _N)]
    return inversion([measure(m) if qualifies(rules, m) else 0 for m in masks])


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _salted(values: np.ndarray, salt: int) -> np.ndarray:
    return _mix(_mix(values.view(np.uint64)) + np.uint64(salt << 32 | 0x9E3779B9))


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, which are there) of a column of longs."""
    column = batch.column(name)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are there) of a batch of events: tokens, process id, parent's id, techniques."""
    tokens = batch.column("tok").flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, _N)
    lists = batch.column("techs")
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.zeros((len(tokens), _N + 2 + int(lengths.max(initial=0))), np.int64)
    there = np.zeros(values.shape, bool)
    values[:, :_N] = tokens
    there[:, :_N] = _column(batch, "held")[0][:, None] >> np.arange(_N) & 1
    for i, name in enumerate(("pid", "ppid")):
        values[:, _N + i], there[:, _N + i] = _column(batch, name)
    there[:, _N + 2:] = np.arange(values.shape[1] - _N - 2) < lengths[:, None]
    values[:, _N + 2:][there[:, _N + 2:]] = lists.flatten().to_numpy(zero_copy_only=False)
    return values, there


class _Events:
    """What the keys of a batch of events are made of, as columns of 64-bit hashes."""

    def __init__(self, scope: np.ndarray, ts: np.ndarray, values: np.ndarray, there: np.ndarray):
        self.scope, self.ts = scope, ts
        self.hashes = np.stack([_salted(np.ascontiguousarray(values[:, r]), r + 1) for r in range(_N)], 1)
        pid, ppid = np.ascontiguousarray(values[:, _N]), np.ascontiguousarray(values[:, _N + 1])
        self.as_parent, self.as_child = there[:, _N], there[:, _N + 1]
        self.lengths = there[:, _N + 2:].sum(1)
        self.techniques = np.zeros((len(ts), max(there.shape[1] - _N - 2, 1)), np.uint64)
        for k in range(there.shape[1] - _N - 2):
            self.techniques[:, k] = np.where(there[:, _N + 2 + k], _salted(np.ascontiguousarray(values[:, _N + 2 + k]), 50), np.uint64(0))
        self.probes = {_ONE_WAY: _salted(pid, 60), _BOTH_WAYS: _salted(pid, 61) + _salted(ppid, 62)}
        self.points = {_ONE_WAY: _salted(ppid, 60), _BOTH_WAYS: _salted(ppid, 61) + _salted(pid, 62)}
        self.itself = self.as_parent & self.as_child & (pid == ppid)
        self.held = there[:, :_N] @ (1 << np.arange(_N))
        self.have = self.held | np.where(self.as_parent | self.as_child, _PARENT, 0) | np.where(self.lengths > 0, _TECHNIQUE, 0)

    def spread(self, mask: int, at: np.ndarray, key: np.ndarray, first: np.ndarray | None, role: np.ndarray | None):
        """(rows, code, way, probes, points, keys) of rows that share ``mask`` and have ``key``.

        With ``first`` the keys hold that technique and subsets begin with it; with ``role`` a row is only parent or only child.
        """
        subsets: list[tuple[int, ...]] = [()]
        if mask & _TECHNIQUE:
            longest = min(int(self.lengths[at].max(initial=0)), MOST_TECHNIQUES)
            subsets = [c for k in range(1, longest + 1) for c in combinations(range(longest), k)]
        for chosen in subsets:
            rows, keys, roles = at, key, role
            if chosen:
                has = self.lengths[at] > chosen[-1]
                has &= (first == chosen[0]) if first is not None else True
                rows, keys, roles = at[has], key[has], None if role is None else role[has]
                for k in chosen:
                    keys = keys + self.techniques[rows, k]
            if len(rows) == 0:
                continue
            code = mask | (_EVEN if chosen and len(chosen) % 2 == 0 else 0)
            if not mask & _PARENT:
                yield rows, code, _EQUAL, True, True, keys
                continue
            parent = self.as_parent[rows] if roles is None else roles == correlate._AS_PARENT
            child = self.as_child[rows] if roles is None else roles == correlate._AS_CHILD
            both = self.as_parent[rows] & self.as_child[rows]
            for way, probe, point in ((_ONE_WAY, parent, child), (_BOTH_WAYS, parent & both, child & both)):
                yield rows[probe], code | way << 13, way, True, False, keys[probe] + self.probes[way][rows[probe]]
                yield rows[point], code | way << 13, way, False, True, keys[point] + self.points[way][rows[point]]


class _Out:
    """Rows to hand over, collected by column."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types = names, types
        self.columns: list[list[np.ndarray]] = [[] for _ in names]
        self.rows = 0

    def add(self, *values) -> None:
        n = max(len(v) for v in values if isinstance(v, np.ndarray))
        for column, v in zip(self.columns, values, strict=True):
            column.append(v if isinstance(v, np.ndarray) else np.full(n, v))
        self.rows += n

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)).cast(t) for c, t in zip(self.columns, self.types, strict=True)]
        self.columns, self.rows = [[] for _ in self.names], 0
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


_MEMBERS = ["place", "info", "scope_key", "ts", "bits", "fields"]


def _members(smallest: Sequence[int], window: int):
    """Events by place: key of a smallest set and stretch of time. ``info`` holds set, role, technique and whether the event is of the stretch before."""
    stretch = STRETCH * max(window, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values, there = _values(batch)
            events = _Events(_column(batch, "scope_key")[0], _column(batch, "ts")[0], values, there)
            bits = pa.array((events.held | events.as_parent << _N | events.as_child << _N + 1).astype(np.int32))
            ends = np.append(0, np.cumsum(there.sum(1))).astype(np.int32) * 8
            fields = pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(ends), pa.py_buffer(values[there].tobytes())])
            owner = _salted(events.scope, 70)
            number, last = events.ts // stretch, (events.ts + window) // stretch
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def add(rows: np.ndarray, key: np.ndarray, info: int) -> None:
                found.append((rows, _mix(key + _salted(number[rows], 71)), np.full(len(rows), info)))
                again = last[rows] > number[rows]
                rows, key = rows[again], key[again]
                found.append((rows, _mix(key + _salted(last[rows], 71)), np.full(len(rows), info | _BEFORE)))

            for mask in smallest:
                at = np.flatnonzero(events.have & mask == mask)
                equal = [r for r in range(_N) if mask >> r & 1 and 1 << r not in (_PARENT, _TECHNIQUE)]
                base = _mix(owner[at] + np.uint64(mask)) + events.hashes[np.ix_(at, equal)].sum(1, dtype=np.uint64)
                for k in range(int(events.lengths.max(initial=0))) if mask & _TECHNIQUE else [0]:
                    rows, key = at, base
                    if mask & _TECHNIQUE:
                        has = events.lengths[at] > k
                        rows, key = at[has], base[has] + events.techniques[at[has], k]
                    if not mask & _PARENT:
                        add(rows, key, mask | k << 16)
                        continue
                    for role, has, own in ((correlate._AS_PARENT, events.as_parent, events.probes), (correlate._AS_CHILD, events.as_child, events.points)):
                        one = has[rows]
                        add(rows[one], key[one] + own[_ONE_WAY][rows[one]], mask | role << 13 | k << 16)
            if not found:
                continue
            rows = pa.array(np.concatenate([f[0] for f in found]))
            place, info = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.view(np.int64)), pa.array(info.astype(np.int32)), *[c.take(rows) for c in (batch.column("scope_key"), batch.column("ts"), bits, fields)]], names=_MEMBERS
            )

    return run


class _Cells:
    """Counts the pairs of events that are sorted by place."""

    def __init__(self, smallest: Sequence[int], sets: frozenset[int], window: int, most: int, at_once: int):
        self.smallest, self.sets, self.window, self.most, self.at_once = list(smallest), sets, window, most, at_once
        self.stretch = STRETCH * max(window, 1)
        #: Further apart than any two times of a place and a window.
        self.apart = self.stretch + 2 * window + 1
        self.sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, crowded = [], 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if not self.most:
                yield from self.handed_over(batch)
                continue
            waiting.append(batch)
            rows += batch.num_rows
            if rows < self.at_once:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            place = table.column("place").to_numpy()
            start, end = 0, int(np.searchsorted(place, place[-1]))
            if crowded is not None:
                start = int(np.searchsorted(place, crowded, "right"))
                yield from self.handed_over(table.slice(0, start))
            if start < end:
                self.count(table.slice(start, end - start))
                crowded = None
            rest = table.slice(max(start, end))
            if rest.num_rows > self.most:
                crowded = int(place[-1])
                yield from self.handed_over(rest)
                rest = rest.slice(rest.num_rows)
            waiting, rows = [rest] if rest.num_rows else [], rest.num_rows
            if sum(len(s[0]) for s in self.sums) > 1 << 20:
                yield from self.summed(1 << 19)
        if waiting:
            table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            start = 0 if crowded is None else int(np.searchsorted(table.column("place").to_numpy(), crowded, "right"))
            yield from self.handed_over(table.slice(0, start))
            self.count(table.slice(start))
        yield from self.summed(0)

    def summed(self, kept: int) -> Iterator[pa.RecordBatch]:
        """The sums by scope and code, if they are more than ``kept``."""
        if not self.sums:
            return
        scope, code, pairs = (np.concatenate([s[i] for s in self.sums]) for i in range(3))
        order = np.lexsort((code, scope))
        scope, code, pairs = scope[order], code[order], pairs[order]
        begins = np.flatnonzero(np.append(True, (scope[1:] != scope[:-1]) | (code[1:] != code[:-1])))
        scope, code, pairs = scope[begins], code[begins], np.add.reduceat(pairs, begins)
        self.sums = [(scope, code, pairs)]
        if len(scope) > kept:
            self.sums = []
            out = _Out([*_ORDER, "pairs"], _SPREAD)
            out.add(scope, code, 0, 0, _COUNTS, pairs)
            yield out.batch()

    def read(self, batch: pa.RecordBatch) -> tuple[_Events, np.ndarray, np.ndarray, np.ndarray]:
        """(events, place, info, time in the stretch) in order of time."""
        info, ts = batch.column("info").to_numpy(), batch.column("ts").to_numpy()
        number = ts // self.stretch + (info & _BEFORE > 0)
        time = ts - number * self.stretch + self.window
        batch = batch.take(pa.array(np.argsort(time, kind="stable")))
        time = np.sort(time, kind="stable")
        info, bits = batch.column("info").to_numpy(), batch.column("bits").to_numpy().astype(np.int64)
        fields = batch.column("fields").combine_chunks() if isinstance(batch.column("fields"), pa.ChunkedArray) else batch.column("fields")
        head = (bits[:, None] >> np.arange(_N + 2) & 1).astype(bool)
        lengths = pc.binary_length(fields).to_numpy(zero_copy_only=False) // 8 - head.sum(1)
        there = np.concatenate([head, np.arange(int(lengths.max(initial=0))) < lengths[:, None]], 1)
        values = np.zeros(there.shape, np.int64)
        ends = np.frombuffer(fields.buffers()[1], np.int32)[fields.offset:][:len(fields) + 1]
        values[there] = np.frombuffer(fields.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].view(np.int64)
        events = _Events(batch.column("scope_key").to_numpy(), batch.column("ts").to_numpy(), values, there)
        return events, batch.column("place").to_numpy(), info, time

    def supersets(self, mask: int) -> list[int]:
        """The sets that are counted under a smallest set: those that contain it and none before it."""
        before = self.smallest[:self.smallest.index(mask)]
        return [m for m in sorted(self.sets) if m & mask == mask and not any(b & m == b for b in before)]

    def handed_over(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of a crowded place: points and probes for every set; events of the stretch before once more, to be taken off with their pairs."""
        for start in range(0, batch.num_rows, 1 << 14):
            events, place, info, _ = self.read(batch.slice(start, 1 << 14))
            out = _Out([*_ORDER, "pairs"], _SPREAD)
            for mask in np.unique(info & (1 << _N) - 1).tolist():
                at = np.flatnonzero(info & (1 << _N) - 1 == mask)
                for wide in self.supersets(mask):
                    rows = at[events.have[at] & wide == wide]
                    equal = [r for r in range(_N) if (wide & ~mask) >> r & 1 and 1 << r not in (_PARENT, _TECHNIQUE)]
                    key = _mix(place[rows].view(np.uint64)) + events.hashes[np.ix_(rows, equal)].sum(1, dtype=np.uint64)
                    first, role = self.variants(mask, info[rows])
                    for some, code, way, probes, points, keys in events.spread(wide, rows, key, first, role):
                        early = np.flatnonzero(info[some] & _BEFORE)
                        for some, keys, code in ((some, keys, code), (some[early], _mix(keys[early]), code ^ _EVEN)):
                            self.stand(out, events, some, keys.view(np.int64), code, way, probes, points)
                        if out.rows > 1 << 18:
                            yield out.batch()
            yield out.batch()

    def stand(self, out: _Out, events: _Events, rows: np.ndarray, keys: np.ndarray, code: int, way: int, probes: bool, points: bool) -> None:
        scope, t = events.scope[rows], events.ts[rows]
        if points:
            out.add(scope, code, keys, t, _POINT, 0)
        if probes:
            itself = events.itself[rows] & (way != _EQUAL)
            out.add(scope, code, keys, t + self.window, np.where(itself, _ADDS_NOT_ITSELF, _ADDS), 0)
            if way != _EQUAL:
                out.add(scope, code, keys, t - self.window - 1, _TAKES, 0)

    def variants(self, mask: int, info: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
        return info >> 16 if mask & _TECHNIQUE else None, info >> 13 & 3 if mask & _PARENT else None

    def count(self, batch: pa.RecordBatch) -> None:
        """Add the pairs of whole places to the sums."""
        place = batch.column("place").to_numpy()
        alone = np.append(True, place[1:] != place[:-1]) & np.append(place[1:] != place[:-1], True)
        if alone.all():
            return
        events, place, info, time = self.read(batch.filter(pa.array(~alone)))
        scopes, scope = np.unique(events.scope, return_inverse=True)
        early = info & _BEFORE > 0

        def add(code: int, rows: np.ndarray, n: np.ndarray) -> None:
            pairs = np.bincount(scope[rows], n, len(scopes)).astype(np.int64)
            some = np.flatnonzero(pairs)
            if len(some):
                self.sums.append((scopes[some], np.full(len(some), code), pairs[some]))

        def equal(code: int, rows: np.ndarray, key: np.ndarray, counts: bool) -> tuple[np.ndarray, np.ndarray]:
            """Add the pairs of equal keys; the rows that are not alone, in order of time, and numbers of their groups."""
            order = np.lexsort((rows, key))
            key = key[order]
            same = key[1:] == key[:-1]
            met = np.append(False, same) | np.append(same, False)
            key, rows = key[met], rows[order[met]]
            if len(key) == 0:
                return rows, key
            group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
            if counts:
                at = group * self.apart + time[rows]
                n = np.arange(len(at)) - np.searchsorted(at, at - self.window)
                now = ~early[rows]
                add(code, rows[now], n[now])
            back = np.argsort(rows, kind="stable")
            return rows[back], group[back]

        def two_sides(code: int, probe: np.ndarray, probe_key: np.ndarray, point: np.ndarray, point_key: np.ndarray) -> None:
            if len(probe) == 0 or len(point) == 0:
                return
            rows, key = np.concatenate([probe, point]), np.concatenate([probe_key, point_key])
            order = np.lexsort((rows, key))
            side, rows, key = (order < len(probe)).astype(np.int64), rows[order], key[order]
            group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
            at = group * self.apart + time[rows]
            before = np.append(0, np.cumsum(side))
            since, here = np.searchsorted(at, at - self.window), np.arange(len(at))
            probes = before[here] - before[since]
            n = np.where(side == 1, here - since - probes, probes) - (side & events.itself[rows])
            now = ~early[rows]
            add(code, rows[now], n[now])

        def others(mask: int, rows: np.ndarray, key: np.ndarray, smallest: int) -> None:
            """Pairs that share a technique or are parent and child."""
            first, role = self.variants(smallest, info[rows])
            # a technique stands at different places in different lists, so all subsets of a code are counted together
            found: dict[int, tuple[list, list]] = {}
            for some, code, way, probes, points, keys in events.spread(mask, rows, key, first, role):
                found.setdefault(code, ([], []))[0 if probes else 1].append((some, keys))
            for code, sides in found.items():
                one, two = ([np.concatenate(c) for c in zip(*side, strict=True)] for side in (sides[0] or [(rows[:0], key[:0])], sides[1] or [(rows[:0], key[:0])]))
                if mask & _PARENT:
                    two_sides(code, *one, *two)
                else:
                    equal(code, *one, True)

        special = _PARENT | _TECHNIQUE
        for smallest in np.unique(info & (1 << _N) - 1).tolist():
            own = set(self.supersets(smallest))

            def visit(mask: int, rows: np.ndarray, key: np.ndarray, bit: int) -> None:
                rows, group = equal(mask, rows, key, mask in own and not mask & special)
                if len(rows) == 0:
                    return
                key = _mix(group.astype(np.uint64))
                for more in {mask, mask | _PARENT, mask | _TECHNIQUE, mask | special}:
                    if more & special and more in own:
                        some = events.have[rows] & more == more
                        others(more, rows[some], key[some], smallest)
                for r in range(bit, _N):
                    wider = mask | 1 << r
                    if 1 << r & (special | mask) or not any(m & wider == wider for m in own):
                        continue
                    some = events.have[rows] >> r & 1 == 1
                    if some.any():
                        visit(wider, rows[some], key[some] + events.hashes[rows[some], r], r + 1)

            at = np.flatnonzero(info & (1 << _N) - 1 == smallest)
            visit(smallest, at, place[at].view(np.uint64), 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the groups of sorted rows: those that end in this task by set, the first and the last group on their own."""
    part = TaskContext.get().partitionId()
    whole: dict[tuple[int, int], list[int]] = {}
    first: list | None = None  # the task's first group, of which rows may be in an earlier task
    last: list | None = None

    def close(group: list) -> None:
        nonlocal first
        if first is None:
            first = group
            return
        (scope, code, _), points, _, reached, itself = group
        total = whole.setdefault((scope, code), [0, 0])
        total[0] += reached - points * (points + 1) // 2 if code >> 13 & 3 == _EQUAL else reached - itself
        total[1] += 1

    for batch in batches:
        if batch.num_rows == 0:
            continue
        scope, code, key = (batch.column(c).to_numpy() for c in _ORDER[:3])
        kind = batch.column("kind").to_numpy()
        new = np.ones(len(kind), bool)
        new[1:] = (scope[1:] != scope[:-1]) | (code[1:] != code[:-1]) | (key[1:] != key[:-1])
        begins = np.flatnonzero(new)
        points = kind == _POINT
        weight = np.where(points, 0, np.where(kind == _TAKES, -1, 1)).astype(np.int64)
        before = np.cumsum(points, dtype=np.int64)
        before -= np.repeat(before[begins] - points[begins], np.diff(np.append(begins, len(kind))))
        sums = [np.add.reduceat(v, begins) for v in (points.astype(np.int64), weight, weight * before, (kind == _ADDS_NOT_ITSELF).astype(np.int64))]
        for g, at in enumerate(begins.tolist()):
            name = (int(scope[at]), int(code[at]), int(key[at]))
            n, probes, reached, itself = (int(s[g]) for s in sums)
            if last is not None and last[0] == name:
                last = [name, last[1] + n, last[2] + probes, last[3] + reached + probes * last[1], last[4] + itself]
            else:
                if last is not None:
                    close(last)
                last = [name, n, probes, reached, itself]
    rows = [(scope, code, 0, part, 0, 0, total, 0, True) for (scope, code), (total, _) in whole.items()]
    rows += [(*g[0], part, *g[1:], False) for g in (first, last) if g is not None]
    if rows:
        names = [c.split()[0] for c in _COUNTED.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(n, t) for n, t in zip(names, _TYPES, strict=True)]))


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def _shared(narrow: DataFrame, sets: frozenset[int], rules: Rules) -> DataFrame:
    """(scope_key, code, pairs): how many pairs share each set, by the way in which they are counted."""
    rows = narrow.select("scope_key", "ts", "tok", "pid", "ppid", "techs", "held")
    smallest, window = rules.smallest_sets(), rules.window_micros
    members = rows.mapInArrow(_members(smallest, window), "place long, info int, scope_key long, ts long, bits int, fields binary")
    # times of a place and numbers of groups make one number of 63 bits; windows of days go the way of crowded places
    most = MOST_ROWS if STRETCH * window < 1 << 42 else 0
    cells = _Cells(smallest, sets, window, most, ROWS_AT_ONCE)
    found = cut_lineage(members.repartition("place").sortWithinPartitions("place").mapInArrow(lambda batches: cells(batches), _ROWS))
    pairs = found.filter(F.col("kind") == _COUNTS).select("scope_key", "code", "pairs")
    crowded = found.filter(F.col("kind") != _COUNTS).select(*_ORDER)
    if not crowded.isEmpty():
        pairs = pairs.unionByName(_in_order(crowded))
    return pairs.groupBy("scope_key", "code").agg(F.sum("pairs").alias("pairs"))


def _in_order(rows: DataFrame) -> DataFrame:
    """(scope_key, code, pairs) of points and probes, by groups of any size."""
    ordered = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    counted = cut_lineage(ordered.mapInArrow(_count, _COUNTED))
    group = ["scope_key", "code", "key"]
    # two rows a task at most: groups that other tasks may hold as well
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = counted.filter("not whole").withColumn("reached", F.col("reached") + F.col("probes") * F.coalesce(F.sum("points").over(earlier), F.lit(0)))
    joined = cut.groupBy(*group).agg(F.sum("points").alias("n"), F.sum("reached").alias("reached"), F.sum("itself").alias("itself"))
    equal = F.col("code").bitwiseAND(3 << 13) == _EQUAL
    pairs = F.when(equal, F.col("reached") - F.expr("n * (n + 1) div 2")).otherwise(F.col("reached") - F.col("itself"))
    ended = counted.filter("whole").select("scope_key", "code", F.col("reached").alias("pairs"))
    return ended.unionByName(joined.select("scope_key", "code", pairs.alias("pairs")))


def _weight() -> Column:
    """What a count adds for its set, doubled, because what is both ways is counted from both sides."""
    even = F.col("code").bitwiseAND(_EVEN) != 0
    both = F.col("code").bitwiseAND(3 << 13) == _BOTH_WAYS << 13
    return F.when(even, -1).otherwise(1) * F.when(both, -1).otherwise(2)


def _least(masks: Sequence[int]) -> list[int]:
    """Masks that contain none of the others."""
    out: list[int] = []
    for mask in sorted(masks, key=int.bit_count):
        if not any(small & mask == small for small in out):
            out.append(mask)
    return out


def _limits(rules: Rules, k: int):
    """Of each scope the sets that find its pairs above the value of the k-th best one, and those that find the pairs of that value."""
    masks = np.arange(1 << _N)
    on_host = masks | np.where(masks & _GATED, _HOST, 0)
    rank = np.array([rules.ranks.get(m, -1) for m in range(1 << _N)])
    counted = np.array([qualifies(rules, m) for m in range(1 << _N)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                exact = np.zeros(1 << _N, np.int64)
                exact[row["masks"]] = row["counts"]
                exact = exact[on_host]  # pairs that share a reason which needs the host share the host
                for bit in range(_N):
                    at = np.flatnonzero(~masks >> bit & 1)
                    exact[at] -= exact[at | 1 << bit]
                there = np.flatnonzero((exact > 0) & counted)
                there = there[np.argsort(-rank[there], kind="stable")]
                level = rank[there[min(int(np.searchsorted(np.cumsum(exact[there]), k)), len(there) - 1)]]
                above, equal = there[rank[there] > level].tolist(), there[rank[there] == level].tolist()
                found.append({"scope_key": row["scope_key"], "above": _least(above), "level": _least(equal)})
            schema = pa.schema([("scope_key", pa.int64()), ("above", pa.list_(pa.int32())), ("level", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return run


class Pairs:
    """The pairs of events, counted. What is read more than once is written once.

    Which pairs there are is told by ``correlate.correlate_all``: an event id counts once in a scope, its earliest delivery.
    """

    def __init__(self, events: DataFrame, scope: Sequence[str], rules: Rules | None = None):
        self.rules, self.scope = rules or Rules(), list(scope)
        narrow = correlate.one_per_id(correlate.tokens(events, self.scope))
        self.narrow = cut_lineage(narrow)
        self._counts: tuple[frozenset[int], DataFrame] | None = None

    @cached_property
    def few(self) -> bool:
        """Whether there are no more pairs than events."""
        return (self.sums().agg(F.sum("pairs")).first()[0] or 0) <= self.narrow.count()

    @cached_property
    def short(self) -> DataFrame:
        return self.narrow.filter(F.size("techs") <= MOST_TECHNIQUES)

    @cached_property
    def made(self) -> DataFrame | None:
        """Pairs with events that have long technique lists, if there are such events."""
        rest = self.narrow.filter(F.size("techs") > MOST_TECHNIQUES)
        return None if rest.isEmpty() else self._made(rest)

    def _made(self, rest: DataFrame) -> DataFrame:
        """Pairs of the few events with long technique lists, which are made; a pair of two of them once."""
        rows = correlate.key_rows(self.narrow, correlate._set_literal(self.rules.smallest_sets()), self.rules)
        ids = rest.select("scope_key", "event_id")
        chosen = rows.join(ids, ["scope_key", "event_id"], "left_semi").select(*rows.columns)
        pairs = correlate._once(correlate._matched(chosen, rows, ["scope_key"], self.rules, both_ways=True, events=self.narrow), self.rules)
        both = ids.select("scope_key", F.col("event_id").alias("related_event_id"), F.lit(True).alias("_both"))
        pairs = pairs.join(both, ["scope_key", "related_event_id"], "left")
        pairs = pairs.filter(F.col("_both").isNull() | (F.col("source_event_id") < F.col("related_event_id")))
        return cut_lineage(pairs.select("scope_key", "source_event_id", "related_event_id", "mask"))

    def _shared(self, sets: frozenset[int]) -> DataFrame:
        if self._counts is None or not sets <= self._counts[0]:
            self._counts = sets, cut_lineage(_shared(self.short, sets, self.rules))
        return self._counts[1]

    def _qualifying(self) -> frozenset[int]:
        return frozenset(m for m in self.rules.masks if qualifies(self.rules, m))

    def sums(self, measures: Mapping[str, Measure] | None = None) -> DataFrame:
        """For each scope with events the sum of every measure over all its pairs, exact, as decimal(38,0).

        A measure gives a whole number for a reason mask; by default ``pairs`` counts.
        """
        rules, exact = self.rules, "decimal(38,0)"
        measures = dict(measures or {"pairs": lambda mask: 1})
        factors = {name: coefficients(rules, f) for name, f in measures.items()}
        sets = frozenset(int(m) for g in factors.values() for m in np.flatnonzero(g)) | self._qualifying()
        names = [f"_{i}" for i in range(len(factors))]
        mask = F.col("code").bitwiseAND((1 << _N) - 1)
        product = {
            n: (_weight() * F.col("pairs")).cast("decimal(19,0)") * rules._table([int(x) for x in g], "long", mask).cast("decimal(19,0)")
            for n, g in zip(names, factors.values(), strict=True)
        }
        halves = {n: (F.sum(x.cast(exact)).cast(exact) / 2).cast(exact).alias(n) for n, x in product.items()}
        parts = self._shared(sets).groupBy("scope_key").agg(*halves.values())
        if self.made is not None:
            value = [rules._table([f(m) if qualifies(rules, m) else 0 for m in range(1 << _N)], "long", F.col("mask")) for f in measures.values()]
            parts = parts.unionByName(self.made.groupBy("scope_key").agg(*[F.sum(v.cast(exact)).cast(exact).alias(n) for v, n in zip(value, names, strict=True)]))
        every = self.narrow.groupBy("scope_key").agg(*[F.first(c).alias(c) for c in self.scope])
        total = parts.groupBy("scope_key").agg(*[F.sum(n).cast(exact).alias(n) for n in names])
        counted = [F.coalesce(F.col(n), F.lit(0).cast(exact)).alias(name) for n, name in zip(names, measures, strict=True)]
        return every.join(total, "scope_key", "left").select(*self.scope, *counted)

    def all(self, without: DataFrame | None = None) -> DataFrame:
        """Every pair, as ``correlate.correlate_all`` gives them; not those of the cases ``without``."""
        events = self.narrow if without is None else self.narrow.join(without, "case_id", "left_anti").select(*self.narrow.columns)
        rows = correlate.key_rows(events, correlate._set_literal(self.rules.smallest_sets()), self.rules)
        pairs = correlate._once(correlate._matched(rows, rows, self.scope, self.rules, events=events), self.rules)
        return correlate._scored(pairs, self.scope, self.rules)

    def best(self) -> DataFrame:
        """The best pair of each scope that has one, with the columns of ``correlate.correlate_all``."""
        return self.top(1).drop("rank")

    def top(self, k: int) -> DataFrame:
        """The best ``k`` pairs of each scope and their ``rank``, with the columns of ``correlate.correlate_all``.

        The counts tell how many pairs have each reason mask, so also the value that the k-th best pair of a scope has. Pairs
        above it are fewer than k: all are made. Of those that have it the first by ids are looked for: the first 2 k events with a
        later partner, then the first of these pairs. Twice as many, because a pair found so may be one of those above.
        """
        rules = self.rules
        n = F.sum(_weight() * F.col("pairs"))
        counted = self._shared(self._qualifying()).groupBy("scope_key", F.col("code").bitwiseAND((1 << _N) - 1).alias("mask")).agg(n.alias("n")).filter("n > 0")
        # at most as many masks as there are sets of reasons
        lists = counted.groupBy("scope_key").agg(F.collect_list("mask").alias("masks"), F.collect_list((F.col("n") / 2).cast("long")).alias("counts"))
        chosen = cut_lineage(lists.mapInArrow(_limits(rules, k), "scope_key long, above array<int>, level array<int>"))
        above, level = (self._members(chosen.select("scope_key", F.col(c).alias("masks")).filter("size(masks) > 0")) for c in ("above", "level"))
        columns = ["scope_key", "source_event_id", "related_event_id"]
        made = correlate._matched(above, above, ["scope_key"], rules, events=self.narrow).select(*columns)
        ids = made.unionByName(self._first(cut_lineage(level), k).select(*columns))
        if self.made is not None:
            ids = ids.unionByName(self.made.select(*columns))
        # of pairs with long lists of techniques either event may stand first
        ordered = self._whole(ids.distinct()).dropDuplicates([*self.scope, "source_event_id", "related_event_id"])
        return top_k(ordered, self.scope, correlate.pair_order(), k)

    def _members(self, chosen: DataFrame) -> DataFrame:
        """Key rows of the events for the sets ``masks`` of their scope."""
        sets = F.transform("masks", lambda m: F.struct(m.alias("mask"), correlate._positions(m).alias("pos")))
        return correlate.key_rows(self.short.join(chosen, "scope_key"), sets, self.rules)

    def _first(self, members: DataFrame, k: int) -> DataFrame:
        """Of pairs of ``members`` (of one key, within the window) the first 2 k of each scope by ids."""
        place = ["scope_key", "mask", "key", "place"]
        rows = members.withColumn("place", F.explode(F.array("cell", F.col("cell") + 1)))
        later = Window.partitionBy(*place).orderBy(F.desc("ts"), F.desc("event_id"), "role")
        upto = {n: later.rowsBetween(Window.unboundedPreceding, -n) for n in (1, 2)}

        def nearest(role: int) -> Column:
            """Time of the next event in a role; an event that is its own parent does not meet itself."""
            after = [F.last(F.when(F.col("role") == role, F.col("ts")), ignorenulls=True).over(upto[n]) for n in (1, 2)]
            return F.when(F.lag("event_id").over(later) == F.col("event_id"), after[1]).otherwise(after[0])

        partner = F.when(F.col("role") == correlate._NO_ROLE, nearest(correlate._NO_ROLE)).when(
            F.col("role") == correlate._AS_PARENT, nearest(correlate._AS_CHILD)
        ).otherwise(nearest(correlate._AS_PARENT))
        paired = rows.withColumn("_next", partner).filter(F.col("_next") - F.col("ts") <= self.rules.window_micros)
        sources = top_k(paired.select("scope_key", F.col("event_id").alias("source_event_id")).distinct(), ["scope_key"], ["source_event_id"], 2 * k)
        own = rows.join(sources.drop("rank"), (rows["scope_key"] == sources["scope_key"]) & (F.col("event_id") == F.col("source_event_id"))).drop(sources["scope_key"])
        a = own.select(*place, F.col("ts").alias("_ts"), F.col("role").alias("_role"), "source_event_id")
        met = rows.join(a, place).filter(
            ((F.col("ts") > F.col("_ts")) | ((F.col("ts") == F.col("_ts")) & (F.col("event_id") > F.col("source_event_id"))))
            & (F.col("ts") - F.col("_ts") <= self.rules.window_micros)
            & (((F.col("role") == 0) & (F.col("_role") == 0)) | (F.col("role") + F.col("_role") == correlate._AS_PARENT + correlate._AS_CHILD))
        )
        ids = met.select("scope_key", "source_event_id", F.col("event_id").alias("related_event_id")).distinct()
        return top_k(ids, ["scope_key"], ["source_event_id", "related_event_id"], 2 * k)

    def _whole(self, ids: DataFrame) -> DataFrame:
        """Pairs (scope_key, source_event_id, related_event_id) in either order with all their columns, the earlier event first."""
        side = F.struct(*self.scope, "event_id", "ts", "pid", "ppid", "techs", "tok", F.lit(0).alias("mask"), F.lit(None).cast("long").alias("technique"), F.lit(0).alias("role"))
        rows = self.narrow.select("scope_key", "event_id", side.alias("side"))
        first = rows.select("scope_key", F.col("event_id").alias("source_event_id"), F.col("side").alias("x"))
        second = rows.select("scope_key", F.col("event_id").alias("related_event_id"), F.col("side").alias("y"))
        both = ids.join(first, ["scope_key", "source_event_id"]).join(second, ["scope_key", "related_event_id"])
        order = (F.col("x.ts") < F.col("y.ts")) | ((F.col("x.ts") == F.col("y.ts")) & (F.col("x.event_id") < F.col("y.event_id")))
        both = both.select(F.when(order, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(order, F.col("y")).otherwise(F.col("x")).alias("b"))
        return correlate._scored(correlate._pair_rows(both, self.scope), self.scope, self.rules)


# -- measures of an investigation ------------------------------------------------------------------

#: Fractions are added up in units of this many decimals.
DECIMALS = 12
#: Confidence under which a pair is weak.
WEAK = 0.5


def confidence_units(rules: Rules, factor: float = 1.0) -> Measure:
    """Confidence, 0..1, times a factor, in whole units."""

    def units(mask: int) -> int:
        value = min(max(rules.values[mask][0], 0.0), 1.0) * factor
        return int(Decimal(repr(value)).scaleb(DECIMALS).to_integral_value(ROUND_HALF_UP))

    return units


def by_case(pairs: Pairs, per_pair: float = 1.0) -> DataFrame:
    """(case_id, pairs, confidence_sum, weak_pairs) of every case; ``confidence_sum`` adds up confidence times ``per_pair``."""
    rules = pairs.rules
    found = pairs.sums(
        {"pairs": lambda m: 1, "confidence_sum": confidence_units(rules, per_pair), "weak_pairs": lambda m: int(rules.values[m][0] < WEAK)},
    )
    total = found.groupBy("case_id").agg(*[F.sum(c).alias(c) for c in ("pairs", "confidence_sum", "weak_pairs")])
    return total.select(
        "case_id", F.col("pairs").cast("long").alias("pairs"),
        (F.col("confidence_sum").cast(f"decimal(38,{DECIMALS})") / (10**DECIMALS)).cast("double").alias("confidence_sum"),
        F.col("weak_pairs").cast("long").alias("weak_pairs"),
    )


def by_reason(pairs: Pairs) -> DataFrame:
    """(scope, reason, category, pairs): how many pairs of a scope share each reason; reasons that none shares are left out."""
    found = pairs.sums({name: lambda mask, bit=bit: int(mask & bit > 0) for name, bit in correlate._BIT.items()})
    each = F.array(
        *[F.struct(F.lit(n).alias("reason"), F.lit(c).alias("category"), F.col(n).cast("long").alias("pairs")) for n, _, c, _ in vocab.CORRELATION_REASONS]
    )
    return found.select(*pairs.scope, F.inline(F.filter(each, lambda r: r["pairs"] > 0)))


def of_pairs(pairs: DataFrame, per_pair: float = 1.0) -> DataFrame:
    """The same of pairs that are at hand."""
    units = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))) * per_pair
    return pairs.groupBy("case_id").agg(
        F.count("*").alias("pairs"), F.sum(units.cast(f"decimal(30,{DECIMALS})")).cast("double").alias("confidence_sum"),
        F.count_if(F.col("confidence") < WEAK).alias("weak_pairs"),
    )
