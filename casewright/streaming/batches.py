"""Event batches: groups of events that are investigated together.

A group's open batch is closed when it has ``max_size`` events, when an event arrives
``window`` seconds after its first one, or ``idle`` seconds after its last one; that
event starts the next batch. The rule is applied per event in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casewright import vocab
from casewright.functions.ordered import with_row_index
from casewright.session import cut_lineage

GROUP_DEFAULTS = {"tenant_id": "__no_tenant__", "host": "__no_host__"}


@dataclass(frozen=True)
class BatchRules:
    window_seconds: float = vocab.BATCH_WINDOW_SECONDS
    idle_seconds: float = vocab.BATCH_IDLE_SECONDS
    max_size: int = vocab.BATCH_MAX_SIZE

    def __post_init__(self) -> None:
        if self.window_seconds <= 0 or self.idle_seconds <= 0 or self.max_size < 1:
            raise ValueError("batch rules must be positive")

    @property
    def window_us(self) -> int:
        return int(self.window_seconds * 1_000_000)

    @property
    def idle_us(self) -> int:
        return int(self.idle_seconds * 1_000_000)


def group_key(by: str | None) -> Column:
    """Key an event is batched by: nothing, its tenant or its host."""
    if by is None:
        return F.lit("__all__")
    if by not in GROUP_DEFAULTS:
        raise ValueError("group by None, tenant_id or host")
    return F.coalesce(F.col(by), F.lit(GROUP_DEFAULTS[by]))


# -- bounded replay -------------------------------------------------------------------------


def _next_start(arrival: np.ndarray, rules: BatchRules) -> np.ndarray:
    """For every position: where the next batch would start if one started here."""
    n = len(arrival)
    here = np.arange(n)
    by_window = np.searchsorted(arrival, arrival + rules.window_us, side="left")
    gaps = np.flatnonzero(np.diff(arrival) >= rules.idle_us) + 1
    places = np.searchsorted(gaps, here, side="right")
    by_idle = np.where(places < len(gaps), np.append(gaps, n)[np.minimum(places, len(gaps))], n)
    return np.maximum(np.minimum(np.minimum(here + rules.max_size, by_window), by_idle), here + 1)


def replay(events: DataFrame, rules: BatchRules | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """Add ``batch_start``, the position of the first event of each event's batch.

    ``events``: batch_group, arrival (microseconds), event_id and more. Where a batch
    starts depends on where the one before did, so a group is a chain. It is cut into
    blocks of ``block_rows`` events. A batch has at most ``max_size`` events, so the
    first batch start in a block is one of ``max_size`` positions: every block is
    solved for all of them in parallel, the small solutions are chained, and then
    every block is labelled from its true start, again in parallel.
    """
    rules = rules or BatchRules()
    if block_rows < rules.max_size:
        raise ValueError("block_rows must be at least max_size")
    key = ["batch_group"]
    indexed = cut_lineage(with_row_index(events, key, ["arrival", "event_id"], "position"))
    place = indexed.select("batch_group", "position", "arrival").withColumn("block", F.floor(F.col("position") / block_rows))
    # a block also sees the first events of the next one, which may end its last batch
    seen = place.withColumn(
        "block",
        F.explode(
            F.when(
                (F.col("position") % block_rows < rules.max_size) & (F.col("block") > 0),
                F.array("block", F.col("block") - 1),
            ).otherwise(F.array("block"))
        ),
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        block = int(pdf["block"].iloc[0])
        own = int((pdf["position"] < (block + 1) * block_rows).sum())
        following = _next_start(pdf["arrival"].to_numpy(), rules)
        exits, lasts = [], []
        for entry in range(rules.max_size):
            at, last = entry, -1
            while at < own:
                last, at = at, int(following[at])
            exits.append(at - own)
            lasts.append(last)
        return pd.DataFrame(
            {"batch_group": [pdf["batch_group"].iloc[0]], "block": [block], "exits": [exits], "lasts": [lasts]}
        )

    solved = seen.groupBy("batch_group", "block").applyInPandas(
        solve, "batch_group string, block long, exits array<int>, lasts array<int>"
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """One small row per block: follow the entries from block to block."""
        rows, entry, carried = [], 0, 0
        for row in pdf.sort_values("block").itertuples(index=False):
            rows.append((row.batch_group, row.block, entry, carried))
            if entry < len(row.exits):
                if row.lasts[entry] >= 0:
                    carried = row.block * block_rows + row.lasts[entry]
                entry = max(row.exits[entry], 0)
        return pd.DataFrame(rows, columns=["batch_group", "block", "entry", "carried"])

    entries = solved.groupBy("batch_group").applyInPandas(
        chain, "batch_group string, block long, entry int, carried long"
    )

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        block, entry = int(pdf["block"].iloc[0]), int(pdf["entry"].iloc[0])
        start = np.full(len(pdf), int(pdf["carried"].iloc[0]), dtype="int64")
        following = _next_start(pdf["arrival"].to_numpy(), rules)
        at = entry
        while at < len(pdf):
            until = int(following[at])
            start[at:until] = block * block_rows + at
            at = until
        own = (pdf["position"] < (block + 1) * block_rows).to_numpy()
        return pd.DataFrame(
            {"batch_group": pdf["batch_group"], "position": pdf["position"], "batch_start": start}
        )[own]

    labelled = seen.join(entries, ["batch_group", "block"]).groupBy("batch_group", "block").applyInPandas(
        label, "batch_group string, position long, batch_start long"
    )
    return indexed.join(labelled, ["batch_group", "position"])


def summarize(batched: DataFrame) -> DataFrame:
    """One row per batch: size, bounds, tenant and host if they are the same for all."""
    only = lambda c: F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c))
    rows = batched.groupBy("batch_group", "batch_start").agg(
        F.count("*").alias("size"), F.min("arrival").alias("first_at"), F.max("arrival").alias("last_at"),
        only("tenant_id").alias("tenant_id"), only("host").alias("host"),
    )
    return rows.withColumn(
        "title", F.when(F.col("host").isNotNull(), F.concat(F.lit("Investigation "), F.col("host"))).otherwise("Investigation")
    )


# -- stream ------------------------------------------------------------------------------------

_STATE = "batch_no long, first_at long, last_at long, ids array<string>, bodies array<string>"
_OUTPUT = "batch_group string, batch_no long, event_id string, body string"


def flush_rows(groups: DataFrame, at: Column) -> DataFrame:
    """Rows for the stream of ``stream_batches`` that close the open batch of each group at time ``at``.

    Send them as the last messages before a worker stops, or whenever pending events must not wait.
    """
    return groups.select(
        "batch_group", at.alias("arrived_at"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("body")
    )


def stream_batches(events: DataFrame, rules: BatchRules | None = None, lateness: str = "1 second") -> DataFrame:
    """Closed batches of a stream, one row per event with its batch number.

    ``events``: batch_group, arrived_at (timestamp), event_id, body (the event as JSON).
    The open batch of a group is its state and has at most ``max_size`` events. A group
    that falls silent is closed by a timer on the watermark of the arrival time, and a
    row without event id (``flush_rows``) closes it at once. A task holds what one trigger brings
    of a group: bound it with the source's trigger limit (``maxFilesPerTrigger`` and the like).
    """
    rules = rules or BatchRules()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, first, last, ids, bodies = state.get if state.exists else (0, 0, 0, [], [])
        ids, bodies, closed = list(ids), list(bodies), []

        def close() -> None:
            nonlocal number, ids, bodies
            closed.extend((key[0], number, i, b) for i, b in zip(ids, bodies))
            number, ids, bodies = number + 1, [], []

        if state.hasTimedOut:
            if ids:
                close()
        else:
            # rows of one group in one trigger; the source's trigger limit bounds them
            rows = pd.concat(list(frames)).sort_values(["arrival", "event_id"], na_position="last")
            for arrival, event_id, body in zip(rows["arrival"], rows["event_id"], rows["body"]):
                if event_id is None:
                    if ids:
                        close()
                    continue
                due = ids and (
                    len(ids) >= rules.max_size or arrival - first >= rules.window_us or arrival - last >= rules.idle_us
                )
                if due:
                    close()
                if not ids:
                    first = int(arrival)
                last = int(arrival)
                ids.append(event_id)
                bodies.append(body)
        state.update((number, first, last, ids, bodies))
        if ids:
            due_ms = min(first + rules.window_us, last + rules.idle_us) // 1000
            state.setTimeoutTimestamp(max(due_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=["batch_group", "batch_no", "event_id", "body"])

    watched = events.withWatermark("arrived_at", lateness).withColumn("arrival", F.unix_micros("arrived_at"))
    return watched.groupBy("batch_group").applyInPandasWithState(
        step, _OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
