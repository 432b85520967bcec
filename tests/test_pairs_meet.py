"""Pairs of all events: what is sent, and the stream whose state is a table of the last events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import correlate
from casewright.operators.correlate import Rules

BASE = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    return [
        {"event_id": f"E{i:03d}", "timestamp": (BASE + dt.timedelta(seconds=i * 25)).isoformat() + "Z", "host": f"h{rng.randrange(2)}",
         "tenant_id": f"t{rng.randrange(2)}", "user": f"u{rng.randrange(2)}", "mitre_techniques": rng.choice([None, ["T1"], ["T1", "T2"]]),
         "process": {"name": "x", "pid": rng.randrange(4), "parent_pid": rng.randrange(4)},
         "network": {"source_ip": "1", "destination_ip": rng.choice(["2", "3"])} if i % 3 == 0 else None}
        for i in range(150)
    ]


def found(pairs):
    return sorted((r.tenant_id, r.source_event_id, r.related_event_id, tuple(r.reasons), r.time_delta_seconds) for r in pairs.collect())


def test_every_set_has_one_place():
    for rules in (Rules(), Rules(confidence_mode="max", min_confidence=0.3), Rules(weights={"same_mitre_technique": 0.5})):
        placed = [m for _, masks in rules.places() for m in masks]
        assert sorted(placed) == sorted(rules.smallest_sets())
        assert all(r == -1 or m >> r & 1 for r, masks in rules.places() for m in masks)


@pytest.mark.parametrize("rules", [
    Rules(), Rules(window_seconds=0), Rules(window_seconds=75), Rules(confidence_mode="max", min_confidence=0.3),
    Rules(weights={"same_mitre_technique": 0.5}, window_seconds=100),
])
def test_pairs_equal_those_of_seeds(spark, make_events, rules):
    """Seeds still meet by key and cell: with every event a seed each pair is found from both ends."""
    events = make_events([r | {"timestamp": rows_at} for r, rows_at in _with_ties(_rows())])
    both = correlate.correlate_seeds(events, events.select("event_id"), rules=rules)
    one = correlate.correlate_all(events, rules=rules)
    key = lambda f: sorted((*sorted((r.source_event_id, r.related_event_id)), tuple(r.reasons)) for r in f.collect())
    assert key(one) == sorted(set(key(both))) and len(key(both)) == 2 * one.count() > 0


def _rows():
    rng = random.Random(5)
    return [
        {"event_id": f"E{i:03d}", "host": f"h{rng.randrange(2)}", "tenant_id": "t", "user": f"u{rng.randrange(2)}",
         "mitre_techniques": rng.choice([None, ["T1"], ["T2", "T1"]]),
         "process": {"name": "x", "pid": rng.randrange(4), "parent_pid": rng.randrange(4)}}
        for i in range(150)
    ]


def _with_ties(rows):
    return [(r, (BASE + dt.timedelta(seconds=i // 2 * 25)).isoformat() + "Z") for i, r in enumerate(rows)]


def test_an_event_is_sent_by_reason_and_not_by_set(spark, make_events, rows):
    rules = Rules()
    narrow = correlate.one_per_id(correlate.tokens(make_events(rows), ["tenant_id"]))
    sent = correlate._blocks(narrow, rules).filter("_home").count()
    keys = correlate.key_rows(narrow, correlate._set_literal(rules.smallest_sets()), rules).count()
    assert sent <= len(rows) * 3 and sent < keys / 2


def test_written_pairs_of_many_triggers(spark, make_events, tmp_path, rows):
    first, rest = rows[:60], rows[60:]
    slow = rest.pop(10)  # comes a trigger later, within the lateness
    again = dict(first[-1], host="h9")  # a second delivery, to be ignored
    parts = [first, rest[:40] + [again], [slow] + rest[40:]]
    for i, part in enumerate(parts):
        make_events(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = make_events(rows)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    handle, repeated = correlate.pair_writer(str(tmp_path), 1200), []

    def twice(batch, number):  # a trigger that is run again gives the same
        handle(batch, number)
        handle(batch, number)
        repeated.append(number)

    run = source.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(twice).start()
    run.awaitTermination()
    assert repeated == [0, 1, 2]
    assert found(correlate.written_pairs(spark, str(tmp_path))) == found(correlate.correlate_all(events))
    # state is a table of the last events alone
    assert not (tmp_path / "state" / "state").exists()
    newest = BASE + dt.timedelta(seconds=149 * 25)
    kept = spark.read.parquet(str(tmp_path / "kept" / "2")).agg(F.min("ts"), F.count("*")).first()
    assert kept[0] >= (newest - dt.timedelta(seconds=2400) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1) and kept[1] < len(rows)
