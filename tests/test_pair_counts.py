import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.operators import correlate, pair_counts, risk
from casewright.operators.correlate import Rules
from casewright.plans.investigate import investigate

START = 1_700_000_000


def random_rows(seed, n):
    """Events that share much: few hosts, process ids that are their own parents', equal times, ids delivered twice."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        process = {"name": pick.choice(["a.exe", "B.exe", None]), "pid": pick.choice([1, 2, 3, None]), "parent_pid": pick.choice([1, 2, 3, None])}
        techniques = pick.sample(["T1", "T2", "T3", "T4"], pick.randrange(4))
        if pick.random() < 0.04:
            techniques = [f"T{k}" for k in range(pick.randrange(11, 14))]  # too many for subsets
        rows.append(
            {
                "event_id": f"E{i if pick.random() < 0.9 else i // 2}", "timestamp": f"2023-11-14T22:{pick.randrange(13, 40):02d}:{pick.choice(['00', '10', '20.5'])}Z",
                "host": pick.choice(["H1", "h1", "H2", None]), "user": pick.choice(["u", "v", None]), "process": process, "mitre_techniques": techniques,
                "dns": {"query": pick.choice(["d.example", None])}, "rule_id": pick.choice(["R", None, None]),
                "network": {"source_ip": pick.choice(["10.0.0.1", None]), "destination_ip": pick.choice(["10.0.0.2", None])},
            }
        )
    return rows


@pytest.fixture(scope="module")
def events(make_events):
    rows = make_events(random_rows(1, 260))
    n = F.abs(F.xxhash64("event_id")) % 5
    return rows.withColumns({"case_id": F.when(n > 0, F.concat(F.lit("C"), n % 2)), "tenant_id": F.when(n != 3, F.lit("T"))}).cache()


@pytest.mark.parametrize(
    "rules",
    [
        Rules(), Rules(window_seconds=0), Rules(window_seconds=95.5, min_confidence=0.2, min_reasons=3),
        Rules(min_confidence=0.3, confidence_mode="max", score_mode="max"), Rules(min_confidence=0.9, confidence_mode="additive", weights={"same_user": 0.0}),
    ],
)
def test_counts_and_best_pairs_equal_those_of_all_pairs(events, rules):
    scope = ["case_id", "tenant_id"]
    made = correlate.correlate_all(events, scope, rules).cache()
    counted = pair_counts.Pairs(events, scope, rules)
    name = {n: 1 << i for i, n in enumerate(correlate._POS)}
    got = counted.sums(
        {"pairs": lambda m: 1, "units": pair_counts.confidence_units(rules, 5.0), "by_parent": lambda m: int(m & name["parent_child"] > 0), "bits": int.bit_count}
    )
    units = F.sum((F.least(F.lit(1.0), F.col("confidence")) * 5.0).cast("decimal(30,12)") * 10**12).cast("decimal(38,0)")
    want = made.groupBy(*scope).agg(
        F.count("*").alias("pairs"), units.alias("units"), F.count_if(F.array_contains("reasons", "parent_child")).alias("by_parent"), F.sum("reason_count").alias("bits")
    )
    got = {(r.case_id, r.tenant_id): tuple(map(int, r[2:])) for r in got.collect()}
    want = {(r.case_id, r.tenant_id): tuple(map(int, r[2:])) for r in want.collect()}
    assert {k: v for k, v in got.items() if v[0]} == want and len(want) > 3
    best = {}
    for r in sorted(made.collect(), key=lambda r: (-r.confidence, -r.score, r.source_event_id, r.related_event_id)):
        best.setdefault((r.case_id, r.tenant_id), tuple(r))
    assert {(r.case_id, r.tenant_id): tuple(r) for r in counted.best().collect()} == best
    assert counted.all().exceptAll(made).count() == 0 and counted.all().count() == made.count()


def test_a_dense_group_costs_no_pairs(spark, make_events):
    """Two hundred million pairs of equal events in ten minutes."""
    one = make_events([{"event_id": "E", "timestamp": "2024-01-01T00:00:00Z", "host": "H", "user": "u", "rule_id": "R", "process": {"name": "p", "pid": 7}}], case_id="C")
    n = 20_000
    rows = one.drop("event_id", "timestamp").crossJoin(spark.range(n)).withColumns(
        {"event_id": F.concat(F.lit("E"), "id"), "timestamp": F.timestamp_micros(F.lit(START * 10**6) + F.col("id") * 30_000)}
    )
    pairs = pair_counts.Pairs(rows.select(*one.columns), ["case_id", "tenant_id"])
    got = pair_counts.by_case(pairs).first()
    within = 10_000  # later events of the 300 seconds after one
    assert got.pairs == sum(min(within, n - 1 - i) for i in range(n))
    best = pairs.best().first()
    assert (best.source_event_id, best.related_event_id) == ("E0", "E1")


def test_groups_cut_between_tasks(spark, events, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    scope, want = ["tenant_id"], None
    for parts in ("1", "2", "33"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted(map(tuple, pair_counts.Pairs(events, scope).sums().collect()), key=str)
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("most, at_once, stretch, seconds", [(3, 2, 1, 300), (7, 100, 2, 95.5), (1 << 19, 5, 1, 20), (9, 30, 16, 4 * 86400)])
def test_places_of_any_size_count_alike(events, monkeypatch, most, at_once, stretch, seconds):
    """Crowded places, places cut between batches, and events of the stretch before."""
    rules = Rules(window_seconds=seconds)
    made = correlate.correlate_all(events, ["tenant_id"], rules).groupBy("tenant_id").agg(F.count("*"), F.sum("reason_count")).collect()
    for name, value in (("MOST_ROWS", most), ("ROWS_AT_ONCE", at_once), ("STRETCH", stretch)):
        monkeypatch.setattr(pair_counts, name, value)
    got = pair_counts.Pairs(events, ["tenant_id"], rules).sums({"pairs": lambda m: 1, "bits": int.bit_count}).collect()
    assert {r[0]: (r[1], r[2]) for r in made} == {r[0]: (int(r[1]), int(r[2])) for r in got} and len(got) == 2


@pytest.mark.parametrize("k, rules", [(1, Rules()), (4, Rules(window_seconds=95.5)), (30, Rules(min_confidence=0.3, confidence_mode="max", score_mode="max")), (10**6, Rules())])
def test_top_pairs_equal_those_of_all_pairs(events, k, rules):
    made: dict = {}
    for r in sorted(correlate.correlate_all(events, ["tenant_id"], rules).collect(), key=lambda r: (-r.confidence, -r.score, r.source_event_id, r.related_event_id)):
        made.setdefault(r.tenant_id, []).append(tuple(r))
    got: dict = {}
    for r in sorted(correlate.correlate_all(events, ["tenant_id"], rules, k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.tenant_id, []).append(tuple(r)[:-1])
    assert got == {t: rows[:k] for t, rows in made.items()} and len(got) == 2


def test_top_pairs_write_no_level_of_reasons(spark, make_events, monkeypatch):
    """Large groups are not keyed again under one more reason: only two small tables are written besides the events and their counts."""
    one = {"host": "H", "user": "u", "process": {"name": "p", "pid": 1}, "rule_id": "R", "network": {"source_ip": "10.0.0.1", "destination_ip": "10.0.0.2"}}
    rows = make_events([{**one, "event_id": f"E{i:03d}", "timestamp": f"2024-01-01T00:00:{i % 60:02d}Z"} for i in range(200)], case_id="C")
    written = []
    for module in (correlate, pair_counts):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(df.checkpoint()) or written[-1])
    got = correlate.correlate_all(rows, ["case_id"], per_scope=3).collect()
    assert [(r.source_event_id, r.related_event_id) for r in got] == [("E000", "E001"), ("E000", "E002"), ("E000", "E003")]
    assert sum(df.count() for df in written if "tok" in df.columns) == 200 and len(written) == 5


def test_top_factors_need_pairs_of_few_cases(events):
    """Cases whose other factors are larger than any pair's are settled without their pairs."""
    tables = investigate(events.withColumn("severity", F.when(F.col("case_id") == "C1", 90).otherwise(10)))
    want = sorted(map(tuple, risk.top_factors(tables["risk_factors"]).collect()), key=str)
    assert sorted(map(tuple, tables["top_factors"].collect()), key=str) == want
    settled, made = [], tables["correlations"]

    def pairs(cases):
        settled.extend(r[0] for r in cases.collect())
        return made.join(cases, "case_id", "left_anti").select(*made.columns)

    got = risk.top_factors_of(tables["evidence"], pairs, tables["hypotheses"])
    assert sorted(map(tuple, got.collect()), key=str) == want and settled == ["C1"]


def test_reasons_are_counted_without_pairs(events):
    pairs = correlate.correlate_all(events, ["tenant_id"])
    want = correlate.breakdown(pairs).select("tenant_id", F.inline("breakdown")).groupBy("tenant_id", "reason", "category").count().collect()
    got = pair_counts.by_reason(pair_counts.Pairs(events, ["tenant_id"])).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 10


def test_an_event_is_sent_once_for_a_smallest_set(make_events):
    """Not once for every set of its reasons: two of these thirty-two wide events have 64 qualifying sets in common and more."""
    one = {"host": "H", "user": "u", "process": {"name": "p", "pid": 1}, "rule_id": "R", "network": {"source_ip": "10.0.0.1", "destination_ip": "10.0.0.2"}}
    rows = make_events([{**one, "event_id": f"E{i}", "timestamp": "2024-01-01T00:00:00Z"} for i in range(32)], case_id="C")
    rules = Rules()
    narrow = correlate.tokens(rows, ["case_id"]).select("scope_key", "ts", "tok", "pid", "ppid", "techs", "held")
    smallest = rules.smallest_sets()
    sent = narrow.mapInArrow(pair_counts._members(smallest, rules.window_micros), "place long, info int, scope_key long, ts long, bits int, fields binary")
    have = narrow.first().held | correlate._PARENT
    assert sent.count() == 32 * sum(s & have == s for s in smallest)


def test_inversion():
    pick = np.random.default_rng(1)
    values = pick.integers(-9, 9, 1 << 13)
    g = pair_counts.inversion(values.tolist())
    for mask in (0, 1, 5, 0b1011, 0b110010):
        assert sum(g[s] for s in range(mask + 1) if s & ~mask == 0) == values[mask]


def test_no_events(make_events):
    empty = make_events([{"event_id": "E", "timestamp": "2024-01-01T00:00:00Z"}], case_id="C").filter("false")
    pairs = pair_counts.Pairs(empty, ["case_id", "tenant_id"])
    assert pair_counts.by_case(pairs).count() == 0 and pairs.best().count() == 0
