import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casewright.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, score long, slot int, block string, part string, rank int"


def brute(rows, every, positives=5, negatives=10):
    kept = {}
    for vec_id, embedding, label in rows:
        if vec_id is None or label is None or embedding is None or any(x is None or not math.isfinite(x) for x in embedding):
            continue
        one = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in embedding])
        kept[vec_id] = min(kept.get(vec_id, one), one)
    out = set()
    for anchor, (label, vec) in kept.items():
        if anchor % every:
            continue
        scored = defaultdict(list)
        for other, (other_label, other_vec) in kept.items():
            if other != anchor:
                scored[other_label == label].append((-sum(x * y for x, y in zip(vec, other_vec, strict=False)), other))
        for p, positive in sorted(scored[True])[:positives]:
            window = [(s, i) for s, i in sorted(scored[False]) if 30 * -p <= 100 * -s <= 90 * -p]
            out |= {(anchor, positive, k + 1, i, -p, -s) for k, (s, i) in enumerate(window[:negatives])}
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "b", "p", 3) for r in rows], SCHEMA)


def mined(spark, rows, every):
    got = hardneg.mine(hardneg.rows_of(table(spark, rows)), F.col("vec_id") % every == 0)
    got = [tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("spread", [0.02, 0.4])
def test_equals_brute_force(spark, monkeypatch, spread):
    """Clusters of labels, one vector that a third of the rows have, equal scores, nulls and repeated rows."""
    pick = random.Random(5)
    centres = [[pick.gauss(0, 0.3) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(600):
        vector = [x + pick.gauss(0, spread) for x in centres[i % 4]]
        rows.append((i, centres[1] if i % 3 == 0 else vector, pick.randrange(3)))
    rows += [(1000, None, 1), (1001, [0.1, None], 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 0), (1004, [0.5] * 8, None)]
    rows += [(None, [0.5] * 8, 1), (1005, [], 1), (1006, [0.5, 0.5], 2), (1007, [0.25] * 12, 0), rows[0], (10, [0.9] * 8, 0), (-20, [-0.2] * 8, 2)]
    # several blocks and groups
    monkeypatch.setattr(hardneg, "ANCHORS", 16)
    monkeypatch.setattr(hardneg, "ROWS", 100)
    want = brute(rows, 10)
    assert len(want) > 500 and mined(spark, rows, 10) == want


def test_large_components_and_empty_tables(spark):
    rows = [(i, [float(x) for x in range(i, i + 4)] + [2e5 * i], 1 + i % 2) for i in range(40)]
    assert mined(spark, rows, 20) == brute(rows, 20)
    assert mined(spark, [], 1) == set()
    assert mined(spark, [(0, [1.0], 1)], 1) == set()
    with pytest.raises(ValueError):
        hardneg.mine(table(spark, []), F.lit(True), low=90, high=30)
