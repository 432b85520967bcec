"""Stretches of a document around a hit, against trying all; their lists are made once."""

import random
from collections import Counter

from pyspark.sql import functions as F

from casewright.llm import decontam


def _known(spark, rows):
    schema = "doc_id long, item_id long, size int, length int, first int, last int, part array<bigint>, item array<bigint>"
    shingles = decontam._runs(F.col("item"), F.least("length", F.lit(decontam.SHINGLE)))
    return spark.createDataFrame(rows, schema).withColumn("shingles", shingles).drop("item")


def test_stretches_equal_trying_all(spark):
    rng, rows, want = random.Random(8), [], set()
    for n in range(300):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 14))]
        text = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        place = rng.randrange(len(text) + 1)
        text = text[:place] + item + text[place:]
        length, size, last = len(item), len(text), rng.randrange(len(text))
        first = last - rng.randrange(length + 1)
        rows.append((n, n, size, length, first, last, text[max(first, 0) : min(size, last + length)], item))
        run = min(length, decontam.SHINGLE)
        for begin in range(first, last + 1):
            start, end = max(begin, 0), min(begin + length, size)
            own, of_item = (Counter(tuple(w[i : i + run]) for i in range(len(w) - run + 1)) for w in (text[start:end], item))
            shared = sum((own & of_item).values())
            if own and 100 * shared >= decontam.PERCENT * sum((own | of_item).values()):
                want.add((n, start, end, shared))
    good = decontam._stretches(_known(spark, rows)).filter("own > 0 AND 100 * shared >= 80 * (n + own - shared)")
    got = {(r["doc_id"], r["start"], r["end"], r["shared"]) for r in good.collect()}
    assert len(want) > 50
    assert got == want


def test_lists_of_a_comparison_are_made_once(spark, documents):
    """Neither in a join's condition nor in the lambda of another list are they made again."""
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve")]
    found = decontam.find(documents(rows), documents(rows).withColumnRenamed("doc_id", "item_id"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1
    assert plan.count("array_contains(") == 1
    assert found.count() == 1
