"""Quality from weak labels.

Heuristics vote good, bad or nothing on every document. Expectation-maximisation over the
vote patterns estimates how accurate each heuristic is, without any true label. The patterns'
posteriors become soft labels, and a linear scorer over hashed text features learns from them
what the heuristics agree on, so it also scores texts on which all of them are silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import words as W
from casewright.llm.common import stored, text_or_empty
from casewright.llm.stats import COUNTS, statistics

#: Documents that the scorer is fitted on at most: a bounded sample by hash of the id.
SAMPLE = 12_000
BUCKETS = 1 << 14
ROUNDS, EPOCHS, RATE, PENALTY = 50, 200, 0.05, 1e-4

#: Heuristics as SQL over the counts: (name, votes bad if, votes good if); silent otherwise.
HEURISTICS = (
    ("symbols", "10 * n_symbols > n_words", None),
    ("marks", "60 * n_symbols > word_chars", None),
    ("repeats", "5 * n_repeat_words > n_words", None),
    (
        "variety", "10 * n_distinct_words < 3 * n_words AND n_words >= 50",
        "2 * n_distinct_words > n_words AND 50 * (n_symbols + n_exclaim) <= n_words AND n_words >= 5",
    ),
    ("capitals", "2 * n_upper > n_upper + n_lower", None),
    ("exclaims", "5 * n_exclaim > n_words", None),
    ("lines", "10 * n_dup_lines > 3 * n_lines", None),
    (
        "prose", None,
        "n_stops > 0 AND 50 * n_symbols <= n_words AND 50 * n_exclaim <= n_words AND 20 * n_repeat_words <= n_words",
    ),
    ("length", "n_words < 3", None),
)

#: Counts whose share of the words is a feature by its range: below each of ``EDGES``, or above all.
RANGED = ("n_symbols", "n_repeat_words", "n_dup_lines", "n_exclaim", "n_distinct_words", "n_stops")
EDGES = (0.001, 0.02, 0.1, 0.3, 0.6)

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x61:0x7B] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[0x30:0x3A] = ord("9")


@dataclass
class WeakModel:
    """``prior`` of a good document and the chance that each heuristic is right when it votes."""

    prior: float
    accuracy: np.ndarray


def vote(bad: str | None, good: str | None) -> Column:
    """-1 bad, 0 silent, 1 good."""
    return F.when(F.expr(bad or "false"), F.lit(-1)).when(F.expr(good or "false"), F.lit(1)).otherwise(F.lit(0)).cast("byte")


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> WeakModel:
    """Accuracies of heuristics from vote patterns (pattern, heuristic in -1, 0, 1) and their counts.

    Starts from the belief that heuristics are mostly right, which also fixes which of the two
    classes is the good one. Silence says nothing. No accuracy comes near 0 or 1.
    """
    model = WeakModel(0.8, np.full(patterns.shape[1], 0.85))
    if counts.sum() == 0:
        return model
    for _ in range(rounds):
        good = posterior(model, patterns)
        right = np.where(patterns > 0, good[:, None], np.where(patterns < 0, 1 - good[:, None], 0.0))
        voted = counts @ (patterns != 0)
        model.accuracy = np.clip((counts @ right + 0.85) / (voted + 1), 0.55, 0.99)
        model.prior = float(np.clip((counts * good).sum() / counts.sum(), 0.05, 0.95))
    return model


def posterior(model: WeakModel, patterns: np.ndarray) -> np.ndarray:
    """The chance that a document with these votes is good."""
    odds = patterns @ np.log(model.accuracy / (1 - model.accuracy)) + np.log(model.prior / (1 - model.prior))
    return 1 / (1 + np.exp(-odds))


def hashed(texts: W.Texts, counts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight): word shapes and repeated neighbours with unit length, and ranges of counts.

    A shape maps letters to a or A and digits to 9 and folds runs, so a word's symbols and
    capitals remain and its spelling goes.
    """
    n = len(texts)
    data = _CLASS[texts.data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = data[1:] != data[:-1]
    fresh[texts.begins[:-1][texts.begins[:-1] < len(data)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    folded = W.Texts(data[fresh], kept[texts.begins])
    shapes = W.words(folded)
    found = W.words(texts)
    again = np.zeros(len(found.hashes), bool)
    again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (found.text[1:] == found.text[:-1])
    keys = np.concatenate([shapes.hashes % np.uint64(BUCKETS - 2), np.where(again, BUCKETS - 2, BUCKETS - 1).astype(np.uint64)]).astype(np.int64)
    owner = np.concatenate([shapes.text, found.text])
    cell, count = np.unique(owner * BUCKETS + keys, return_counts=True)
    text, bucket = np.divmod(cell, BUCKETS)
    weight = np.sqrt(count)
    length = np.sqrt(np.bincount(text, weight**2, minlength=n))
    weight = weight / np.maximum(length[text], 1e-9)
    words, every = np.maximum(counts["n_words"], 1), np.arange(n)
    for k, name in enumerate(RANGED):
        place = np.searchsorted(EDGES, counts[name] / words, "right")
        ranged = W.mix((place + 100 * (k + 1)).astype(np.uint64)) % np.uint64(BUCKETS - 2)
        text, bucket, weight = np.append(text, every), np.append(bucket, ranged.astype(np.int64)), np.append(weight, np.ones(n))
    order = np.argsort(text, kind="stable")
    return text[order], bucket[order], weight[order]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in W.slices(batch.column(1)):
            counts = statistics(texts)
            text, bucket, weight = hashed(texts, counts)
            begins = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, len(texts)), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                    pa.ListArray.from_arrays(pa.array(begins), pa.array(bucket.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(begins), pa.array(weight.astype(np.float32))),
                ],
                names=["doc_id", *COUNTS, "buckets", "weights"],
            )


def fit_scorer(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights of hashed features for soft labels, by full-batch Adam."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if len(good) == 0:
        return weights, bias
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column, value = np.concatenate(rows), np.concatenate(values).astype(float)
    moment, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, EPOCHS + 1):
        score = np.bincount(row, weights[column] * value, minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-score)) - good) / len(good)
        grad = np.append(np.bincount(column, error[row] * value, minlength=BUCKETS) + PENALTY * weights, error.sum())
        moment, second = 0.9 * moment + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - change[:-1], bias - float(change[-1])
    return weights, bias


def _apply(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, values = (batch.column(c) for c in ("buckets", "weights"))
            lengths = np.diff(buckets.offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), lengths)
            score = np.bincount(row, weights[buckets.flatten().to_numpy()] * values.flatten().to_numpy(), minlength=len(batch))
            score = 1 / (1 + np.exp(-(score + bias)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("pattern"), pa.array(score)], names=["doc_id", "pattern", "score"]
            )

    return run


def scores(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes, posterior, score, predicted of every row.

    ``votes`` has one letter for each heuristic (b, - or g), ``posterior`` the chance of a good
    document by votes alone, ``score`` the scorer's, ``predicted`` 1 from 0.5 on. Votes are
    counted over all rows; the scorer is fitted on about ``sample`` of them. Null and empty texts
    have no word: the length heuristic votes bad and the scorer has its bias alone. Repeated rows count and score each; an
    empty table gives an empty result; only doc_id and text are read.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary"))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", buckets array<int>, weights array<float>"
    counted = rows.mapInArrow(_counts, schema)
    pattern = F.concat(*[F.element_at(F.array(F.lit("b"), F.lit("-"), F.lit("g")), vote(b, g).cast("int") + 2) for _, b, g in HEURISTICS])
    voted = stored(counted.select("doc_id", pattern.alias("pattern"), "buckets", "weights"))
    table = voted.groupBy("pattern").count().orderBy("pattern").collect()  # 3 ** heuristics rows at most
    patterns = np.array([["b-g".index(c) - 1 for c in r["pattern"]] for r in table]).reshape(len(table), len(HEURISTICS))
    counts = np.array([r["count"] for r in table], float)
    model = expectation_maximisation(patterns, counts)
    good = dict(zip((r["pattern"] for r in table), posterior(model, patterns).tolist(), strict=True))
    share = min(1.0, sample / max(counts.sum(), 1))
    mix = F.pmod(F.xxhash64("doc_id", F.lit("weak label")), F.lit(1_000_000))
    chosen = voted.filter(mix < int(share * 1_000_000)).select("doc_id", "pattern", "buckets", "weights").toPandas()
    chosen = chosen.sort_values(["doc_id", "pattern"], kind="stable")
    weights, bias = fit_scorer(list(chosen["buckets"]), list(chosen["weights"]), chosen["pattern"].map(good).to_numpy(float))
    scored = voted.mapInArrow(_apply(weights, bias), "doc_id long, pattern string, score double")
    belief = F.lit(None).cast("double")
    if good:
        pairs = [F.lit(x) for item in good.items() for x in item]
        belief = F.element_at(F.create_map(*pairs), F.col("pattern"))
    return scored.select(
        "doc_id", F.col("pattern").alias("votes"), belief.alias("posterior"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
