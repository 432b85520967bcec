"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; everything else is only unlabelled, since nobody has
confirmed it clean. With the class prior the risk on the negative class is estimated as the
unlabelled risk less the positives' share of it, and held at zero or above, so the classifier
cannot gain by calling every unlabelled text negative beyond what is possible.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from casewright.llm import words as W
from casewright.llm.common import fresh, stored, text_or_empty

#: Texts that the classifier is fitted on at most: a bounded sample by hash of the ids.
POSITIVES, UNLABELLED = 4_000, 8_000
#: A feature must stand in so many of the sampled positives.
LEAST_TEXTS = 5
#: Features kept, and how far (in deviations) their share in positives must exceed that in all.
MOST_FEATURES, DEVIATIONS = 4_096, 5.0
#: Word beginnings of so many bytes are features beside whole words, for derived forms.
PREFIXES = tuple(range(4, 11))
#: Score from which a text counts as toxic.
THRESHOLD = 0.5
EPOCHS, RATE, PENALTY = 1000, 0.05, 1e-3


@dataclass
class Classifier:
    keys: np.ndarray
    weights: np.ndarray
    bias: float


def _features(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every distinct word (a run of letters, lower-cased) of a text and its beginnings.

    A key stands as often as the text has distinct words with it.
    """
    lower = W.Texts(W.lowered(texts.data), texts.begins)
    spans = W.Spans(lower.data)
    found = W.words(lower, inside=W.LETTERS, spans=spans)
    owner = found.text
    order = np.lexsort((found.hashes, owner))
    fresh = np.ones(len(order), bool)
    h, t = found.hashes[order], owner[order]
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = order[fresh]
    starts, ends, owner = found.starts[first], found.ends[first], owner[first]
    keys, text = [found.hashes[first]], [owner]
    for size in PREFIXES:
        long = np.flatnonzero(ends - starts > size)
        keys.append(W.mix(spans.hash(starts[long], starts[long] + size) + np.uint64(size)))
        text.append(owner[long])
    return np.concatenate(keys), np.concatenate(text)


def _counted(keys: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each text, how strongly each stands there, and where each text's begin."""
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    place = np.flatnonzero(fresh)
    strength = np.log2(1 + np.diff(np.append(place, len(keys))))
    return keys[place], strength, np.searchsorted(text[place], np.arange(texts + 1))


#: The features of a text: keys and how strongly each stands in it.
Features = tuple[np.ndarray, np.ndarray]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, positive texts, other texts) of the texts of a slice."""
    for batch in batches:
        positive = np.array(batch.column(0).to_pylist(), bool)
        for row, texts in W.slices(batch.column(1)):
            keys, _, begins = _counted(*_features(texts), len(texts))
            mine = np.repeat(positive[row : row + len(texts)], np.diff(begins))
            keys, inverse = np.unique(keys, return_inverse=True)
            in_p = np.bincount(inverse[mine], minlength=len(keys))
            in_u = np.bincount(inverse[~mine], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(in_p), pa.array(in_u)], names=["key", "in_p", "in_u"])


def _choose(sample: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """Features whose share in positives is beyond noise above their share in all, and twice as large.

    Counting runs on the executors; ``MOST_FEATURES`` keys at most reach the driver.
    """
    total = sample.select("positive", "content").mapInArrow(_counts, "key long, in_p long, in_u long").groupBy("key").agg(
        F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")
    )
    share_p, share_u = F.col("in_p") / n_p, F.col("in_u") / n_u
    deviation = F.sqrt(F.greatest(share_u, F.lit(1 / n_u)) * (1 / n_p + 1 / n_u))
    gain = (share_p - share_u) / deviation
    clear = total.filter((F.col("in_p") >= LEAST_TEXTS) & (gain > DEVIATIONS) & (share_p > 2 * share_u))
    rows = clear.orderBy(gain.desc(), "key").select("key").limit(MOST_FEATURES).collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def _extract(only: np.ndarray):
    """The features in ``only`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = W.Model(only, only)
        for batch in batches:
            for row, texts in W.slices(batch.column(1)):
                keys, text = _features(texts)
                hit, _ = table.find(keys)
                keys, strength, begins = _counted(keys[hit], text[hit], len(texts))
                columns = [
                    pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((begins * v.itemsize).astype(np.int32)), pa.py_buffer(v)])
                    for v in (keys, strength.astype(np.float32))
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), *columns], names=["positive", "keys", "strengths"])

    return run


def _gather(sample: DataFrame, only: np.ndarray) -> tuple[list[Features], list[Features]]:
    """Chosen features of the bounded sample's positives and other texts, sorted: rows arrive in any order, sums of floats must not change."""
    rows = sample.select("positive", "content").mapInArrow(_extract(only), "positive boolean, keys binary, strengths binary").collect()
    pairs = sorted((r["positive"], bytes(r["keys"]), bytes(r["strengths"])) for r in rows)
    texts = [(p, np.frombuffer(k, np.uint64), np.frombuffer(v, np.float32)) for p, k, v in pairs]
    return [(k, v) for p, k, v in texts if p], [(k, v) for p, k, v in texts if not p]


def risk_step(score_p: np.ndarray, score_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative risk under the sigmoid loss, and its gradient by score.

    Where the estimated negative risk falls below zero the step goes up it instead, which is
    how the published algorithm corrects over-fitting. The loss is bounded: with an unbounded
    one, features of positives alone would push the estimate below zero without end.
    """
    p, u = 1 / (1 + np.exp(-score_p)), 1 / (1 + np.exp(-score_u))
    n_p, n_u = max(len(p), 1), max(len(u), 1)
    positive = prior * float((1 - p).sum()) / n_p
    negative = float(u.sum()) / n_u - prior * float(p.sum()) / n_p
    slope_p, slope_u = prior * p * (1 - p) / n_p, u * (1 - u) / n_u
    if negative >= 0:
        return positive + negative, -2 * slope_p, slope_u
    return positive, slope_p, -slope_u


def fit(keys: np.ndarray, positives: list[Features], unlabelled: list[Features], prior: float) -> Classifier:
    """Weights of the sorted features ``keys`` by non-negative risk; without any, the bias alone."""
    if len(keys) == 0 or not positives or not unlabelled:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-3) / 2)))
    both = positives + unlabelled
    column = np.searchsorted(keys, np.concatenate([k for k, _ in both]))
    row = np.repeat(np.arange(len(both)), [len(k) for k, _ in both])
    value = np.concatenate([v for _, v in both]).astype(float)
    n_p, n_u = len(positives), len(unlabelled)
    weights, bias = np.ones(len(keys)), float(np.log(prior / (1 - prior)))
    moment, second = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for step in range(1, EPOCHS + 1):
        score = np.bincount(row, weights[column] * value, minlength=n_p + n_u) + bias
        _, d_p, d_u = risk_step(score[:n_p], score[n_p:], prior)
        d = np.concatenate([d_p, d_u])
        grad = np.bincount(column, d[row] * value, minlength=len(keys)) + PENALTY / n_p * weights
        grad = np.append(grad, d.sum())
        moment = 0.9 * moment + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights, bias = np.maximum(weights - change[:-1], 0.0), bias - float(change[-1])
    return Classifier(keys, weights, bias)


def _score(model: Classifier, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = W.Model(model.keys, model.weights)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for row, texts in W.slices(batch.column(batch.num_columns - 1)):
                keys, text = _features(texts)
                hit, known = table.find(keys)
                cell, n = np.unique(text[hit] * np.int64(len(table.keys) + 1) + known, return_counts=True)
                text, known = np.divmod(cell, len(table.keys) + 1)
                scores[row : row + len(texts)] = np.bincount(text, table.values[known] * np.log2(1 + n), minlength=len(texts))
            scores = 1 / (1 + np.exp(-(scores + model.bias)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(scores)], names=[*batch.schema.names[:-1], column]
            )

    return run


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether a document is kept from learning: by the checksum of its id; a null id is not."""
    rest = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))
    return F.coalesce(rest == part, F.lit(False))


def train(df: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Fit on documents that are not held out; ``labels`` (doc_id, toxic) of held-out ones are not read.

    The prior is the share of toxic rows among the labels used. The two samples are bounded by
    hash of the id whatever the input's size.
    """
    known = labels.filter("toxic is not null").filter(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not counts["toxic"]:
        return fit(np.zeros(0, np.uint64), [], [], 0.0)
    prior = min(max(counts["toxic"] / counts["n"], 1e-3), 0.9)
    documents = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("content"))
    documents = documents.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0))
    rows = max(documents.select("doc_id").count(), 1)
    mix = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    toxic = known.filter("toxic = 1").filter(mix < int(min(1.0, positives / counts["toxic"]) * 1_000_000))
    # about ``positives`` ids, whatever the input's size: sent to every task, so no text is shuffled
    one = documents.join(F.broadcast(toxic.select("doc_id")), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "content")
    other = documents.filter(mix < int(min(1.0, unlabelled / rows) * 1_000_000)).select(F.lit(False).alias("positive"), "content")
    sample = stored(one.union(other))
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        return fit(np.zeros(0, np.uint64), [], [], prior)
    keys = _choose(sample, sizes[True], sizes[False])
    return fit(keys, *_gather(sample, keys), prior)


def score(df: DataFrame, model: Classifier, column: str = "score") -> DataFrame:
    """``df`` with ``column``, the estimated probability of toxicity; all its columns are kept.

    ``column`` must be a new name. Null and empty texts hold no feature and score by the bias
    alone; repeated rows score alike.
    """
    schema = StructType([*df.schema.fields, StructField(column, DoubleType())])
    content = fresh(df, "content")
    return df.withColumn(content, text_or_empty().cast("binary")).mapInArrow(_score(model, column), schema)


def classify(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; other columns are not read."""
    model = train(df, labels)
    scored = score(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
