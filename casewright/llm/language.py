"""Language by words first, shorter and shorter character n-grams after.

A word that is known scores by its log frequency in each language. Only an unseen word is cut
into character n-grams, the longest that any language knows, and their scores are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm import words as W
from casewright.llm.common import stored, text_or_empty
from casewright.llm.toxicity import held_out

LONGEST = 5
#: Documents of each language that are learned from at most: a bounded sample by hash of the id.
SAMPLE = 8_000
#: Languages up to which the table of their shares is sent to every task.
BROADCAST_LANGUAGES = 100_000
#: Words and n-grams of each length that are kept of each language: the most frequent.
KEPT_WORDS, KEPT_GRAMS = 30_000, 10_000
#: Score of what a language does not know but another does.
UNKNOWN = -7.0
#: How sharply mean log scores turn into a probability.
SHARPNESS = 4.0
UNDECIDED = "und"


@dataclass
class Languages:
    names: list[str]
    tables: list[W.Model]  # of words, then of n-grams by length


def _grams(spans: W.Spans, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, word) of every run of ``size`` characters of the given words; from two on, their ends count as one each."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(lead, starts), np.searchsorted(lead, ends)
    ends_count = int(size > 1)  # a mark before and one after
    count = last - first + 2 * ends_count - size + 1
    word = np.repeat(np.arange(len(starts)), np.maximum(count, 0))
    if len(word) == 0:
        return np.zeros(0, np.uint64), word
    offset = np.arange(len(word)) - np.repeat(np.cumsum(np.maximum(count, 0)) - np.maximum(count, 0), np.maximum(count, 0))
    begin = first[word] + offset - ends_count
    end = begin + size
    opens, closes = begin < first[word], end > last[word]
    bounds = np.append(lead, len(data))
    a, b = bounds[np.maximum(begin, first[word])], bounds[np.minimum(end, last[word])]
    b = np.where(end >= last[word], ends[word], b)
    marks = np.uint64(size) + opens.astype(np.uint64) * np.uint64(64) + closes.astype(np.uint64) * np.uint64(128)
    return W.mix(spans.hash(a, b) + marks), word


def _prepared(texts: W.Texts) -> tuple[np.ndarray, W.Spans, W.Words]:
    lower = W.Texts(W.lowered(texts.data), texts.begins)
    spans = W.Spans(lower.data)
    return lower.data, spans, W.words(lower, inside=W.LETTERS, spans=spans)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n) summed within a slice; kind 0 for words, else the n-gram's length."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for row, texts in W.slices(batch.column(1)):
            data, spans, found = _prepared(texts)
            owner = langs[row : row + len(texts)][found.text]
            for lang in sorted(set(owner)):
                mine = np.flatnonzero(owner == lang)
                for kind in range(LONGEST + 1):
                    if kind == 0:
                        keys = found.hashes[mine]
                    else:
                        keys, _ = _grams(spans, data, found.starts[mine], found.ends[mine], kind)
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)],
                        names=["lang", "kind", "key", "n"],
                    )


def train(df: DataFrame, sample: int = SAMPLE) -> Languages:
    """Frequencies from documents with a language that are not held out (id checksum mod 4 = 2).

    What reaches the driver is the model: ``KEPT_WORDS + 5 * KEPT_GRAMS`` keys for each language.
    """
    documents = df.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))
    sizes = documents.groupBy("lang").count()
    mix = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000))
    share = stored(sizes.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")).alias("_share")))
    # the shares go to the texts, not the texts to their language
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGUAGES else share
    chosen = documents.join(share, (F.col("lang") == F.col("_lang")) & (mix < F.col("_share") * 1_000_000))
    counted = chosen.select("lang", text_or_empty().cast("binary")).mapInArrow(_count, "lang string, kind int, key long, n long")
    totals = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    by_n = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    kept = totals.withColumn("_rank", F.row_number().over(by_n))
    kept = kept.filter(F.col("_rank") <= F.when(F.col("kind") == 0, KEPT_WORDS).otherwise(KEPT_GRAMS)).drop("_rank")
    return _tables(kept.toArrow())


def _tables(rows: pa.Table) -> Languages:
    lang, kind, key, n = (rows.column(c).to_numpy() for c in ("lang", "kind", "key", "n"))
    names = sorted(set(lang.tolist()))
    index = np.searchsorted(np.array(names, object), lang) if names else np.zeros(0, int)
    tables = []
    for k in range(LONGEST + 1):
        mine = kind == k
        keys, place = np.unique(key[mine].view(np.uint64) if mine.any() else np.zeros(0, np.uint64), return_inverse=True)
        counts = np.zeros((len(keys), len(names)))
        counts[place, index[mine]] = n[mine]
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = np.log10(counts / counts.sum(0))
        scores[~(counts > 0)] = UNKNOWN
        tables.append(W.Model(keys, np.maximum(scores, UNKNOWN)))
    return Languages(names, tables)


def score_words(model: Languages, texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(sum of word scores by language, words scored) of every text."""
    data, spans, found = _prepared(texts)
    distinct, first, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
    scores, known = np.zeros((len(distinct), len(model.names))), np.zeros(len(distinct), bool)
    hit, row = model.tables[0].find(distinct)
    scores[hit], known[hit] = model.tables[0].values[row], True
    for size in range(LONGEST, 0, -1):
        rest = np.flatnonzero(~known)
        if len(rest) == 0:
            break
        keys, word = _grams(spans, data, found.starts[first[rest]], found.ends[first[rest]], size)
        hit, row = model.tables[size].find(keys)
        n = np.bincount(word[hit], minlength=len(rest))
        some = n > 0
        for k in range(len(model.names)):
            total = np.bincount(word[hit], model.tables[size].values[row, k], minlength=len(rest))
            scores[rest[some], k] = total[some] / n[some]
        known[rest[some]] = True
    used = known[inverse]
    text, inverse = found.text[used], inverse[used]
    n = np.bincount(text, minlength=len(texts))
    sums = np.stack([np.bincount(text, scores[inverse, k], minlength=len(texts)) for k in range(len(model.names))], 1)
    return sums, n


def _identify(model: Languages):
    names = np.array([*model.names, UNDECIDED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in W.slices(batch.column(2)):
                letters = np.array(batch.column(1).slice(row, len(texts)).to_pylist(), bool)
                best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
                if model.names:
                    sums, n = score_words(model, texts)
                    mean = sums / np.maximum(n, 1)[:, None]
                    weight = np.exp(SHARPNESS * (mean - mean.max(1, keepdims=True)))
                    best = np.where(letters, mean.argmax(1), best)
                    score = np.where(letters, (weight / weight.sum(1, keepdims=True)).max(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(names[best], pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"],
                )

    return run


def identify(df: DataFrame, model: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only doc_id and text are read.

    A null text or one without a letter is ``und`` with score 0. A text whose letters no model
    knows ties all languages, and the first in order is taken; repeated rows get one answer. With
    no language learned, all are ``und``.
    """
    content = text_or_empty()
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), content.rlike(r"\p{L}").alias("letters"), content.cast("binary").alias("content"))
    out = rows.mapInArrow(_identify(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
