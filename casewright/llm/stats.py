"""Statistics of whole texts that quality rules look at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import words as W
from casewright.llm.common import text_or_empty

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_lower",
    "n_digits", "n_exclaim", "n_stops",
)

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.isin(np.arange(256), list(b".?;:"))


def _sums(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[begins[1:]] - total[begins[:-1]]


def _repeats(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether the same hash stands twice or more in its text."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    same = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(h), bool)
    out[order] = twice
    return out


def statistics(texts: W.Texts) -> dict[str, np.ndarray]:
    """``COUNTS`` of every text, whole and case-sensitive."""
    data, begins, n = texts.data, texts.begins, len(texts)
    spans = W.Spans(data)
    found = W.words(texts, spans=spans)
    out = {"n_words": found.counts}
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, found.starts, 1)
    np.add.at(inside, found.ends, -1)
    in_word = np.cumsum(inside[:-1]) > 0
    out["word_chars"] = _sums(in_word & ((data & 0xC0) != 0x80), begins)
    for name, table in (("n_symbols", _IS_SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_stops", _STOP)):
        out[name] = _sums(table[data], begins)
    out["n_exclaim"] = _sums(data == 0x21, begins)

    starts, ends = W.runs(data != 0x0A, begins)
    line_words = np.searchsorted(found.starts, ends) - np.searchsorted(found.starts, starts)
    starts, ends = starts[line_words > 0], ends[line_words > 0]
    line_text = np.searchsorted(begins, starts, "right") - 1
    out["n_lines"] = np.bincount(line_text, minlength=n)
    different = np.diff(W.distinct(spans.hash(starts, ends), line_text, n)[1])
    out["n_dup_lines"] = out["n_lines"] - different
    out["n_distinct_words"] = np.diff(W.distinct(found.hashes, found.text, n)[1])

    hashes, text = W.shingles(found, WINDOW)
    whole = found.counts >= WINDOW
    full = int(np.maximum(found.counts - WINDOW + 1, 0)[whole].sum())
    hashes, text = hashes[:full], text[:full]  # shorter texts' runs stand at the end
    begin = np.concatenate([[0], np.cumsum(np.maximum(found.counts - WINDOW + 1, 0))])
    word = found.first[text] + np.arange(full) - begin[text]
    word = word[_repeats(hashes, text)]
    cover = np.zeros(len(found.hashes) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(cover[:-1]) > 0, found.first)
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in W.slices(batch.column(1)):
            counts = statistics(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(texts)), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS]],
                names=["doc_id", *COUNTS],
            )


def text_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``COUNTS`` of every row; a null text counts as empty."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary"))
    return rows.mapInArrow(_run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: What rules are made of: name and SQL over the counts. Shares are 0 where there is nothing to share.
FEATURES = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaim_per_word": "n_exclaim / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
}


def feature(name: str) -> Column:
    return F.expr(FEATURES[name]).cast("double")
