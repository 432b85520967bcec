"""Words, shingles and their hashes for whole Arrow batches, in numpy.

Texts are UTF-8; a word is a run of bytes that are not ASCII white space. Nothing here loops
over words: hashes come from prefix sums, so a batch costs a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken in slices of about so many bytes; one longer text is a slice of its own.
SLICE = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_STEP = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(256, dtype=np.uint64) + _U(0x1234567))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of letters: ASCII letters and all bytes of longer UTF-8 sequences.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, factor in enumerate((_STEP, _inverse(_STEP))):
            base = np.full(n, factor, np.uint64)
            base[0] = 1
            _POWERS[k] = np.cumprod(base, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


@dataclass
class Texts:
    """``data`` are the bytes of some texts, ``begins`` their offsets (one more than texts)."""

    data: np.ndarray
    begins: np.ndarray

    def __len__(self) -> int:
        return len(self.begins) - 1


@dataclass
class Words:
    """Words of some texts: byte ranges, 64-bit hashes, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the capital letters U+00C0 to U+00DE, in place of their bytes."""
    out = _LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[capital] += 0x20
    return out


class Spans:
    """Hashes of any byte ranges of ``data`` in constant time each, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.back = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[:n], out=self.sums[1:], dtype=np.uint64)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the runs of true values; a text's begin also begins a run."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def slices(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """(row, texts) over a string or binary array without nulls, in slices of bounded bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return
    size = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def words(texts: Texts, lower: bool = False, inside: np.ndarray = ~_IS_SPACE, spans: Spans | None = None) -> Words:
    """Runs of the bytes that ``inside`` marks: all but ASCII white space unless given."""
    data = _LOWER[texts.data] if lower else texts.data
    starts, ends = runs(inside[data], texts.begins)
    return Words(starts, ends, (spans or Spans(data)).hash(starts, ends), np.searchsorted(starts, texts.begins))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``size`` words; a shorter text with words is one run."""
    counts, n = found.counts, len(found.hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    text = found.text
    left = found.first[1:][text] - np.arange(n)  # words from here to the text's end
    begins = np.flatnonzero(left >= size)
    total = np.zeros(len(begins), np.uint64)
    for k in range(size):
        total = mix(total + found.hashes[begins + k] + _U(k + 1))
    brief = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = counts[short] > k
        at = np.where(has, found.first[short] + k, 0)
        brief = np.where(has, mix(brief + found.hashes[at] + _U(k + 1)), brief)
    return np.concatenate([total, mix(brief + _U(0xABCDEF))]), np.concatenate([text[begins], short])


def distinct(hashes: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, sorted; and where each text's begin."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[keep], text[keep]
    return hashes, np.searchsorted(text, np.arange(texts + 1))


class Model:
    """Rows of numbers by 64-bit key, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[keys >> _U(48)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``keys`` that are known, their rows)."""
        maybe = np.flatnonzero(self.seen[keys >> _U(48)])
        if len(self.keys) == 0 or len(maybe) == 0:
            return maybe[:0], maybe[:0]
        row = np.searchsorted(self.keys, keys[maybe])
        row[row == len(self.keys)] = 0
        hit = self.keys[row] == keys[maybe]
        return maybe[hit], row[hit]
