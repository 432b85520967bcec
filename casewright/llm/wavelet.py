"""Token ids in wavelet matrices: one compressed file per shard, with rank and select.

A shard holds the ids of a range of documents as bit planes. Plane 0 holds the top bit of
every id in text order; each next plane holds the next bit after a stable partition by the
bit before. With counts of ones at every 512th bit, the id at a place, the count of an id in a
range and the place of its n-th occurrence take one look per plane, without unpacking.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.common import text_or_empty

#: Id that ends every document.
END = 1
#: A shard is closed by the first document that reaches so many ids; documents are never cut.
SHARD_TOKENS = 1 << 22
BLOCK = 512
#: Chunks, and pieces of chunks, whose ids a Python worker remembers: so many new ones and as many older.
REMEMBERED = 130_000
#: Longer ones are not remembered.
LONGEST = 64

SHARDS = "shard long, doc_ids array<bigint>, ends array<bigint>, n_tokens long, bits int, zeros array<bigint>, planes binary, ranks binary"
DOCS = "shard long, place int, doc_id long, begin long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Ids below ``2**bits``; ``planes`` are packed bits, ``ranks`` counts of ones before each block."""

    def __init__(self, n: int, bits: int, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, blocks = len(ids), len(ids) // BLOCK + 1
        planes = np.zeros((bits, blocks * BLOCK // 8), np.uint8)
        ranks, zeros = np.zeros((bits, blocks), np.uint32), np.zeros(bits, np.int64)
        rest = ids
        for level in range(bits):
            ones = (rest & rest.dtype.type(1 << (bits - 1 - level))) != 0
            packed = np.packbits(ones, bitorder="little")
            planes[level, : len(packed)] = packed
            counts = np.bitwise_count(planes[level].view(np.uint64)).reshape(blocks, -1).sum(1, dtype=np.uint32)
            ranks[level, 1:] = np.cumsum(counts[:-1], dtype=np.uint32)
            low = rest[~ones]
            zeros[level] = len(low)
            rest = np.concatenate([low, rest[ones]])
        return cls(n, bits, zeros, planes, ranks)

    @classmethod
    def load(cls, n: int, bits: int, zeros: Iterable[int], planes: bytes, ranks: bytes) -> WaveletMatrix:
        blocks = n // BLOCK + 1
        return cls(
            n, bits, np.asarray(zeros, np.int64), np.frombuffer(planes, np.uint8).reshape(bits, blocks * BLOCK // 8),
            np.frombuffer(ranks, "<u4").reshape(bits, blocks),
        )

    def _ones(self, level: int, at: int) -> int:
        block, rest = divmod(at, BLOCK)
        begin = block * BLOCK // 8
        full, odd = divmod(rest, 8)
        count = int(self.ranks[level, block]) + int(np.bitwise_count(self.planes[level, begin : begin + full]).sum())
        return count + (int(self.planes[level, begin + full]) & ((1 << odd) - 1)).bit_count() if odd else count

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level, at // 8]) >> (at % 8) & 1

    def access(self, at: int) -> int:
        """The id at place ``at``."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value = value << 1 | bit
            at = int(self.zeros[level]) + ones if bit else at - ones
        return value

    def rank(self, token: int, at: int) -> int:
        """How often ``token`` occurs before place ``at``."""
        if token >> self.bits:
            return 0
        begin, end = 0, at
        for level in range(self.bits):
            a, b = self._ones(level, begin), self._ones(level, end)
            if token >> (self.bits - 1 - level) & 1:
                begin, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                begin, end = begin - a, end - b
        return end - begin

    def count(self, token: int, begin: int, end: int) -> int:
        return self.rank(token, end) - self.rank(token, begin)

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th (from 0) occurrence of ``token``; -1 if there are fewer."""
        if k < 0 or k >= self.rank(token, self.n):
            return -1
        begins, at = [], 0
        for level in range(self.bits):
            begins.append(at)
            ones = self._ones(level, at)
            at = int(self.zeros[level]) + ones if token >> (self.bits - 1 - level) & 1 else at - ones
        at += k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            wanted = at - int(self.zeros[level]) if bit else at
            low, high = begins[level], self.n - 1  # the first place with so many equal bits up to it
            while low < high:
                middle = (low + high) // 2
                ones = self._ones(level, middle + 1)
                if (ones if bit else middle + 1 - ones) > wanted:
                    high = middle
                else:
                    low = middle + 1
            at = low
        return at

    def decode(self) -> np.ndarray:
        """All ids in text order: the planes are undone from the last to the first."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            moved = np.empty_like(out)
            split = int(self.zeros[level])
            moved[~ones] = out[:split]
            moved[ones] = out[split:] | out.dtype.type(1 << (self.bits - 1 - level))
            out = moved
        return out


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memory(dict):
    """A dictionary of bounded size that drops what was not asked for longest.

    When it is full its entries become the older ones, and the older ones before them go;
    an older entry that is asked for counts as new again.
    """

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Pieces(Memory):
    """Ids of one piece by the library's model."""

    def __init__(self, model, mapped: dict[int, str], dtype: str):
        super().__init__()
        self.model, self.mapped, self.dtype = model, mapped, dtype
        self.code = "H" if dtype == "<u2" else "I"

    def make(self, piece: str) -> bytes:
        ids = array(self.code, [t.id for t in self.model.tokenize(piece.translate(self.mapped))])
        return ids.tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()


class Encoder(Memory):
    """Ids of a white-space separated chunk as bytes, remembered.

    The vocabulary drops white space and joins nothing across it, so a text's ids are those
    of its chunks in order. Chunks of plain Latin letters, digits and ASCII punctuation take a
    short way: each character is normalised by the tokenizer once, the chunk is split by the
    tokenizer's own pattern, and the library's model encodes the pieces. All others go through
    the whole library.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.dtype = "<u2" if self.bits <= 16 else "<u4"
        latin = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
        plain = "".join(chr(c) for c in range(0x21, 0x7F)) + latin
        before, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.lower = {ord(c): before.normalize_str(c) for c in plain}
        self.mapped = {ord(c): split.pre_tokenize_str(c)[0][0] for c in plain if self.lower[ord(c)] == c}
        letters = f"a-z{latin[latin.index('ß'):]}"
        self.pieces = Pieces(self.tokenizer.model, self.mapped, self.dtype)
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9]+").findall
        self.plain = re.compile(f"[{re.escape(plain)}]+").fullmatch

    def make(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters alone are one piece
            return self.pieces[chunk.lower().decode()]
        text = chunk.decode()
        if self.plain(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, self.split(text.translate(self.lower))))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _shard_row(shard: int, doc_ids: list, parts: list[bytes], encode: Encoder) -> pa.RecordBatch:
    size = np.dtype(encode.dtype).itemsize
    ends = np.cumsum([len(p) // size for p in parts], dtype=np.int64)
    matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), encode.dtype), encode.bits)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
            pa.array([matrix.n], pa.int64()), pa.array([matrix.bits], pa.int32()),
            pa.array([matrix.zeros], pa.list_(pa.int64())), pa.array([matrix.planes.tobytes()], pa.binary()),
            pa.array([matrix.ranks.astype("<u4").tobytes()], pa.binary()),
        ],
        names=["shard", "doc_ids", "ends", "n_tokens", "bits", "zeros", "planes", "ranks"],
    )


def write(df: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS, end: int = END, order: str = "doc_id") -> None:
    """Write ``df`` (doc_id, text) as wavelet shards below ``path``, in ascending order of ``order``.

    Documents are range-partitioned by it and a hash of the text, so equal ids can be split
    too; nulls come first and equal ids are ordered by text. Null and empty texts have the
    end id alone. Other columns are not read. An empty table gives no file. ``shard`` numbers
    ascend with the documents: the partition in the upper bits, the place in it in the lower 20.
    """

    def encode_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tail = np.array([end], encode.dtype).tobytes()
        shard, limit = TaskContext.get().partitionId() << 20, shard_tokens * len(tail)
        ids, parts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = encode.encode(text.as_buffer().to_pybytes()) + tail
                ids.append(doc_id)
                parts.append(part)
                size += len(part)
                if size >= limit:
                    yield _shard_row(shard, ids, parts, encode)
                    shard, ids, parts, size = shard + 1, [], [], 0
        if ids:
            yield _shard_row(shard, ids, parts, encode)

    content = text_or_empty()
    keyed = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), content.cast("binary").alias("content"), F.col(order).alias("order"),
        F.xxhash64(content).alias("mix"),
    )
    ordered = keyed.repartitionByRange("order", "mix").sortWithinPartitions("order", "mix")
    shards = ordered.select("doc_id", "content").mapInArrow(encode_partition, SHARDS)
    # one row, so one shard, in each file; the writer looks at its memory after every row
    options = {"maxRecordsPerFile": "1", "compression": "zstd", "parquet.page.size.row.check.min": "1"}
    shards.write.options(**options).parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document as the files have it: shard, place, doc_id, begin, n_tokens, ids_crc32, start."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("shard", "doc_ids", "ends", "n_tokens", "bits", "zeros")}
                planes, ranks = (batch.column(name)[i].as_buffer() for name in ("planes", "ranks"))
                ids = WaveletMatrix.load(row["n_tokens"], row["bits"], row["zeros"], planes, ranks).decode()
                ends = np.array(row["ends"], np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(begins, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["shard"]), pa.int64()), pa.array(np.arange(n), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(ends - begins),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["shard", "place", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    files = shards(spark, path)
    rows = files.mapInArrow(decode, DOCS)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one small row per shard; the planes are not read for it
    offsets = files.select("shard", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before"))
    return rows.join(offsets, "shard").withColumn("start", F.col("begin") + F.col("before")).drop("before")


def find(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Count and first place of a token in every shard, from the planes alone."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, bits, zeros = (batch.column(name)[i].as_py() for name in ("n_tokens", "bits", "zeros"))
                planes, ranks = (batch.column(name)[i].as_buffer() for name in ("planes", "ranks"))
                matrix = WaveletMatrix.load(n, bits, zeros, planes, ranks)
                yield pa.RecordBatch.from_pydict(
                    {"shard": [batch.column("shard")[i].as_py()], "n": [matrix.rank(token, n)], "first": [matrix.select(token, 0)]}
                )

    return shards(spark, path).select("shard", "n_tokens", "bits", "zeros", "planes", "ranks").mapInArrow(
        look, "shard long, n long, first long"
    )
