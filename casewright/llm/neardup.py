"""Near-duplicate documents by one-permutation MinHash.

A document is the set of its distinct shingles. One hash per shingle fills 256 bins with the
smallest hash that falls into each (one permutation); an empty bin takes the value of the
first filled bin in a random order of its own (optimal densification). Bands of bins make
buckets. In a bucket every document is compared with one centre only, so candidates grow with
the rows, never with the square of a bucket. Rows of components that still meet in a bucket
are joined once more on their rarest shingles, so links that the stars passed over are found too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm import words as W
from casewright.llm.common import stored, text_or_empty
from casewright.llm.components import components, extended

BINS = 256
#: Bands of so many bins. Two sets of similarity 0.8 share no band with probability 7e-6.
BANDS, ROWS = 30, 5
#: Similarity, as a percentage, for which bands and sketches are made.
LEAST_PERCENT = 80
#: Sets of up to so many shingles also meet without one of them: two such sets of similarity 0.8 differ in one shingle, or each in one.
TINY = 9
#: Rounds of stars with new centres before the rest is compared in full; fewer if a round finds nothing.
STAR_ROUNDS = 4
#: Differing 2-bit values of 256 bins at which a pair is given up without reading its sets. For similarity 0.8 the number is 38
#: on average with a deviation of 5 to 7, so this is seven of them. Sets of fewer shingles than ``SKETCHED`` are always read:
#: there one bin can stand for a large share of a set.
MOST_APART, SKETCHED = 90, 32

SIGNATURES = "n_shingles long, set_a long, set_b long, bands array<bigint>, sketch array<bigint>"


def _signature(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Densified bins of every text, one row each; rows of empty sets hold zeros."""
    texts = len(begins) - 1
    text = np.repeat(np.arange(texts), np.diff(begins))
    cell = text * BINS + (hashes >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # sorted by text and hash: the first of a cell is its minimum
    bins, filled = np.zeros(texts * BINS, np.uint64), np.zeros(texts * BINS, bool)
    bins[cell[first]] = hashes[first]
    filled[cell[first]] = True
    has = np.repeat(np.diff(begins) > 0, BINS)
    empty, turn = np.flatnonzero(~filled & has), 0
    while len(empty):
        donors = (W.mix(np.arange(BINS, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(turn)) >> np.uint64(56)).astype(np.int64)
        donor = empty - empty % BINS + donors[empty % BINS]
        ok = filled[donor]
        bins[empty[ok]] = bins[donor[ok]]
        empty, turn = empty[~ok], turn + 1
    return bins.reshape(texts, BINS)


def _set_hash(hashes: np.ndarray, begins: np.ndarray, salt: int) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
    return sums[begins[1:]] - sums[begins[:-1]]


def _without_one(hashes: np.ndarray, begins: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    """Buckets of every tiny set: its own hash and those of what is left without one of its shingles."""
    n, mixed = np.diff(begins), W.mix(hashes ^ np.uint64(0x51))
    out = [np.zeros(0, np.uint64)] * len(n)
    for i in np.flatnonzero((n > 0) & (n <= TINY)):
        left = sums[i] - mixed[begins[i] : begins[i + 1]]
        out[i] = W.mix(np.concatenate([sums[i : i + 1], left]) + np.uint64(BANDS))
    return out


def _longs(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    """A list of longs for each row; null where ``rows`` is false."""
    width = values.shape[1]
    offsets = np.concatenate([[0], np.cumsum(np.where(rows, width, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[rows].reshape(-1).view(np.int64)))
    return lists


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(BINS, dtype=np.uint64)
        for batch in batches:
            for row, texts in W.slices(batch.column(batch.num_columns - 1)):
                hashes, text = W.shingles(W.words(texts, lower=True), size)
                hashes, begins = W.distinct(hashes, text, len(texts))
                n, bins = np.diff(begins), _signature(hashes, begins)
                band = np.zeros((len(texts), BANDS), np.uint64)
                for k in range(ROWS):
                    band = W.mix(band + bins[:, k : BANDS * ROWS : ROWS] + np.uint64(k + 1))
                band = W.mix(band + np.arange(BANDS, dtype=np.uint64))
                bits = W.mix(bins + numbers) & np.uint64(3)
                packed = np.zeros((len(texts), BINS // 32), np.uint64)
                for k in range(32):
                    packed |= bits[:, k::32] << np.uint64(2 * k)
                some = n > 0
                sums = [_set_hash(hashes, begins, salt) for salt in (0x51, 0xA7)]
                more = _without_one(hashes, begins, sums[0])
                widths = np.where(some, BANDS + np.array([len(m) for m in more], np.int64), 0)
                joined = [x for i in np.flatnonzero(some) for x in (band[i], more[i])]
                buckets = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)),
                    pa.array(np.concatenate(joined).view(np.int64) if joined else np.zeros(0, np.int64)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(row, len(texts)) for i in range(batch.num_columns - 1)],
                        pa.array(n, pa.int64()),
                        *[pa.array(x.view(np.int64), mask=~some) for x in sums],
                        buckets, _longs(packed, some),
                    ],
                    names=[*batch.schema.names[:-1], "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return run


def _collect_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in W.slices(batch.column(1)):
                hashes, begins = W.distinct(*W.shingles(W.words(texts, lower=True), size), len(texts))
                sets = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), sets], names=["row", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def apart(x: Column, y: Column) -> Column:
    """In how many bins two sketches differ."""
    total = None
    for i in range(BINS // 32):
        both = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        one = F.bit_count(both.bitwiseOR(F.shiftrightunsigned(both, 1)).bitwiseAND(0x5555555555555555))
        total = one if total is None else total + one
    return total


def _shared_buckets(members: DataFrame) -> DataFrame:
    """Rows (bucket, row) of buckets with two rows or more; counts are added up before the shuffle."""
    several = members.groupBy("bucket").agg(F.min("row").alias("_low"), F.max("row").alias("_high")).filter("_low < _high")
    return members.join(several.select("bucket"), "bucket")


def _star(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of every row with its bucket's centre, where their components differ."""
    order = F.struct(F.xxhash64("row", F.lit(turn)), "row", "root")
    centres = members.groupBy("bucket").agg(F.min(order).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    centres = centres.filter("lo < hi").select("bucket", F.col("c.row").alias("centre"), F.col("c.root").alias("centre_root"))
    pairs = members.join(centres, "bucket").filter("root <> centre_root")
    return pairs.select(F.least("row", "centre").alias("a"), F.greatest("row", "centre").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full sets."""
    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def _close(x: str, y: str) -> Column:
    """Whether sketches do not rule out the pair of two structs or aliases with n and sketch."""
    small = F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) < SKETCHED
    return small | (apart(F.col(f"{x}.sketch"), F.col(f"{y}.sketch")) <= MOST_APART)


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches do not rule them out."""
    side = F.struct(F.col("n_shingles").alias("n"), "sketch")
    left = sketches.select(F.col("row").alias("a"), side.alias("_x"))
    right = sketches.select(F.col("row").alias("b"), side.alias("_y"))
    return pairs.join(left, "a").join(right, "b").filter(_close("_x", "_y")).select("a", "b")


def groups(df: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's near-duplicate class: doc_id, n_shingles, component_id, kept.

    Rows are linked when ``100 * intersection >= percent * union`` holds for their sets of
    ``size``-word shingles (ASCII letters lower-cased; a text of fewer words is one shingle).
    ``component_id`` is the smallest doc_id that links lead to, ``kept`` whether it is the row's
    own. A null or blank text has an empty set and is linked with nothing. A null doc_id is never
    the smallest unless a class has no other. Rows with one doc_id are rows of their own, so all of
    them are kept if theirs is the smallest id. An empty table gives an empty result; other
    columns are not read.

    Equal sets become one row first, whatever their number. Sets of the rows that share a bucket
    are made again from the text, and every link is confirmed on them. Bands and sketches are made for
    similarity 0.8; a lower ``percent`` would lose links and is refused.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be at least {LEAST_PERCENT}, not {percent}")
    content = text_or_empty(text)
    # 128 bits of the content find a row's text again; rows themselves get a number once
    base = df.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(content).alias("text_a"), F.xxhash64(F.lit("second"), content).alias("text_b"),
        content.cast("binary").alias("content"),
    )
    signed = stored(
        base.mapInArrow(_sign(size), f"doc_id long, text_a long, text_b long, {SIGNATURES}")
        .withColumn("row", F.monotonically_increasing_id())
    )
    owners = stored(signed.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("row").alias("owner")))
    single = signed.join(owners.select(F.col("owner").alias("row")), "row", "left_semi")
    members = stored(_shared_buckets(single.select("row", F.explode("bands").alias("bucket"))))
    meeting = stored(
        signed.join(members.select("row").distinct(), "row", "left_semi").select("row", "doc_id", "n_shingles", "text_a", "text_b", "sketch")
    )
    wanted = meeting.select("row", F.col("doc_id").alias("_id"), "text_a", "text_b")
    found = base.join(wanted, ["text_a", "text_b"]).filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = stored(found.select("row", "content").mapInArrow(_collect_sets(size), "row long, shingles array<bigint>").dropDuplicates(["row"]))

    placed = members.withColumn("root", F.col("row"))
    tried = labels = None
    turn, last = 0, False
    while True:
        pairs = _across(placed, sets, meeting, percent) if last else _near(_star(placed, turn), meeting)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        links = stored(_confirmed(pairs, sets, percent))
        tried = pairs if tried is None else tried.union(pairs)
        nothing = links.isEmpty()
        if labels is None or not nothing:
            labels = components(links) if labels is None else extended(labels, links)
        if last:
            break
        turn += 1
        last = turn == STAR_ROUNDS or (nothing and turn > 1)
        if not nothing:
            rooted = members.join(labels.withColumnRenamed("node", "row"), "row", "left")
            placed = stored(rooted.select("bucket", "row", F.coalesce("root", "row").alias("root")))

    owned = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(owners, ["set_a", "set_b"], "left")
    rooted = owned.join(labels.withColumnRenamed("node", "owner"), "owner", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "owner").alias("root")
    )
    smallest = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n"))
    # written, so that the join below is one of plain tables and a class of any size can be split
    several = stored(smallest.filter("n > 1").drop("n"))
    out = rooted.join(several, "root", "left").withColumn("component_id", F.coalesce("smallest", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _across(placed: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that can be similar, among rows whose buckets hold several.

    In one order of all shingles, rarest first, two sets that are similar enough share one
    of the first ``n - needed + 1`` shingles of each, and at the first that they share, what is
    left of both must still reach the overlap that the similarity asks for. Rows of one template that have edits in common
    still meet there; their sketches are compared where they meet, so what they rule out is no row of the result.
    """
    ranges = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    open_rows = placed.join(ranges.select("bucket"), "bucket").select("row", "root").distinct()
    each = stored(sets.join(open_rows, "row").select("row", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s")))
    common = each.groupBy("s").agg(F.count("*").alias("often")).filter("often > 1")
    by_rarity = Window.partitionBy("row").orderBy(F.desc("often"), F.desc("s"))
    # from the most frequent: what comes before the first common shingle need not be ranked
    ranked = each.join(common, "s").withColumn("at", F.col("n") - F.row_number().over(by_rarity) + 1)
    first = ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("row", "root", "n", "s", "at")
    first = stored(first.join(sketches.select("row", "sketch"), "row"))
    x, y = first.alias("x"), first.alias("y")
    overlap = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    left = 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    condition = (F.col("x.s") == F.col("y.s")) & (F.col("x.row") < F.col("y.row")) & (F.col("x.root") != F.col("y.root")) & (left >= overlap)
    return x.join(y, condition & _close("x", "y")).select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct()
