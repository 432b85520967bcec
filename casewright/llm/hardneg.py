"""Hard negatives for contrastive training: rows of another label that score just below a positive.

Anchors are a part of the rows and meet all others in blocks: a task has one block of anchors and one group of rows.
Every positive of an anchor opens a window of scores for its negatives. The windows of one anchor overlap; their upper limits cut
the scores into disjoint slots, the first one highest. A task keeps the best few of each slot (what else it
has cannot be in any result), tasks' lists are merged, and a window's first negatives are the first in the descending
merge of its own slot and those below.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.ordered import top_k
from casewright.llm.common import stored

#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 10
#: A window's limits, as percentages of the positive's score.
LOW, HIGH = 30, 90
#: Anchors of a block and rows of a group, about.
ANCHORS, ROWS = 1024, 1 << 16
#: Rows that are scored at once in a task.
CHUNK = 4096

_PAIR = ["block", "part"]
_LEAST = np.iinfo(np.int64).min


def rows_of(df: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part: ``vec`` has the whole numbers floor(256 * x).

    Rows with a null id, label or vector, or with a null or non-finite component are left out; of rows with one id the one with
    the smallest label, then vector, counts. Labels of ids divisible by 7 become (label + 1) % 10 first.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    label = F.col("label").cast("long")
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"),
    )
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row of ``width`` numbers for each list, short ones filled with zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _sides(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of both sides: as doubles where their products are exact in doubles, else as 64-bit numbers, which wrap around."""
    width = max((int(np.max(t["vec"].combine_chunks().value_lengths().to_numpy(), initial=0)) for t in (anchors, rows)), default=0)
    a, r = _matrix(anchors["vec"], width), _matrix(rows["vec"], width)
    largest = [float(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) for x in (a, r)]
    if largest[0] * largest[1] * max(width, 1) < 2.0**53:
        return a.astype(np.float64), r.astype(np.float64)
    return a, r


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score, highest first, then id."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _lists(ids: list[int], found: list[list[tuple]], names: list[str]) -> pa.Table:
    """A row for each anchor with something found: its id and a list of structs."""
    kind = pa.list_(pa.struct([(n, pa.int32() if n == "slot" else pa.int64()) for n in names]))
    some = [i for i, f in enumerate(found) if f]
    return pa.table({"anchor_id": pa.array([ids[i] for i in some], pa.int64()), "found": pa.array([[dict(zip(names, x, strict=True)) for x in found[i]] for i in some], kind)})


def _positives(count: int):
    """Of every anchor the best rows of its label, itself left out."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        other, other_labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        a, r = _sides(anchors, rows)
        found: list[list[tuple]] = [[] for _ in ids]
        for label in np.unique(labels):
            mine, same = np.flatnonzero(labels == label), np.flatnonzero(other_labels == label)
            for begin in range(0, len(same), CHUNK):
                at = same[begin : begin + CHUNK]
                scores = (a[mine] @ r[at].T).astype(np.int64)
                for i, row in zip(mine, scores, strict=True):
                    free = np.flatnonzero(other[at] != ids[i])
                    more = free[_best(row[free], other[at[free]], count)]
                    found[i] += zip(row[more].tolist(), other[at[more]].tolist(), strict=True)
                    found[i] = sorted(found[i], key=lambda x: (-x[0], x[1]))[:count]
        return _lists(ids.tolist(), found, ["score", "id"])

    return run


def _slots(count: int, low: int, high: int):
    """Of every anchor and slot the best rows of other labels."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        # by id, so that of equal scores the first seen stays
        rows = rows.sort_by("vec_id")
        ids, labels = anchors["vec_id"].to_pylist(), anchors["label"].to_numpy()
        limits = [np.array([s for s in scores if s >= 0], np.int64) for scores in anchors["scores"].to_pylist()]
        other, other_labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        a, r = _sides(anchors, rows)
        found: list[list[tuple]] = [[] for _ in ids]
        worst = [np.full(len(x), _LEAST) for x in limits]  # what a full slot would have to lose
        for begin in range(0, len(other), CHUNK):
            scores = (a @ r[begin : begin + CHUNK].T).astype(np.int64)
            at, at_labels = other[begin : begin + CHUNK], other_labels[begin : begin + CHUNK]
            for i, positive in enumerate(limits):
                if len(positive) == 0:
                    continue
                upper, row = np.array([s * high // 100 for s in positive.tolist()], np.int64), scores[i]
                lowest = -(-int(positive[-1]) * low // 100)
                may = np.flatnonzero((row <= upper[0]) & (row >= lowest) & (at_labels != labels[i]))
                slot = np.searchsorted(-upper, -row[may], "right") - 1
                better = row[may] > worst[i][slot]
                may, slot = may[better], slot[better]
                for s in np.unique(slot):
                    mine = may[slot == s]
                    mine = mine[_best(row[mine], at[mine], count)]
                    own = [x for x in found[i] if x[0] == s] + [(int(s), int(row[j]), int(at[j])) for j in mine]
                    own = sorted(own, key=lambda x: (-x[1], x[2]))[:count]
                    found[i] = [x for x in found[i] if x[0] != s] + own
                    if len(own) == count:
                        worst[i][s] = own[-1][1]
        return _lists(ids, found, ["slot", "score", "id"])

    return run


def _meet(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int, run, found: str) -> DataFrame:
    """(anchor_id, found): what ``run`` makes of every block of anchors and group of rows."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part")
    left = anchors.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = rows.select("*", part, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = right.toDF(*right.columns)  # anchors are some of the rows: columns of their own
    return left.groupBy(*_PAIR).cogroup(right.groupBy(*_PAIR)).applyInArrow(run, f"anchor_id long, found array<{found}>")


def mine(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id (unique), label, vec (whole numbers); ``anchor`` chooses the anchors. A row's score is its inner product with
    the anchor, where a vector that is shorter than another counts as filled with zeros; products beyond 64 bits wrap around.
    An anchor's positives are the first ``positives`` other rows of its label, by descending score, then id. For each of them the first
    ``negatives`` rows of other labels with ``low * positive_score <= 100 * score <= high * positive_score`` are returned
    in that order, ranks from 1. An anchor without a positive, and a positive with an empty window (each of negative
    score), have no rows; an empty table gives an empty result.
    """
    if not 0 <= low <= high:
        raise ValueError(f"limits must be ordered and not negative: {low}, {high}")
    rows = stored(rows.select("vec_id", "label", "vec"))
    n, n_anchors = rows.agg(F.count("*"), F.count_if(anchor)).first()
    blocks = max(1, -(-n_anchors // ANCHORS))
    parts = max(1, -(-n // ROWS), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks))
    anchors = rows.filter(anchor)
    best = _meet(anchors, rows, blocks, parts, _positives(positives), "struct<score:long,id:long>")
    best = best.select("anchor_id", F.explode("found").alias("f")).select("anchor_id", "f.score", "f.id")
    best = top_k(best, ["anchor_id"], [F.desc("score"), F.asc("id")], positives)
    chosen = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("positives"))
    chosen = stored(chosen)
    ready = anchors.join(chosen, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vec", F.col("positives.score").alias("scores"))

    held = _meet(ready, rows, blocks, parts, _slots(negatives, low, high), "struct<slot:int,score:long,id:long>")
    held = held.select("anchor_id", F.explode("found").alias("f")).select("anchor_id", "f.*")
    held = top_k(held, ["anchor_id", "slot"], [F.desc("score"), F.asc("id")], negatives)
    item = F.struct("slot", "rank", "score", "id")
    # at most ``positives * negatives`` items of an anchor, descending: slots descend, and ranks inside them
    lists = held.groupBy("anchor_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def window(p: Column) -> Column:
        merged = F.slice(F.filter("items", lambda x: x["slot"] >= p["rank"] - 1), 1, negatives)
        score = p["score"].cast("decimal(20,0)")
        return F.filter(merged, lambda x: (100 * x["score"].cast("decimal(20,0)")).between(low * score, high * score))

    answered = chosen.join(lists, "anchor_id").select(
        "anchor_id", F.explode(F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"), window(p).alias("window")))).alias("p")
    )
    each = answered.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode("p.window").alias("place", "x"))
    return each.select(
        "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"),
    )
