"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time 0..1. Its integral, scaled to the
source's target, is the number of words the mix has asked of it so far. The inverse of that
demand turns a document's place in its source into a training position, and one range sort
by position gives the training order.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import before, stored, text_or_empty, word_count

#: Weights, dealt in turn to the sources in code point order, null last.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's words are taken so many times at most.
MOST_PASSES = 3
#: Schedules, dealt like the weights: (time, weight) knots, linear between. Only the shape counts.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
PARTS = 256


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Add ``index``, ``weight`` and ``target`` to rows (source, source_size).

    Targets are proportional to the weights but stop at ``most`` times the source's size, and
    what lies above is shared out again by weight. The end of that sharing has a closed form:
    sources fill up in the order of capacity by weight, and the first that does not fill fixes
    the level of all that follow. One row per source is gathered, not one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sources.withColumn("index", F.row_number().over(by_name).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("index", F.lit(len(weights))) + 1).cast("int"))
    capped = numbered.withColumns({"weight": weight, "_cap": F.col("source_size").cast("double") * most})
    filling = Window.orderBy((F.col("_cap") / F.col("weight")), "index")
    so_far, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("_cap").over(so_far), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = capped.withColumn("_level", level).withColumn(
        "_level", F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("weight"), F.struct(F.col("_cap") / F.col("weight"), "_level"))).over(everything)["_level"]
    )
    target = F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))
    return levelled.withColumn("target", target).drop("_cap", "_level")


def _inverse(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Training time at which a schedule has asked for ``share`` (0..1) of its whole demand."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in itertools.pairwise(knots)]
    whole, done, out = sum(areas), 0.0, None
    for (a, b), area in zip(itertools.pairwise(knots), areas, strict=True):
        length, slope = b[0] - a[0], (b[1] - a[1]) / (b[0] - a[0])
        need = share * whole - F.lit(done)  # area asked for inside this piece
        root = F.sqrt(F.greatest(F.lit(a[1] ** 2) + need * (2 * slope), F.lit(0.0)))
        inside = F.lit(a[0]) + F.when(need <= 0, F.lit(0.0)).otherwise(F.least((need * 2) / (root + F.lit(a[1])), F.lit(length)))
        done += area
        out = F.when(share * whole <= done, inside) if out is None else out.when(share * whole <= done, inside)
    return out.otherwise(F.lit(knots[-1][0]))


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, schedules=SCHEDULES, most: int = MOST_PASSES) -> DataFrame:
    """Every document's place in the mix: doc_id, source, size, source_size, target, passes.

    ``passes`` is an array of (taken, position): the words taken by each pass over the document
    and when. A source's passes are laid end to end in the order of a hash; the mix takes from
    there up to the target, so the words of a source add up to its rounded target and the last
    document is cut there. Null text has size 0; a null source is a source; repeated rows count
    each; sources of size 0 have target 0. Other columns of ``df`` are not read.
    """
    sized = stored(
        df.select("doc_id", "source", word_count().alias("size"), F.xxhash64("doc_id", text_or_empty()).alias("mix_key"))
        .withColumn("_part", F.pmod("mix_key", F.lit(PARTS)))
    )
    sources = targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, most)
    sources = sources.withColumnRenamed("source", "_name")
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["_name"])).drop("_name")
    laid = before(placed, "index", "_part", ["mix_key", "doc_id", "size"], F.col("size"), "start")
    goal = F.round("target").cast("long")
    kind = F.pmod("index", F.lit(len(schedules)))

    def one(number: Column) -> Column:
        begin = F.col("start") + number * F.col("source_size")
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - begin))
        share = F.when(F.col("target") > 0, begin / F.col("target")).otherwise(F.lit(0.0))
        position = None
        for k, knots in enumerate(schedules):
            term = _inverse(share, knots)
            position = F.when(kind == k, term) if position is None else position.when(kind == k, term)
        return F.struct(taken.cast("long").alias("taken"), position.alias("position"))

    passes = F.filter(F.array(*[one(F.lit(k).cast("long")) for k in range(most)]), lambda p: p["taken"] > 0)
    return laid.select("doc_id", "source", "size", "source_size", "target", "mix_key", passes.alias("passes"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per pass over a document, range-sorted by training position."""
    rows = mixed.select("*", F.explode("passes").alias("_pass")).select(
        *[c for c in mixed.columns if c != "passes"], "_pass.taken", "_pass.position"
    )
    return rows.repartitionByRange("position", "mix_key").sortWithinPartitions("position", "mix_key")
