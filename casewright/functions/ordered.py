"""Order-dependent columns for groups of any size.

``Window.partitionBy(group)`` puts a whole group into one task, which does not
hold when one group owns a large share of the rows. These helpers cut every
group into range blocks by its full sort order, work inside the blocks, and
carry one small row per block from each block to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import cut_lineage

BLOCK = "_block"


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_block``: ranges of (keys, order) of about equal size.

    The order must be total, so that ranges can split even a group of rows with
    one time stamp. Written once, because a second evaluation could sample other
    range bounds.
    """
    ranged = df.repartitionByRange(*keys, *order)
    return cut_lineage(ranged.withColumn(BLOCK, F.spark_partition_id()))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Add ``prev_<column>``: the values of the row before, within ``keys``."""
    blocks = range_blocks(df, keys, order)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    payload = F.struct(*columns)
    lagged = blocks.withColumn("_lag", F.lag(payload).over(inside))
    # one row per (group, block): at most groups + blocks rows in all
    tails = blocks.groupBy(*keys, BLOCK).agg(F.max_by(payload, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = tails.select(*keys, BLOCK, F.lag("_tail").over(across).alias("_carry"))
    joined = _add_by_block(lagged, carried.filter(F.col("_carry").isNotNull()), [*keys, BLOCK])
    previous = F.coalesce("_lag", "_carry")
    out = joined.select(
        *df.columns, *[previous[c].alias(prefix + c) for c in columns]
    )
    return out


def with_row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_index"
) -> DataFrame:
    """Add the 0-based position of each row within ``keys``, as BIGINT."""
    blocks = range_blocks(df, keys, order)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    local = blocks.withColumn("_local", F.row_number().over(inside).cast("long") - 1)
    sizes = blocks.groupBy(*keys, BLOCK).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, BLOCK, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    joined = _add_by_block(local, offsets.filter(F.col("_offset") > 0), [*keys, BLOCK])
    return joined.select(*df.columns, (F.col("_local") + F.coalesce("_offset", F.lit(0))).alias(name))


def with_sum_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``column`` over the rows before, within ``keys``, as BIGINT; 0 for the first row."""
    blocks = range_blocks(df, keys, order)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumn("_local", F.coalesce(F.sum(column).over(inside), F.lit(0)))
    sums = blocks.groupBy(*keys, BLOCK).agg(F.sum(column).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, BLOCK, F.sum("_sum").over(before).alias("_offset"))
    joined = _add_by_block(local, offsets.filter(F.col("_offset").isNotNull()), [*keys, BLOCK])
    return joined.select(*df.columns, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long").alias(name))


def _add_by_block(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys.

    ``right`` has a row only where a group goes on from one block into the next. Blocks
    are ranges, so that is at most one row per block, and it is broadcast.
    """
    right = right.select(
        *[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for i, key in enumerate(keys):
        term = F.col(key).eqNullSafe(F.col(f"_r_{i}"))
        condition = term if condition is None else condition & term
    return left.join(F.broadcast(right), condition, "left").drop(*[f"_r_{i}" for i in range(len(keys))])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    Spark keeps only ``k`` rows per group and task before the shuffle (window
    group limit), so the size of a group does not matter.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
