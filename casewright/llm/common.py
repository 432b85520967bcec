"""What the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.session import cut_lineage

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(0))  # sets the folder by the session's rule
    return f"{context.getCheckpointDir().rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()``, later reads still prune columns and push filters down.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, made from ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _from_files(df: DataFrame) -> DataFrame:
    """``df``, written first if its rows are not those of files."""
    try:
        df.select(df.metadataColumn("_metadata")["file_path"])
    except AnalysisException:
        return stored(df)
    return df


#: Files up to which the table of their numbers is sent to every task.
BROADCAST_FILES = 100_000


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row, unique and equal in every evaluation.

    For Parquet tables as they are read; other rows are written first. The number is that of the file and the row's place in it, so it
    does not depend on how a scan packs files into partitions, which changes with the cores of a cluster.
    """
    df = _from_files(df)
    path, file = fresh(df, "_path"), fresh(df, "_file")
    meta = df.metadataColumn("_metadata")
    paths = df.select(meta["file_path"].alias(path)).distinct()
    files = stored(paths.select(path, F.row_number().over(Window.orderBy(path)).cast("long").alias(file)))
    files = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
    placed = df.select("*", meta["file_path"].alias(path), meta["row_index"].alias(name))
    return placed.join(files, path).withColumn(name, F.col(file) * (1 << 40) + F.col(name)).select(*df.columns, name)


def ordered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of a row in a Parquet table as it was written: part, file of the part, row of the file.

    A scan takes files by size, so the order in which it returns rows is not this one.
    """
    df = _from_files(df)
    meta = df.metadataColumn("_metadata")
    part, split = (F.regexp_extract(meta["file_name"], p, 1).try_cast("long") for p in (r"^part-(\d+)", r"-c(\d+)\."))
    place = F.struct(part.alias("part"), split.alias("split"), meta["file_path"].alias("path"), meta["row_index"].alias("at"))
    return df.withColumn(name, place)


#: Hash classes that ``narrowed`` tells apart: the most rows it sends to every task.
MARKS = 1 << 18


def narrowed(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose 64-bit ``column`` falls into a hash class of ``wanted``'s; all that match, and some more.

    For a join of whole texts with few of them: the texts of other classes are dropped where they
    are read. At most ``MARKS`` numbers are broadcast, whatever the sizes.
    """
    mark = F.pmod(F.col(column), F.lit(MARKS)).cast("int")
    marks = stored(wanted.select(mark.alias("_mark")).distinct())
    return rows.withColumn("_mark", mark).join(F.broadcast(marks), "_mark", "left_semi").drop("_mark")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def before(
    rows: DataFrame, group: str, part: str, order: list[str], value: Column, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before, within ``group``.

    ``part`` cuts a group of any size into parts by hash, so no task holds a group. Parts are
    ordered by number, rows in a part by ``order``. ``rows`` is read twice: store it first.
    """
    value_name, offset = f"_{name}_value", f"_{name}_offset"
    rows = rows.withColumn(value_name, value)
    sums = rows.groupBy(group, part).agg(F.sum(value_name).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, part, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(offset))
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn(name, F.coalesce(F.sum(value_name).over(inside), F.lit(0)))
    joined = local.join(offsets, [group, part])
    return joined.withColumn(name, (F.col(name) + F.col(offset)).cast("long")).drop(value_name, offset)
