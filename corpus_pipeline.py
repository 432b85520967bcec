"""A training corpus from raw documents: five stages, each over all that the one before kept.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a
benchmark passage go, sources are mixed to their target weights, and what is left is written
as token ids in the order of training.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import decontam, mixing, neardup, toxicity, wavelet
from casewright.llm.common import fresh, numbered, ordered, read, shared_folder, stored
from casewright.llm.queries import vocabulary


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; null and empty texts stay."""
    column = fresh(docs, "score")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")), column)
    return scored.filter(F.col(column) < toxicity.THRESHOLD).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (5-word shingles, similarity 0.8) the document with the smallest doc_id.

    Of rows with that id, the first stays. Null and blank texts are in no group and stay.
    """
    row = fresh(docs, "row_number")
    rows = numbered(docs, row)
    grouped = neardup.groups(rows, size=5, percent=80, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    ranked = rows.select(row, F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("_rank")).join(grouped, row)
    first = ranked.groupBy("component_id").agg(F.min("_rank").alias("_first")).select(F.col(f"_first.{row}").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    row = fresh(docs, "row_number")
    rows = numbered(docs, row)
    found = decontam.find(rows.select(F.col(row).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every pass of the mix over half of it or more, in training order.

    Documents without a word (null, empty, blank) have no pass, so they go here.
    """
    row, position = fresh(docs, "row_number"), fresh(docs, "_position")
    rows = numbered(docs, row)
    mixed = mixing.mix(rows.select(F.col(row).alias("doc_id"), "source", "text"))
    whole = F.filter("passes", lambda p: 2 * p["taken"] >= F.col("size"))
    times = mixed.select(F.col("doc_id").alias(row), F.explode(whole).alias("_pass")).select(row, F.col("_pass.position").alias(position))
    taken = rows.join(times, row)
    return taken.repartitionByRange(position, row).sortWithinPartitions(position, row).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet shards in the order in which ``docs`` was written; every document as it is read back from them."""
    row = fresh(docs, "row_number")
    path = shared_folder(spark)
    wavelet.write(ordered(docs, row), path, vocabulary(), order=row)
    return wavelet.documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Learned scores and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
