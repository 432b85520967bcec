"""Registered queries of the operators in this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import declist, decontam, hardneg, language, merkle, mixing, neardup, pii, secretscan, sharding, toxicity, wavelet, weaklabel
from casewright.llm.common import read, shared_folder
from casewright.llm.oracle import SQL as SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _equals(value: int):
    return lambda x: x == value


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.KINDS))
    ranks = F.transform("spans", lambda s: s["rank"])
    counts = [F.size(F.filter(ranks, _equals(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.spelled(base), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


@query
def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    wavelet.write(read(spark, sf_dir, "documents"), path, vocabulary())
    return wavelet.documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op5_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return language.identify(documents, language.train(documents))


@query
def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabel.scores(read(spark, sf_dir, "documents"))


@query
def op7_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read(spark, sf_dir, "documents"), size=4, percent=80)


@query
def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = declist.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query
def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["taken"])
    rows = mixed.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), F.get("passes", F.lit(0))["position"].alias("position"),
    )
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


@query
def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _every_seventh(doc_id) -> Column:
    return F.col(doc_id).isNotNull() & (F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 7 == 0)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.proofs(read(spark, sf_dir, "documents"), _every_seventh("doc_id"), F.col("n_chars") + 1)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(hardneg.rows_of(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


@query
def op12_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(read(spark, sf_dir, "documents"))
    ranks = F.transform("spans", lambda s: s["rank"])
    counts = [F.size(F.filter(ranks, _equals(k))).cast("long").alias(f"n_{rule.kind}") for k, rule in enumerate(secretscan.BASE)]
    base = F.filter("spans", lambda s: s["rank"] < len(secretscan.BASE))
    return found.select(
        "doc_id", *counts, F.sha2(secretscan.spelled(base), 256).alias("base_sha256"), secretscan.spelled(F.col("spans")).alias("spans")
    )
