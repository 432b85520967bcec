"""Stored tables: cases, children and the graph as Parquet, replaced by key.

Rows are spread over a fixed number of buckets by the hash of their key; writing
replaces only the buckets that changed. A write goes to a new folder first and the
old one is replaced after it is complete, so a lost executor or a failed job leaves
the old rows in place.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.operators import graph
from casewright.session import cut_lineage

BUCKETS = 256
BUCKET = "bucket"


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class Store:
    """Tables under one root folder, each bucketed by its key."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_schemas/{table}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, table: str) -> DataFrame:
        """The table with its stored schema, so an empty one reads too."""
        schema = self.spark.read.text(f"{self.root}/_schemas/{table}").first()[0]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(self.path(table))

    def load(self, table: str) -> DataFrame:
        return self._read(table).drop(BUCKET)

    def _touched(self, table: str, key: str, rows: DataFrame) -> DataFrame:
        """Stored rows in the buckets that ``rows`` fall into; the other folders are not read."""
        hit = rows.select(bucket(key, self.buckets).alias(BUCKET)).distinct().collect()  # at most BUCKETS numbers
        return self._read(table).filter(F.col(BUCKET).isin(sorted(r[0] for r in hit)))

    def _write(self, table: str, key: str, rows: DataFrame) -> None:
        """Replace the buckets present in ``rows``; they are read back from a finished copy."""
        placed = cut_lineage(rows.withColumn(BUCKET, bucket(key, self.buckets)))
        # rebalance: few files for small buckets, and a bucket one case fills is split
        (
            placed.hint("rebalance", BUCKET).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path(table))
        )
        if not self.exists(table):
            text = self.spark.createDataFrame([(placed.schema.json(),)], "value string")
            text.coalesce(1).write.mode("overwrite").text(f"{self.root}/_schemas/{table}")

    def upsert(self, table: str, key: str, rows: DataFrame) -> None:
        """Insert rows, or replace all stored rows with the same key.

        With child rows keyed by their parent this also removes children that are gone.
        """
        if not self.exists(table):
            self._write(table, key, rows)
            return
        rows = cut_lineage(rows)
        kept = self._touched(table, key, rows).join(rows.select(key).distinct(), key, "left_anti")
        self._write(table, key, kept.drop(BUCKET).select(*rows.columns).unionByName(rows))

    def delete(self, table: str, key: str, keys: DataFrame) -> None:
        """Remove all rows with one of the keys."""
        keys = cut_lineage(keys.select(key).distinct())
        touched = self._touched(table, key, keys)
        kept = cut_lineage(touched.join(keys, key, "left_anti").select(*touched.columns))
        emptied = (
            keys.select(bucket(key, self.buckets).alias(BUCKET)).distinct()
            .join(kept.select(BUCKET).distinct(), BUCKET, "left_anti")
        )
        if not kept.isEmpty():
            self._write(table, key, kept.drop(BUCKET))
        for row in emptied.collect():  # at most BUCKETS rows
            self._drop_bucket(table, row[0])

    def _drop_bucket(self, table: str, number: int) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/{BUCKET}={number}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# -- cases --------------------------------------------------------------------------------------

CASE_TABLES = ("cases", "evidence", "hypotheses", "hypothesis_support", "correlations", "risk_factors", "case_links")


def save_cases(store: Store, tables: dict[str, DataFrame]) -> None:
    """Store an investigation; a second run of the same cases replaces the first."""
    for name in CASE_TABLES:
        if name in tables:
            store.upsert(name, "case_id", tables[name])
    save_graph(store, tables)


def load_cases(store: Store) -> dict[str, DataFrame]:
    return {name: store.load(name) for name in CASE_TABLES if store.exists(name)}


def delete_cases(store: Store, case_ids: DataFrame) -> None:
    """Remove cases, their children, and entities and edges that belong to no other case.

    The tables that say what belongs to whom go last, so a repeat after a failure finds the rest.
    """
    case_ids = cut_lineage(case_ids.select("case_id").distinct())

    def lonely(bridge: str, key: str) -> DataFrame:
        rows = store.load(bridge)
        mine = rows.join(case_ids, "case_id", "left_semi").select(key).distinct()
        shared = rows.join(case_ids, "case_id", "left_anti").select(key).distinct()
        return cut_lineage(mine.join(shared, key, "left_anti"))

    if store.exists("case_relationships"):
        store.delete("relationships", "fingerprint", lonely("case_relationships", "fingerprint"))
    if store.exists("case_entities"):
        _delete_entities(store, lonely("case_entities", "entity_id"))
    for name in (*CASE_TABLES, "case_relationships", "case_entities"):
        if store.exists(name):
            store.delete(name, "case_id", case_ids)


def snapshot(cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Case rows with their content as one JSON text."""
    return cases.select("case_id", F.to_json(F.struct(*columns)).alias("snapshot"))


def load_snapshot(rows: DataFrame, schema) -> DataFrame:
    return rows.select("case_id", F.from_json("snapshot", schema).alias("s")).select("case_id", "s.*")


# -- graph ---------------------------------------------------------------------------------------


def save_graph(store: Store, tables: dict[str, DataFrame]) -> None:
    """Merge case graphs into the stored graph; edges are keyed by identity, so a re-run adds none.

    Counts and times come from the provenance per case, which is replaced as a whole.
    """
    bridge = tables["entities"].select("case_id", "entity_id", "mention_count", "first_seen", "last_seen").distinct()
    store.upsert("case_entities", "case_id", bridge)
    edge_bridge = tables["relationships"].select(
        "case_id", "fingerprint", "event_count", "weight", "confidence", "first_seen", "last_seen"
    )
    store.upsert("case_relationships", "case_id", edge_bridge)
    same = ["entity_id", "fingerprint", "tenant_id", "entity_type", "normalized_value", "host", "identity_scope", "identity_domain", "hash_algorithm"]
    nodes = tables["entities"].groupBy("entity_id").agg(
        *[F.first(c).alias(c) for c in same if c != "entity_id"],
        F.min_by("value", F.struct("first_seen", "value")).alias("value"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    _merge(store, "entities", "entity_id", _with_properties(nodes, tables["entities"]), _merge_nodes)
    ends = ["tenant_id", "source_type", "source_id", "relationship_type", "target_type", "target_id"]
    edges = tables["relationships"].groupBy("fingerprint").agg(
        *[F.first(c).alias(c) for c in ends],
        F.max("weight").alias("weight"), F.max("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    _merge(store, "relationships", "fingerprint", edges, _merge_edges)


def _merge(store: Store, table: str, key: str, fresh: DataFrame, fold) -> None:
    fresh = cut_lineage(fresh)
    if not store.exists(table):
        store._write(table, key, fresh)
        return
    stored = store._touched(table, key, fresh).drop(BUCKET)
    store._write(table, key, fold(stored.select(*fresh.columns).unionByName(fresh)).select(*fresh.columns))


def _with_properties(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Properties merged key by key; of two values that of the entity seen last counts."""
    return nodes.join(graph.merged_column(rows, ["entity_id"], "properties", ["last_seen", "value"]), "entity_id", "left")


def _merge_nodes(rows: DataFrame) -> DataFrame:
    same = [c for c in rows.columns if c not in ("entity_id", "value", "properties", "first_seen", "last_seen")]
    nodes = rows.groupBy("entity_id").agg(
        *[F.first(c).alias(c) for c in same],
        F.min_by("value", F.struct("first_seen", "value")).alias("value"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    return _with_properties(nodes, rows)


def _merge_edges(rows: DataFrame) -> DataFrame:
    same = [c for c in rows.columns if c not in ("fingerprint", "weight", "confidence", "first_seen", "last_seen")]
    return rows.groupBy("fingerprint").agg(
        *[F.first(c).alias(c) for c in same],
        F.max("weight").alias("weight"), F.max("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def _delete_entities(store: Store, ids: DataFrame) -> None:
    if store.exists("relationships"):
        edges = store.load("relationships")
        gone = edges.join(ids.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi").select("fingerprint").unionByName(
            edges.join(ids.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi").select("fingerprint")
        )
        store.delete("relationships", "fingerprint", gone)
    store.delete("entities", "entity_id", ids)


def delete_tenant(store: Store, tenant_id: str) -> None:
    """Remove a tenant's graph."""
    entities = store.load("entities").filter(F.col("tenant_id") == tenant_id)
    _delete_entities(store, entities.select("entity_id"))


def stored_stats(store: Store, tenant_id: str | None = None) -> DataFrame:
    return graph.stats(store.load("entities"), store.load("relationships"), tenant_id)
