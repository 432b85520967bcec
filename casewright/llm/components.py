"""Connected components of links that need not fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import stored


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root being the smallest node it reaches.

    Every round hooks each root to its smallest neighbour, flattens the hooks by doubling, and
    contracts the links, so the links left fall at least by half in a round. Hooks point to
    smaller nodes only, so they hold no cycle. No links give no rows. Steps are written as tables
    in the shared folder: a checkpointed plan would carry its constraints from round to round.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = stored(ends.select("node", F.col("node").alias("root")))
    rest = stored(_ordered(links))
    while not rest.isEmpty():
        hooks = stored(rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(hooks.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").alias("moved")))
            hooks = jumped.select("node", "up")
            if jumped.filter("moved is not null").isEmpty():
                break
        labels = stored(follow(labels, hooks, "root"))
        rest = stored(_ordered(follow(follow(rest, hooks, "a"), hooks, "b")))
    return labels


def follow(rows: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by where ``hooks`` (node, up) lead from it."""
    renamed = hooks.select(F.col("node").alias(column), F.col("up").alias("_up"))
    return rows.join(renamed, column, "left").withColumn(column, F.coalesce("_up", column)).select(*rows.columns)


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of components after more links are added; only the new links are searched."""
    up = labels.select("node", F.col("root").alias("up"))
    merged = components(follow(follow(links.select("a", "b"), up, "a"), up, "b"))
    hooks = merged.select("node", F.col("root").alias("up"))
    new = merged.join(labels, "node", "left_anti")
    return stored(follow(labels, hooks, "root").unionByName(new.select("node", "root")))
