"""Process trees: parents, ancestors, descendants for all nodes at once.

Walks double their reach every round (the ancestor at distance 2k is the ancestor
at distance k of the ancestor at distance k), so a chain of a million processes
takes twenty joins on the node key, not a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.ordered import with_sum_before
from casewright.session import cut_lineage

NODE_COLUMNS = ["node", "host", "pid", "name", "parent_pid", "guid", "parent_guid", "event_id"]


def node_key(host: Column, guid: Column, pid: Column) -> Column:
    return F.when(guid.isNotNull(), F.concat(host, F.lit("|guid:"), guid)).otherwise(
        F.concat(host, F.lit("|pid:"), pid.cast("string"))
    )


def nodes(events: DataFrame) -> DataFrame:
    """One row per process event; ``node`` is host with guid, else host with pid."""
    host = F.coalesce("host", F.lit(""))
    guid = F.nullif(F.col("process.guid"), F.lit(""))
    return events.select(
        node_key(host, guid, F.col("process.pid")).alias("node"), host.alias("host"),
        F.col("process.pid").alias("pid"), F.coalesce("process.name", F.lit("")).alias("name"),
        F.col("process.parent_pid").alias("parent_pid"), guid.alias("guid"),
        F.nullif(F.col("process.parent_guid"), F.lit("")).alias("parent_guid"),
        F.trim("event_id").alias("event_id"), F.col("process").isNull().alias("no_process"),
    )


def violations(rows: DataFrame) -> DataFrame:
    """Rows that cannot be nodes: no process, no pid, or a key used twice."""
    missing = rows.filter(F.col("no_process") | F.col("pid").isNull()).select(
        "event_id", "node",
        F.when(F.col("no_process"), "missing process context").otherwise("missing valid pid").alias("error"),
    )
    repeated = (
        rows.filter(~F.col("no_process") & F.col("pid").isNotNull())
        .groupBy("node").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id"))
        .filter("n > 1").select("event_id", "node", F.lit("duplicate process node").alias("error"))
    )
    return missing.unionByName(repeated)


def with_parent(rows: DataFrame) -> DataFrame:
    """Add ``parent``: by guid on the same host, else by pid when that pid is unique there.

    ``is_orphan`` marks nodes that name a parent which does not resolve.
    """
    valid = rows.filter(~F.col("no_process") & F.col("pid").isNotNull()).select(*NODE_COLUMNS)
    by_guid = valid.filter(F.col("guid").isNotNull()).select(
        "host", F.col("guid").alias("parent_guid"), F.col("node").alias("guid_parent")
    )
    by_pid = (
        valid.groupBy("host", F.col("pid").alias("parent_pid"))
        .agg(F.min("node").alias("pid_parent"), F.count("*").alias("n")).filter("n = 1").drop("n")
    )
    joined = valid.join(by_guid, ["host", "parent_guid"], "left").join(by_pid, ["host", "parent_pid"], "left")
    parent = F.coalesce("guid_parent", "pid_parent")
    declared = F.col("parent_pid").isNotNull() | F.col("parent_guid").isNotNull()
    return joined.select(
        *NODE_COLUMNS, parent.alias("parent"), (declared & parent.isNull()).alias("is_orphan"),
    )


def roots(tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("parent").isNull())


def orphans(tree: DataFrame) -> DataFrame:
    return tree.filter("is_orphan")


def children(tree: DataFrame, node: str) -> DataFrame:
    return tree.filter(F.col("parent") == node).orderBy("pid", "event_id")


def find(tree: DataFrame, host: str, pid: int | None = None, guid: str | None = None) -> DataFrame:
    """Node by host and guid, or by host and pid (the first key)."""
    at_host = tree.filter(F.col("host") == host)
    if guid is not None:
        return at_host.filter(F.col("guid") == guid)
    return at_host.filter(F.col("pid") == pid).orderBy("node").limit(1)


class CycleError(ValueError):
    """A process is its own ancestor."""


def depths(tree: DataFrame) -> DataFrame:
    """(node, root, depth, descendants) for every node.

    Round k knows the ancestor at distance 2^k and how many nodes lie fewer than
    2^k steps below. A node still climbing after log2(nodes) rounds is on a cycle.
    """
    state = cut_lineage(
        tree.select(
            "node", F.col("parent").alias("up"), F.coalesce("parent", "node").alias("root"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
            F.lit(1).cast("long").alias("below"),
        )
    )
    total = state.count()
    rounds = 0
    while True:
        climbing = state.filter(F.col("up").isNotNull())
        if climbing.isEmpty():
            break
        if (1 << rounds) > total:
            node = climbing.agg(F.min("node")).first()[0]
            raise CycleError(f"cycle detected in process tree at {node!r}")
        above = state.select(
            F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"),
            F.col("depth").alias("depth2"),
        )
        gained = climbing.groupBy(F.col("up").alias("node")).agg(F.sum("below").alias("more"))
        joined = state.join(above, "up", "left").join(gained, "node", "left")
        state = cut_lineage(
            joined.select(
                "node", F.col("up2").alias("up"),
                F.when(F.col("up").isNull(), F.col("root")).otherwise(F.col("root2")).alias("root"),
                (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
                (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"),
            )
        )
        rounds += 1
    return state.select("node", "root", "depth", (F.col("below") - 1).alias("descendants"))


def intervals(tree: DataFrame) -> DataFrame:
    """(node, root, depth, descendants, enter, leave) of every node.

    ``enter`` counts the nodes of a tree from 0 as a walk meets them, children by (pid, node); ``leave`` is the number of the
    last node below. So a node is below another of the same root when its number lies in the other's range: lineages and
    subtrees are filters, and no table of pairs is made.

    A node's number is that of its parent, one, and the sizes of the siblings before it; numbers add up along the way to the root by
    doubling, a round for each power of two of the deepest tree.
    """
    sizes = cut_lineage(depths(tree).join(tree.select("node", "parent", "pid"), "node"))
    below = sizes.filter(F.col("parent").isNotNull()).withColumn("_size", F.col("descendants") + 1)
    placed = with_sum_before(below, ["parent"], ["pid", "node"], "_size", "_before")
    state = cut_lineage(placed.select("node", F.col("parent").alias("up"), (F.col("_before") + 1).alias("enter")))
    moving, done = state, None
    while True:
        # who has no way further up has its number; the others add that of the ancestor they have come to
        further = moving.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("enter").alias("enter2"))
        if done is not None:
            further = further.unionByName(done.select(F.col("node").alias("up"), F.lit(None).cast("string").alias("up2"), F.col("enter").alias("enter2")))
        joined = moving.join(further, "up", "left")
        stepped = cut_lineage(joined.select("node", F.col("up2").alias("up"), (F.col("enter") + F.coalesce("enter2", F.lit(0))).alias("enter")))
        ended = stepped.filter(F.col("up").isNull())
        done = ended if done is None else done.unionByName(ended)
        moving = stepped.filter(F.col("up").isNotNull())
        if moving.isEmpty():
            break
    numbered = sizes.join(done.select("node", "enter"), "node", "left")
    enter = F.coalesce("enter", F.lit(0).cast("long"))
    return numbered.select("node", "root", "depth", "descendants", enter.alias("enter"), (enter + F.col("descendants")).alias("leave"))


def _range(labels: DataFrame, node: str) -> DataFrame:
    names = {c: f"_{c}" for c in ("root", "depth", "enter", "leave")}
    return F.broadcast(labels.filter(F.col("node") == node).select(*[F.col(c).alias(n) for c, n in names.items()]))  # one row


def inside(labels: DataFrame, node: str) -> DataFrame:
    """Rows of ``intervals`` below a node."""
    met = (F.col("root") == F.col("_root")) & (F.col("enter") > F.col("_enter")) & (F.col("enter") <= F.col("_leave"))
    return labels.join(_range(labels, node), met).select(*labels.columns)


def around(labels: DataFrame, node: str) -> DataFrame:
    """Rows of ``intervals`` above a node, and its own, with ``distance``: their ranges hold its number."""
    met = (F.col("root") == F.col("_root")) & F.col("_enter").between(F.col("enter"), F.col("leave"))
    return labels.join(_range(labels, node), met).select(*labels.columns, (F.col("_depth") - F.col("depth")).alias("distance"))


def ancestors(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, distance): the way from each node (of ``of``) to its root.

    The node itself has distance 0. The table has one row per step of every way,
    so pass ``of`` when only some lineages are wanted.
    """
    jump = cut_lineage(tree.filter(F.col("parent").isNotNull()).select("node", F.col("parent").alias("up")))
    wanted = tree.select("node") if of is None else of.select("node").distinct()
    known = cut_lineage(wanted.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance")))
    rounds, total = 0, tree.count()
    while True:
        step = 1 << rounds
        if jump.isEmpty():
            break
        if step > total:
            raise CycleError("cycle detected in process tree")
        further = known.join(jump.withColumnRenamed("node", "ancestor"), "ancestor").select(
            "node", F.col("up").alias("ancestor"), (F.col("distance") + step).alias("distance")
        )
        known = cut_lineage(known.unionByName(further))
        jump = cut_lineage(
            jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up")
            .select("node", F.col("up2").alias("up"))
        )
        rounds += 1
    return known


def lineage(tree: DataFrame, node: str) -> DataFrame:
    """Root to node, as (position, node)."""
    way = ancestors(tree, tree.sparkSession.createDataFrame([(node,)], "node string"))
    length = way.groupBy("node").agg(F.max("distance").alias("top"))
    return way.join(length, "node").select(
        (F.col("top") - F.col("distance")).alias("position"), F.col("ancestor").alias("node")
    ).orderBy("position")


def descendants(tree: DataFrame, node: str) -> DataFrame:
    """Everything below one node, by (pid, event_id).

    Every node knows whether the wanted one is among its 2^k nearest ancestors, and k grows by
    one a round, so a chain of a million takes twenty rounds. A node that still climbs after
    log2(nodes) rounds is on a cycle or below one, which is an error.
    """
    state = cut_lineage(
        tree.filter(F.col("parent").isNotNull()).select(
            "node", F.col("parent").alias("up"), (F.col("parent") == node).alias("below")
        )
    )
    rounds, total = 0, tree.count()
    while True:
        climbing = state.filter(F.col("up").isNotNull() & ~F.col("below"))
        if climbing.isEmpty():
            break
        if (1 << rounds) > total:
            raise CycleError(f"cycle detected in process tree at {climbing.agg(F.min('node')).first()[0]!r}")
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("below").alias("below2"))
        joined = climbing.join(above, "up", "left").select(
            "node", F.col("up2").alias("up"), F.coalesce("below2", F.lit(False)).alias("below")
        )
        state = cut_lineage(state.filter(F.col("up").isNull() | F.col("below")).unionByName(joined))
        rounds += 1
    inside = state.filter(F.col("below") & (F.col("node") != node)).select("node")
    return tree.join(inside, "node").orderBy("pid", "event_id")
