"""A Merkle manifest of a table, with a version of the tree for every changed leaf.

Rows are leaves, hashed together two by two, a tree for each group and one over the groups' roots. A tree of
any size is cut into aligned blocks of ``2 ** LEVELS`` nodes; a block is a whole subtree, so a task builds it
alone, and the blocks' roots are the nodes of the next stage of the tree. The tree is persistent: a changed leaf
makes a new version that shares every node but the leaf's ancestors, which are copied. A block is handed the siblings
above it, so the task that copies the ancestors inside it also continues its versions up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.ordered import with_row_index
from casewright.llm.common import stored

#: Levels of a block.
LEVELS = 10
#: Sides on which a sibling stands in a proof; a node without one has none.
LEFT, RIGHT, ALONE = "L", "R", "-"

#: What a block hands up: its root at its own height and at the height of a full block.
_RISEN = "group string, position long, own string, full string"
_PLACE = ["group", "block"]


def value(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value (integers as decimals)."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a row: lower-case hex SHA-256 of its values in this order."""
    return F.sha2(F.concat(*[value(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def height(nodes: int) -> int:
    return max(nodes - 1, 0).bit_length()


class Block:
    """The nodes of an aligned block, level by level; its base version."""

    def __init__(self, nodes: list[str], levels: int):
        self.levels = [nodes]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([_hash("".join(below[i : i + 2])) for i in range(0, len(below), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[str]:
        """The sibling on every level from a node to the block's root: side and digest."""
        steps = []
        for nodes in self.levels[:-1]:
            other = at ^ 1
            steps.append(ALONE if other >= len(nodes) else (LEFT if other < at else RIGHT) + nodes[other])
            at >>= 1
        return steps


def copied(digest: str, path: list[str]) -> Iterator[str]:
    """The ancestors that a version with another digest at the foot of ``path`` has of its own."""
    for step in path:
        side, other = step[:1], step[1:]
        digest = _hash(digest + other if side == RIGHT else other + digest)
        yield digest


def _rise(levels: int):
    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("position")
        tree = Block(nodes["node"].to_pylist(), levels)
        own = tree.levels[height(len(nodes))][0]
        return pa.table({"group": [key[0].as_py()], "position": [key[1].as_py()], "own": [own], "full": [tree.root]})

    return run


def _inside(nodes: pa.Table, parent: pa.Table, levels: int) -> tuple[list[str], list[list[str]], str, str]:
    """(digests, whole paths, subroot, root) of a block's nodes in order, below their parent."""
    digests = nodes["node"].to_pylist()
    tree = Block(digests, height(len(digests)) if parent["single"][0].as_py() else levels)
    above = parent["path"][0].as_py()
    return digests, [tree.path(i) + above for i in range(len(digests))], parent["subroot"][0].as_py(), parent["root"][0].as_py()


def _fall(levels: int):
    def run(nodes: pa.Table, parent: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("position")
        digests, paths, subroot, root = _inside(nodes, parent, levels)
        return pa.table(
            {
                "group": nodes["group"], "position": nodes["position"], "single": nodes["single"], "path": pa.array(paths, pa.list_(pa.string())),
                "subroot": pa.array([subroot] * len(digests), pa.string()), "root": pa.array([root] * len(digests), pa.string()),
            }
        )

    return run


def _prove(levels: int):
    def run(nodes: pa.Table, parent: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("position")
        digests, paths, subroot, root = _inside(nodes, parent, levels)
        own, folded = [], []
        for digest, changed, path in zip(digests, nodes["changed"].to_pylist(), paths, strict=True):
            version = list(copied(changed or digest, path))
            folded.append(version[-1] if version else changed or digest)
            own.append(version if changed else None)
        return pa.table(
            {
                "doc_id": nodes["doc_id"], "leaf": nodes["node"], "changed": nodes["changed"],
                "subroot": pa.array([subroot] * len(digests), pa.string()), "root": pa.array([root] * len(digests), pa.string()),
                "proof": pa.array(paths, pa.list_(pa.string())), "copied": pa.array(own, pa.list_(pa.string())), "folded_root": pa.array(folded, pa.string()),
            }
        )

    return run


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("position", levels))


def _stages(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` (group, position, node) and the stages of the trees above, to one node of each group.

    ``single`` tells whether a node is the only one of its group in its stage, so that the block below it is no higher than it must be.
    """
    stages = [nodes]
    while True:
        blocks = _blocks(stages[-1].select("group", "position", "node"), levels).groupBy(*_PLACE)
        risen = stored(blocks.applyInArrow(_rise(levels), _RISEN))
        several = risen.filter("position = 1").select("group", F.lit(False).alias("single"))
        above = risen.join(several, "group", "left").withColumn("single", F.coalesce("single", F.lit(True)))
        stages.append(above.select("group", "position", F.when(F.col("single"), F.col("own")).otherwise(F.col("full")).alias("node"), "single"))
        if several.isEmpty():
            return stages


def _fallen(nodes: DataFrame, parents: DataFrame, levels: int) -> DataFrame:
    below = _blocks(nodes, levels).groupBy(*_PLACE)
    above = parents.withColumnRenamed("position", "block").groupBy(*_PLACE)
    schema = "group string, position long, single boolean, path array<string>, subroot string, root string"
    return stored(below.cogroup(above).applyInArrow(_fall(levels), schema))


def prove(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs of all leaves and versions of all changes.

    ``rows``: lang, doc_id, leaf, and ``changed``, the leaf's other digest or null. Returned for each row: doc_id, leaf,
    changed, subroot, root, ``proof`` (for every level up to the root the sibling's side and digest, or ``-`` for a node without one),
    ``copied`` (of a changed leaf the ancestors of its version, the last one its root; null for others) and ``folded_root``,
    made from ``changed`` if there is one, else from the leaf, and the siblings.

    Leaves of a lang ascend by doc_id, null first, and by digest where ids are equal; langs ascend bytewise, null
    first. A lang with one leaf has it as its subroot, and a single subroot is the root. An empty table gives an
    empty result.
    """
    # a null lang sorts before all others, the empty one included
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    leaves = rows.select(group.alias("group"), "doc_id", F.col("leaf").alias("node"), "changed")
    leaves = stored(with_row_index(leaves, ["group"], ["doc_id", "node"], "position"))
    stages = _stages(leaves, levels)
    subroots = stages[-1].select(F.lit("").alias("group"), F.col("group").alias("lang"), "node", "single")
    langs = stored(with_row_index(subroots, ["group"], ["lang"], "position"))
    top = _stages(langs, levels)
    nothing = F.array().cast("array<string>")
    falling = top[-1].select("group", "position", "single", nothing.alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    for stage in reversed(top[:-1]):
        falling = _fallen(stage.select("group", "position", "node", "single"), falling, levels)
    placed = langs.select("position", F.col("lang").alias("group"), F.col("node").alias("subroot"))
    falling = placed.join(falling.drop("group", "subroot"), "position").withColumn("position", F.lit(0).cast("long"))
    for stage in reversed(stages[1:-1]):
        falling = _fallen(stage.select("group", "position", "node", "single"), falling, levels)
    below = _blocks(leaves, levels).groupBy(*_PLACE)
    above = falling.withColumnRenamed("position", "block").groupBy(*_PLACE)
    schema = (
        "doc_id long, leaf string, changed string, subroot string, root string, proof array<string>, copied array<string>, folded_root string"
    )
    return below.cogroup(above).applyInArrow(_prove(levels), schema)


def proofs(df: DataFrame, tampered: Column, n_chars: Column, levels: int = LEVELS) -> DataFrame:
    """``prove`` for documents; a row where ``tampered`` holds is changed to have another ``n_chars``.

    A row that is the same afterwards (a null n_chars that stays null) counts as changed and proves right. Other columns are not read.
    """
    whole, other = ([F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), n, F.col("text")] for n in (F.col("n_chars"), n_chars))
    changed = F.when(tampered, leaf(*other))
    return prove(df.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf(*whole).alias("leaf"), changed.alias("changed")), levels)


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of the digests of a proof, from the leaf to the root; of nothing for a proof without siblings."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda step: F.substring(step, 2, 64))), 256)
