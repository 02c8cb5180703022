"""Merkle manifest of a dataset, with a proof for every row (operator 12).

Each row is hashed to a leaf. The leaves of a group, in the order of their ids, are
the lowest level of the group's tree; a level's nodes are hashed in runs of `fanout`
until one is left. The nodes that are left, in the order of the groups, make one
more tree in the same way, whose last node is the root of the dataset.

A level is pivoted by slot: conditional aggregates spread the children of a parent
into `fanout` columns. All columns concatenated are what the parent hashes; the
columns but a child's own are its siblings. So a level is one grouped aggregate going
up, and one join with the paths of its parents going down, and rows never meet
except three by three, however many a group has.

Only DataFrame functions are used; the places of leaves come from a sort by ranges
that is written once, counted by task and group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlog.operators.groups import collapse_copies, join_back, unfold_copies

from .scratch import written

FANOUT = 3
#: A step of a proof: the digests before and after the own one in its run.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of texts one after another, as lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value of a leaf: its UTF-8 bytes after their number, or a dash for null."""
    text = value.cast("string")
    counted = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(counted, F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """The digest of a row by the given columns, in their order."""
    return digest(*[field(column) for column in columns])


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with `place`, counted from 0 within their group, and the group's `size`.

    The rows are sorted by ranges of group and order over all tasks, so a group of any
    size is spread, and written with their task and number. Of each group in each task
    one row goes into a running sum; a group has no more of these than there are tasks.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.select("*", F.spark_partition_id().alias("part"), at.alias("at")), name)
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    runs = runs.select(group, "part", offset.alias("offset"), F.sum("n").over(whole).alias("size"))
    found = join_back(placed, runs, [group, "part"])
    place = (F.col("at") + F.col("offset")).alias("place")
    return found.select(*rows.columns, place, "size")


@dataclass(frozen=True)
class Forest:
    """Trees over the rows of a table.

    runs[k] has a row for each run of nodes of level k: (tree, parent, size, s0, s1, ...),
    where a slot is a struct of the node's hash and, at level 0, its payload.
    tops are (tree, height, hash): the last node of each tree and its level.
    """

    runs: list[DataFrame]
    tops: DataFrame
    fanout: int


def _heights(size: int, fanout: int) -> int:
    count = 0
    while size > 1:
        size, count = -(-size // fanout), count + 1
    return count


def forest(nodes: DataFrame, fanout: int = FANOUT, name: str = "merkle") -> Forest:
    """Trees over nodes (tree, place, size, hash, payload...), each level written.

    A tree of one node has no run: the node is its top.
    """
    payload = [c for c in nodes.columns if c not in ("tree", "place", "size")]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    top = ["tree", F.lit(0).alias("height"), "hash"]
    tops = nodes.where("size = 1").select(*top)
    runs = []
    for height in range(1, _heights(largest, fanout) + 1):
        slot, parent = F.col("place") % fanout, F.floor(F.col("place") / fanout)
        slots = [
            F.max(F.when(slot == k, F.struct(*payload))).alias(f"s{k}") for k in range(fanout)
        ]
        level = nodes.where("size > 1").groupBy("tree", parent.alias("parent"))
        runs.append(written(level.agg(F.max("size").alias("size"), *slots), f"{name}-{height}"))
        children = [F.coalesce(f"s{k}.hash", F.lit("")) for k in range(fanout)]
        nodes = runs[-1].select(
            "tree",
            F.col("parent").alias("place"),
            F.ceil(F.col("size") / fanout).alias("size"),
            digest(*children).alias("hash"),
        )
        payload = ["hash"]
        top = ["tree", F.lit(height).alias("height"), "hash"]
        tops = tops.union(nodes.where("size = 1").select(*top))
    return Forest(runs, tops, fanout)


def _children(runs: DataFrame, fanout: int) -> DataFrame:
    """The nodes of written runs with their place, and the step of their proof."""
    slots = [F.col(f"s{k}") for k in range(fanout)]
    hashes = [F.coalesce(slot["hash"], F.lit("")) for slot in slots]
    nodes = [
        F.when(
            slot.isNotNull(),
            F.struct(
                (F.col("parent") * fanout + k).alias("place"),
                F.concat(F.lit(""), *hashes[:k]).alias("left"),
                F.concat(F.lit(""), *hashes[k + 1 :]).alias("right"),
                slot.alias("node"),
            ),
        )
        for k, slot in enumerate(slots)
    ]
    kept = [c for c in runs.columns if c not in ("parent", "size") and c not in _slots(fanout)]
    found = runs.select(*kept, F.explode(F.array_compact(F.array(*nodes))).alias("child"))
    step = F.array(F.struct("child.left", "child.right"))
    return found.select(
        *[c for c in kept if c != "path"],
        "child.place",
        F.concat(step, "path").alias("path"),
        "child.node.*",
    )


def _slots(fanout: int) -> list[str]:
    return [f"s{k}" for k in range(fanout)]


def paths(trees: Forest, tops: DataFrame) -> DataFrame:
    """The nodes of level 0 that are in a run, with what their tree's top has and their path.

    tops: (tree, height, path, others...): the steps from the top of each tree on
    and what else all its nodes get.
    """
    others = [c for c in tops.columns if c not in ("tree", "height", "path")]
    known = ["tree", "place", "path", *others]
    place = F.lit(0).cast("bigint").alias("place")
    nodes = None
    for height in range(len(trees.runs), 0, -1):
        own = tops.where(F.col("height") == height).select("tree", place, "path", *others)
        parents = own if nodes is None else own.union(nodes.select(*known))
        parents = parents.withColumnRenamed("place", "parent")
        nodes = _children(trees.runs[height - 1].join(parents, ["tree", "parent"]), trees.fanout)
    return nodes


def manifest(
    docs: DataFrame,
    columns: list[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    altered: Column | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """(id, leaf, altered, subroot, root, path), a row for each row of `docs`.

    leaf is the digest of `columns`; path the siblings from the leaf's run to the root,
    each step with those on the left and those on the right; subroot the top of the
    group's tree. altered is the given column, computed on `docs`, carried along.

    Groups are ordered bytewise, null first; leaves by id, null first, and equal ids by
    leaf. Equal rows are leaves of their own, each with its own path. Other columns of
    `docs` play no part. An empty table has no rows and no root.
    """
    other = F.lit(None).cast("string") if altered is None else altered
    rows = docs.select(
        F.col(group_col).alias("source"),
        F.col(id_col).alias("id"),
        leaf([F.col(c) for c in columns]).alias("hash"),
        other.alias("altered"),
    )
    # Equal rows are told apart by a number, so that very many of them are sorted by
    # ranges too.
    counted = collapse_copies(rows)
    names = rows.columns
    once = counted.where("copies = 1").select(*names, F.lit(0).cast("bigint").alias("copy_no"))
    more = unfold_copies(counted.where("copies > 1")).select(*names, "copy_no")
    leaves = ranked(once.union(more), "source", ["id", "hash", "copy_no"], "merkle-leaves")
    sources = leaves.select("source").distinct().withColumn("all", F.lit(0))
    sources = ranked(sources, "all", ["source"], "merkle-groups")
    tree = sources.select("source", F.col("place").alias("tree"))
    leaves = join_back(leaves, tree, ["source"])
    leaves = leaves.select("tree", "place", "size", "hash", "id", "altered")
    leaves = written(leaves, "merkle-nodes")
    trees = forest(leaves, fanout)
    size = sources.select(F.col("place").alias("tree"), "size")
    upper = trees.tops.join(size, "tree").select(
        F.lit(0).cast("bigint").alias("tree"),
        F.col("tree").alias("place"),
        "size",
        "hash",
        "height",
    )
    # Written, as every level of the way down takes some of these few rows.
    upper = written(upper, "merkle-tops")
    above = forest(upper, fanout, "merkle-top")
    no_steps = F.array().cast(PATH)
    root = above.tops.select("tree", "height", no_steps.alias("path"), F.col("hash").alias("root"))
    lone = upper.where("size = 1").select(
        F.col("place").alias("tree"),
        "height",
        no_steps.alias("path"),
        F.col("hash").alias("subroot"),
        F.col("hash").alias("root"),
    )
    found = lone
    if above.runs:
        found = found.union(
            paths(above, root).select(
                F.col("place").alias("tree"), "height", "path", F.col("hash").alias("subroot"), "root"
            )
        )
    found = written(found, "merkle-subroots")
    result = ["id", F.col("hash").alias("leaf"), "altered", "subroot", "root", "path"]
    alone = leaves.where("size = 1").join(found, "tree").select(*result)
    return alone.union(paths(trees, found).select(*result)) if trees.runs else alone


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf's to those below the root."""
    steps = F.transform(path, lambda x: F.concat(x["left"], x["right"]))
    return F.sha2(F.array_join(steps, ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, start, lambda node, x: digest(x["left"], node, x["right"]))
