"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import checkpointed


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge; the component is its smallest node.

    edges: columns u and v, of one integer type, in any direction and repeated at
    will; ends that are null are left out. Large and small stars take turns until
    every edge joins a node to the least node of its component, which takes a
    number of rounds that is logarithmic in the length of the longest chain. Each
    round is written to the checkpoint folder. A hub is never gathered: its least
    neighbour is an aggregate, joined back on the side of the edges.
    """
    current = checkpointed(_directed(edges.where("u is not null and v is not null")))
    state = None
    while True:
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        new = current.agg(F.count(F.lit(1)), digest).first()
        if new == state or not new[0]:
            break
        state = new
        current = checkpointed(_directed(_small_star(_directed(_large_star(current)))))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select("v", "v").distinct()
    )
