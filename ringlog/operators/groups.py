"""Group statistics put back on rows, without gathering a group in one task.

A window over a key sorts the whole group of that key in one task. Here the
group is aggregated first, with partial sums on the map side, and the small
result is joined back. The joins are left joins from the rows, so adaptive
execution may broadcast the statistics where their measured size allows, and
otherwise splits the row side of a hot key over several tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Copies written by one task when a collapsed row is unfolded again.
COPIES_PER_TASK_ROW = 1_000_000


# A table of up to so many rows is broadcast.
MOST_BROADCAST_ROWS = 200_000


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint if a count of its rows, which runs now, allows it.

    A larger one is left to the optimizer and to adaptive execution.
    """
    small = table.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS
    return F.broadcast(table) if small else table


def join_back(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; key columns come from the rows.

    A digest of the keys goes first, as sorting by one number rarely has to
    compare the keys themselves.
    """
    others = [f"stat_{key}" for key in keys]
    renamed = stats.withColumnsRenamed(dict(zip(keys, others, strict=True)))
    same = reduce(
        Column.__and__,
        [F.col(key).eqNullSafe(F.col(other)) for key, other in zip(keys, others, strict=True)],
        F.xxhash64(*keys) == F.xxhash64(*others),
    )
    return rows.join(renamed, same, how).drop(*others)


def with_group_stats(rows: DataFrame, keys: list[str], *stats: Column) -> DataFrame:
    """What `stats over (partition by keys)` would put on every row."""
    return join_back(rows, rows.groupBy(*keys).agg(*stats), keys)


def collapse_copies(rows: DataFrame) -> DataFrame:
    """Each distinct row once, with its number of copies."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


def unfold_copies(collapsed: DataFrame) -> DataFrame:
    """Undo collapse_copies; copy_no counts the copies of a row from 0.

    A row is cut into chunks of copies, which are spread over the cluster before
    they are unfolded, so one with very many copies is no burden to a task.
    """
    step, zero = F.lit(COPIES_PER_TASK_ROW), F.lit(0).cast("bigint")
    chunks = F.sequence(zero, F.floor((F.col("copies") - 1) / step).cast("bigint"))
    chunk = F.col("chunk")
    numbers = F.sequence(chunk * step, F.least((chunk + 1) * step, F.col("copies")) - 1)
    return (
        collapsed.withColumn("chunk", F.explode(chunks))
        .repartition(F.xxhash64(*collapsed.columns), "chunk")
        .withColumn("copy_no", F.explode(numbers))
        .drop("chunk", "copies")
    )
