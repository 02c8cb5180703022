"""Near-duplicate vectors by a neighbour graph that is refined step by step (operator 10).

Equal vectors are one node. The graph begins with the neighbours of every node in
a few orders of all nodes, each by cross-polytope codes of a random rotation, so
near vectors stand close by. Then it is refined as in NN-descent: the neighbours
of a node are compared with each other, which finds the neighbours of neighbours.
A node keeps the nearest `size` of its list, and where the links fill a list that
far, it is enlarged to hold all of them, and more of it is compared (in proportion
to the root of its length, so that the comparisons keep up with the links). Orders
and the places compared in them grow with the number of nodes. An audit compares
nodes with all others until enough of them have links, or all nodes are compared;
the rounds go on, each with new orders, until the edges have the wanted part of the
audited links. If they never do, the operator fails. Edges at the threshold or above
are the links.

No step gathers a group: orders are cut into ranges, lists are sampled by hash
before their vectors are fetched, and copies are counted, never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import remove, written

THRESHOLD = 0.9
#: Neighbours a node keeps beside its links, and the cosine below which none is kept.
LIST_SIZE = 8
FLOOR = 0.5
#: Orders in the first round and in each later one, and places compared in an order,
#: at the least; and the part of lone pairs at the threshold that the first round is
#: expected to meet, which more nodes need more orders for.
FIRST_ORDERS = 10
LATER_ORDERS = 4
REACH = 8
FIRST_RECALL = 0.95
#: Neighbours of a node that are compared: at least this many, and this often the
#: root of the number of its neighbours.
SAMPLE = 24
SAMPLE_ROOT = 2.5
#: From this round on, orders and reach double with each; and the most rounds.
ROUNDS = 6
MOST_ROUNDS = 12
#: Nodes that an audit compares at first, and how many times that in one pass; nodes
#: with links that it wants; and the recall at which the rounds end.
AUDIT_NODES = 1000
AUDIT_PASS = 8
AUDIT_LINKED = 1000
AUDIT_RECALL = 0.999

PAIR = "u bigint, v bigint, sim double"


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision, a row for each value."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = flat.reshape(len(column), -1)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def pairs_batch(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(u, v), np.maximum(u, v)
    return pa.RecordBatch.from_arrays(
        [pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sim, pa.float64())],
        ["u", "v", "sim"],
    )


def nearest_axes(units: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of each vector the nearest of the 2d axes, after a random rotation."""
    turned = units @ rng.standard_normal((units.shape[1], units.shape[1]))
    axis = np.abs(turned).argmax(axis=1)
    return 2 * axis + (turned[np.arange(len(units)), axis] < 0)


def codes(units: np.ndarray, order: int, turns: int = 3) -> np.ndarray:
    """Of each vector the nearest of the 2d axes, after some random rotations, as one number."""
    rng = np.random.default_rng([10, order])
    found = np.zeros(len(units), np.int64)
    for _ in range(turns):
        found = found * (2 * units.shape[1]) + nearest_axes(units, rng)
    return found


def effort(count: int, size: int, threshold: float) -> tuple[int, int, int]:
    """(orders in the first round, places compared, rotations) for so many vectors of a size.

    Places grow with the logarithm of the count. Rotations are as many as it takes
    to tell all nodes apart. Two vectors at the threshold agree on a rotation as
    often as simulated ones do, and to come within reach in an order they must on as
    many as leave that few nodes together.
    """
    axes = 2 * size
    reach = max(REACH, math.ceil(math.log2(max(count, 2))))
    turns = math.ceil(math.log(max(count, 2)) / math.log(axes))
    turns = max(3, min(turns, int(62 / math.log2(axes))))
    rng = np.random.default_rng([10, size])
    one, other = rng.standard_normal((2, 2000, size))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= one * (one * other).sum(axis=1, keepdims=True)
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
    near = threshold * one + math.sqrt(max(0.0, 1 - threshold * threshold)) * other
    seed = [11, size]
    same = nearest_axes(one, np.random.default_rng(seed)) == nearest_axes(
        near, np.random.default_rng(seed)
    )
    agree = min(max(float(same.mean()), 0.01), 0.99)
    needed = max(0.0, math.log(max(count, 1) / reach) / math.log(axes))
    meets = min(agree**needed, 0.99)
    orders = math.ceil(math.log(1 - FIRST_RECALL) / math.log(1 - meets))
    return max(FIRST_ORDERS, orders), reach, turns


def ordered_pairs(
    nodes: DataFrame, orders: range, reach: int = REACH, turns: int = 3
) -> DataFrame:
    """(u, v, sim) of nodes that stand close in one of the orders, at FLOOR or above."""
    kind = nodes.schema["vector"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = matrix(batch.column("vector"))
                for order in orders:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(units), order), pa.int32()),
                            pa.array(codes(units, order, turns), pa.int64()),
                            *batch.columns,
                        ],
                        ["order", "code", "node", "vector"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            order, node = (batch.column(k).to_numpy() for k in (0, 2))
            units = matrix(batch.column("vector"))
            fresh = 0
            if held is not None:
                fresh = len(held[1])
                order, node = (np.concatenate(x) for x in zip(held[:2], (order, node), strict=True))
                units = np.concatenate((held[2], units))
            for step in range(1, reach + 1):
                # Pairs whose later place was in an earlier batch are done.
                first = max(0, fresh - step)
                u, v = np.arange(first, len(node) - step), np.arange(first + step, len(node))
                sim = np.einsum("ij,ij->i", units[u], units[v])
                good = (sim >= FLOOR) & (order[u] == order[v])
                yield pairs_batch(node[u[good]], node[v[good]], sim[good])
            held = order[-reach:], node[-reach:], units[-reach:]

    placed = nodes.select("node", "vector").mapInArrow(
        place, f"order int, code bigint, node bigint, vector {kind}"
    )
    keys = ["order", "code", "node"]
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(compare, PAIR)


def joined_pairs(edges: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """(u, v, sim) of the neighbours of a node with each other, at FLOOR or above."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    wanted = F.greatest(F.lit(float(SAMPLE)), SAMPLE_ROOT * F.sqrt("degree"))
    share = F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    chosen = both.join(degree.where("degree > 1"), "u").where(share * F.col("degree") < wanted)
    rows = chosen.select("u", "v").join(
        nodes.select(F.col("node").alias("v"), "vector"), "v"
    ).select("u", "v", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
            middle = held.column("u").to_numpy()
            cut = int(np.searchsorted(middle, middle[-1]))  # the last group may go on
            if cut:
                yield from groups(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from groups(held)

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        middle, node = (table.column(k).to_numpy() for k in ("u", "v"))
        units = matrix(table.column("vector").combine_chunks())
        starts = np.flatnonzero(np.concatenate(([True], middle[1:] != middle[:-1])))
        ends = np.concatenate((starts[1:], [len(middle)]))
        found: list[tuple] = []
        size = 0
        for start, end in zip(starts, ends, strict=True):
            sims = units[start:end] @ units[start:end].T
            u, v = np.nonzero(np.triu(sims >= FLOOR, 1))
            found.append((node[start + u], node[start + v], sims[u, v]))
            size += len(u)
            if size > 200_000:
                yield distinct(found)
                found, size = [], 0
        if found:
            yield distinct(found)

    def distinct(found: list[tuple]) -> pa.RecordBatch:
        u, v, sim = (np.concatenate(x) for x in zip(*found, strict=True))
        low, high = np.minimum(u, v), np.maximum(u, v)
        order = np.lexsort((high, low))
        low, high, sim = low[order], high[order], sim[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        return pairs_batch(low[new], high[new], sim[new])

    return rows.repartition("u").sortWithinPartitions("u").mapInArrow(compare, PAIR)


def kept_edges(pairs: DataFrame, threshold: float) -> DataFrame:
    """(u, v, sim) once each: all links, and what is among the nearest of one of its ends."""
    once = pairs.where("u <> v").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    links = once.where(F.col("sim") >= threshold)
    rest = once.where(F.col("sim") < threshold)
    both = rest.union(rest.select("v", "u", "sim"))
    nearest = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    ranked = both.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= LIST_SIZE)
    others = ranked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim")
    return links.union(others.distinct())


def _asked(nodes: DataFrame, asked: pa.Table, threshold: float) -> DataFrame:
    """(q, u, v): all links of the nodes asked for, each compared with all nodes in batches."""
    names = asked.column("node").to_numpy()
    queries = matrix(asked.column("vector").combine_chunks())
    # What rounding alone decides is not asked for.
    least = threshold + 1e-12

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            for start in range(0, len(node), 2000):
                part = batch.slice(start, 2000)
                sims = matrix(part.column("vector")) @ queries.T
                row, query = np.nonzero(sims >= least)
                ends = part.column("node").to_numpy()[row], names[query]
                good = ends[0] != ends[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ends[1][good]), pa.array(ends[0][good])], ["q", "w"]
                )

    found = nodes.select("node", "vector").mapInArrow(compare, "q bigint, w bigint")
    return found.select("q", F.least("q", "w").alias("u"), F.greatest("q", "w").alias("v"))


def true_links(
    nodes: DataFrame, threshold: float, most: int = AUDIT_NODES, linked: int = AUDIT_LINKED
) -> tuple[list[DataFrame], int, int]:
    """((q, u, v) of all links of audited nodes, written; nodes audited; those with links).

    Nodes are audited in the order of their hashes, `most` at first and up to
    AUDIT_PASS times as many in each later pass, until `linked` of them have links
    or no node is left.
    """
    rows = nodes.select("node", "vector", F.xxhash64("node").alias("hash"))
    parts: list[DataFrame] = []
    audited = having = 0
    after, size = rows, most
    while True:
        asked = after.orderBy("hash", "node").limit(size).toArrow()
        if not asked.num_rows:
            return parts, audited, having
        part = written(_asked(nodes, asked, threshold), "audit")
        parts.append(part)
        audited += asked.num_rows
        having += part.agg(F.count_distinct("q")).first()[0]
        if having >= linked:
            return parts, audited, having
        at, node = asked.column("hash")[-1].as_py(), asked.column("node")[-1].as_py()
        after = rows.where(
            (F.col("hash") > at) | ((F.col("hash") == at) & (F.col("node") > node))
        )
        size = min(2 * size, AUDIT_PASS * most)


def recall_of(parts: list[DataFrame], edges: DataFrame, threshold: float) -> float:
    """The part of all links of an audited node that the edges have, over those that have any."""
    found = edges.where(F.col("sim") >= threshold).select("u", "v", F.lit(1).alias("hit"))
    truth = None
    for part in parts:
        truth = part if truth is None else truth.union(part)
    if truth is None:
        return 1.0
    each = truth.join(found, ["u", "v"], "left").groupBy("q").agg(
        (F.count("hit") / F.count(F.lit(1))).alias("recall")
    )
    recall = each.agg(F.avg("recall")).first()[0]
    return 1.0 if recall is None else float(recall)


def audit(nodes: DataFrame, edges: DataFrame, threshold: float, most: int = AUDIT_NODES) -> float:
    """The recall of the edges over audited nodes. 1 without any only if no node has a link."""
    parts, _, _ = true_links(nodes, threshold, most)
    recall = recall_of(parts, edges, threshold)
    for part in parts:
        remove(part)
    return recall


def graph(nodes: DataFrame, threshold: float, rounds: int = MOST_ROUNDS) -> tuple[DataFrame, float]:
    """The edges found, written, and their audited recall, AUDIT_RECALL at least if rounds suffice."""
    count = nodes.count()
    size = len(nodes.select("vector").first()[0]) if count else 1
    orders, reach, turns = effort(count, size, threshold)
    later = max(LATER_ORDERS, math.ceil(orders * LATER_ORDERS / FIRST_ORDERS))
    truth, _, _ = true_links(nodes, threshold)
    edges = written(
        kept_edges(ordered_pairs(nodes, range(orders), reach, turns), threshold), "edges"
    )
    recall, used = 0.0, orders
    for k in range(rounds):
        new = edges.union(joined_pairs(edges, nodes, k))
        if k:
            more = 2 ** max(0, k - ROUNDS + 1)
            wanted = range(used, used + later * more)
            new = new.union(ordered_pairs(nodes, wanted, reach * more, turns))
            used = wanted.stop
        better = written(kept_edges(new, threshold), "edges")
        remove(edges)
        edges = better
        recall = recall_of(truth, edges, threshold)
        if recall >= AUDIT_RECALL and k:
            break
    for part in truth:
        remove(part)
    return edges, recall


def complete_graph(nodes: DataFrame, threshold: float, rounds: int = MOST_ROUNDS) -> DataFrame:
    """The edges of a graph whose audited recall is AUDIT_RECALL; fails if it is not."""
    edges, recall = graph(nodes, threshold, rounds)
    if recall < AUDIT_RECALL:
        raise RuntimeError(
            f"{recall:.4f} of the audited links found in {rounds} rounds, {AUDIT_RECALL} wanted"
        )
    return edges


def valid(vector: str) -> F.Column:
    """Whether a vector can have a cosine: finite numbers, not all zero."""
    column = F.col(vector)
    finite = F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    moved = F.exists(column, lambda x: x != 0)
    return F.coalesce(finite & moved, F.lit(False))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of `vectors`.

    n_links counts the other rows whose cosine with this one is `threshold` or
    more, equal vectors among them; component_id is the smallest id reachable over
    links, the row's own included; kept says whether they are the same. Vectors
    that are null, empty or zero, or hold null or a number that is not finite, link
    with nothing; vectors of different lengths do not link. Null ids are never the
    smallest where there is another. Fails if the links cannot be found to the
    audited recall.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    good = rows.where(valid("vector"))
    found = []
    # One graph for each length; a table of embeddings has one.
    lengths = [row.n for row in good.select(F.size("vector").alias("n")).distinct().collect()]
    for length in sorted(lengths):
        found.append(_of_length(good.where(F.size("vector") == length), threshold))
    rest = rows.where(~valid("vector")).select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    for part in found:
        rest = rest.union(part)
    return rest.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _of_length(rows: DataFrame, threshold: float) -> DataFrame:
    copies = rows.groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # Written before they are used: a node's number is what the files say.
    nodes = written(copies.withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = complete_graph(nodes, threshold)
    links = edges.where(F.col("sim") >= threshold)
    both = links.select("u", "v").union(links.select("v", "u"))
    counts = nodes.select(F.col("node").alias("v"), "n")
    linked = both.join(counts, "v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("linked"))
    parts = components(links.select("u", "v"))
    known = (
        nodes.join(linked, "node", "left")
        .join(parts, "node", "left")
        .select(
            "vector",
            "least",
            (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("vector", "n_links", "component_id")
    return rows.join(known, "vector").select("id", "n_links", "component_id")
