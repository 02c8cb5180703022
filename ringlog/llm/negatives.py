"""Hard negatives by an inverted multi-index (operator 11).

Vectors are cut in halves, and each half is put to the nearest code of a codebook of
its own. A pair of codes is a cell. The inner product of a query with a row of a cell
is at most the sum of two half scores: query half by code, plus the query half's
length times the radius of the code's rows. A heap visits a query's cells in the
order of these bounds (multi-sequence). A search asks for the best rows below a
score; it is over when enough rows are found and no cell is left whose bound reaches
the last of them, so that its window is certified and the result exact.

Each round, the queries that are not certified name their next cells, rows and
queries meet by cell in one shuffle, and only hits are kept. Cells with many rows are
cut into blocks of about BLOCK rows, which go to tasks of their own, and a task holds
one block at a time while queries stream past it. Of rows with the same vector and
label no more can be in a result than the smallest ids, so only these are indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlog.operators.groups import unfold_copies

from .scratch import remove, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: Rows of a block, and sampled rows for each code that is learned.
BLOCK = 2048
SAMPLE_PER_CODE = 64
#: Cells that a query visits in its first round, and how many times more in each next one.
FIRST_CELLS, MORE_CELLS = 16, 8
LARGEST = 2**63 - 1

ROWS = "id bigint, label bigint, length int, v binary"
QUERIES = "query bigint, own bigint, label bigint, length int, v binary, same boolean, high bigint, low bigint, seen int"


def comparable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the rows that take part: a label, an id, and finite components."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & finite)
    return rows.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("bigint").alias("label"),
        vector.alias("vector"),
    )


def as_integers(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """ROWS: components as floor(SCALE * x), with zeros up to the width, in a numpy type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            full = np.zeros((batch.num_rows, width))
            full[np.arange(width) < sizes[:, None]] = np.floor(values * SCALE)
            data = [row.tobytes() for row in full.astype(kind)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("label"),
                    pa.array(sizes.astype(np.int32)),
                    pa.array(data, pa.binary()),
                ],
                ["id", "label", "length", "v"],
            )

    return rows.mapInArrow(run, ROWS)


def codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centres of the points by Lloyd's rounds, from every n-th point on."""
    found = points[:: max(1, len(points) // size)][:size].copy()
    for _ in range(rounds):
        nearest, _ = nearest_code(points, found)
        count = np.bincount(nearest, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, nearest, points)
        found = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], found)
    return found


def nearest_code(points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point its nearest code and the distance to it."""
    score = points @ codes.T - (codes * codes).sum(axis=1) / 2
    nearest = score.argmax(axis=1)
    return nearest, np.linalg.norm(points - codes[nearest], axis=1)


@dataclass(frozen=True)
class Index:
    """rows: ROWS with their cell (c1, c2) and block; what a query needs to know of cells.

    blocks[i, j] is the number of blocks of a cell. All but the rows is a number for
    each code or each cell; there are about four times the square root of the rows.
    """

    rows: DataFrame
    kind: str
    width: int
    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    blocks: np.ndarray

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.width // 2
        return points[:, :cut], points[:, cut:]

    def vectors(self, column: pa.Array) -> np.ndarray:
        data = b"".join(column.to_pylist())
        return np.frombuffer(data, self.kind).reshape(len(column), self.width).astype(np.float64)


def build(vectors: DataFrame, copies: int) -> Index | None:
    """Index rows (id, label, vector), of equal vectors and labels the `copies` smallest ids.

    Codebooks are learned from a sample, ordered by a digest, that grows with the
    number of codes, hence with the fourth root of the rows; every row is indexed. An
    empty table has no index.
    """
    largest = F.max(F.array_max(F.transform("vector", F.abs)))
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), largest.alias("most")).first()
    if not stats.n:
        return None
    most = (stats.most or 0.0) * SCALE + 1
    kind = next(k for k, top in (("<i2", 2**15), ("<i4", 2**31), ("<f8", np.inf)) if most <= top)
    width = max(2, stats.width)
    if most * most * width > LARGEST:
        raise OverflowError("inner products of these vectors do not fit a bigint")
    rows = as_integers(vectors, width, kind)
    alike = Window.partitionBy("label", "length", "v").orderBy("id")
    few = written(rows.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= copies).drop("nth"), "negatives-rows")
    size = max(2, round(2 * stats.n**0.25))
    order = [F.xxhash64("id", "v"), "id"]
    sample = few.orderBy(*order).limit(SAMPLE_PER_CODE * size).select("v").toArrow().column("v").combine_chunks()
    shape = Index(few, kind, width, (), (), np.empty(0))
    codes = tuple(codebook(half, min(size, len(half))) for half in shape.halves(shape.vectors(sample)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Index(None, kind, width, codes, (), np.empty(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            halves = plain.halves(plain.vectors(batch.column("v")))
            found = [nearest_code(half, code) for half, code in zip(halves, codes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    *[pa.array(c.astype(np.int32)) for c, _ in found],
                    *[pa.array(d) for _, d in found],
                ],
                [*batch.schema.names, "c1", "c2", "d1", "d2"],
            )

    placed = written(few.mapInArrow(place, f"{ROWS}, c1 int, c2 int, d1 double, d2 double"), "negatives-cells")
    radii = []
    for c, d, code in (("c1", "d1", codes[0]), ("c2", "d2", codes[1])):
        radius = np.full(len(code), -1.0)
        for row in placed.groupBy(c).agg(F.max(d).alias("r")).collect():
            radius[row[c]] = row.r
        radii.append(radius)
    cells = placed.groupBy("c1", "c2").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    blocks = np.zeros((len(codes[0]), len(codes[1])), np.int32)
    for row in cells.collect():
        blocks[row.c1, row.c2] = row.n
    counts = F.broadcast(cells.withColumnsRenamed({"c1": "k1", "c2": "k2"}))
    of = placed.join(counts, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")))
    block = F.pmod(F.xxhash64("id", "v", "label"), F.col("n")).cast("int")
    blocked = of.select("c1", "c2", block.alias("block"), "id", "label", "length", "v")
    return Index(blocked, kind, width, codes, tuple(radii), blocks)


def cells_in_order(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs from two lists of numbers, largest sum first, by a heap."""
    one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)] if a and b else []
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, int(one[i]), int(two[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


VISITS = "c1 int, c2 int, block int, kind int, query bigint, id bigint, label bigint, length int, v binary, same boolean, high bigint, low bigint"


def visits(queries: DataFrame, index: Index, cells: int) -> DataFrame:
    """VISITS: the next cells of each query that a row above its `low` may be in, by block."""
    plain = Index(None, index.kind, index.width, index.codes, index.radii, index.blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                halves = plain.halves(plain.vectors(part.column("v")))
                bounds = []
                for half, codes, radius in zip(halves, plain.codes, plain.radii, strict=True):
                    length = np.linalg.norm(half, axis=1)[:, None]
                    slack = 1e-9 * length * (np.linalg.norm(codes, axis=1) + radius + 1)
                    bound = half @ codes.T + length * radius + slack
                    bounds.append(np.where(radius >= 0, bound, -np.inf))
                found = []
                lows, starts = part.column("low").to_pylist(), part.column("seen").to_pylist()
                for k, (low, start) in enumerate(zip(lows, starts, strict=True)):
                    for n, (bound, i, j) in enumerate(cells_in_order(bounds[0][k], bounds[1][k])):
                        if n >= start + cells or bound + 1e-6 < low:
                            break
                        if n >= start:
                            found += [(i, j, block, k) for block in range(plain.blocks[i, j])]
                if not found:
                    continue
                c1, c2, block, k = (pa.array(x, pa.int32()) for x in zip(*found, strict=True))
                rows = part.take(k)
                yield pa.RecordBatch.from_arrays(
                    [c1, c2, block, pa.array(np.ones(len(k), np.int32)), rows.column("query"), rows.column("own")]
                    + [rows.column(c) for c in ("label", "length", "v", "same", "high", "low")],
                    [field.split()[0] for field in VISITS.split(", ")],
                )

    return queries.mapInArrow(run, VISITS)


def _best(scores: list[int], ids: list[int], count: int) -> list[tuple[int, int]]:
    return heapq.nsmallest(count, ((-s, i) for s, i in zip(scores, ids, strict=True)))


def hits(index: Index, asked: DataFrame, count: int) -> DataFrame:
    """(query, score, id): of each visited block the best `count` rows in the query's window.

    Rows and visits are brought together by block and sorted, rows first, so a task
    holds one block while the visits to it stream past. The product is taken in
    doubles as long as these are exact, else in Python's integers.
    """
    plain = Index(None, index.kind, index.width, (), (), np.empty(0))
    names = [field.split()[0] for field in VISITS.split(", ")]
    none = {"kind": F.lit(0), "query": F.lit(None).cast("bigint"), "same": F.lit(None).cast("boolean")}
    none |= {name: F.lit(None).cast("bigint") for name in ("high", "low")}
    rows = index.rows.select(*[none[n].alias(n) if n in none else F.col(n) for n in names])
    keys = ["c1", "c2", "block"]
    both = rows.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind", "id")

    def score(block: list[pa.RecordBatch], part: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
        def whole(name: str) -> np.ndarray:
            return np.concatenate([b.column(name).to_numpy() for b in block])

        matrix = np.concatenate([plain.vectors(b.column("v")) for b in block])
        wanted = plain.vectors(part.column("v"))
        bound = np.abs(matrix).max(initial=0) * np.abs(wanted).max(initial=0) * plain.width
        if bound >= 2**53:
            matrix, wanted = (np.vectorize(int, otypes=[object])(x) for x in (matrix, wanted))
        ids, labels, lengths = whole("id"), whole("label"), whole("length")
        own, label, length, high, low, query = (
            part.column(n).to_numpy() for n in ("id", "label", "length", "high", "low", "query")
        )
        same = part.column("same").to_numpy(zero_copy_only=False).astype(bool)
        found = matrix @ wanted.T
        fit = (found >= low) & (found <= high) & (lengths[:, None] == length)
        fit &= (labels[:, None] == label) == same
        for k in np.flatnonzero(fit.any(axis=0)):
            at = np.flatnonzero(fit[:, k])
            if same[k]:
                mine = [x for x in at if ids[x] == own[k] and (matrix[x] == wanted[k]).all()]
                at = np.setdiff1d(at, mine[:1])
            best = _best([int(x) for x in found[at, k]], ids[at].tolist(), count)
            yield from ((int(query[k]), -s, i) for s, i in best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(n).to_numpy() for n in (*keys, "kind")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key, part = tuple(marks[:3, start]), batch.slice(start, stop - start)
                if key != held:
                    held, block = key, []
                if marks[3, start] == 0:
                    block.append(part)
                elif block:
                    for k in range(0, part.num_rows, 1024):
                        found = list(score(block, part.slice(k, 1024)))
                        if found:
                            columns = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)]
                            yield pa.RecordBatch.from_arrays(columns, ["query", "score", "id"])

    return both.mapInArrow(run, "query bigint, score bigint, id bigint")


def search(index: Index, queries: DataFrame, count: int) -> DataFrame:
    """(query, score, id, rank): the best `count` rows of each query's window, exactly.

    queries: QUERIES with low <= high; only rows of the query's length take part, with
    its label if same, else of other labels, and with a score from low to high. Higher
    scores come first, then smaller ids. A row that equals the query in id, label and
    vector is the query's own and left out once where same is set.
    """
    spark = queries.sparkSession
    queries = written(queries, "negatives-queries")
    best = spark.createDataFrame([], "query bigint, score bigint, id bigint, rank int")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    cells = FIRST_CELLS
    while True:
        asked = written(visits(queries, index, cells), "negatives-visits")
        if asked.isEmpty():
            return best
        new = hits(index, asked, count).unionByName(best.drop("rank"))
        ranked = new.withColumn("rank", F.row_number().over(first))
        best = written(ranked.where(F.col("rank") <= count), "negatives-best")
        remove(asked)
        last = best.where(F.col("rank") == count).select(F.col("query").alias("q"), F.col("score").alias("last"))
        known = queries.join(last, F.col("query") == F.col("q"), "left")
        low = F.greatest("low", "last").alias("low")
        seen = (F.col("seen") + cells).alias("seen")
        names = [field.split()[0] for field in QUERIES.split(", ")]
        queries = written(known.select(*[{"low": low, "seen": seen}.get(n, F.col(n)) for n in names]), "negatives-queries")
        cells *= MORE_CELLS


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    share: tuple[int, int] = (80, 100),
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which the given column, over `id`, holds. Of an anchor, the
    positives are the best other rows with its label; for each, the negatives are the
    best rows of other labels that score at most as much and at least the given share
    of it. Scores are inner products of components as floor(256 * x); ties go to the
    smaller id.

    Rows without a label, vector or id, or with a component that is null or not finite,
    take no part, and vectors of different lengths never meet. Repeated rows count
    each: a copy of an anchor is a positive, and an anchor as well, with the same
    result. Without anchors, positives or negatives there are no rows.
    """
    rows = comparable(vectors, id_col, vector_col, label_col)
    index = build(rows, max(positives + 1, negatives))
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    own = as_integers(rows.where(anchors), index.width, index.kind)
    own = own.groupBy("id", "label", "length", "v").agg(F.count("*").alias("copies"))
    own = written(own.withColumn("query", F.monotonically_increasing_id()), "negatives-anchors")
    common = [F.col("id").alias("own"), "label", "length", "v"]
    start = [F.lit(LARGEST).alias("high"), F.lit(-LARGEST).alias("low"), F.lit(0).alias("seen")]
    liked = search(index, own.select("query", *common, F.lit(True).alias("same"), *start), positives)
    pairs = liked.select(F.col("query").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    least, whole = (F.lit(x).cast("bigint") for x in share)
    scaled = F.col("positive_score").cast("decimal(20,0)") * least + whole - 1
    low = F.call_function("div", scaled, whole.cast("decimal(20,0)"))
    windows = pairs.where("positive_score >= 0").select("anchor", "positive_score").distinct()
    windows = written(windows.select("*", F.monotonically_increasing_id().alias("query")), "negatives-windows")
    asked = windows.join(own.withColumnRenamed("query", "anchor"), "anchor").select(
        "query", *common, F.lit(False).alias("same"), F.col("positive_score").alias("high"), low.alias("low"), F.lit(0).alias("seen")
    )
    disliked = search(index, asked, negatives).join(windows, "query")
    disliked = disliked.select("anchor", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = pairs.join(disliked, ["anchor", "positive_score"])
    named = found.join(own.select(F.col("query").alias("anchor"), F.col("id").alias("anchor_id"), "copies"), "anchor")
    result = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    once = named.where("copies = 1").select(*result)
    repeated = unfold_copies(named.where("copies > 1").select(*result, "copies"))
    return once.union(repeated.select(*result))
