"""Operator 11 against a comparison with all rows, and its query against DuckDB."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from compare import duck_bag, spark_bag
from pyspark.sql import functions as F

from ringlog.llm import negatives, oracle, queries

SCHEMA = "vec_id bigint, embedding array<double>, label int, id int, query string, v int"


def plain(rows):
    """Rows (id, vector, label): the result as a bag."""
    good = []
    for name, vector, label in rows:
        if name is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.append((name, label, [math.floor(256 * x) for x in vector]))
    found = Counter()
    for k, (name, label, vector) in enumerate(good):
        if name % 100:
            continue
        scored = [
            (-sum(a * b for a, b in zip(vector, other, strict=True)), i, kind)
            for n, (i, kind, other) in enumerate(good)
            if n != k and len(other) == len(vector)
        ]
        likes = sorted((s, i) for s, i, kind in scored if kind == label)[:5]
        for p, positive in likes:
            near = sorted((s, i) for s, i, kind in scored if kind != label and 80 * -p <= 100 * -s <= 100 * -p)
            for rank, (s, i) in enumerate(near[:5], 1):
                found[name, positive, rank, i, -p, -s] += 1
    return found


def mined(spark, rows):
    frame = spark.createDataFrame([(*row, 1, "x", 2) for row in rows], SCHEMA).repartition(3)
    found = negatives.hard_negatives(frame, F.col("id") % 100 == 0)
    return Counter(tuple(row) for row in found.collect())


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    found = queries.op11_negatives(spark, sf_dir)
    kinds = {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint"}
    assert dict(found.dtypes) == kinds | {"positive_score": "bigint", "negative_score": "bigint"}
    rows = spark_bag(found)
    assert rows == duck_bag(connection, oracle.SQL["op11_negatives"]) and len(rows[1]) > 50


def test_groups_ties_and_copies(spark, monkeypatch):
    """A tight group over several blocks, equal vectors, equal rows and equal scores."""
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "FIRST_CELLS", 2)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    rows = [(k, [float(x) for x in centre + 0.05 * rng.normal(size=8)], k % 3) for k in range(400)]
    rows += [(k, [1.0, 0.5, *[0.0] * 6], k % 2) for k in range(400, 460)]
    rows += [(700, [0.25] * 8, 1)] * 9 + [(701, [0.25] * 8, 0)] * 3
    rows += [(k, [float(x) for x in rng.integers(-2, 3, 8)], k % 4) for k in range(800, 1101)]
    assert mined(spark, rows) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.9, 0.4], 2), (3, [0.95, 0.4], 2), (4, None, 1), (5, [nan, 1.0], 1),
        (6, [inf, 1.0], 2), (7, [None, 1.0], 1), (8, [1.0, 1.0], None), (None, [1.0, 0.45], 2), (100, [], 1), (101, [], 1),
        (102, [], 2), (200, [0.0, 0.0], 1), (201, [0.0, -0.0], 2), (300, [1.0, 2.0, 3.0], 1), (301, [1.0, 2.0, 2.5], 1),
        (302, [1.0, 2.0, 2.4], 3), (400, [-1.0, -0.5], 5), (401, [1.0, 1.0], 5), (None, None, None),
    ]
    assert mined(spark, rows) == plain(rows)
    assert not mined(spark, rows[4:8]) and not mined(spark, [])


def test_large_components(spark):
    """Products beyond the doubles' exact range are exact; beyond a bigint they fail."""
    rows = [(k, [1e5 + k / 256, 1e5 - k / 512, 4e6 + k / 256], k % 2) for k in range(0, 220)]
    assert mined(spark, rows) == plain(rows)
    with pytest.raises(OverflowError):
        mined(spark, [(0, [1e15, 1e15], 1)])


def test_cells_come_by_falling_bounds():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=7), rng.normal(size=5)
    a[3] = -np.inf
    found = list(negatives.cells_in_order(a, b))
    assert len({(i, j) for _, i, j in found}) == 35
    assert [total for total, *_ in found] == sorted((x + y for x in a for y in b), reverse=True)
