"""Operator 12 against a plain version, and its query against DuckDB."""

import hashlib
import zlib

import duckdb
from compare import duck_bag, spark_bag

from ringlog.llm import merkle, oracle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [*(row[name] for name in FIELDS[:-1]), text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fanout):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
        found.append(nodes)
    return found


def plain(rows, fanout=3):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of each row."""
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(
            key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]))
        )
        trees[source] = levels([leaf_of(r, r["text"]) for r in groups[source]], fanout)
    above = levels([trees[source][-1][0] for source in order], fanout)
    root = above[-1][0]
    found = []
    for k, source in enumerate(order):
        for place, row in enumerate(groups[source]):
            text = row["text"]
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = text and text.replace("\n", "")
            node, proof = leaf_of(row, text), ""
            for tree, at in ((trees[source], place), (above, k)):
                for level in tree[:-1]:
                    run = level[at // fanout * fanout :][:fanout]
                    own = at % fanout
                    proof += "".join(run[:own] + run[own + 1 :])
                    node = sha("".join([*run[:own], node, *run[own + 1 :]]))
                    at //= fanout
            leaf = trees[source][0][place]
            found.append(
                (row["doc_id"], leaf, trees[source][-1][0], root, sha(proof), node, node == root)
            )
    return sorted(found, key=str)


def as_query(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_merkle(spark, str(tmp_path))
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert found.columns == names
    return sorted((tuple(row) for row in found.collect()), key=str)


def test_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = queries.op12_merkle(spark, sf_dir)
    assert spark_bag(found) == duck_bag(connection, oracle.SQL["op12_merkle"])


def test_odd_rows(spark, odd_docs, tmp_path):
    """Null ids and sources, equal rows, clashing columns, a text without line ends."""
    rows = [r.asDict() for r in odd_docs.collect()]
    assert as_query(spark, odd_docs, tmp_path) == plain(rows)


def test_sizes(spark, tmp_path):
    """Groups of every shape of the last run, one of a single row and one with an empty name."""
    rows = [
        (100 * size + k, "" if size == 2 else f"s{size}", None, 1, f"t\n{k}")
        for size in (1, 2, 3, 4, 9, 10, 28)
        for k in range(size)
    ]
    frame = spark.createDataFrame(
        rows, "doc_id bigint, source string, lang string, n_chars int, text string"
    ).repartition(4)
    assert as_query(spark, frame, tmp_path) == plain([r.asDict() for r in frame.collect()])


def test_one_row_and_none(spark, no_docs, tmp_path):
    one = spark.createDataFrame([(2, "a", "b", 3, "c\n")], "doc_id int, source string, lang string, n_chars int, text string")
    assert as_query(spark, one, tmp_path / "one") == plain([r.asDict() for r in one.collect()])
    assert as_query(spark, no_docs, tmp_path / "none") == []


def test_very_many_equal_rows_are_spread(spark):
    """Places of equal rows are all different and dense, with any number of ranges."""
    rows = spark.range(3000).selectExpr("'s' as source", "7 as id", "'h' as hash", "id as copy_no")
    found = merkle.ranked(rows.repartition(5), "source", ["id", "hash", "copy_no"], "t").collect()
    assert sorted(r.place for r in found) == list(range(3000))
    assert all(r.place == r.copy_no and r["size"] == 3000 for r in found)


def test_other_fanout(spark, docs):
    found = merkle.manifest(docs.select(*FIELDS), FIELDS, fanout=5).collect()
    want = plain([r.asDict() for r in docs.collect()], 5)
    assert sorted((r.id, r.leaf, r.subroot, r.root) for r in found) == sorted(w[:4] for w in want)
