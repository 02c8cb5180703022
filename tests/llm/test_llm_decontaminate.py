"""Operator 8 against the exact distance to every stretch."""

import random
import re

import numpy as np

from ringlog.llm import decontaminate, queries


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", decontaminate.lowered(text or ""))


def plain_edits(item, words):
    """Fewest word edits from the item to any stretch."""
    row = [0] * (len(words) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_query(spark):
    """Whatever the exact search finds at sf0.001, and nothing else."""
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    rows = queries.op8_decontaminate(spark, sf_dir).collect()
    found = {(r.doc_id, r.item_id): r for r in rows}
    assert len(found) == len(rows) > 0
    words = {k: plain_words(t) for k, t in docs.items()}
    for item, text in items.items():
        wanted = plain_words(text)
        known = set(wanted)
        for doc, own in words.items():
            # A stretch within the distance has this many words of the item.
            if sum(w in known for w in own) < len(wanted) - int(0.2 * len(wanted) + 1e-9):
                continue
            edits = plain_edits(wanted, own)
            if edits <= int(0.2 * len(wanted) + 1e-9):
                row = found.pop((doc, item))
                assert row.edits == edits and abs(row.similarity - (1 - edits / len(wanted))) < 1e-12
                stretch = plain_words(docs[doc][row.start : row.end])
                assert plain_edits(wanted, stretch) == edits
    assert not found


def test_recall_of_edited_items(spark):
    rng = random.Random(9)
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect()]
    prose = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    other = [w for words in prose for w in words]
    rows, truth = [], 0
    for share in (0.0, 0.1, 0.2):
        for k, item in enumerate(items):
            words = item.split()
            for _ in range(int(share * len(words))):
                at, kind = rng.randrange(len(words)), rng.choice("sdi")
                words[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice(other)]
            host = rng.choice(prose)[:50]
            at = rng.randrange(len(host) + 1)
            rows.append((len(rows), " ".join([*host[:at], *words, *host[at:]]), k))
            truth += 1
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    hits = sum((doc, item) in found for doc, _, item in rows)
    assert hits / truth > 0.95
    assert sum((doc, item) in found for doc, _, item in rows[: len(items)]) == len(items)


def test_blocks_of_items(spark):
    items = spark.createDataFrame(
        [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(7)], "item_id bigint, text string"
    )
    docs = items.selectExpr("item_id + 100 as doc_id", "concat('Some words. ', text, ' more') as text")
    for block in (2, 7, 100):
        rows = decontaminate.matches(docs, items, block_items=block).collect()
        assert sorted((r.doc_id, r.item_id, r.edits, r.start) for r in rows) == [
            (k + 100, k, 0, 12) for k in range(7)
        ]


def test_short_items_are_found_as_they_are(spark):
    items = ["alpha", "beta gamma", "a b c d", "a b c d e", "", "..."]
    texts = ["x Alpha, y", "beta. GAMMA! beta gamma", "beta x gamma", "a b c d", "b c d e a b c", "gamma", "alpha"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = decontaminate.matches(docs, bench).collect()
    found = sorted((r.doc_id, r.item_id, r.edits, texts[r.doc_id][r.start : r.end]) for r in rows)
    assert found == [
        (0, 0, 0, "Alpha"), (1, 1, 0, "beta. GAMMA"), (3, 2, 0, "a b c d"), (3, 3, 1, "a b c d"),
        (4, 3, 1, "b c d e"), (6, 0, 0, "alpha")
    ]


def test_odd_rows(spark, odd_docs, no_docs):
    from conftest import PROSE

    items = spark.createDataFrame(
        [(1, PROSE), (2, PROSE.upper()), (3, None), (4, ""), (5, "one more"), (None, PROSE)],
        "item_id bigint, text string",
    )
    rows = decontaminate.matches(odd_docs, items).collect()
    found = sorted(((r.doc_id or 0, r.item_id or 0) for r in rows))
    assert found == sorted([(d, i) for d in (1, 2, 2, 0) for i in (1, 2, 5, 0)])
    kept = decontaminate.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 4, 5, 6, 7, 8, 9]
    assert decontaminate.matches(no_docs, items).count() == 0
    assert decontaminate.matches(odd_docs, items.limit(0)).count() == 0


def test_nearest_and_hashes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        item = rng.integers(0, 4, rng.integers(1, 8)).astype(np.uint64)
        part = rng.integers(0, 4, rng.integers(0, 15)).astype(np.uint64)
        assert decontaminate.nearest(item, part)[0] == plain_edits(list(item), list(part))
    words = decontaminate.words_of(["Ab, cd ab", None, "", "CD\0ab"])
    assert words.text.tolist() == [0, 0, 0, 3, 3]
    assert words.hashes[0] == words.hashes[2] == words.hashes[4] != words.hashes[1] == words.hashes[3]


def test_recall_at_the_largest_distance_by_length(spark):
    """A fifth of the words edited, for each length alone."""
    rng = random.Random(4)
    lengths, each = (6, 12, 15, 20, 29, 59, 80, 150, 250), 120
    items, rows = [], []
    for size in lengths:
        for k in range(each):
            item = [f"w{rng.randrange(20_000)}" for _ in range(size)]
            words = list(item)
            for _ in range(int(0.2 * size + 1e-9)):
                at, kind = rng.randrange(len(words)), rng.choice("sdi") if k % 2 else "s"
                words[at : at + (kind != "i")] = [] if kind == "d" else [f"w{rng.randrange(20_000)}"]
            host = [f"w{rng.randrange(20_000)}" for _ in range(60)]
            rows.append((len(rows), " ".join([*host[:30], *words, *host[30:]])))
            items.append((len(items), " ".join(item)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    for n, size in enumerate(lengths):
        hits = sum((k, k) in found for k in range(n * each, (n + 1) * each))
        assert hits / each >= 0.95, (size, hits / each)
