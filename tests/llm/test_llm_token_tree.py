"""Operator 9 against encoding every text anew."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ringlog.llm import queries, token_tree

PATH = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def vocabulary():
    return token_tree.read_vocabulary(PATH, token_tree.PATTERN)


@pytest.fixture(scope="module")
def encode(vocabulary):
    return vocabulary.encoding().encode_ordinary


def plain(text, edits):
    end, chosen = 0, []
    for start, stop, new in sorted(edits, key=lambda e: e[:2]):
        start, stop = min(max(start, 0), len(text)), min(max(stop, 0), len(text))
        if start >= end and stop >= start:
            chosen.append((start, stop, new or ""))
            end = max(end, stop)
    for start, stop, new in reversed(chosen):
        text = text[:start] + new + text[stop:]
    return text, len(chosen)


def test_random_edits(encode):
    rng = random.Random(8)
    cut = re.compile(token_tree.CUT)
    bits = ["word", " ", " the", "  ", "\n", "'s", "123", "é漢", "😀", ".", " a", "_x", " ", "\x1c"]
    for _ in range(300):
        text = "".join(rng.choices(bits, k=rng.randint(0, 900)))
        leaves = token_tree.leaves_of(text, cut)
        assert "".join(leaves) == text
        state = token_tree.Text(
            text, token_tree.sums([len(x) for x in leaves]), token_tree.sums([len(encode(x)) for x in leaves]), encode, cut
        )
        assert state.tokens[1] == len(encode(text))
        for _ in range(3):
            edits = []
            for _ in range(rng.randint(0, 6)):
                start = rng.randint(0, len(state.text) + 2)
                edits.append((start, start + rng.choice([0, 1, 5, 400]), "".join(rng.choices(bits, k=rng.choice([0, 1, 3, 200])))))
            want, count = plain(state.text, edits)
            assert token_tree.edited(state, [dict(zip(("start", "end", "text"), e, strict=True)) for e in edits]) == count
            assert state.text == want
            assert state.tokens[1] == len(encode(want)) and state.chars[1] == len(want)
            half = len(state.chars) // 2
            assert all(state.tokens[k] == state.tokens[2 * k] + state.tokens[2 * k + 1] for k in range(1, half))


def test_few_characters_are_encoded_anew(encode):
    text = " ".join(f"word{k}" for k in range(5000))
    cut = re.compile(token_tree.CUT)
    leaves = token_tree.leaves_of(text, cut)
    state = token_tree.Text(
        text, token_tree.sums([len(x) for x in leaves]), token_tree.sums([len(encode(x)) for x in leaves]), encode, cut
    )
    token_tree.edited(state, [{"start": 20_000, "end": 20_003, "text": "new"}])
    assert state.encoded < 600 and state.tokens[1] == len(encode(state.text))


def test_query(spark, encode, texts):
    rows = queries.op9_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id]
        after, edits = re.subn(queries.PRIVATE, queries.REMOVED, text)
        assert (row.n_chars, row.n_tokens, row.n_edits) == (len(text), len(encode(text)), edits)
        assert row.n_tokens_after == len(encode(after))
        assert bool(edits) == bool(row.n_chars_encoded) and row.n_chars_encoded <= edits * len(after)
    assert sum(r.n_edits for r in rows) > 10


def test_odd_rows(spark, vocabulary, encode, odd_docs, no_docs):
    def counted(frame, edits):
        out = frame.withColumn("tree", token_tree.tree(F.col("text"), vocabulary))
        return out.withColumn("after", token_tree.edit_tree(F.col("text"), F.col("tree"), edits, vocabulary))

    none = F.lit(None).cast("array<struct<start:int,end:int,text:string>>")
    for row in counted(odd_docs, none).collect():
        assert row.tree.tokens[1] == len(encode(row.text or "")) == row.after.tokens[1]
        assert (row.after.text, row.after.applied) == (row.text or "", 0)
    given = spark.createDataFrame(
        [(k, 0, 3, "new ") for k in range(1, 10)] + [(1, 5, 6, None), (1, 2, 9, "overlaps"), (None, 0, 1, "x")],
        "doc_id bigint, start int, end int, text string",
    )
    edits = token_tree.gathered(given).withColumnRenamed("doc_id", "of")
    joined = odd_docs.join(edits, F.col("doc_id") == F.col("of"), "left")
    rows = counted(joined, F.col("edits")).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        own = [(e.start, e.end, e.text) for e in row.edits or []]
        text, count = plain(row.text or "", own)
        assert (row.after.text, row.after.applied) == (text, count)
        assert row.after.tokens[1] == len(encode(text))
    assert counted(no_docs, none).count() == 0


def test_edits_without_a_place(spark, vocabulary, encode):
    """An edit that is null, or has no start or end, is left out; the others are applied."""
    edits = [(4, 7, "NEW"), (None, 2, "x"), (1, None, "y"), (None, None, None), None]
    frame = spark.createDataFrame(
        [(1, "abc def ghi", edits)], "doc_id bigint, text string, edits array<struct<start:int,end:int,text:string>>"
    )
    out = frame.withColumn("tree", token_tree.tree(F.col("text"), vocabulary))
    out = out.select(token_tree.edit_tree(F.col("text"), F.col("tree"), F.col("edits"), vocabulary).alias("after"))
    after = out.first().after
    assert (after.text, after.applied) == ("abc NEW ghi", 1)
    assert after.tokens[1] == len(encode(after.text))
