"""Operator 1 against the library that the model files are made for."""

import random

import pytest
import sentencepiece
from conftest import LONG
from pyspark.sql import functions as F

from ringlog.llm import pieces, queries

PATH = f"{queries.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts_as_the_library(model, library):
    rng = random.Random(5)
    letters = "ab  the\n\tçé漢😀0019▁.,'ing"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(4000)]
    texts += [" " * k + "the" for k in range(40)] + ["a" * 500, " " * 300, "<s> <0x0A>", "a\0b", "", None]
    search = pieces.Search(model)
    values, counts = pieces.encode_texts(model, search, pieces.word_pattern(model), texts)
    ends = counts.cumsum()
    found = [values[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
    assert found == [library.encode(t) if t else [] for t in texts]


def test_unigram_is_the_best_sum(model):
    """By trying every segmentation."""
    names = ["<unk>", "▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab"]
    scores = [0.0, -2.0, -2.5, -3.0, -3.1, -4.0, -4.2, -4.3, -5.0]
    kinds = [pieces.UNKNOWN] + [pieces.NORMAL] * 8
    small = pieces.Model(names, scores, kinds)

    def best(word):
        if not word:
            return 0.0
        return max(
            (scores[names.index(word[:k])] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in names[1:]),
            default=float("-inf"),
        )

    search = pieces.Search(small)
    for word in sorted({"▁" + "".join(random.Random(k).choices("ab", k=k % 9)) for k in range(60)}):
        ids = search.encode(word)
        assert "".join(names[k] for k in ids) == word
        assert sum(scores[k] for k in ids) == pytest.approx(best(word))


def test_columns(spark, model, library, odd_docs, no_docs):
    def coded(frame):
        out = frame.withColumn("ids", pieces.encode(F.col("text"), model))
        return out.withColumn("back", pieces.decode(F.col("ids"), model))

    rows = coded(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        assert row.ids == (library.encode(row.text) if row.text else [])
        assert row.back == (row.text or "")
    assert any(row.text == LONG for row in rows)
    assert coded(no_docs).count() == 0
    checked = odd_docs.select("text", pieces.encode_checked(F.col("text"), model).alias("c")).collect()
    assert [(r.c.ids, r.c.round_trip) for r in checked] == [
        (library.encode(r.text) if r.text else [], True) for r in checked
    ]
    null = spark.range(1).select(pieces.decode(F.lit(None).cast("array<int>"), model).alias("t"))
    assert null.first().t is None


def test_query(spark, library, texts):
    rows = queries.op1_pieces(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.ids for r in rows} == {k: library.encode(t) for k, t in texts.items()}
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in rows)


def test_models_that_rewrite_texts_are_refused(tmp_path):
    # A model of one piece whose normaliser takes away spaces.
    data = b"\x0a\x07\x0a\x01a\x18\x02" + b"\x1a\x02\x20\x01"
    path = tmp_path / "own.model"
    path.write_bytes(data.replace(b"\x0a\x07", b"\x0a\x05"))
    with pytest.raises(ValueError, match="normalise"):
        pieces.read_model(str(path))
