"""Operator 6: held-out accuracy, spans, and the search against one without arrays."""

import zlib

import numpy as np
import pytest

from ringlog.llm import languages, queries


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return languages.fit(docs.where(~queries.held_out()))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_languages(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_documents_teach_nothing(spark):
    frame = spark.createDataFrame(
        [(k, "abc def", "xx" if zlib.crc32(str(k).encode()) % 4 == 2 else "en") for k in range(40)],
        "doc_id bigint, text string, lang string",
    )
    assert languages.fit(frame.where(~queries.held_out())).languages == ["en"]


def test_spans_of_a_mixed_text(spark, model, docs):
    rows = docs.where("n_chars between 1500 and 2500").collect()
    one = {lang: next(r.text for r in rows if r.lang == lang)[:600] for lang in ("fr", "de")}
    text = one["fr"] + " 12 -- " + one["de"]
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    spans = languages.identify(frame, model).first().spans
    assert [s.lang for s in spans] == ["fr", "de"]
    assert abs(spans[0].end - 600) < 40 and abs(spans[1].start - 607) < 40
    assert spans[1].end <= len(text)


def plain_viterbi(scores, switch):
    best, back = scores[0].astype(float), []
    for row in scores[1:]:
        came = [max(range(len(row)), key=lambda k, s=s: (best[k] - switch * (k != s), k == s)) for s in range(len(row))]
        best = np.array([best[k] - switch * (k != s) + row[s] for s, k in enumerate(came)])
        back.append(came)
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1], best.max()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    sizes = np.array([0, 7, 1, 30, 0, 12, 30, 2])
    scores = rng.normal(0, 3, (int(sizes.sum()), 4))
    labels = languages.viterbi(scores, sizes, 4.0)
    at = 0
    for size in sizes:
        if size:
            part, own = scores[at : at + size], labels[at : at + size]
            value = part[np.arange(size), own].sum() - 4.0 * (own[1:] != own[:-1]).sum()
            assert value == pytest.approx(plain_viterbi(part, 4.0)[1])
        at += size


def test_long_texts_are_cut_at_spaces(model, monkeypatch):
    letters = np.unpackbits(np.frombuffer(model.letters, np.uint8), count=languages.CODES).astype(bool)
    scripts = languages.script_table()
    texts = ["the and of " * 50, None, "x" * 90, "", "und die das " * 20, "  "]
    whole = languages.scored(texts, model, letters, scripts)
    monkeypatch.setattr(languages, "PIECE_CHARS", 100)
    parts = languages.scored(texts, model, letters, scripts)
    for name in ("starts", "sizes", "scripts", "per_text"):
        assert (getattr(whole, name) == getattr(parts, name)).all()
    assert np.allclose(whole.scores, parts.scores)
    monkeypatch.setattr(languages, "PIECE_CHARS", 7)
    assert sum(languages.scored(["x" * 90], model, letters, scripts).sizes) == 90


def test_odd_rows(odd_docs, no_docs, model):
    rows = languages.identified(odd_docs, model, "text", "said").collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        if not any(c.isalpha() for c in row.text or ""):
            assert (row.said.lang, row.said.score, row.said.spans) == ("und", 0.0, [])
        else:
            assert row.said.lang in model.languages and 0 < row.said.score <= 1
            for span in row.said.spans:
                assert row.text[span.start].isalpha() and row.text[span.end - 1].isalpha()
    assert languages.identified(no_docs, model, "text", "said").count() == 0


def test_unknown_script_and_no_labels(spark, model, no_docs, odd_docs):
    frame = spark.createDataFrame([(1, "漢字漢字"), (2, "the and of")], "doc_id bigint, text string")
    found = {r.id: r for r in languages.identify(frame, model).collect()}
    assert found[1].lang in model.languages and found[1].score == 0.0
    assert found[2].lang == "en" and found[2].score == 1.0
    empty = languages.fit(no_docs)
    assert empty.languages == []
    assert {r.lang for r in languages.identify(odd_docs, empty).collect()} == {"und"}
