"""The pipeline against its stages in plain Python, as far as they go."""

import re

import sentencepiece
from test_llm_simhash import plain_components, plain_print

import corpus_pipeline
from ringlog.llm import decontaminate, queries


def test_stages(spark, tmp_path, texts):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, kept[-1], sf_dir).write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert all(frame.columns == columns for frame in kept[:-1])
    ids = [{r.doc_id for r in frame.select("doc_id").collect()} for frame in kept]
    # 6: every document has a letter and is in a language.
    assert ids[1] == ids[0]
    # 7: the smallest id of each group.
    groups = plain_components({k: plain_print(texts[k]) for k in ids[1]}, 2)
    assert ids[2] == {k for k in ids[1] if groups[k] == k} != ids[1]
    # 8: what the exact search finds goes.
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    gone = {k for k in ids[2] for item in bench if item.text.lower() in texts[k].lower()}
    assert gone and gone <= ids[2] - ids[3]
    matched = {r.doc_id for r in decontaminate.matches(kept[2], spark.createDataFrame(bench)).collect()}
    assert ids[3] == ids[2] - matched
    # 3: no document goes, keys do.
    assert ids[4] == ids[3] == ids[5]
    clean = {r.doc_id: r for r in kept[4].collect()}
    for k, row in clean.items():
        assert row.n_chars == len(row.text)
        assert not re.search(r"[0-9a-f]{24,}", row.text)
        if not re.search(r"[0-9a-f]{24,}|token", texts[k]):
            assert row.text == texts[k]
    assert all(("[secret]" in clean[k].text) == (clean[k].text != texts[k]) for k in clean)
    # 1: as the library does it.
    library = sentencepiece.SentencePieceProcessor(model_file=f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    for row in kept[5].collect():
        assert row.ids == library.encode(clean[row.doc_id].text) and row.round_trip
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, kept[5].collect()))


def test_odd_rows(spark, odd_docs, no_docs):
    sf_dir = "/root/testdata/sf0.001"
    for docs, ids in ((odd_docs, [1, 5, 7, 9]), (no_docs, [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert set(docs.columns) == set(odd_docs.columns)
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == ids


def test_no_labels(spark):
    frame = spark.createDataFrame(
        [(1, "words", None), (2, "123", None), (3, None, None)], "doc_id bigint, text string, lang string"
    )
    assert [r.doc_id for r in corpus_pipeline.in_a_language(spark, frame, "").collect()] == [1]


def test_keys_are_marked(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.without_secrets(spark, docs, sf_dir).collect()
    old = {r.doc_id: r.text for r in docs.collect()}
    marked = [r for r in rows if r.text != old[r.doc_id]]
    assert {r.doc_id for r in marked} >= {k for k, t in old.items() if re.search(r"[0-9a-f]{24,}", t)}
    assert marked and all("[secret]" in r.text and r.n_chars == len(r.text) for r in marked)
