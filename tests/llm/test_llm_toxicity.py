"""Operator 13: the kernel against a plain count, and what a trained model says."""

from itertools import combinations

import numpy as np
import pytest

from ringlog.llm import queries, toxicity

INSULTS = ["idiot", "moron", "scoundrel", "blockhead"]
SYLLABLES = ["ther", "an", "ing", "wo", "be", "li", "ness", "sta", "per", "mo", "on", "sh", "rid"]


def plain_kernel(a, b):
    """Sum over common subsequences of the decays of both, scaled by each one's own weights."""

    def counts(text):
        edged = f"^{text}$"
        found, norm = {}, 0.0
        for start in range(len(edged)):
            for rest in combinations(range(start + 1, len(edged)), toxicity.ORDER - 1):
                if rest[-1] - start < toxicity.SPAN:
                    key = "".join(edged[k] for k in (start, *rest))
                    weight = toxicity.DECAY ** (rest[-1] - start - toxicity.ORDER + 1)
                    found[key] = found.get(key, 0) + weight
                    norm += weight * weight
        return found, norm**0.5

    (x, m), (y, n) = counts(a), counts(b)
    return sum(x[key] * y.get(key, 0) for key in x) / (m * n)


def test_kernel():
    strings = ["idiot", "idixot", "banana", "ananas", "ab", "diotidiot", "straße"]
    letters = np.unique(np.frombuffer("".join(strings).encode("utf-32-le"), "<u4"))
    row, code, weight = toxicity.subsequences(toxicity.coded(strings, letters), len(letters) + 3)
    table = np.zeros((len(strings), len(np.unique(code))))
    np.add.at(table, (row, np.unique(code, return_inverse=True)[1]), weight)
    want = [[plain_kernel(a, b) for b in strings] for a in strings]
    np.testing.assert_allclose(table @ table.T, want, atol=1e-12)


def test_words_and_pieces():
    assert toxicity.words("You i d i o t, say") == {"you", "i", "d", "o", "t,", "idiot,", "say"}
    assert toxicity.words("i. d. i. o. t.") >= {"i.d.i.o.t."}
    assert toxicity.pieces("i-d-i.o_t!") == ["idiot"] and toxicity.pieces("--") == []
    long = "".join(chr(97 + k % 26) for k in range(100))
    parts = toxicity.pieces(long)
    assert all(len(part) <= 24 for part in parts) and all(long[k : k + 12] in "".join(parts) for k in range(0, 88, 12))
    assert toxicity.sentences("One. Two!\nThree") == ["One.", "Two!", "Three"]


def made_docs(count, seed):
    rng = np.random.default_rng(seed)
    docs = []
    for k in range(count):
        words = ["".join(rng.choice(SYLLABLES, 1 + rng.integers(3))) for _ in range(60)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for insult in rng.choice(INSULTS, 2, replace=False):
                words[rng.integers(len(words))] = insult
        docs.append((k, " ".join(words) + ".", toxic))
    return docs


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(made_docs(600, 1), "doc_id bigint, text string, toxic int")
    return toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))


def test_unseen_documents(model):
    docs = made_docs(400, 2)
    scores = model.scores([text for _, text, _ in docs], {})
    toxic = np.array([label == 1 for *_, label in docs])
    assert (scores[toxic] >= toxicity.TOXIC).mean() >= 0.98
    assert (scores[~toxic] < toxicity.TOXIC).mean() >= 0.98


def test_gaps_and_insertions(model):
    clean = "the other thing rests on "
    forms = ["idiot", "i.d.i.o.t", "i d i o t", "IDIOT!!", "id-iot", "idixot", "mor*on", "blockzhead"]
    bad = model.scores([clean + form + " here" for form in forms], {})
    base = model.scores([clean + "here", "", None], {})
    assert (bad > base[0]).all() and (bad[:5] >= toxicity.TOXIC).all()
    assert (base < toxicity.TOXIC).all() and base[1] == base[2]


def test_scores_do_not_depend_on_batches(model):
    texts = [text for _, text, _ in made_docs(50, 3)]
    together = model.scores(texts, {})
    known = {}
    np.testing.assert_array_equal(together, [model.scores([text], known)[0] for text in texts])


def test_odd_rows(spark, odd_docs, no_docs, model):
    found = odd_docs.withColumn("score", toxicity.score(odd_docs["text"], model)).collect()
    assert len(found) == odd_docs.count() and all(0 <= row.score <= 1 for row in found)
    assert no_docs.withColumn("score", toxicity.score(no_docs["text"], model)).count() == 0


def test_labels_of_one_kind_or_none(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    assert toxicity.fit(odd_docs, labels).scores(["x"], {})[0] == pytest.approx(1)
    assert toxicity.fit(odd_docs, labels.limit(0)).scores(["x", None], {}) == pytest.approx([0, 0], abs=1e-6)
    assert toxicity.fit(no_docs, labels).scores(["x"], {})[0] == pytest.approx(1)
    mixed = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (5, 0), (9, 1)], "doc_id bigint, toxic int")
    scores = toxicity.fit(odd_docs, mixed).scores(["x", "", None], {})
    assert ((scores >= 0) & (scores <= 1)).all()


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op13_toxicity(spark, sf_dir)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null")
    rows = found.join(labels, "doc_id", "left").select("score", "predicted", "held_out", "toxic").collect()
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.3) for r in rows)
    # A third of the toxic documents of this small table show no insult at all.
    held = [r for r in rows if r.held_out and r.toxic is not None]
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in held if r.toxic) >= 0.6 * (len(held) - len(clean))
    assert sum(r.predicted for r in clean) <= 0.08 * len(clean)
