"""Operator 4 against a join that compares every block with every template."""

import random
import re

from ringlog.llm import licenses, queries


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_base(text):
    words, places, labels = plain_words(text), [], set()
    for label, phrase in licenses.PHRASES:
        parts = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return words, places, labels


def plain_blocks(text):
    found, lines, run = set(), (text or "").split("\n"), []
    at = 0
    for line in [*lines, ""]:
        if line.strip():
            found.add((at, at + len(line)))
            run.append((at, at + len(line)))
        else:
            if len(run) > 1:
                found.add((run[0][0], run[-1][1]))
            run = []
        at += len(line) + 1
    return found


def test_join_finds_every_block(spark):
    rng = random.Random(11)
    notices = [text for _, text in licenses.TEMPLATES]
    texts = []
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(0, 5)):
            words = rng.choice(notices).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["foo", "the", "License", "É"])
            cut = rng.randint(1, len(words))
            lines += [" ".join(words[:cut]), " ".join(words[cut:])] if rng.random() < 0.5 else [" ".join(words)]
            if rng.random() < 0.3:
                lines.append("")
        texts.append("\n".join(lines))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.id: r for r in licenses.scan(frame).collect()}
    hits = 0
    for k, text in enumerate(texts):
        want = set()
        for start, end in plain_blocks(text):
            block = set(plain_words(text[start:end]))
            for label, notice in licenses.TEMPLATES:
                wanted = set(plain_words(notice))
                share = len(wanted & block) / len(wanted)
                if len(wanted & block) >= licenses.THRESHOLD * len(wanted):
                    want.add((label, start, end, round(share, 9)))
        got = {(b.label, b.start, b.end, round(b.containment, 9)) for b in rows[k].blocks}
        assert got == want, text
        hits += len(want)
        words, places, labels = plain_base(text)
        assert (rows[k].n_words, rows[k].n_base) == (len(words), len(places))
        assert rows[k].first_word == min(places, default=None)
        assert rows[k].last_word == max(places, default=None)
        assert rows[k].base_labels == sorted(labels)
    assert hits > 300


def test_query(spark, texts):
    rows = queries.op4_licenses(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for row in rows:
        words, places, labels = plain_base(texts[row.doc_id])
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert labels <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1
    assert any(row.labels for row in rows)


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_base == 0 and r.blocks == [] and r.first_word is None for r in rows)
    assert sorted(r.n_words for r in rows)[-1] == 60_000
    assert licenses.scan(no_docs).count() == 0
