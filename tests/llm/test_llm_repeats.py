"""Operator 2 against a plain pass over the texts in order."""

import re

from conftest import LONG, PROSE

from ringlog.llm import queries, repeats


def word_list(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def plain(texts, least=8):
    """Units of each line in order; a unit's key are the words it is hashed with, and its place there."""
    seen, result = {}, {}
    for doc, text in sorted(texts.items()):
        units = []
        for line in re.finditer(r"[^\n]+", text):
            parts = [
                (line.start() + m.start(), word_list(m[0]))
                for m in re.finditer(r"[^.!?]+", line[0])
                if word_list(m[0])
            ]
            for u, (at, words) in enumerate(parts):
                k, around = u, list(words)
                while len(around) < least and k:
                    k -= 1
                    around = parts[k][1] + around
                offset = len(around) - len(words)
                v = u
                while len(around) < least and v + 1 < len(parts):
                    v += 1
                    around = around + parts[v][1]
                first = re.search(r"[0-9a-z\x80-\U0010ffff]", text[at:].lower()).start()
                units.append((at + first, (tuple(around), offset, len(words))))
        ends = [start for start, _ in units[1:]] + [len(text)]
        merged, kept = [], set()
        for (start, key), end in zip(units, ends, strict=True):
            if key not in seen:
                seen[key] = doc
                continue
            kept.add(seen[key])
            if merged and start <= merged[-1][1]:
                merged[-1][1] = end
            else:
                merged.append([start, end])
        if merged:
            rest = text
            for start, end in reversed(merged):
                rest = rest[:start] + rest[end:]
            result[doc] = (merged, sorted(kept), rest)
    return result


def test_query(spark, texts):
    rows = queries.op2_repeats(spark, "/root/testdata/sf0.001").collect()
    found = {r.doc_id: ([[s.start, s.end] for s in r.removed], r.kept_ids, r.text) for r in rows}
    assert found == plain(texts)
    assert len(found) == len(rows) > 0


def test_passage_within_lines(spark):
    """A passage of over fifty words, in the middle of a line, goes from all texts but one."""
    passage = " ".join(f"Sentence {k} has words {k * k} that nobody else wrote here." for k in range(8))
    rows = [(k, f"Some start of text {k} {passage} and an end {k}") for k in (5, 3, 9)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    result = {r.id: r for r in found.collect()}
    assert set(result) == {5, 9}
    for row in result.values():
        assert row.kept_ids == [3]
        assert len(row.text) < 120


def cleaned(spark, rows, schema="doc_id bigint, text string"):
    found = repeats.without_repeats(spark.createDataFrame(rows, schema))
    return {r.id: (r.text, r.kept_ids) for r in found.collect()}


def test_short_lines(spark):
    """A line that repeats goes, however short, and its neighbours stay."""
    rows = [(k, f"The start of text {k}\nall rights reserved\nand its end {k}") for k in range(4)]
    found = cleaned(spark, rows)
    assert found == {k: (f"The start of text {k}\nand its end {k}", [0]) for k in (1, 2, 3)}


def test_what_stays_is_whole(spark):
    """Sentences of four words in overlapping rows: each stays in the document that is named."""
    x, y, z = "One two three four.", "Five six seven eight.", "Nine ten eleven twelve."
    texts = {0: f"{y} {z}", 1: f"{x} {y} {z}", 2: f"{x} {y}"}
    found = cleaned(spark, list(texts.items()))
    assert found == {1: (f"{x} {y} ", [0]), 2: ("", [1])}


def test_kept_documents_hold_what_was_removed(spark, texts):
    """Whatever was removed still stands in the result of a document that is named."""
    rows = queries.op2_repeats(spark, "/root/testdata/sf0.001").collect()
    after = texts | {r.doc_id: r.text for r in rows}
    joined = {k: f" {' '.join(word_list(t or ''))} " for k, t in after.items()}
    for row in rows:
        for span in row.removed:
            for part in re.split(r"[.!?\n]", texts[row.doc_id][span.start : span.end]):
                words = " ".join(word_list(part))
                assert not words or any(f" {words} " in joined[k] for k in row.kept_ids)


def test_text_ids(spark):
    rows = [("b", "Some words that stand here twice, or so."), ("a", "Some words that stand here twice, or so.")]
    assert cleaned(spark, rows, "doc_id string, text string") == {"b": ("", ["a"])}


def test_large_and_negative_ids(spark):
    text = "Some words that stand here more than once."
    rows = [(k, text) for k in (2**63 - 1, -(2**63), 0, None)]
    assert cleaned(spark, rows) == {k: ("", [-(2**63)]) for k in (2**63 - 1, 0, None)}


def test_same_id_other_text(spark):
    """Of one id with two texts, a passage stays in one."""
    line = "Some words that stand here more than once"
    found = repeats.without_repeats(
        spark.createDataFrame([(1, line), (1, f"{line}\nand more")], "doc_id bigint, text string")
    )
    assert [r.kept_ids for r in found.collect()] == [[1]]


def test_odd_rows(odd_docs, no_docs):
    rows = repeats.without_repeats(odd_docs).collect()
    # The row of id 2 is there twice, as in the table. The long text is one unit.
    assert sorted((r.id or 0, r.text, r.kept_ids) for r in rows) == [
        (0, "", [1]),
        (2, "", [1]),
        (2, "", [1]),
    ]
    assert LONG and PROSE
    assert repeats.without_repeats(no_docs).count() == 0
