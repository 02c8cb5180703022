"""License notices by an exact set-similarity join with templates (operator 4).

A text block (a line, or a paragraph of lines) has a template if it contains at
least `threshold` of the template's different words. The tokens of all templates
are put in order by the number of documents that have them, rarest first, counted
over all documents. A block with enough of a template has one of the template's
first (size - needed + 1) tokens in that order, so only these prefixes are looked
up. A candidate then needs a block of enough tokens (length filter), and at each
shared token enough tokens left on both sides (positional filter). What remains
is counted exactly. Templates are few and fixed; the documents are read twice and
never moved.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

#: Phrases that name a license wherever their words stand in a row.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Notices as their licenses publish them.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy"
        " of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files, to deal in the Software without"
        " restriction",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with"
        " or without fee is hereby granted",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels array<string>, "
    "blocks array<struct<label:string,start:int,end:int,containment:double>>"
)


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8. Bytes know ASCII only: of a lower() just A-Z change."""
    return re.findall(WORD, text.encode().lower())


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of a phrase stand in a row."""
    found, at, size = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return found
        if words[at : at + size] == phrase:
            found.append(at)


@dataclass
class Index:
    """The templates with their tokens in order, and which of them have a token in front."""

    labels: list[str]
    tokens: list[list[bytes]]
    needed: list[int]
    rank: dict[bytes, int]
    prefixes: dict[bytes, list[int]]


def template_tokens(templates=TEMPLATES) -> list[set[bytes]]:
    return [set(words_of(text)) for _, text in templates]


def index(counts: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> Index:
    sets = template_tokens(templates)
    order = sorted(set().union(*sets), key=lambda token: (counts.get(token, 0), token))
    rank = {token: k for k, token in enumerate(order)}
    tokens = [sorted(tokens, key=rank.__getitem__) for tokens in sets]
    needed = [max(1, -int(-threshold * len(t) // 1)) for t in tokens]
    prefixes: dict[bytes, list[int]] = defaultdict(list)
    for k, (ordered, least) in enumerate(zip(tokens, needed, strict=True)):
        for token in ordered[: len(ordered) - least + 1]:
            prefixes[token].append(k)
    return Index([label for label, _ in templates], tokens, needed, rank, dict(prefixes))


def join_block(found: Index, block: set[bytes]) -> list[tuple[int, float]]:
    """(template, containment) of all templates that the block has enough of."""
    here = sorted((token for token in block if token in found.rank), key=found.rank.__getitem__)
    result = []
    for k in sorted({k for token in here for k in found.prefixes.get(token, ())}):
        wanted, needed = found.tokens[k], found.needed[k]
        if len(here) < needed:
            continue
        i = j = shared = 0
        while i < len(wanted) and j < len(here):
            if shared + min(len(wanted) - i, len(here) - j) < needed:
                break
            a, b = found.rank[wanted[i]], found.rank[here[j]]
            shared += a == b
            i, j = i + (a <= b), j + (b <= a)
        if shared >= needed:
            result.append((k, shared / len(wanted)))
    return result


def blocks_of(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every line that is not blank, and of every paragraph of several lines."""
    at, first, lines = 0, 0, 0
    for line in [*text.split("\n"), ""]:
        end = at + len(line)
        if line.strip():
            yield at, end
            first = first if lines else at
            lines += 1
        else:
            if lines > 1:
                yield first, min(at, len(text) + 1) - 1
            lines = 0
        at = end + 1


def document(found: Index, text: str | None) -> dict:
    """What the scan says about one text; a null text counts as empty."""
    text = text or ""
    words = words_of(text)
    here = set(words)
    starts, labels = [], set()
    for label, phrase in PHRASES:
        parts = phrase.encode().split()
        if here.issuperset(parts):
            at = places(words, parts)
            starts += at
            labels |= {label} if at else set()
    blocks = []
    if not here.isdisjoint(found.prefixes):
        for start, end in blocks_of(text):
            for k, share in join_block(found, set(words_of(text[start:end]))):
                blocks.append(
                    {"label": found.labels[k], "start": start, "end": end, "containment": share}
                )
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": sorted(labels),
        "blocks": blocks,
    }


def token_counts(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each token of a template stands; a row for each token at most."""
    wanted = set().union(*template_tokens(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for part in slices(batches, "text"):
            for text in part.column(0).to_pylist():
                counts.update(wanted.intersection(words_of(text or "")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            ["token", "n"],
        )

    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token binary, n bigint")
    total = partial.groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(row.token): row.n for row in total.collect()}


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates=TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, blocks) of every row.

    base_labels and the word numbers (from 0) are those of PHRASES, n_base their
    places in all. blocks are the lines and paragraphs that have enough of a
    template, in code points with the end exclusive. A null or empty text has no
    words; rows that repeat are scanned one by one.
    """
    found = index(token_counts(docs, text_col, templates), templates, threshold)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    result = pa.schema(
        [
            ("n_words", pa.int64()),
            ("n_base", pa.int64()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("base_labels", pa.list_(pa.string())),
            (
                "blocks",
                pa.list_(
                    pa.struct(
                        [
                            ("label", pa.string()),
                            ("start", pa.int32()),
                            ("end", pa.int32()),
                            ("containment", pa.float64()),
                        ]
                    )
                ),
            ),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            done = [document(found, text) for text in part.column("text").to_pylist()]
            table = pa.RecordBatch.from_pylist(done, result)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *table.columns], ["id", *result.names]
            )

    return rows.mapInArrow(run, f"id {kind}, {RESULT}")


def digest_columns() -> list:
    """Labels and score of a scanned frame; a base phrase that stands there whole scores 1."""
    labels = F.array_sort(
        F.array_distinct(F.concat("base_labels", F.transform("blocks", lambda b: b["label"])))
    )
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return [
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    ]
