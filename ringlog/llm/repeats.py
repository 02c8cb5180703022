"""Passages that repeat within and across documents (operator 2).

A text is cut at line ends and at the ends of sentences into units, which do not
overlap. What is hashed are a unit's words, lower-cased and without punctuation, and,
if they are fewer than `least_words`, those of the units around it in its line: of as
many before it as it takes, or, near the start of the line, of the first units that
have so many words. A line of fewer words is hashed whole, however short it is. So a
line that repeats goes whole, a passage in the middle of a line goes too, and a few
words within a sentence's reach count only together with their neighbours.

128-bit digests are grouped over all documents; of units with equal digests the first,
by document id and then by place, stays, and the others are removed from their texts.
As units do not overlap, what stays is never cut by another removal.

Digests are counted before they are shuffled, and joined back from the side of
the units, so a passage that very many documents share is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .decontaminate import BASE, INVERSE, mixed, powers, words_of
from .scratch import written

#: Words that a digest covers at least, if the line has so many.
LEAST_WORDS = 8
#: Bytes that end a unit, and the one that ends a line.
ENDS = b".!?\n"
LINE_END = ord("\n")
SECOND = np.uint64(0xD1B54A32D192ED03)
OFFSET, LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def units(texts: list[str | None], least_words: int) -> dict[str, np.ndarray]:
    """text, k1, k2, start and end (code points) of every unit.

    All at once: a digest is a sum over words, taken from the sums over all words,
    with the unit's place and length among these words mixed in.
    """
    words = words_of(texts)
    count = len(words.hashes)
    codes = np.frombuffer(words.data, np.uint8)
    ended = np.zeros(256, bool)
    ended[list(ENDS)] = True
    other = np.ones(count, bool)
    other[1:] = words.text[1:] != words.text[:-1]

    def beginnings(ends: np.ndarray) -> np.ndarray:
        number = np.cumsum(ends)[words.starts] if count else np.empty(0, np.int64)
        new = other.copy()
        new[1:] |= number[1:] != number[:-1]
        return np.flatnonzero(new)

    begins = np.append(beginnings(ended[codes]), count)
    lines = np.append(beginnings(codes == LINE_END), count)
    first, stop = begins[:-1], begins[1:]
    line = np.searchsorted(lines, first, side="right") - 1
    line_first, line_stop = lines[line], lines[np.minimum(line + 1, len(lines) - 1)]
    # The words hashed: up to the unit's end, or from the start of its line.
    before = begins[np.maximum(np.searchsorted(begins, stop - least_words, side="right") - 1, 0)]
    before = np.minimum(before, first)
    early = (before < line_first) | (stop - before < least_words)
    reach = begins[np.minimum(np.searchsorted(begins, line_first + least_words), len(first))]
    since = np.where(early, line_first, before)
    until = np.where(early, np.maximum(np.minimum(reach, line_stop), stop), stop)
    power, back = powers(count + 1, BASE), powers(count + 1, INVERSE)
    place = (first - since).astype(np.uint64) * OFFSET + (stop - first).astype(np.uint64) * LENGTH
    keys = []
    for hashes in (words.hashes, mixed(words.hashes + SECOND)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:count])))
        whole = mixed((sums[until] - sums[since]) * back[since])
        keys.append(mixed(whole + place).view(np.int64))
    # Up to the word that comes next in the text, or to the text's end.
    sizes = np.append(words.begins[1:], len(words.data) + 1) - 1
    text = words.text[first]
    inside = words.left[first] > stop - first
    after = np.where(inside, np.append(words.starts, 0)[np.minimum(stop, count)], sizes[text])
    points = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))
    zero = points[words.begins[text]]
    return {
        "text": text,
        "k1": keys[0],
        "k2": keys[1],
        "start": points[words.starts[first]] - zero,
        "end": points[after] - zero,
    }


def unit_rows(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(id, check, k1, k2, start, end) of all units; check is the text's CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2_000_000):
            found = units(part.column("text").to_pylist(), least_words)
            rows = pa.array(found["text"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(rows),
                    part.column("check").take(rows),
                    pa.array(found["k1"], pa.int64()),
                    pa.array(found["k2"], pa.int64()),
                    pa.array(found["start"], pa.int32()),
                    pa.array(found["end"], pa.int32()),
                ],
                ["id", "check", "k1", "k2", "start", "end"],
            )

    rows = _checked(docs, id_col, text_col).where("text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, check bigint, k1 bigint, k2 bigint, start int, end int"
    )


def _checked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, check, text): whole numbers as bigint, other ids in their own type."""
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    key = F.col(id_col).cast("bigint") if whole else F.col(id_col)
    return docs.select(
        key.alias("id"), check(text_col).alias("check"), F.col(text_col).alias("text")
    )


def check(text_col: str) -> Column:
    return F.crc32(F.col(text_col).cast("binary"))


def _rank(rows: DataFrame) -> Column:
    """Id, place and text in order, ids that are null last.

    For whole numbers this is one number, which a hash aggregate can take the least of.
    """
    if not isinstance(rows.schema["id"].dataType, T.LongType):
        return F.struct(F.col("id").isNull().alias("none"), "id", "start", "check")
    beyond = F.lit(Decimal(1 << 63)).cast("decimal(19,0)")
    number = F.coalesce(F.col("id").cast("decimal(19,0)"), beyond) * beyond
    place = F.col("start").cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)")
    return number + place + F.col("check").cast("decimal(10,0)")


def repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(id, check, start, end, kept_id): every unit that is removed, and where its like stays.

    Rows that repeat id and text are one document; so are rows without an id that
    repeat a text, and these come after all others. A null text has no unit. kept_id is
    null where the unit stays in a document without an id.
    """
    rows = unit_rows(docs, id_col, text_col, least_words)
    rows = rows.withColumn("rank", _rank(rows))
    groups = rows.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.min("id").alias("kept_id")
    )
    # Written first: a join of the units with what is read again, not with the
    # aggregate that lies by the same key, is one that adaptive execution can cut.
    groups = written(groups.where("n > 1").drop("n"), "repeated")
    return (
        rows.join(groups, ["k1", "k2"])
        .where("rank > first")
        .select("id", "check", "start", "end", "kept_id")
    )


REMOVED = "array<struct<start:int,end:int>>"


def _without(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Texts without their spans, and the spans where they overlap or touch made one."""
    kind = pa.struct(
        [
            ("text", pa.string()),
            ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )
    for texts, spans in columns:
        found = []
        for text, cuts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            merged: list[list[int]] = []
            for start, end in sorted((cut["start"], cut["end"]) for cut in cuts):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            edges = [0, *(edge for span in merged for edge in span), len(text)]
            kept = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            found.append(
                {"text": kept, "removed": [{"start": a, "end": b} for a, b in merged]}
            )
        yield pa.array(found, kind)


_without.__annotations__ = {
    "columns": Iterator[tuple[pa.Array, ...]],
    "return": Iterator[pa.Array],
}


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(id, text, removed, kept_ids), one row per document that repeats something.

    text is what stays; removed are the spans taken out, in code points of the
    original text with the end exclusive; kept_ids are the documents in which these
    passages stay, without null ids. All other documents stay as they are and have no row.
    """
    spans = (
        repeated(docs, id_col, text_col, least_words)
        .groupBy("id", "check")
        .agg(
            F.collect_set(F.struct("start", "end")).alias("spans"),
            F.array_sort(F.collect_set("kept_id")).alias("kept_ids"),
        )
    )
    rows = _checked(docs, id_col, text_col)
    same = F.col("t.id").eqNullSafe(F.col("s.id")) & (F.col("t.check") == F.col("s.check"))
    joined = rows.alias("t").join(spans.alias("s"), same).select("t.id", "text", "spans", "kept_ids")
    kind = f"struct<text:string,removed:{REMOVED}>"
    found = joined.withColumn("found", F.arrow_udf(_without, kind)(F.col("text"), F.col("spans")))
    return found.select("id", "found.text", "found.removed", "kept_ids")
