"""Near-duplicate documents by SimHash and deletion-variant signatures (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .components import components
from .scratch import checkpointed

#: Words in a shingle, and bits by which the fingerprints of a link differ at most.
SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle, repeats included.

    bytes.lower and bytes.split know ASCII only: A-Z, and the six white spaces
    \\x20 and \\x09-\\x0D.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    digest = xxhash.xxh64_intdigest
    ends = range(words, len(tokens) + 1) if len(tokens) >= words else [len(tokens)]
    return np.fromiter(
        (digest(b" ".join(tokens[max(0, end - words) : end]), SEED) for end in ends), "<u8"
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half of the hashes; without hashes zero."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS
) -> DataFrame:
    """(id, fingerprint as a signed 64-bit number) of every row.

    A text that is null or has no word gets zero; one with fewer words than a
    shingle is one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [
                fingerprint(shingle_hashes(text, words)) for text in part.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(found, pa.int64())], ["id", "fingerprint"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fingerprint bigint")


def _segment(width: int) -> tuple[Column, Column]:
    """The first bit of the segment that holds bit `w`, and the segment's mask."""
    first = F.floor(F.col("w") / width).cast("int") * width
    bits = F.least(F.lit(width), F.lit(64) - first)
    mask = F.when(bits >= 64, F.lit(-1)).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    )
    return first, mask


def links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(u, v): every two different fingerprints that differ in at most `bits` bits.

    Cut into bits // 2 + 1 segments, two such fingerprints have a segment in which
    they differ in one bit or none. So each segment is indexed as it is, and once
    for each of its bits with that bit made a wildcard; the sides of the equality
    join are the variants whose wildcard stands for 0 and for 1, so no pair of
    equal segments is met again under each wildcard. The join's condition counts
    the differing bits of the whole fingerprints.
    """
    count = bits // 2 + 1
    width = -(-64 // count)
    first, mask = _segment(width)
    value = F.call_function("shiftrightunsigned", F.col("p"), first).bitwiseAND(mask)
    one = F.call_function("getbit", F.col("p"), F.col("w"))
    wild = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("w") - first))
    base = prints.select(F.col("fingerprint").alias("p")).distinct()
    variants = base.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(63)))).select(
        "p", "w", one.alias("one"), value.bitwiseAND(wild).alias("rest")
    )
    whole = base.withColumn(
        "w", F.explode(F.array(*[F.lit(k * width) for k in range(-(-64 // width))]))
    ).select("p", (F.col("w") + 64).alias("w"), value.alias("rest"))
    left = variants.where("one = 0").select("p", "w", "rest").union(whole).alias("a")
    right = variants.where("one = 1").select("p", "w", "rest").union(whole).alias("b")
    close = F.expr("bit_count(a.p ^ b.p)") <= bits
    ordered = F.expr("a.w < 64 or a.p < b.p")
    on = (F.col("a.w") == F.col("b.w")) & (F.col("a.rest") == F.col("b.rest"))
    return left.join(right, on & close & ordered).select(
        F.col("a.p").alias("u"), F.col("b.p").alias("v")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    bits: int = MAX_BITS,
) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    component_id is the smallest id reachable over links of fingerprints that
    differ in at most `bits` bits, the row's own included. Equal fingerprints are
    one node, so copies are never paired. A null id is never a component's id
    unless the component has no other; repeated rows get a row each. Columns of
    `docs` other than the two named are not looked at.
    """
    # Written once: the texts are hashed once, and what follows uses the prints three times.
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    classes = prints.groupBy("fingerprint").agg(F.min("id").alias("first_id"))
    joined = components(links(prints, bits)).withColumnRenamed("node", "fingerprint")
    labelled = classes.join(joined, "fingerprint", "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component")
    )
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_print = labelled.join(least, "component").select("fingerprint", "component_id")
    return prints.join(of_print, "fingerprint").select("id", "fingerprint", "component_id")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    bits: int = MAX_BITS,
) -> DataFrame:
    """The rows of `docs` that stay: of each component the document with the smallest id.

    Rows that repeat an id are one document and stay or go together. Rows without
    an id cannot be named as copies and stay.
    """
    found = near_duplicates(docs, id_col, text_col, words, bits)
    gone = found.where("component_id <> id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
