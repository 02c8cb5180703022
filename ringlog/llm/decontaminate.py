"""Benchmark items within documents, edits allowed (operator 8).

Words are lower-cased runs of letters and digits. An item is in a document if a
stretch of the document is within a word edit distance of a fifth of the item's
words. To find such stretches, long items are cut into pieces, of which one has at
most its part of the edits; pieces of about one size form a class, and windows of
that size begin at every word of a document. Windows and pieces are embedded by
random walks (Chakraborty, Goldenberg, Koucky): the walk gives out the word it
stands at, and a random bit of that word and the step says whether it moves on.
Near in edit distance becomes near in Hamming distance, so keys made of a few
sampled steps are often equal. Walks and samples of a class are as many as made-up
pieces at its largest distance need to share a key with their stretch. The exact
distance decides on each pair of item and document that does.

A window that holds more words unknown to the benchmark than the distance allows
cannot be near any piece, and is not walked.

All windows of a batch of texts are walked together as arrays.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .batches import slices

#: A stretch is an item if 1 - edits / words of the item is at least this.
SIMILARITY = 0.8
#: Items of fewer words, which may have no edit, are found by equality of their words.
WALKED_WORDS = 5
#: Words that a piece of an item has at least.
PIECE_WORDS = 30
#: Steps in a key, least and most walks, most samples of a walk, and the share of
#: stretches at the largest distance of a class that share a key with their piece,
#: as measured on TRIALS made-up pieces of each kind.
SAMPLES = 3
WALKS = 3
MOST_WALKS = 48
MOST_SAMPLES = 16
TARGET_RECALL = 0.95
TRIALS = 400
#: Items are looked for in blocks of at most this many, so that what a task gets of
#: the benchmark is bounded; every block is a pass over the documents.
BLOCK_ITEMS = 20_000
#: How much longer the longest item of a class is than its shortest.
CLASS_RATIO = 1.25

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
KNOWN_BITS = 20
#: Of a key, the bits by which most windows are told from all keys of a class.
FILTER_BITS = 20
#: Multipliers, all odd: of the words in a key, and of a word for a walk's next move.
PLACES = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407), np.uint64(0xD6E8FEB86659FD93))
MOVE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text whose windows are walked at a time.
WALK_BYTES = 1_000_000


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(30))
    values = values * MIX[0]
    values = values ^ (values >> np.uint64(27))
    values = values * MIX[1]
    return values ^ (values >> np.uint64(31))


# Words


def lowered(text: str) -> str:
    """In lower case, at its length: a character that would become two stays."""
    lower = text.lower()
    if len(lower) == len(text):
        return lower
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[ord("0") : ord("9") + 1] = True
    table[ord("a") : ord("z") + 1] = True
    table[128:] = True
    return table


def powers(count: int, base: np.uint64) -> np.ndarray:
    found = np.full(count, base, np.uint64)
    if count:
        found[0] = 1
    return np.cumprod(found, dtype=np.uint64)


@dataclass
class Words:
    """The words of some texts one after another: hash, text, and place in the joined bytes."""

    hashes: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    left: np.ndarray  # words from this one to the end of its text
    data: bytes
    begins: np.ndarray  # of the texts, in the joined bytes


def words_of(texts: list[str | None]) -> Words:
    """A word's hash is that of its bytes as the digits of a number, from sums over all bytes."""
    parts = [lowered(text or "").encode("utf-8", "surrogatepass") for text in texts]
    data = b"\0".join(parts)
    codes = np.frombuffer(data, np.uint8)
    inside = word_bytes()[codes].astype(np.int8)
    edges = np.diff(np.concatenate(([0], inside, [0])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.concatenate(
        (
            np.zeros(1, np.uint64),
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes), BASE)),
        )
    )
    hashes = mixed((sums[ends] - sums[starts]) * powers(len(codes) + 1, INVERSE)[starts])
    sizes = np.array([len(part) + 1 for part in parts], np.int64)
    bounds = np.cumsum(sizes)
    text = np.searchsorted(bounds, starts, side="right")
    count = np.bincount(text, minlength=len(texts))
    last = np.cumsum(count)
    left = last[text] - np.arange(len(text)) if len(text) else np.empty(0, np.int64)
    return Words(hashes, text, starts, ends, left, data, bounds - sizes)


# Walks and keys


@dataclass
class Plan:
    """What is random about the walks and samples, from a seed."""

    seed: int
    walks: int
    samples: int

    def steps(self, size: int, walk: int) -> np.ndarray:
        """(samples, SAMPLES): the steps sampled on a walk over about `size` words."""
        rng = np.random.default_rng([self.seed, size, walk])
        return rng.integers(0, 2 * size, (MOST_SAMPLES, SAMPLES))[: self.samples]

    def keys(self, hashes: np.ndarray, at: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
        """(walks * samples, windows): the keys of windows that begin at `at`.

        A walk that comes to `stop` gives out zeros from there.
        """
        found = np.zeros((self.walks * self.samples, len(at)), np.uint64)
        padded = np.concatenate((hashes, np.zeros(1, np.uint64)))
        for walk in range(self.walks):
            steps = self.steps(size, walk)
            wanted = defaultdict(list)
            for row, chosen in enumerate(steps):
                for place, step in enumerate(chosen):
                    wanted[int(step)].append((walk * self.samples + row, place))
            here = at.copy()
            for step in range(int(steps.max()) + 1):
                gone = here >= stop
                word = np.where(gone, np.uint64(0), padded[np.minimum(here, len(hashes))])
                for row, place in wanted.get(step, ()):
                    found[row] += word * PLACES[place]
                salt = np.uint64((step * 0x632BE59BD9B4E019 + walk * 0xD6E8FEB86659FD93) % (1 << 64))
                moves = ((word ^ salt) * MOVE) >> np.uint64(63)
                here = here + (moves.astype(bool) & ~gone)
        return mixed(found + np.arange(len(found), dtype=np.uint64)[:, None])


def edited(words: np.ndarray, edits: int, rng: np.random.Generator, mixed_kinds: bool) -> list:
    """The words with random substitutions, or with insertions and deletions among them."""
    found = words.tolist()
    for _ in range(edits):
        at = int(rng.integers(len(found)))
        kind = int(rng.integers(3)) if mixed_kinds and len(found) > 1 else 0
        new = [] if kind == 2 else [int(rng.integers(1, 1 << 62))]
        found[at : at + (kind != 1)] = new
    return found


@cache
def plan_for(seed: int, least: int, most: int, allowed: int) -> Plan:
    """The fewest keys with which made-up pieces share one with their stretch as often as wanted.

    The pieces are of the least and of the most words, with all the edits allowed,
    and other words follow.
    """
    rng = np.random.default_rng([seed, least, most, allowed])
    pieces, windows = [], []
    for size in (least, most):
        for kinds in (False, True):
            for _ in range(TRIALS):
                words = rng.integers(1, 1 << 62, size).astype(np.uint64)
                after = rng.integers(1, 1 << 62, most + allowed).tolist()
                pieces.append(words)
                window = edited(words, allowed, rng, kinds) + after
                windows.append(np.array(window[: most + allowed], np.uint64))
    joined = []
    for parts in (pieces, windows):
        ends = np.cumsum([len(part) for part in parts])
        joined.append((np.concatenate(parts), ends - [len(part) for part in parts], ends))
    walks = WALKS
    while walks <= MOST_WALKS:
        most_keys = Plan(seed, walks, MOST_SAMPLES)
        one, other = (most_keys.keys(*parts, least) for parts in joined)
        shared = (one == other).reshape(walks, MOST_SAMPLES, 4, TRIALS)
        # By number of samples, the recall of the kind of pieces that is found least.
        recall = np.logical_or.accumulate(shared.any(axis=0), axis=0).mean(axis=2).min(axis=1)
        enough = np.flatnonzero(recall >= TARGET_RECALL)
        if len(enough):
            return Plan(seed, walks, int(enough[0]) + 1)
        walks += max(1, walks // 3)
    raise ValueError(
        f"no plan finds {allowed} edits in {least} to {most} words with recall {TARGET_RECALL}"
    )


# The benchmark


@dataclass
class Class:
    """Pieces of about one size: the least and the most words, the most edits, and in order
    of their keys the item that each is of, and the words of it before the piece."""

    least: int
    most: int
    allowed: int
    plan: Plan
    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    filter: np.ndarray


@dataclass
class Short:
    """Items of so many words: the digests of their words in order, and the items."""

    words: int
    keys: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    similarity: float
    items: list[np.ndarray]
    sorted: list[np.ndarray]
    known: np.ndarray
    classes: list[Class]
    short: list[Short]

    def edits(self, words: int) -> int:
        """Edits that an item of so many words may have."""
        return math.floor((1 - self.similarity) * words + 1e-9)


def cut(size: int, edits: int) -> int:
    """Into how many pieces an item is cut: where a piece's edits are fewest for its size.

    With so many edits in all, one of n pieces has at most an n-th of them. Walks
    drift apart with the square of the edits.
    """
    most = max(1, size // PIECE_WORDS)
    return min(range(1, most + 1), key=lambda n: ((edits // n) ** 2 * n, n))


def filtered(keys: np.ndarray) -> np.ndarray:
    """The lowest bits of a key as a place in a table."""
    return keys & np.uint64((1 << FILTER_BITS) - 1)


def in_order(hashes: np.ndarray, words: int) -> np.ndarray:
    """A digest of the so many words that begin at each word."""
    found = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        found = mixed(found + hashes[k : len(hashes) - words + 1 + k])
    return found


def index(texts: list[str | None], similarity: float, seed: int = 8) -> Index:
    words = words_of(texts)
    bounds = np.searchsorted(words.text, np.arange(len(texts) + 1))
    items = [words.hashes[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    in_sort = [np.unique(item) for item in items]
    found = Index(similarity, items, in_sort, np.zeros(1 << KNOWN_BITS, bool), [], [])
    parts: list[tuple[int, int, int, int]] = []  # words, edits, item, words before
    short: dict[int, list[int]] = defaultdict(list)
    for k, item in enumerate(items):
        if len(item) < WALKED_WORDS and not found.edits(len(item)):
            if len(item):
                short[len(item)].append(k)
            continue
        count = cut(len(item), found.edits(len(item)))
        bounds = [len(item) * j // count for j in range(count + 1)]
        edits = found.edits(len(item)) // count
        parts += [(b - a, edits, k, a) for a, b in zip(bounds, bounds[1:], strict=False)]
    for size, own in sorted(short.items()):
        keys = np.concatenate([in_order(items[k], size) for k in own])
        order = np.argsort(keys, kind="stable")
        found.short.append(Short(size, keys[order], np.array(own)[order]))
    groups: list[list[tuple[int, int, int, int]]] = []
    for part in sorted(parts):
        if not groups or part[0] > CLASS_RATIO * groups[-1][0][0]:
            groups.append([])
        groups[-1].append(part)
    for group in groups:
        shortest, longest = group[0][0], group[-1][0]
        allowed = max(edits for _, edits, _, _ in group)
        plan = plan_for(seed, shortest, longest, allowed)
        joined = np.concatenate([items[k][a : a + size] for size, _, k, a in group])
        found.known[joined & np.uint64((1 << KNOWN_BITS) - 1)] = True
        sizes = np.array([size for size, _, _, _ in group])
        ends = np.cumsum(sizes)
        keys = plan.keys(joined, ends - sizes, ends, shortest)
        flat = keys.ravel()
        order = np.argsort(flat, kind="stable")
        owners = np.tile(np.array([k for _, _, k, _ in group]), len(keys))
        offsets = np.tile(np.array([a for _, _, _, a in group]), len(keys))
        table = np.zeros(1 << FILTER_BITS, bool)
        table[filtered(flat)] = True
        found.classes.append(
            Class(
                shortest, longest, allowed, plan, flat[order], owners[order], offsets[order], table
            )
        )
    return found


# Search


def candidates(found: Index, words: Words) -> dict[tuple[int, int], set[int]]:
    """By text and item, the words at which it would begin if a piece is where a key is shared."""
    pairs: dict[tuple[int, int], set[int]] = defaultdict(set)
    count = len(words.hashes)
    known = found.known[words.hashes & np.uint64((1 << KNOWN_BITS) - 1)]
    sums = np.concatenate(([0], np.cumsum(known)))
    for each in found.classes:
        allowed = each.allowed
        begins = np.arange(count)
        inside = np.minimum(words.left, each.least)
        good = sums[begins + inside] - sums[begins] >= each.least - allowed
        at = np.flatnonzero(good)
        if not len(at):
            continue
        stop = at + np.minimum(words.left[at], each.most + allowed)
        for row in each.plan.keys(words.hashes, at, stop, each.least):
            maybe = np.flatnonzero(each.filter[filtered(row)])
            low = np.searchsorted(each.keys, row[maybe], side="left")
            high = np.searchsorted(each.keys, row[maybe], side="right")
            for k in np.flatnonzero(high > low):
                place = int(at[maybe[k]])
                own = slice(low[k], high[k])
                for item, offset in zip(
                    each.items[own].tolist(), each.offsets[own].tolist(), strict=True
                ):
                    pairs[int(words.text[place]), item].add(place - offset)
    for each in found.short:
        row = in_order(words.hashes, each.words)
        low = np.searchsorted(each.keys, row, side="left")
        high = np.searchsorted(each.keys, row, side="right")
        for k in np.flatnonzero((high > low) & (words.left[: len(row)] >= each.words)):
            for item in each.items[low[k] : high[k]].tolist():
                # All stretches are equal: the first is the result.
                pairs.setdefault((int(words.text[k]), item), {int(k)})
    return pairs


def nearest(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """(edits, end) of the stretch of `part` that is nearest to the item; the first of equals."""
    columns = np.arange(len(part) + 1)
    row = np.zeros(len(part) + 1, np.int64)
    for word in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (part != word))
        row = np.minimum.accumulate(new - columns) + columns
    end = int(row.argmin())
    return int(row[end]), end


def verify(found: Index, words: Words, text: int, item: int, places: set[int]) -> tuple | None:
    """(edits, first word, end word) of the best stretch about these places, if near enough."""
    wanted = found.items[item]
    size, allowed = len(wanted), found.edits(len(wanted))
    first = int(np.searchsorted(words.text, text, side="left"))
    last = int(np.searchsorted(words.text, text, side="right"))
    stretches: list[list[int]] = []
    for place in sorted(places):
        low, high = max(first, place - size), min(last, place + 2 * size)
        if stretches and low <= stretches[-1][1]:
            stretches[-1][1] = high
        else:
            stretches.append([low, high])
    best = None
    for low, high in stretches:
        # A near stretch has so many of the item's words on so few places.
        part, own = words.hashes[low:high], found.sorted[item]
        place = np.minimum(np.searchsorted(own, part), len(own) - 1)
        held = np.concatenate(([0], np.cumsum(own[place] == part)))
        span = min(size + allowed, high - low)
        if (held[span:] - held[: len(held) - span]).max() < size - allowed:
            continue
        edits, end = nearest(wanted, words.hashes[low:high])
        if edits <= allowed and (best is None or edits < best[0]):
            back = words.hashes[low : low + end][::-1][: size + allowed]
            length = nearest_prefix(wanted[::-1], back)
            best = (edits, low + end - length, low + end)
    return best


def nearest_prefix(item: np.ndarray, part: np.ndarray) -> int:
    """The length of the shortest prefix of `part` that is nearest to the item."""
    columns = np.arange(len(part) + 1)
    row = columns.copy()
    for word in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (part != word))
        row = np.minimum.accumulate(new - columns) + columns
    return int(row.argmin())


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(doc_id, item_id, edits, similarity, start, end): the best stretch of each item found.

    start and end are code points of the document, end exclusive. Items that are
    null or without a word match nothing; so do null and empty documents. Equal items match each by its own id. Documents that repeat are
    searched one by one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = items.select(F.col(item_id_col).alias("id"), F.col(item_text_col).alias("text"))
    chosen = chosen.where("text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    item_kind = chosen.schema["id"].dataType.simpleString()
    item_type = to_arrow_type(chosen.schema["id"].dataType)
    schema = (
        f"doc_id {kind}, item_id {item_kind}, edits int, similarity double, start int, end int"
    )
    result = None
    block: list = []
    found = []
    for row in chosen.orderBy("id", "text").toLocalIterator():
        block.append(row)
        if len(block) == block_items:
            found.append(_search(rows, block, similarity, schema, item_type))
            block = []
    if block or not found:
        found.append(_search(rows, block, similarity, schema, item_type))
    for part in found:
        result = part if result is None else result.union(part)
    return result


def _search(
    rows: DataFrame, block: list, similarity: float, schema: str, item_type: pa.DataType
) -> DataFrame:
    benchmark = index([row.text for row in block], similarity)
    ids = [row.id for row in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", WALK_BYTES):
            texts = part.column("text").to_pylist()
            words = words_of(texts)
            lines = []
            for (text, item), places in sorted(candidates(benchmark, words).items()):
                best = verify(benchmark, words, text, item, places)
                if best:
                    edits, first, end = best
                    begin = int(words.begins[text])
                    ends = words.starts[first], words.ends[max(first, end - 1)]
                    start, stop = (len(words.data[begin:x].decode("utf-8", "replace")) for x in ends)
                    share = 1 - edits / len(benchmark.items[item])
                    lines.append((text, ids[item], edits, share, start, stop))
            columns = list(zip(*lines, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(columns[0], pa.int64())),
                    pa.array(columns[1], item_type),
                    pa.array(columns[2], pa.int32()),
                    pa.array(columns[3], pa.float64()),
                    pa.array(columns[4], pa.int32()),
                    pa.array(columns[5], pa.int32()),
                ],
                ["doc_id", "item_id", "edits", "similarity", "start", "end"],
            )

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that hold no item. Rows without an id cannot be named and stay."""
    gone = matches(docs, items, id_col, **options).select(F.col("doc_id").alias(id_col))
    return docs.join(gone.distinct(), id_col, "left_anti").select(docs.columns)
