"""SentencePiece encoding and decoding by a shared-prefix Viterbi search (operator 1).

Texts are marked (a mark for each space, one before the text) and cut into words:
runs of marks with what follows them. No piece reaches from one word into the
next, so a word is encoded alone, and only once for all texts that a task works
on at a time. The distinct words are sorted, which makes neighbours share
prefixes: going through them in order is a depth-first walk of their trie, and
the forward states of the characters they share are kept.

The state of a prefix is the last piece of its best segmentation and that
segmentation's score. For a unigram model the score is the sum of the pieces'
scores. A BPE model has no sum to maximise: there, a piece may follow another if
merging the two pieces' text by the model gives just these two, at score 0, and
else not at all. Exactly one segmentation has no forbidden step, that which
merging pair by pair gives. So both kinds are the same search.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import lists, slices

MARK = "▁"
#: Fixed values of the model file: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How far the score of an unknown character lies below the least score of a piece.
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " ⁇ "
#: Answers about pairs of pieces, and words, that a task remembers at most.
MOST_PAIRS = 500_000
MOST_WORDS = 200_000


# The model file


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message, one level deep."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What encoding and decoding need of a model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    type: int = UNIGRAM
    dummy_prefix: bool = True
    byte_fallback: bool = False
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {
            piece: k
            for k, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True))
            if kind in (NORMAL, USER_DEFINED)
        }
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [k for k, kind in enumerate(self.kinds) if kind == BYTE]


def read_model(path: str) -> Model:
    """The model in a file. Only models that do not rewrite texts are taken."""
    with open(path, "rb") as file:
        data = file.read()
    model = Model([""], [0.0], [UNKNOWN])
    pieces: list[tuple[str, float, int]] = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.type = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(_fields(value))
            model.dummy_prefix = bool(rules.get(3, 1))
            if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                raise ValueError("models that normalise texts are not supported")
    if model.type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    for piece, _, kind in pieces:
        if kind == NORMAL and MARK in piece.lstrip(MARK):
            raise ValueError("models whose pieces reach over spaces are not supported")
    model.pieces, model.scores, model.kinds = (list(x) for x in zip(*pieces, strict=True))
    model.__post_init__()
    return model


# Encoding


#: A piece that stands at an end of another while that is merged, and the score of
#: the merge that takes it up.
Spine = list[tuple[str, float]]


def spines(model: Model, piece: str) -> tuple[Spine, Spine] | None:
    """What stands at the left and at the right end of a piece while it is merged.

    Merges go by the best score, then leftmost. None if they do not end in the piece.
    """
    parts = list(piece)
    left, right = [(parts[0], -np.inf)], [(parts[-1], -np.inf)]
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            found = model.ids.get(parts[k] + parts[k + 1])
            if found is not None and (best is None or model.scores[found] > best):
                best, at = model.scores[found], k
        if best is None:
            return None
        new = parts[at] + parts[at + 1]
        for spine, here in ((left, at == 0), (right, at == len(parts) - 2)):
            if here:
                spine[-1] = (spine[-1][0], best)
                spine.append((new, -np.inf))
        parts[at : at + 2] = [new]
    return left, right


class Search:
    """Forward states of one word, of which a prefix is kept for the next."""

    def __init__(self, model: Model):
        self.model = model
        self.bpe = model.type == BPE
        self.pairs: dict[int, bool] = {}
        self.ends: dict[int, tuple[Spine, Spine] | None] = {}
        self.floor = min(model.scores, default=0.0) - UNKNOWN_PENALTY
        self.word = ""
        self.known: dict[str, tuple[int, ...]] = {}
        # By number of characters: id of the last piece (under 0: an unknown
        # character), where it begins, and the score.
        self.last, self.begin, self.score = [0], [0], [0.0]
        # Where pieces that go on may have begun, by number of characters; and the
        # beginnings of all pieces, with their ids or -1.
        self.open: list[list[int]] = [[]]
        self.prefixes = {piece[:k]: -1 for piece in model.ids for k in range(1, len(piece))}
        self.prefixes.update(model.ids)

    def _spines(self, piece: int) -> tuple[Spine, Spine] | None:
        if piece not in self.ends:
            self.ends[piece] = spines(self.model, self.model.pieces[piece])
        return self.ends[piece]

    def _follows(self, left: int, right: int) -> bool:
        """Whether a BPE model leaves these two pieces side by side; left under 0: nothing.

        It does not if, while both are merged, a piece at the right end of one and
        a piece at the left end of the other have a merge before either is taken
        up by its own: at equal scores the merge further left comes first.
        """
        after, before = self._spines(right), self._spines(left) if left >= 0 else ([], [])
        known = after is not None
        for a, a_ends in before[1] if known else ():
            for b, b_ends in after[0]:
                both = self.model.ids.get(a + b)
                if both is not None and a_ends < self.model.scores[both] >= b_ends:
                    known = False
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[(left + 1) * len(self.model.scores) + right] = known
        return known

    def _step(self, word: str, end: int) -> None:
        """The state of a prefix from those of shorter ones, earliest beginnings first."""
        prefixes, scores, last = self.prefixes, self.model.scores, self.last
        pairs, count = self.pairs, len(scores)
        best, piece, start = -np.inf, -1, end - 1
        open_ = []
        for begin in (*self.open[end - 1], end - 1):
            found = prefixes.get(word[begin:end])
            if found is None:
                continue
            open_.append(begin)
            if found < 0:
                continue
            if self.bpe:
                if piece < 0:
                    left = last[begin] if begin else -1
                    follows = pairs.get((left + 1) * count + found)
                    if follows is None:
                        follows = self._follows(left, found)
                    if follows:
                        best, piece, start = 0.0, found, begin
            elif self.score[begin] + scores[found] > best:
                best, piece, start = self.score[begin] + scores[found], found, begin
        if piece < 0:
            best = self.score[end - 1] + (0.0 if self.bpe else self.floor)
        self.open.append(open_)
        last.append(piece)
        self.begin.append(start)
        self.score.append(best)

    def encode(self, word: str) -> list[int]:
        """The ids of a word. The longer its common prefix with the last word, the less to do."""
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        for states in (self.last, self.begin, self.score, self.open):
            del states[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            self._step(word, end)
        self.word = word
        ids: list[int] = []
        end = len(word)
        while end:
            begin = self.begin[end]
            if self.last[end] >= 0:
                ids.append(self.last[end])
            elif self.model.byte_fallback:
                ids.extend(self.model.bytes[b] for b in reversed(word[begin:end].encode()))
            elif not (ids and ids[-1] == self.model.unknown):  # unknown characters in a row are one
                ids.append(self.model.unknown)
            end = begin
        ids.reverse()
        return ids


def word_pattern(model: Model) -> re.Pattern:
    """Marked words; white space that no piece has is a word of its own."""
    inside = set("".join(model.ids))
    alone = "".join(c for c in "\n\r\t" if c not in inside)
    each = f"|[{alone}]" if alone else ""
    return re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+{each}")


def encode_texts(
    model: Model, search: Search, words: re.Pattern, texts: list[str | None]
) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the number of ids of each text."""
    prefix = MARK if model.dummy_prefix else ""
    places: dict[str, int] = {}
    sequence: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            found = words.findall(prefix + text.replace(" ", MARK))
            sequence.extend([places.setdefault(word, len(places)) for word in found])
            counts[k] = len(found)
    # Words of the last texts are known; the others are gone through in order.
    known = search.known
    for word in sorted(places.keys() - known.keys()):
        known[word] = tuple(search.encode(word))
    encoded = [known[word] for word in places]
    if len(known) > MOST_WORDS:
        search.known = {word: known[word] for word in places} if len(places) < MOST_WORDS else {}
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    values = np.fromiter((i for ids in encoded for i in ids), np.int32, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    order = np.array(sequence, np.int64)
    per_word = lengths[order]
    ends = np.cumsum(per_word)
    total = int(ends[-1]) if len(ends) else 0
    taken = values[np.repeat(starts[order] - (ends - per_word), per_word) + np.arange(total)]
    edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
    return taken, np.diff(edges)


#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 2_000_000


def encode(text: Column, model: Model) -> Column:
    """The ids of a text as array<int>; none for a null or empty text."""
    return _coded(text, model, False)


def encode_checked(text: Column, model: Model) -> Column:
    """struct<ids, round_trip>: as encode, and whether decoding the ids gives the text back.

    A null text counts as empty. Decoding cannot tell the mark U+2581 from a space.
    """
    return _coded(text, model, True)


def _coded(text: Column, model: Model, checked: bool) -> Column:
    ids = pa.list_(pa.int32())
    kind = pa.struct([("ids", ids), ("round_trip", pa.bool_())]) if checked else ids

    def code(search: Search, words: re.Pattern, table: pa.Array, part: pa.Array) -> pa.Array:
        texts = part.to_pylist()
        found = lists(*encode_texts(model, search, words, texts), pa.int32())
        if not checked:
            return found
        back = decode_lists(table, found, model.dummy_prefix)
        same = [a == (b or "") for a, b in zip(back, texts, strict=True)]
        return pa.StructArray.from_arrays([found, pa.array(same, pa.bool_())], fields=list(kind))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search, words, table = Search(model), word_pattern(model), piece_bytes(model)
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [
                code(search, words, table, part.column(0))
                for part in slices(iter([batch]), "text", ENCODE_BYTES)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    name = "struct<ids:array<int>,round_trip:boolean>" if checked else "array<int>"
    return F.arrow_udf(run, name)(text)


# Decoding


def piece_bytes(model: Model) -> pa.Array:
    """By id, what a piece stands for."""
    found = []
    for piece, kind in zip(model.pieces, model.kinds, strict=True):
        if kind == BYTE:
            found.append(bytes([int(piece[3:5], 16)]))
        elif kind == CONTROL:
            found.append(b"")
        elif kind == UNKNOWN:
            found.append(UNKNOWN_TEXT.encode())
        else:
            found.append(piece.replace(MARK, " ").encode())
    return pa.array(found, pa.binary())


def decode_lists(table: pa.Array, ids: pa.ListArray, dummy_prefix: bool) -> list[str | None]:
    taken = table.take(ids.values)
    joined = pc.binary_join(
        pa.ListArray.from_arrays(ids.offsets, taken), pa.scalar(b"", pa.binary())
    )
    texts: list[str | None] = []
    for known, value in zip(ids.is_valid().to_pylist(), joined.to_pylist(), strict=True):
        text = (value or b"").decode("utf-8", "replace")
        texts.append(text[dummy_prefix and text[:1] == " " :] if known else None)
    return texts


def decode(ids: Column, model: Model) -> Column:
    """The text that ids stand for; null for null, bytes that are no UTF-8 become U+FFFD."""
    rows = 500

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = piece_bytes(model)
        for column in columns:
            texts: list[str | None] = []
            for start in range(0, len(column), rows):
                part = pa.concat_arrays([column.slice(start, rows)])  # offsets from 0
                flat = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0)))), pa.int32()),
                    part.flatten().cast(pa.int32()),
                )
                found = decode_lists(table, flat, model.dummy_prefix)
                known = part.is_valid().to_pylist()
                texts.extend(t if k else None for t, k in zip(found, known, strict=True))
            yield pa.array(texts, pa.string())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ids)
