"""Languages of texts and of the spans within them (operator 6).

A word is a run of letters. Script ranges say which languages it can be in: those
whose training texts use the script of its first letter. Each of these gets a
score for the word from its characters, in threes with the word's edges, and from
the word as a whole. A Viterbi search with a penalty for every change of language
then labels the words of a text, and words of one label in a row are a span.

All of it is arrays over many texts at a time: no word is handled alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import lists, slices

#: Code point ranges of scripts, first and last.
SCRIPTS = (
    ("latin", ((0x41, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x2D00, 0x2D2F))),
    ("ethiopic", ((0x1200, 0x139F),)),
    ("khmer", ((0x1780, 0x17FF),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
OTHER_SCRIPT = len(SCRIPTS)

#: The model is fitted on about so many documents of each language, chosen by a hash
#: of the text, and has 2 ** TABLE_BITS numbers for each language.
TRAIN_DOCS = 600
TABLE_BITS = 17
SMOOTHING = 0.1
#: A language has a script if at least this part of its training letters is of it.
SCRIPT_SHARE = 0.01
#: What a change of language costs, as a difference of log-likelihoods.
SWITCH = 12.0
UNDETERMINED = "und"

#: Characters that are turned into features at a time, and bytes of text whose words
#: are labelled together.
PIECE_CHARS = 250_000
LABEL_BYTES = 4_000_000

CODES = 0x110000
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (2 ** TABLE_BITS, languages): log-likelihood of a feature
    scripts: np.ndarray  # (scripts + 1, languages): whether a language has a script
    letters: bytes  # a bit for each code point


def letter_bits() -> bytes:
    return np.packbits(np.array([chr(c).isalpha() for c in range(CODES)])).tobytes()


def script_table() -> np.ndarray:
    table = np.full(CODES, OTHER_SCRIPT, np.uint8)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for first, last in ranges:
            table[first : last + 1] = k
    return table


@dataclass
class Words:
    """The words of some texts: where they are, and the features of their characters."""

    starts: np.ndarray  # in code points, from the text's beginning
    sizes: np.ndarray
    per_text: np.ndarray
    scripts: np.ndarray
    features: np.ndarray  # of each letter
    first: np.ndarray  # of each word: its first letter's place among the letters
    whole: np.ndarray  # of each word: its own feature


def words_of(texts: list[str | None], letters: np.ndarray, scripts: np.ndarray) -> Words:
    joined = "\0".join(text or "" for text in texts)
    # Lower case where it keeps a text's length, as it all but always does.
    lower = joined.lower()
    if len(lower) != len(joined):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letters[codes]
    at = np.flatnonzero(inside)
    edges = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sizes = ends - starts
    masked = np.where(inside, codes, 0).astype(np.uint64)
    padded = np.concatenate((np.zeros(1, np.uint64), masked, np.zeros(1, np.uint64)))
    here = at + 1
    mixed = (
        padded[here - 1] * np.uint64(_MIX[0])
        + padded[here] * np.uint64(_MIX[1])
        + padded[here + 1] * np.uint64(_MIX[2])
    )
    shift = np.uint64(64 - TABLE_BITS)
    mixed ^= mixed >> np.uint64(29)
    features = ((mixed * np.uint64(_MIX[0])) >> shift).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    if len(starts):
        power = np.uint64(_MIX[2]) ** (np.arange(int(sizes.max())) % 64).astype(np.uint64)
        inner = np.arange(len(at)) - np.repeat(first, sizes)
        whole = np.add.reduceat(masked[at] * power[inner], first)
        whole ^= whole >> np.uint64(31)
        whole = ((whole * np.uint64(_MIX[1])) >> shift).astype(np.int64)
    else:
        whole = np.empty(0, np.int64)
    bounds = np.cumsum([len(text or "") + 1 for text in texts])
    text_of = np.searchsorted(bounds, starts, side="right")
    begins = np.concatenate(([0], bounds[:-1])) if len(texts) else np.empty(0, np.int64)
    return Words(
        starts - begins[text_of],
        sizes,
        np.bincount(text_of, minlength=len(texts)),
        scripts[codes[starts]],
        features,
        first,
        whole,
    )


# Fitting


def training_rows(
    docs: DataFrame, text_col: str, lang_col: str, most: int = TRAIN_DOCS
) -> DataFrame:
    """(text, lang): about `most` different texts of each language, chosen by a hash of the text."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null"
    )
    # A row for each language: as many as the model has columns.
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    shares = docs.sparkSession.createDataFrame(
        [(row.lang, min(1.0, most / row.n)) for row in counts], "lang string, share double"
    )
    place = F.pmod(F.xxhash64("text", F.lit(0)), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.join(F.broadcast(shares), "lang").where(place < F.col("share"))
    return chosen.select("text", "lang").distinct()


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS
) -> Model:
    """A model from texts with a language; rows without either teach nothing.

    Of each language at most 2 ** TABLE_BITS counts come to the driver.
    """
    bits = letter_bits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.unpackbits(np.frombuffer(bits, np.uint8), count=CODES).astype(bool)
        scripts = script_table()
        for part in slices(batches, "text", PIECE_CHARS):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            texts = part.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [text for text, x in zip(texts, langs, strict=True) if x == lang]
                words = words_of(own, letters, scripts)
                for kind, found, weights in (
                    (0, words.features, None),
                    (0, words.whole, None),
                    (1, words.scripts, words.sizes),
                ):
                    counts = np.bincount(found, weights=weights)
                    keys = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(keys), pa.string()),
                            pa.array(np.full(len(keys), kind), pa.int32()),
                            pa.array(keys, pa.int64()),
                            pa.array(counts[keys].astype(np.int64), pa.int64()),
                        ],
                        ["lang", "kind", "key", "n"],
                    )

    partial = training_rows(docs, text_col, lang_col, most).mapInArrow(
        run, "lang string, kind int, key bigint, n bigint"
    )
    total = partial.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toArrow()
    langs = total.column("lang").to_pylist()
    languages = sorted(set(langs))
    column = np.array([languages.index(x) for x in langs], np.int64)
    kind, key, n = (total.column(c).to_numpy() for c in ("kind", "key", "n"))
    counts = np.zeros((1 << TABLE_BITS, len(languages)))
    counts[key[kind == 0], column[kind == 0]] = n[kind == 0]
    known = (counts.sum(axis=1) > 0).sum() + 1
    table = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * known))
    scripts = np.zeros((OTHER_SCRIPT + 1, len(languages)))
    scripts[key[kind == 1], column[kind == 1]] = n[kind == 1]
    has = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, table.astype(np.float32), has, bits)


# Labelling


def word_scores(words: Words, model: Model) -> np.ndarray:
    """(words, languages): log-likelihoods, from which languages without the script are out.

    A script that no language has says nothing: all languages are as likely.
    """
    if not len(words.sizes):
        return np.empty((0, len(model.languages)), np.float32)
    scores = np.add.reduceat(model.table[words.features], words.first, axis=0)
    scores += model.table[words.whole]
    fits = model.scripts[words.scripts]
    nowhere = ~fits.any(axis=1)
    scores[nowhere] = 0
    return np.where(fits | nowhere[:, None], scores, np.float32(-1e6))


def viterbi(scores: np.ndarray, per_text: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of every word, for all texts at once, one word further at each step."""
    count, states = scores.shape
    labels = np.zeros(count, np.int32)
    if not count:
        return labels
    order = np.argsort(-per_text, kind="stable")
    sizes = per_text[order]
    begins = (np.cumsum(per_text) - per_text)[order]
    own = np.arange(states, dtype=np.int16)
    back = np.zeros((count, states), np.int16)
    last = np.zeros((len(order), states))
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
    for step, live in enumerate(active):
        at = begins[:live] + step
        if step:
            state = last[:live]
            best = state.argmax(axis=1)
            changed = state[np.arange(live), best] - switch
            stays = state >= changed[:, None]
            back[at] = np.where(stays, own, best[:, None])
            last[:live] = np.where(stays, state, changed[:, None]) + scores[at]
        else:
            last[:live] = scores[at]
    state = last.argmax(axis=1).astype(np.int32)
    for step in range(len(active) - 1, -1, -1):
        live = active[step]
        at = begins[:live] + step
        labels[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return labels


def pieces_of(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    """The texts in lists of about PIECE_CHARS, as (text, offset, part).

    Longer texts are cut at a space, or where there is none anywhere.
    """
    held: list[tuple[int, int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = min(len(text), at + PIECE_CHARS)
            if end < len(text):
                space = text.rfind(" ", at + 1, end)
                end = space if space > 0 else end
            if held and size + end - at > PIECE_CHARS:
                yield held
                held, size = [], 0
            held.append((k, at, text[at:end]))
            size += end - at
            at = end
    if held:
        yield held


@dataclass
class Scored:
    """The words of some texts in order, with their scores."""

    starts: np.ndarray
    sizes: np.ndarray
    scripts: np.ndarray
    scores: np.ndarray
    per_text: np.ndarray


def scored(texts: list[str | None], model: Model, letters, scripts) -> Scored:
    parts = [
        (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8),
         np.empty((0, len(model.languages)), np.float32), np.empty(0, np.int64))
    ]
    for held in pieces_of(texts) if model.languages else ():
        words = words_of([part for _, _, part in held], letters, scripts)
        owner = np.repeat([k for k, _, _ in held], words.per_text)
        offset = np.repeat([at for _, at, _ in held], words.per_text)
        scores = word_scores(words, model)
        parts.append((words.starts + offset, words.sizes, words.scripts, scores, owner))
    starts, sizes, own, scores, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    counts = np.bincount(owner.astype(np.int64), minlength=len(texts))
    return Scored(starts, sizes, own, scores, counts)


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])


def label(texts: list[str | None], model: Model, letters: np.ndarray, scripts: np.ndarray) -> list:
    """Columns lang, score and spans of some texts."""
    count = len(texts)
    words = scored(texts, model, letters, scripts)
    labels = viterbi(words.scores, words.per_text)
    text_of = np.repeat(np.arange(count), words.per_text)
    states = len(model.languages)
    place = text_of * states + labels
    known = model.scripts.any(axis=1)[words.scripts]
    share = np.bincount(place, weights=words.sizes, minlength=count * states)
    sure = np.bincount(place, weights=words.sizes * known, minlength=count * states)
    share, sure = share.reshape(count, states), sure.reshape(count, states)
    total = share.sum(axis=1)
    best = share.argmax(axis=1) if states else np.zeros(count, np.int64)
    names = np.array([*model.languages, UNDETERMINED], dtype=object)
    lang = names[np.where(total > 0, best, states)]
    most = sure[np.arange(count), best] if states else np.zeros(count)
    score = most / np.maximum(total, 1)
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.flatnonzero(new)
    final = np.concatenate((first[1:], [len(labels)]))[: len(first)] - 1
    spans = pa.StructArray.from_arrays(
        [
            pa.array(words.starts[first], pa.int32()),
            pa.array(words.starts[final] + words.sizes[final], pa.int32()),
            pa.array(names[labels[first]], pa.string()),
        ],
        fields=list(SPAN),
    )
    return [
        pa.array(lang, pa.string()),
        pa.array(score, pa.float64()),
        lists(spans, np.bincount(text_of[first], minlength=count), SPAN),
    ]


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang, score, spans) of every row; see `identified` for the rows themselves."""
    found = identified(docs.select(id_col, text_col), model, text_col, "found")
    return found.select(F.col(id_col).alias("id"), "found.lang", "found.score", "found.spans")


def identified(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """The rows of `docs` with a column `out`: struct<lang, score, spans>.

    lang is the language of most of the letters, score the part of the letters that
    is in it and in a script that some language has, spans
    array<struct<start, end, lang>> in code points. A text that is null or has no
    letter is "und" with score 0 and no span, and so is every text where the model
    knows no language.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = np.unpackbits(np.frombuffer(model.letters, np.uint8), count=CODES).astype(bool)
        scripts = script_table()
        kind = pa.struct(
            [("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))]
        )
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [
                pa.StructArray.from_arrays(
                    label(part.column(0).to_pylist(), model, letters, scripts), fields=list(kind)
                )
                for part in slices(iter([batch]), "text", LABEL_BYTES)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = "lang string, score double, spans array<struct<start:int,end:int,lang:string>>"
    return docs.withColumn(out, F.arrow_udf(run, kind)(F.col(text_col)))
