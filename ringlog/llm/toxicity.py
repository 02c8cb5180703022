"""Toxicity by a subsequence kernel, Nystroem landmarks and a support vector machine (operator 13).

Texts are cut into sentences and these into strings: a word without punctuation, a run
of single letters put together, a window of a word that is longer than WIDTH. The
kernel of two strings is the number of subsequences of ORDER letters that they share,
each weighted by DECAY for every letter that it skips, and at most SPAN letters long;
so `idiot`, `i-d-i-o-t` and `idxiot` stay near each other. It is scaled by the weight
of all subsequences of each string.

The machine works on the kernel's values with a bounded number of landmark strings,
made orthonormal by the inverse root of the landmarks' own kernel matrix. As the
kernel is a product of counts of subsequences, its decision for a string is a sum of
weights of the subsequences that it shares with landmarks; a text is scored with
these, string by string, and every new string only once per task.

A sentence is toxic if one of its strings is, a document if one of its sentences is.
Labels say so of documents; which strings are to blame is found in training: those
that are in toxic sentences far beyond chance, by themselves or, once these are set
aside, by a piece of theirs, and then those that the machine agrees on.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices

ORDER = 4
SPAN = 6
DECAY = 0.7
#: Letters of a string at most; longer words are windows that overlap by half.
WIDTH = 24
#: Bounds of what is learned from: documents of each label, and strings of each document.
TRAIN_DOCS = 1000
TRAIN_STRINGS = 1500
#: Clean strings that the machine is trained on, and those added for being mistaken.
CLEAN_STRINGS = 15_000
MISTAKEN = 3_000
LANDMARKS = 500
ROUNDS = 3
COST = 5.0
#: Weight of a clean string, of a toxic one, and of a toxic one with a letter put in.
WEIGHTS = (1.0, 4.0, 0.5)
#: How far, in log odds less its error, a string must stand out to be blamed.
EVIDENCE, ERRORS = 0.4, 2.5
#: Letters known by name; all others count as one.
ALPHABET = 80
#: A score from which a text counts as toxic.
TOXIC = 0.3
#: Distinct words that a task remembers.
REMEMBERED = 400_000

STEPS = list(combinations(range(1, SPAN), ORDER - 1))
_PAD, _OTHER, _EDGE = 0, 1, 2
_SPACED = re.compile(r"(?<!\S)[^\w\s]*\w(?:[^\w\s]*\s+[^\w\s]*\w){2,}[^\w\s]*(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def pieces(word: str) -> list[str]:
    """The strings of a word: its letters and digits, in windows if they are many."""
    letters = "".join(filter(str.isalnum, word))
    half = WIDTH // 2
    return [letters[k : k + WIDTH] for k in range(0, max(1, len(letters) - half), half)] if letters else []


def words(text: str) -> set[str]:
    """The distinct words of a text in lower case, and its runs of single letters as words."""
    lower = text.lower()
    spaced = {"".join(found.split()) for found in _SPACED.findall(lower)}
    return spaced.union(lower.split()) if spaced else set(lower.split())


def sentences(text: str) -> list[str]:
    return [part for part in _SENTENCE.split(text) if part and not part.isspace()]


def coded(strings: list[str], letters: np.ndarray) -> np.ndarray:
    """A row of letter numbers for each string, with an edge before and after it."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    place = np.searchsorted(letters, points)
    known = letters[np.minimum(place, len(letters) - 1)] == points if len(letters) else place < 0
    rows = np.full((len(strings), WIDTH + 2), _PAD, np.int64)
    of = np.repeat(np.arange(len(strings)), sizes)
    at = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows[of, at + 1] = np.where(known, place + 3, _OTHER)
    rows[:, 0] = _EDGE
    rows[np.arange(len(strings)), sizes + 1] = _EDGE
    return rows


def subsequences(rows: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of all subsequences; the squares of a row's weights sum to 1."""
    of, codes, weights = [], [], []
    for steps in STEPS:
        row, first = np.nonzero(rows[:, steps[-1] :] != _PAD)
        code = rows[row, first]
        for step in steps:
            code = code * base + rows[row, first + step]
        of.append(row)
        codes.append(code)
        weights.append(np.full(len(row), DECAY ** (steps[-1] - ORDER + 1)))
    row, weight = np.concatenate(of), np.concatenate(weights)
    norms = np.sqrt(np.bincount(row, weight * weight, minlength=len(rows)))
    return row, np.concatenate(codes), weight / norms[row]


@dataclass(frozen=True)
class Model:
    """letters known, weights of subsequences, the machine's offset, and its scale to a probability.

    Without any subsequence, the probability is the share of toxic labels.
    """

    letters: np.ndarray
    codes: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def margins(self, strings: list[str]) -> np.ndarray:
        """The machine's decision for each string."""
        found = np.full(len(strings), self.offset)
        for start in range(0, len(strings), 20_000):
            part = strings[start : start + 20_000]
            row, code, weight = subsequences(coded(part, self.letters), len(self.letters) + 3)
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            shared = np.flatnonzero(self.codes[place] == code)
            value = weight[shared] * self.weights[place[shared]]
            found[start : start + len(part)] += np.bincount(row[shared], value, len(part))
        return found

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))

    def scores(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """A probability for each text; known keeps the decision on words seen before."""
        if not len(self.codes):
            return self.probability(np.full(len(texts), self.offset))
        bags = [words(text or "") for text in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set().union(*bags).difference(known)) if bags else []
        parts = [pieces(word) for word in new]
        margins = self.margins([part for found in parts for part in found])
        at = 0
        for word, found in zip(new, parts, strict=True):
            best = margins[at : at + len(found)].max() if found else self.offset
            known[word] = max(float(best), self.offset) if len(found) > 1 else float(best)
            at += len(found)
        best = [max(map(known.__getitem__, bag), default=self.offset) for bag in bags]
        return self.probability(np.array(best, np.float64))


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return odds - ERRORS * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _counts(bags: list[np.ndarray], toxic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.zeros((2, size), np.int64)
    for bag, label in zip(bags, toxic, strict=True):
        found[int(label), bag] += 1
    return found[1], found[0]


def blamed(strings: list[str], bags: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each string whether it stands out by itself, and whether it or a piece of it does."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    in_toxic, in_clean = _counts(bags, toxic, len(strings))
    own = _evidence(in_toxic, in_clean, n_toxic, n_clean)
    sure = own > EVIDENCE
    grams: dict[str, int] = {}
    parts = []
    for string in strings:
        edged = "^" + string
        mine = {edged[k : k + n] for n in (4, 5) for k in range(len(edged) - n + 1)}
        parts.append(np.fromiter((grams.setdefault(gram, len(grams)) for gram in mine), np.int64))
    of_rest = []
    for bag in bags:
        rest = [parts[k] for k in bag if not sure[k]]
        of_rest.append(np.unique(np.concatenate(rest)) if rest else np.empty(0, np.int64))
    seen = _counts(of_rest, toxic, len(grams))
    by_gram = _evidence(*seen, n_toxic, n_clean)
    by_part = np.array([by_gram[part].max() if len(part) else -np.inf for part in parts])
    return sure, sure | ((in_clean == 0) & (by_part > EVIDENCE))


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights, and at last the offset, of least squared hinge loss, by Newton's steps."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    rule = np.full(x.shape[1], 1 / COST)
    rule[-1] = 1e-6
    found = np.zeros(x.shape[1])
    for _ in range(30):
        margin = y * (x @ found)
        near = margin < 1
        part, scale = x[near], weight[near]
        slope = rule * found - part.T @ (scale * y[near] * (1 - margin[near]))
        bend = np.diag(rule) + part.T @ (part * scale[:, None].astype(x.dtype))
        step = np.linalg.solve(bend, slope)
        found -= step
        if np.abs(step).max() < 1e-5:
            break
    return found


def sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, with a small penalty on the slope."""
    x = np.c_[margin, np.ones(len(margin))]
    found = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -500, 500)))
        slope = x.T @ (weight * (p - y)) + np.array([0.01, 1e-6]) * found
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.01, 1e-6])
        step = np.linalg.solve(bend, slope)
        found -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(found[0], 1e-3)), float(found[1])


def train(strings_of: list[list[str]], toxic: np.ndarray, share: float) -> Model:
    """The model of documents given by their strings; share of them is toxic in all.

    With one label only, or none, there is nothing to learn: all scores are the share.
    """
    flat = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    none = np.empty(0, np.int64)
    if toxic.all() or not toxic.any():
        return Model(none.astype("<u4"), none, none.astype(float), 0.0, 1.0, float(flat))
    strings = sorted(set().union(*strings_of))
    number = {string: k for k, string in enumerate(strings)}
    bags = [np.array([number[s] for s in found], np.int64) for found in strings_of]
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds, often = np.unique(points, return_counts=True)
    letters = np.sort(kinds[np.argsort(-often, kind="stable")[:ALPHABET]])
    base = len(letters) + 3
    sure, guilty = blamed(strings, bags, toxic)
    in_toxic, in_clean = _counts(bags, toxic, len(strings))
    clean = np.flatnonzero((in_clean > 0) & ~sure)
    # Strings in an order that depends on neither letters nor labels.
    mixed = np.argsort(np.arange(len(strings), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    common = np.argsort(-(in_toxic + in_clean), kind="stable")
    first = np.flatnonzero(guilty)[np.argsort(-in_toxic[guilty], kind="stable")]
    chosen = [*first[: LANDMARKS // 4], *common[: LANDMARKS // 4], *mixed[: LANDMARKS // 2]]
    rows = coded([strings[k] for k in sorted(set(chosen))], letters)
    row, code, weight = subsequences(rows, base)
    codes = np.unique(code)
    marks = np.zeros((len(rows), len(codes)), np.float32)
    np.add.at(marks, (row, np.searchsorted(codes, code)), weight)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-4 * values.max()
    to_features = (marks.T @ (vectors[:, kept] / np.sqrt(values[kept]))).astype(np.float32)

    def features(found: list[str]) -> np.ndarray:
        out = []
        for start in range(0, len(found), 1000):
            part = found[start : start + 1000]
            row, code, weight = subsequences(coded(part, letters), base)
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            same = codes[place] == code
            dense = np.zeros((len(part), len(codes)), np.float32)
            np.add.at(dense, (row[same], place[same]), weight[same])
            out.append(dense @ to_features)
        return np.concatenate(out) if out else np.empty((0, to_features.shape[1]), np.float32)

    gapped = [
        s[:k] + letter + s[k:]
        for s in (strings[k] for k in np.flatnonzero(sure)[:100])
        for k in range(1, len(s))
        for letter in "\0x"
        if len(s) < WIDTH
    ]
    extra = features(gapped)
    taken = mixed[np.isin(mixed, clean)][:CLEAN_STRINGS]
    bad = guilty
    for _ in range(ROUNDS):
        toxic_ones = np.flatnonzero(bad)
        picked = [strings[k] for k in (*taken, *toxic_ones)]
        y = np.repeat([-1.0, 1.0], [len(taken), len(toxic_ones) + len(gapped)])
        scale = np.repeat(WEIGHTS, [len(taken), len(toxic_ones), len(gapped)])
        found = machine(np.concatenate((features(picked), extra)), y, scale)
        model = Model(letters, codes, to_features @ found[:-1], float(found[-1]), 1.0, 0.0)
        margin = model.margins(strings)
        witness = np.zeros(len(strings), bool)
        for bag, label in zip(bags, toxic, strict=True):
            if label and len(bag):
                witness[bag[np.argmax(margin[bag])]] = True
        bad = guilty & ((margin > 0) | witness | sure)
        worst = clean[np.argsort(-margin[clean], kind="stable")[:MISTAKEN]]
        taken = np.union1d(taken, worst)
    best = np.array([margin[bag].max() if len(bag) else found[-1] for bag in bags])
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    slope, shift = sigmoid(best, toxic.astype(float), weight)
    return Model(letters, codes, to_features @ found[:-1], float(found[-1]), slope, shift)


def _bounded(texts: list[str | None]) -> list[list[str]]:
    """The distinct strings of the sentences of each text; of very many, an even choice."""
    found = []
    for text in texts:
        strings = sorted(
            {p for part in sentences(text or "") for word in words(part) for p in pieces(word)}
        )
        step = max(1.0, len(strings) / TRAIN_STRINGS)
        found.append([strings[int(k * step)] for k in range(min(len(strings), TRAIN_STRINGS))])
    return found


def sample(labelled: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, toxic) of TRAIN_DOCS ids of each label at most, by a digest of the id.

    An id with several labels is toxic if one of them says so; other labels than 0 and
    1, and rows without an id, are left out.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    one = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    order = [F.xxhash64(F.col("id").cast("string")), "id"]
    parts = [one.where(F.col("toxic") == k).orderBy(*order).limit(TRAIN_DOCS) for k in (0, 1)]
    return parts[0].union(parts[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """The model of labelled documents, trained in one task on a bounded sample of them.

    The sample is at most 2 * TRAIN_DOCS documents and TRAIN_STRINGS strings of each, so
    the task, and the ids that are broadcast, do not grow with the tables. Of documents
    with the same id one is taken. The model is some thousand numbers.
    """
    counts = labels.agg(
        F.count_if(F.col(label_col) == 1).alias("toxic"),
        F.count_if(F.col(label_col) == 0).alias("clean"),
    ).first()
    share = counts.toxic / max(1, counts.toxic + counts.clean)
    chosen = F.broadcast(sample(labels, id_col, label_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(chosen, "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = _bounded(part.column("text").to_pylist())
            strings = pa.array(found, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), strings], ["toxic", "strings"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, strings = [], []
        for part in batches:
            toxic += part.column("toxic").to_pylist()
            strings += part.column("strings").to_pylist()
        model = train(strings, np.array(toxic, np.int64) == 1, share)
        data = io.BytesIO()
        numbers = np.array([model.offset, model.slope, model.shift])
        np.savez(data, letters=model.letters, codes=model.codes, weights=model.weights, numbers=numbers)
        yield pa.RecordBatch.from_arrays([pa.array([data.getvalue()], pa.binary())], ["model"])

    cuts = rows.mapInArrow(cut, "toxic int, strings array<string>")
    ordered = cuts.coalesce(1).sortWithinPartitions("toxic", F.xxhash64("strings"))
    found = ordered.mapInArrow(learn, "model binary").first()
    if found is None:
        return train([], np.empty(0, bool), share)
    data = np.load(io.BytesIO(bytes(found.model)))
    return Model(data["letters"], data["codes"], data["weights"], *map(float, data["numbers"]))


def score(text: Column, model: Model) -> Column:
    """The probability that a text is toxic; a text that is null is empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for batch in batches:
            column = pa.RecordBatch.from_arrays([batch], ["text"])
            found = [
                model.scores(part.column("text").to_pylist(), known)
                for part in slices(iter([column]), "text")
            ]
            yield pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)
