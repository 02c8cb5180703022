"""Secrets in texts: known forms, and character Markov models (operator 3).

DataFrame functions only; nothing here runs Python on the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import free_name

#: The known forms, in the order in which kinds are listed, and the
#: characters that the counted part has at least.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LENGTH = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the models are asked about, and the log-likelihood ratio, in all and
#: per pair of characters, from which one counts as random.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_RATIO = 12.0
MIN_PAIR_RATIO = 1.0
#: The models are fitted on at most so many different words of so many documents,
#: both chosen by a hash.
TRAIN_DOCS = 500
TRAIN_WORDS = 3000
#: Added to every count of a pair of characters.
SMOOTHING = 0.5
CODES = 128


def _running(values: Column, join) -> Column:
    """At each place of an array, join() of all values up to there; none is below 0.

    Each round joins with what stands 1, 2, 4, ... places before, so it takes as many
    rounds as the length has binary digits, and no array is copied for each value.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    back = F.transform(rounds, lambda k: F.pow(F.lit(2), k).cast("int"))

    def further(found: Column, step: Column) -> Column:
        kept = F.greatest(F.size(found) - step, F.lit(0))
        zeros = F.array_repeat(F.lit(0), F.size(found) - kept)
        earlier = F.concat(zeros, F.slice(found, 1, kept))
        return F.zip_with(found, earlier, lambda x, y: join(x, y))

    return F.aggregate(back, values, further)


def matches(text: Column, pattern: str) -> Column:
    """(s, e, m) of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches and the matches take turns, so a match ends
    after all pieces and matches up to it.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.split(text, pattern, -1).alias("gap"),
    )

    def placed(part: Column) -> Column:
        count = F.size(part["m"])
        gaps = F.slice(part["gap"], 1, count)
        sizes = F.zip_with(gaps, part["m"], lambda gap, m: F.length(gap) + F.length(m))
        return F.zip_with(
            _running(sizes, lambda x, y: x + y),
            part["m"],
            lambda end, m: F.struct(
                (end - F.length(m)).alias("s"), end.alias("e"), m.alias("m")
            ),
        )

    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    # An array of one, so that the parts are worked out once.
    spans = F.get(F.transform(F.array(parts), placed), F.lit(0))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _spans(matches: Column, kind: str, keep=None) -> Column:
    order = KINDS.index(kind)
    if keep is not None:
        matches = F.filter(matches, keep)
    return F.transform(
        matches,
        lambda x: F.struct(
            x["s"].alias("start"),
            F.lit(order).alias("order"),
            x["e"].alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def _long_enough(match: Column) -> Column:
    return F.length(F.regexp_extract(match["m"], ASSIGN, 1)) >= ASSIGN_LENGTH


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


# The models


def training_rows(
    docs: DataFrame, id_col: str, text_col: str, most: int = TRAIN_DOCS, words: int = TRAIN_WORDS
) -> DataFrame:
    """(random, value): labelled samples from at most `most` documents.

    Ordinary are at most `words` words of these documents outside the known forms,
    alone and joined as identifiers, paths and camel case are, and numbers. Random
    are the values of the known forms and, as few documents have one, digests of
    each word written in hexadecimal and in base 64, as keys are.
    """
    chosen = (
        docs.select(F.col(id_col).alias("id"))
        .where("id is not null")
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
        .distinct()
    )
    texts = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(chosen, "id", "left_semi")
        .select(F.coalesce("text", F.lit("")).alias("text"))
    )
    forms = f"{ASSIGN}|{ACCESS}|{HEX}"
    secrets = F.concat(
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)),
        F.regexp_extract_all("text", F.lit(f"({ACCESS}|{HEX})"), F.lit(1)),
    )
    found = F.regexp_extract_all(
        F.regexp_replace("text", forms, " "), F.lit(r"([A-Za-z][A-Za-z0-9_]{2,})"), F.lit(1)
    )
    distinct = texts.select(F.explode(found).alias("word")).distinct()
    distinct = distinct.orderBy(F.xxhash64("word"), "word").limit(words)
    digest = F.sha2("word", 256)
    samples = (
        (0, F.col("word")),
        (0, F.concat_ws("_", F.lower("word"), F.lit("id"))),
        (0, F.concat_ws("/", F.initcap("word"), F.upper("word"))),
        (0, F.concat(F.lower("word"), F.initcap("word"), F.initcap("word"))),
        (0, F.concat(F.crc32("word").cast("string"), F.crc32(F.reverse("word")).cast("string"))),
        (1, F.substring(digest, 1, 40)),
        (1, F.base64(F.unhex(digest))),
    )
    made = distinct.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("random"), v.alias("value")) for k, v in samples])
        ).alias("x")
    ).select("x.random", "x.value")
    known = texts.select(F.lit(1).alias("random"), F.explode(secrets).alias("value"))
    return made.union(known)


def ratios(training: DataFrame) -> list[float]:
    """By 128 * first + second code: log P(second | first, random) - log P(second | first, ordinary).

    At most 128 x 128 counts of each label come to the driver, whatever is trained on.
    A first character that a label never has is followed by all alike.
    """
    pairs = training.where("length(value) > 1").select(
        "random",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("value") - 1),
                lambda k: F.ascii(F.substr("value", k, F.lit(1))) * CODES
                + F.ascii(F.substr("value", k + 1, F.lit(1))),
            )
        ).alias("pair"),
    )
    found = pairs.groupBy("random", "pair").count().where(f"pair < {CODES * CODES}").collect()
    counts = np.full((2, CODES, CODES), SMOOTHING)
    for row in found:
        counts[row.random, row.pair // CODES, row.pair % CODES] += row["count"]
    chances = np.log(counts / counts.sum(axis=2, keepdims=True))
    return (chances[1] - chances[0]).ravel().tolist()


def _random(value: Column, weights: Column) -> Column:
    """Whether the pairs of characters in a string are likelier in random ones.

    The characters are cut once, and each is looked at with the one before it.
    """
    codes = F.transform(F.split(value, ""), F.ascii)
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("ratio"))

    def step(state: Column, code: Column) -> Column:
        ratio = F.when(state["before"] < 0, F.lit(0.0)).otherwise(
            F.get(weights, state["before"] * CODES + code)
        )
        return F.struct(code.alias("before"), (state["ratio"] + ratio).alias("ratio"))

    def enough(state: Column) -> Column:
        return (state["ratio"] >= MIN_RATIO) & (
            state["ratio"] >= MIN_PAIR_RATIO * (F.length(value) - 1)
        )

    return F.aggregate(codes, start, step, enough)


# The operator


def scan(
    docs: DataFrame,
    weights: list[float],
    text_col: str = "text",
    out: str = "secrets",
    partly: bool = False,
) -> DataFrame:
    """The rows of `docs` with a column `out`: array<struct<start, order, end, kind>>.

    Positions are code points, end exclusive; sorted by start, then by kind as
    KINDS lists them. A null or empty text has none. Kinds "assign", "access" and
    "hex" are the known forms; "markov" is a string of CANDIDATE that the models
    find random, and that no known form overlaps; with `partly`, that no single known
    span covers whole. A column of `docs` named as `out` is replaced; rows that repeat
    are scanned one by one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(
        _spans(matches(text, ASSIGN), "assign", _long_enough),
        _spans(matches(text, ACCESS), "access"),
        _spans(matches(text, HEX), "hex"),
    )
    table = F.lit(np.array(weights, dtype=np.float64))

    candidates = F.filter(matches(text, CANDIDATE), lambda x: _random(x["m"], table))
    both = F.struct(base.alias("b"), _spans(candidates, "markov").alias("c"))
    found = docs.withColumn(out, both)
    known, more = F.col(out)["b"], F.col(out)["c"]
    spans = F.when(F.size(more) == 0, known).otherwise(
        F.concat(known, _uncovered(known, more, partly))
    )
    return found.withColumn(out, F.array_sort(spans))


def _uncovered(known: Column, more: Column, partly: bool) -> Column:
    """The spans of `more` that no known one overlaps; with `partly`, that none covers whole.

    Put in one order, a known span before those of `more` that it can meet, what counts
    is the farthest end of the known ones so far: no span is compared with all others.
    """

    def mark(spans: Column, at, is_more: int, reach) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(
                at(x).alias("at"), F.lit(is_more).alias("more"), reach(x).alias("reach"), x.alias("x")
            ),
        )

    meets = (lambda x: x["start"]) if partly else (lambda x: x["end"] - 1)
    marked = F.array_sort(
        F.concat(
            mark(known, lambda x: x["start"], 0, lambda x: x["end"]),
            mark(more, meets, 1, lambda x: F.lit(0)),
        )
    )

    def left(order: Column) -> Column:
        farthest = _running(F.transform(order, lambda x: x["reach"]), F.greatest)
        needed = (lambda x: x["end"]) if partly else (lambda x: x["start"] + 1)
        pairs = F.zip_with(
            order,
            farthest,
            lambda x, end: F.when((x["more"] == 1) & (end < needed(x["x"])), x["x"]),
        )
        return F.filter(pairs, lambda x: x.isNotNull())

    return F.get(F.transform(F.array(marked), left), F.lit(0))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The weights of the models, from a bounded sample of the documents."""
    return ratios(training_rows(docs, id_col, text_col))


def digest_columns(secrets: str = "secrets") -> list[Column]:
    """Counts and joined spans of a scanned frame."""
    spans = F.col(secrets)
    base = F.filter(spans, lambda x: x["kind"] != "markov")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")

    return [
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    ]


#: Characters of the blocks that a text is cut into to take pieces out of it.
BLOCK = 1024


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of a text in blocks, of which only those between are read."""
    first, last = (start / BLOCK).cast("int"), (end / BLOCK).cast("int")
    head, tail = F.get(blocks, first), F.coalesce(F.get(blocks, last), F.lit(""))
    at = start - first * BLOCK
    within = F.substr(head, at + 1, end - start)
    across = F.concat(
        F.substr(head, at + 1, F.lit(BLOCK)),
        F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substr(tail, F.lit(1), end - last * BLOCK),
    )
    return F.when(start >= end, "").when(first == last, within).otherwise(across)


def _redacted(rows: DataFrame, text_col: str, spans_col: str, mark: str) -> DataFrame:
    """The rows with a mark in the text in the place of its spans, which are in order.

    What a text is cut into is a column, so it is worked out once. It is not bound to the
    variable of a function: Spark does not plan a Python function over such nested ones.
    """
    text, spans, name = F.col(text_col), F.col(spans_col), free_name(rows, "parts")
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"),
        _running(F.transform(spans, lambda x: x["end"]), F.greatest).alias("ends"),
    )
    rows = rows.withColumn(name, F.when(F.size(spans) > 0, parts))
    blocks, ends = F.col(name)["blocks"], F.col(name)["ends"]
    pieces = F.zip_with(
        spans,
        F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ends)),
        lambda x, at: F.when(
            x["start"] >= at, F.concat(_piece(blocks, at, x["start"]), F.lit(mark))
        ).otherwise(""),
    )
    rest = _piece(blocks, F.element_at(ends, -1), F.length(text))
    changed = F.concat(F.array_join(pieces, ""), rest)
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, changed).otherwise(text)).drop(name)


def redact(
    docs: DataFrame, weights: list[float], text_col: str = "text", mark: str = "[secret]"
) -> DataFrame:
    """The rows of `docs` with every secret in the text replaced by a mark.

    Spans that overlap are one. A null text stays null; a text without secrets is
    not changed.
    """
    out = free_name(docs, "secrets")
    found = scan(docs, weights, text_col, out, partly=True)
    return _redacted(found, text_col, out, mark).select(docs.columns)
