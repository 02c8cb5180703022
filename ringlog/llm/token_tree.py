"""Token counts that follow edits (operator 9).

A text is cut into leaves of some hundred characters, each a run of whole
pre-tokens, with a segment tree over them: every node has the characters and the
tokens below it. An edit finds its leaves by the characters, encodes only these
anew, with the next leaf where the edit has changed the cut between them, and
updates the sums on the way up. The count of the edited text is the root's.

Leaves are cut before a space that stands alone between other characters. The
pattern takes such a space as the beginning of a pre-token whatever is around it,
so the leaves' counts add up to the text's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices

#: A leaf ends at the first cut after so many characters.
LEAF_CHARS = 256
#: Fixed value: the pattern that the public byte-level vocabularies were made with.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
CUT = r"(?<=\S) (?=\S)"
TREE = "struct<chars:array<int>,tokens:array<int>>"
EDITED = "struct<text:string,chars:array<int>,tokens:array<int>,encoded:int,applied:int>"


@dataclass
class Vocabulary:
    """A byte-level BPE: the bytes of its file of ranks, and its pattern of pre-tokens."""

    ranks: bytes
    pattern: str

    def encoding(self):
        import tiktoken

        ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in map(bytes.split, self.ranks.splitlines())
        }
        return tiktoken.Encoding(
            "leaves", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}
        )


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as file:
        return Vocabulary(file.read(), pattern)


# One text


def leaves_of(text: str, cut: re.Pattern) -> list[str]:
    found, at = [], 0
    while True:
        match = cut.search(text, at + LEAF_CHARS)
        if match is None:
            found.append(text[at:])
            return found
        found.append(text[at : match.start()])
        at = match.start()


def sums(values: list[int]) -> list[int]:
    """The segment tree over the values: node k has the children 2k and 2k + 1; 1 is the root."""
    half = 1
    while half < len(values):
        half *= 2
    tree = [0] * half + values + [0] * (half - len(values))
    for k in range(half - 1, 0, -1):
        tree[k] = tree[2 * k] + tree[2 * k + 1]
    return tree


def put(tree: list[int], leaf: int, value: int) -> None:
    k = len(tree) // 2 + leaf
    tree[k] = value
    while k > 1:
        k //= 2
        tree[k] = tree[2 * k] + tree[2 * k + 1]


def locate(chars: list[int], offset: int) -> tuple[int, int]:
    """(leaf, its first character) that holds the character at an offset within the text."""
    half, k, start = len(chars) // 2, 1, 0
    while k < half:
        k *= 2
        if offset - start >= chars[k]:
            start += chars[k]
            k += 1
    return k - half, start


class Text:
    """A text with its trees, under edits."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], encode, cut: re.Pattern):
        self.text, self.chars, self.tokens = text, chars, tokens
        self.encode, self.cut = encode, cut
        self.encoded = 0

    def _is_cut(self, at: int) -> bool:
        return at in (0, len(self.text)) or bool(self.cut.match(self.text, at))

    def edit(self, start: int, end: int, new: str) -> None:
        """Put `new` in place of the characters from start to end."""
        half = len(self.chars) // 2
        last_char = max(self.chars[1] - 1, 0)
        first, low = locate(self.chars, min(start, last_char))
        last, high = locate(self.chars, min(max(start, end - 1), last_char))
        self.text = self.text[:start] + new + self.text[end:]
        high += self.chars[half + last] + len(new) - (end - start)
        while first and not self._is_cut(low):
            first -= 1
            low -= self.chars[half + first]
        while last < half - 1 and not self._is_cut(high):
            last += 1
            high += self.chars[half + last]
        parts = leaves_of(self.text[low:high], self.cut)
        room = last - first + 1
        if len(parts) > room:
            parts = [*parts[: room - 1], "".join(parts[room - 1 :])]
        for k in range(room):
            part = parts[k] if k < len(parts) else ""
            put(self.chars, first + k, len(part))
            put(self.tokens, first + k, len(self.encode(part)) if part else 0)
        self.encoded += high - low


def edited(text: Text, edits: list[dict]) -> int:
    """Apply edits, last first so that the places of the others hold; how many were applied.

    Edits are places in the text as it is. Places beyond its end mean its end; an
    edit that begins before an earlier one ends is left out, and so is one that is null
    or has no start or end. A null text of an edit means that nothing is put in.
    """
    chosen, end = [], 0
    size = len(text.text)
    whole = [e for e in edits if e and e["start"] is not None and e["end"] is not None]
    for edit in sorted(whole, key=lambda e: (e["start"], e["end"])):
        start, stop = min(max(edit["start"], 0), size), min(max(edit["end"], 0), size)
        if start >= end and stop >= start:
            chosen.append((start, stop, edit["text"] or ""))
            end = max(stop, end)
    for start, stop, new in reversed(chosen):
        text.edit(start, stop, new)
    return len(chosen)


# Columns


def tree(text: Column, vocabulary: Vocabulary) -> Column:
    """The trees of a text, struct<chars, tokens>; a null text counts as empty.

    Each is an array of 2 * n numbers for n places for leaves, a power of two: the
    root at 1, the children of k at 2k and 2k + 1.
    """
    kind = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, cut = vocabulary.encoding().encode_ordinary, re.compile(CUT)
        for column in columns:
            found = []
            for part in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
                for value in part.column(0).to_pylist():
                    leaves = leaves_of(value or "", cut)
                    found.append(
                        {
                            "chars": sums([len(leaf) for leaf in leaves]),
                            "tokens": sums([len(encode(leaf)) for leaf in leaves]),
                        }
                    )
            yield pa.array(found, kind)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, TREE)(text)


def edit_tree(text: Column, trees: Column, edits: Column, vocabulary: Vocabulary) -> Column:
    """The text and its trees after edits, struct<text, chars, tokens, encoded, applied>.

    edits is array<struct<start:int,end:int,text:string>> in code points of the
    text, end exclusive; see `edited`. encoded is how many characters were encoded
    anew, applied how many edits counted. A null text counts as empty, null edits
    as none.
    """
    kind = pa.struct(
        [
            ("text", pa.string()),
            ("chars", pa.list_(pa.int32())),
            ("tokens", pa.list_(pa.int32())),
            ("encoded", pa.int32()),
            ("applied", pa.int32()),
        ]
    )

    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        encode, cut = vocabulary.encoding().encode_ordinary, re.compile(CUT)
        for columns_of_batch in columns:
            batch = pa.RecordBatch.from_arrays(list(columns_of_batch), ["text", "trees", "edits"])
            parts = []
            for part in slices(iter([batch]), "text"):
                found = []
                rows = zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)
                for value, known, changes in rows:
                    state = Text(value or "", known["chars"], known["tokens"], encode, cut)
                    applied = edited(state, changes or [])
                    found.append(
                        {
                            "text": state.text,
                            "chars": state.chars,
                            "tokens": state.tokens,
                            "encoded": state.encoded,
                            "applied": applied,
                        }
                    )
                parts.append(pa.array(found, kind))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {
        "columns": Iterator[tuple[pa.Array, ...]],
        "return": Iterator[pa.Array],
    }
    return F.arrow_udf(run, EDITED)(text, trees, edits)


def gathered(edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, edits): the rows (id, start, end, text) as one array for each document.

    An array holds the edits of one document only, and is no longer than these.
    """
    each = F.struct("start", "end", "text")
    return edits.groupBy(id_col).agg(F.collect_list(each).alias("edits"))


def tokens_of(trees: Column) -> Column:
    """The root: how many tokens a text has."""
    return F.get(trees["tokens"], F.lit(1)).cast("bigint")
