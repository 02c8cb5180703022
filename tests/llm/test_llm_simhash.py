"""Operator 7 against all pairs of fingerprints."""

import random

import xxhash

from ringlog.llm import queries, simhash
from ringlog.llm.components import components


def plain_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.translate({k: " " for k in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    if not shingles and words:
        shingles = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, bits):
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for a in keys:
        for b in keys:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_query(spark, texts):
    rows = queries.op7_simhash(spark, "/root/testdata/sf0.001").collect()
    prints = {k: plain_print(t) for k, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert all(len(r.fingerprint) == 16 for r in rows)
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints, 2)


def test_links_lose_none(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for centre in centres:
        for _ in range(25):
            value = centre
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                value ^= 1 << bit
            prints.add(value)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fingerprint bigint")
    for bits in (0, 1, 2, 3, 5):
        found = {frozenset((r.u, r.v)) for r in simhash.links(frame, bits).collect()}
        mask = (1 << 64) - 1
        want = {
            frozenset((a, b)) for (a,) in signed for (b,) in signed
            if a < b and ((a ^ b) & mask).bit_count() <= bits
        }
        assert found == want, bits


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(200)]
    hub = [(1000, 1001 + k) for k in range(300)]
    odd = [(5000, 5000), (None, 7), (6001, 6000), (6000, 6001)]
    frame = spark.createDataFrame(chain + hub + odd, "u bigint, v bigint")
    found = {r.node: r.component for r in components(frame).collect()}
    want = {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(301)} | {6000: 6000, 6001: 6000}
    assert found == want
    assert components(frame.limit(0)).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.id: r for r in rows if r.id is not None}
    assert {by_id[k].component_id for k in (1, 2)} == {1}
    # Texts without a word have fingerprint zero and are linked, with or without an id.
    assert {by_id[k].component_id for k in (3, 4, 8)} == {3}
    assert all(r.component_id in (1, 3) for r in rows if r.id is None)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(k for k in ids if k is not None) == [1, 3, 5, 6, 7, 9]
    assert ids.count(None) == 3
    assert simhash.keep_one(no_docs).count() == 0
