"""HyperMinHash groups against the similarity of all pairs of whole shingle sets."""

import random

import brute
import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from decoylens.llm import hyperminhash as H

VOCABULARY = [f"w{i}" for i in range(3000)]


def shingles(text, size=4):
    own = [w for w in brute.lower(text or "").split(" ") if w]
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def truth(docs):
    """(id, set size, smallest id reachable) of each document, over all pairs."""
    sets, part = [shingles(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                part[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(docs):
        ids.setdefault(root(i), []).append(doc_id)
    return sorted((doc_id, len(s), min(ids[root(i)])) for i, ((doc_id, _), s) in enumerate(zip(docs, sets)))


def changed(rng, text, n):
    own = text.split()
    for at in rng.sample(range(len(own)), n):
        own[at] = rng.choice(VOCABULARY) + "x"
    return " ".join(own)


def corpus(rng):
    base = [" ".join(rng.choices(VOCABULARY, k=k)) for k in [4, 6, 9, 25, 60] * 3 + [150, 400] * 4]
    near = [changed(rng, b, max(1, len(b.split()) // 40 * n)) for b in base for n in (1, 2, 3)]
    longer = [f"{b} {rng.choice(VOCABULARY)}" for b in base]
    crowd = [changed(rng, base[-2], rng.choice([1, 2, 4, 7])) for _ in range(60)]
    common = [f"{base[3]} {' '.join(rng.choices(VOCABULARY, k=40))}" for _ in range(30)]
    return list(enumerate([*base, *base[:4], *near, *longer, *crowd, *common]))


@pytest.mark.parametrize("nodes, pivots", [(1024, 32), (8, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, nodes, pivots):
    monkeypatch.setattr(H, "TASK_NODES", nodes)
    monkeypatch.setattr(H, "PIVOTS", pivots)
    docs = corpus(random.Random(3))
    random.Random(1).shuffle(docs)
    rows = H.groups(cases.documents(spark, docs, extra=True)).select("_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, rows)) == truth(docs)


def test_nodes_of_a_bucket_that_hang_together_by_no_pivot(spark, monkeypatch):
    """Two crowds that agree in their bands only by force: each is found whole, and they stay apart."""
    monkeypatch.setattr(H, "TASK_NODES", 6)
    monkeypatch.setattr(H, "PIVOTS", 1)
    monkeypatch.setattr(H, "_sketches", lambda texts, own=H._sketches: own(texts).assign(bands=[np.array([7])] * len(texts)))
    rng = random.Random(5)
    base = [" ".join(rng.choices(VOCABULARY, k=80)) for _ in range(3)]
    docs = list(enumerate([changed(rng, b, 1) for b in base for _ in range(9)] + [" ".join(rng.choices(VOCABULARY, k=80)) for _ in range(5)]))
    rows = H.groups(cases.documents(spark, docs)).select("_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, rows)) == truth(docs)


def test_awkward_documents(spark):
    docs = [*cases.AWKWARD, (20, "The same words in the same order every time they are SAID"), (11, "　 wide blank is a word"), (12, "x" * 300_000)]
    frame = cases.documents(spark, docs, extra=True)
    rows = {(r["_id"], r["n_shingles"], r["component_id"]) for r in H.groups(frame).collect()}
    assert H.groups(frame).count() == len(docs) and H.groups(frame.limit(0)).count() == 0
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 9, 5), (6, 9, 5), (20, 9, 5), (None, 0, None), (None, 9, None), (8, 2, 8), (11, 3, 11), (12, 1, 12)} <= rows


def test_an_id_names_a_group_before_null(spark):
    docs = [(None, "one two three four five"), (9, "one two three four five"), (9, "one two three four five")]
    assert {r["component_id"] for r in H.groups(cases.documents(spark, docs)).collect()} == {9}


def test_registers_hold_zeros_and_mantissa_of_the_smallest_hash():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 3000):
        hashes, expected = rng.integers(0, 2**64, n, np.uint64), [0] * H.REGISTERS
        least = {}
        for h in map(int, hashes):
            mixed = (h ^ h >> 29) * 0x9E3779B97F4A7C15 % 2**64
            mixed = (mixed ^ mixed >> 32) * 0xD6E8FEB86659FD93 % 2**64 >> 11
            bucket = (h >> 40) * H.REGISTERS >> 24
            least[bucket] = min(least.get(bucket, 2**53), mixed)
        for bucket, v in least.items():
            binary = f"{v:053b}"
            zeros = len(binary) - len(binary.lstrip("0"))
            expected[bucket] = zeros + 1 << 10 | int(binary[zeros + 1 :].ljust(10, "0")[:10], 2)
        assert H.registers(hashes).tolist() == expected


def pair(rng, size, shared):
    every = rng.integers(0, 2**64, 2 * size - shared, np.uint64)
    return np.unique(every[:size]), np.unique(every[size - shared :])


@pytest.mark.parametrize("size", [9, 45, 180, 1800])
def test_pairs_of_the_least_overlap_meet_and_pass(size):
    """Sets that share 8 of 9 hashes each, the least that counts: in a band, and by the estimate."""
    rng = np.random.default_rng(size)
    for _ in range(200):
        a, b = map(H.registers, pair(rng, size, size * 8 // 9))
        assert (H.band_keys(a) == H.band_keys(b)).any()
        agree, either = H.similarity(a, b[None, :], size, np.array([size]))
        assert agree[0] >= H.least_agreeing()[either[0]] - 1


def test_estimates_are_corrected_for_accidents(monkeypatch):
    monkeypatch.setattr(H, "MANTISSA", 2)  # so few bits that accidents are many
    for cache in (H._cell_chances, H.accidents):
        cache.cache_clear()
    rng, size = np.random.default_rng(2), 20_000
    raw, corrected = [], []
    for _ in range(300):
        a, b = map(H.registers, pair(rng, size, 0))
        agree, either = H.similarity(a, b[None, :], size, np.array([size]))
        raw.append(((a == b) & (a > 0)).sum())
        corrected.append(agree[0])
    for cache in (H._cell_chances, H.accidents):
        cache.cache_clear()
    assert np.mean(raw) > 5 and abs(np.mean(corrected)) < 0.1 * np.mean(raw)


def test_estimates_are_close():
    rng = np.random.default_rng(3)
    for shared in (0.3, 0.6, 0.9):
        found = [H.similarity(a, b[None, :], 3000, np.array([3000])) for a, b in (map(H.registers, pair(rng, 3000, int(3000 * shared))) for _ in range(60))]
        assert abs(np.mean([x[0] / n[0] for x, n in found]) - shared / (2 - shared)) < 0.03


def test_short_texts_have_whole_bands():
    keys = H.band_keys(H.registers(np.arange(3, dtype=np.uint64) * np.uint64(2**60 + 12345)))
    assert len(keys) == H.BANDS and len(set(keys)) == H.BANDS and len(H.band_keys(H.registers(np.zeros(0, np.uint64)))) == 0


def test_columns_of_the_query(spark):
    from decoylens.llm import queries

    rows = queries.op11_hyperminhash(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows.filter(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0
