"""Hard negatives and centroid clustering against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from decoylens.llm import hardnegatives as N, lloyd

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, block string, id string, cells string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# Hard negatives

def hard_negatives(rows, step):
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and finite(v):
            one = (label, [math.floor(256 * x) for x in v])
            best[i] = min(best.get(i, one), one)
    result = []
    for a, (label, own) in best.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(own, v)), i, other) for i, (other, v) in best.items() if i != a)
        for s, p, other in [x for x in scored if x[2] == label][:5]:
            found = [(i, -t) for t, i, kind in scored if kind != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            result += [(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(found, 1)]
    return sorted(result)


def vectors(rng, n, width=6):
    rows = [(i, [round(rng.gauss(0, 1), 1) + (i % 4) for _ in range(width)], rng.randrange(3)) for i in range(n)]
    rows += [(n + i, rows[7][1], i % 3) for i in range(40)]  # ties
    rows += [(None, rows[0][1], 1), (n + 50, None, 1), (n + 51, rows[1][1], None), (n + 52, [1.0, None, 2.0], 1), (n + 53, [NAN] * width, 0), (n + 54, [INF] * width, 0)]
    rows += [(n + 55, [], 1), (n + 56, [3.0, 1.0], 2), (n + 57, [0.0] * width, 1), (20, rows[3][1], 2), (20, rows[3][1], 2), (-40, rows[2][1], 0)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ROWS": 16, "ANCHOR_ROWS": 4, "CHUNK_ROWS": 3, "BROADCAST_BYTES": 0}])
def test_hard_negatives(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(N, name, value)
    rows = vectors(random.Random(4), 150)
    expected = hard_negatives(rows, 20)
    data = frame(spark, rows)
    assert sorted(map(tuple, N.mine(data, F.col("id") % 20 == 0).collect())) == expected and len(expected) > 100
    assert N.mine(data.limit(0), F.lit(True)).count() == 0 and N.mine(data, F.lit(False)).count() == 0
    assert N.mine(data.withColumn("label", F.lit(1)), F.col("id") % 20 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-2e5, 2e5) for _ in range(20)], i % 2) for i in range(60)]
    assert sorted(map(tuple, N.mine(frame(spark, rows), F.col("id") % 5 == 0).collect())) == hard_negatives(rows, 5)
    assert N.mine(frame(spark, [(i, [1e300, -1e300], i % 2) for i in range(6)]), F.lit(True)).count() > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-(2**63), 2**63 - 1)] * 2, st.integers(0, 1), st.integers(-(2**63), 2**63 - 1)), min_size=2, max_size=2))
def test_keys_sort_by_anchor_descending_score_kind_id(keys):
    a, b = keys
    order = lambda k: (k[0], -k[1], k[2], k[3])
    assert (N.packed(*a) < N.packed(*b)) == (order(a) < order(b))
    assert N.unpacked(N.packed(*a)) == a


def test_windows_are_read_as_a_stream():
    """The iterator gives a row as soon as its key is read, and holds no more than the open windows."""

    def keys():
        yield N.packed(1, 100, N.POSITIVE, 5), None
        for i in range(10**9):  # never read to its end
            yield N.packed(1, 100, N.NEGATIVE, i), None

    found = N.negatives(keys(), 3, (80, 100))
    assert [next(found) for _ in range(3)] == [(1, 5, r, r - 1, 100, 100) for r in (1, 2, 3)]


# Centroid clustering

def clustering(rows, clusters, rounds, width):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if finite(v) and len(v) == width]
    draw = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=draw)[:clusters]]
    for turn in range(rounds + 1):
        far = [[sum((x - y) ** 2 for x, y in zip(v, c)) for c in centres] for _, v in kept]
        to = [d.index(min(d)) for d in far]
        for k in range(len(centres) if turn < rounds else 0):
            own = [v for (_, v), c in zip(kept, to) if c == k]
            centres[k] = [sum(x) // len(own) for x in zip(*own)] if own else centres[k]
    inertia = [sum(min(d) for d, c in zip(far, to) if c == k) for k in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, min(d), inertia[k], sum(inertia), sha[k]) for (i, _), k, d in zip(kept, to, far)), key=str)


@pytest.mark.parametrize("limits", [{}, {"SHARD_COLUMNS": 2, "BLOCK_ROWS": 16, "BROADCAST_BYTES": 0}])
def test_lloyd(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lloyd, name, value)
    rows = vectors(random.Random(5), 150, width=7)
    data = frame(spark, rows)
    for clusters, rounds in ((5, 3), (1, 1), (400, 2)):
        found = lloyd.report(*lloyd.cluster(data, clusters, rounds, width=7))
        assert found.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, found.collect()), key=str) == clustering(rows, clusters, rounds, 7)
    assert lloyd.report(*lloyd.cluster(data.limit(0), 5, 2, width=7)).count() == 0


def test_lloyd_of_large_and_equal_components(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-9e5, 9e5) for _ in range(5)], 0) for i in range(80)] + [(100 + i, [2.5] * 5, 0) for i in range(80)]
    assert sorted(map(tuple, lloyd.report(*lloyd.cluster(frame(spark, rows), 6, 3, width=5)).collect()), key=str) == clustering(rows, 6, 3, 5)
    assert lloyd.report(*lloyd.cluster(frame(spark, [(1, [1e300] * 5, 0), (2, [-1e300] * 5, 0)]), 1, 1, width=5)).count() == 2


def test_shards_add_up():
    rng = np.random.default_rng(2)
    own, centres = rng.integers(-200, 200, (30, 10)), rng.integers(-200, 200, (4, 10))
    parts = [lloyd.partial_distances(own[:, c].astype("<i4").tobytes(), 30, centres[:, c]) for c in (slice(0, 4), slice(4, 8), slice(8, 10))]
    assert (sum(parts) == ((own[:, None, :] - centres[None]) ** 2).sum(axis=2)).all()
    assert lloyd.moved(np.array([[5, 5], [7, 7]]), np.array([[-3, 4, 2], [0, 0, 0]])).tolist() == [[-2, 2], [7, 7]]
