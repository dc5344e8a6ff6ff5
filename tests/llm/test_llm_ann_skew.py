"""Neighbours where a large part of the vectors are near copies."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from decoylens.llm import ann


def skewed(rng):
    matrix = rng.standard_normal((900, 16)).astype(np.float32)
    matrix[300:600] = matrix[300] + rng.standard_normal((300, 16)).astype(np.float32) * 1e-3
    return matrix


def found(frame):
    return {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(frame, F.col("vec_id") % 20 == 0).collect()}


def test_a_cell_of_near_copies_is_sliced(spark, monkeypatch):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(skewed(np.random.default_rng(7)))], "vec_id long, embedding array<float>")
    whole = found(frame)
    monkeypatch.setattr(ann, "GROUP_ROWS", 64)
    p = ann.plan(900, 45, 16, float(np.sqrt((skewed(np.random.default_rng(7)).astype(float) ** 2).sum(axis=1).max())))
    classes = frame.select(F.col("embedding").alias("vector"))
    slices = ann.group_slices(classes, 900, p)
    assert p.groups > 1 and (slices.max(axis=1) >= 300 // 64).all() and slices.min() == 1
    assert found(frame) == whole


def test_a_large_cell_is_walked_in_blocks():
    rng = np.random.default_rng(3)
    vectors, queries = rng.standard_normal((20_000, 8)), rng.standard_normal((200, 8))
    codes, ids = np.zeros(20_000, np.int64), np.arange(20_000)
    tracemalloc.start()
    q, near, score = ann.best_in_cells(codes, ids, vectors, [np.zeros(1, np.int64)] * 200, queries, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for i in range(0, 200, 20):
        best = np.argsort(-(vectors @ queries[i]))[:5]
        mine = sorted(zip(-score[q == i], near[q == i]))[:5]
        assert [n for _, n in mine] == best.tolist()
