"""Softmax boosting against a version in plain loops, and fits in step against fits alone."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from decoylens.operators import boosting as B, classify as K

SCHEMA = "src_ip string, label string, label_id double, w double, fold int, x array<double>"


def table(spark, n=160, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 0.5)
    rows = [(f"p{i}", "abc"[c], float(c), float(1 + i % 3), i % 3, [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SCHEMA).withColumn("features", array_to_vector("x")), x, y


def plain_tree(rows, codes, g, h, depth, rate, bins):
    """The value that each row gets, by recursion over sets of rows."""
    total = sum(g[i] for i in rows), sum(h[i] for i in rows)
    values = {i: -rate * total[0] / (total[1] + 1.0) for i in rows}
    if depth == 0 or total[1] < 2.0:
        return values
    best = (1e-9, None)
    for f in range(len(codes[0])):
        for b in range(bins - 1):
            left = [i for i in rows if codes[i][f] <= b]
            gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
            gr, hr = total[0] - gl, total[1] - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - total[0] ** 2 / (total[1] + 1)
            if hl >= 1.0 and hr >= 1.0 and gain > best[0] + 1e-9:
                best = gain, (f, b)
    if best[1]:
        f, b = best[1]
        for side in ([i for i in rows if codes[i][f] <= b], [i for i in rows if codes[i][f] > b]):
            values |= plain_tree(side, codes, g, h, depth - 1, rate, bins)
    return values


def plain(codes, y, w, classes, rounds, depth, rate, bins):
    margin = [[0.0] * classes for _ in y]
    for _ in range(rounds):
        shares = [[math.exp(m) / sum(map(math.exp, row)) for m in row] for row in margin]
        trees = []
        for c in range(classes):
            g = [(p[c] - (k == c)) * v for p, k, v in zip(shares, y, w)]
            h = [2 * p[c] * (1 - p[c]) * v for p, v in zip(shares, w)]
            trees.append(plain_tree(range(len(y)), codes, g, h, depth, rate, bins))
        margin = [[m + t[i] for m, t in zip(row, trees)] for i, row in enumerate(margin)]
    return np.array(margin).T


def test_margins_are_those_of_plain_loops(spark):
    df, x, y = table(spark)
    run, _ = B.fit_together(df, [B.Setting(3, 3, 0.3)], 3, weight="w", bins=8)
    codes = run.binned(x)
    assert run.edges and all(len(e) <= 7 for e in run.edges)
    expected = plain(codes.tolist(), y.tolist(), [1.0 + i % 3 for i in range(len(y))], 3, 3, 3, 0.3, 8)
    assert np.allclose(run.margins(codes)[0], expected)
    assert run.importance().sum() == pytest.approx(1) and run.importance().argmin() == 3  # the fourth feature is noise
    found = {r.src_ip: r.prediction for r in run.transform(df).select("src_ip", "prediction").collect()}
    assert [found[f"p{i}"] for i in range(len(y))] == expected.argmax(axis=0).tolist()


def test_fits_in_step_equal_fits_alone(spark, monkeypatch):
    df, x, _ = table(spark)
    settings = [B.Setting(4, 2, 0.3), B.Setting(3, 4, 0.1, without=1), B.Setting(4, 3, 0.5, without=2)]
    monkeypatch.setattr(B, "CELLS", 300)  # several groups of nodes a level
    monkeypatch.setattr(B, "REPLAY", 2)  # margins are replayed
    monkeypatch.setattr(B, "BLOCK_ROWS", 50)
    monkeypatch.setattr(B, "TASK_ROWS", 60)
    together, read = B.fit_together(df, settings, 3, fold="fold", bins=8, read_at=(2, 4))
    monkeypatch.undo()
    codes = together.binned(x)
    for i, s in enumerate(settings):
        own = df.withColumn("w", (F.col("fold") != (-1 if s.without is None else s.without)).cast("double"))
        alone, _ = B.fit_together(own, [B.Setting(s.rounds, s.depth, s.rate)], 3, weight="w", bins=8)
        assert np.allclose(together.margins(codes)[i], alone.margins(codes)[0])
        assert np.allclose(together.only(i, 2).margins(codes)[0], alone.margins(codes, 2)[0])
        if s.without is not None:
            for n in (2, 4):
                counts = read[n][read[n]["point"] == i]
                guess = alone.margins(codes, n)[0].argmax(axis=0)
                out = [j for j in range(len(x)) if j % 3 == s.without]
                assert counts["n"].sum() == len(out)
                hits = counts[counts["label"] == counts["prediction"]]["n"].sum()
                labels = [int(r.label_id) for r in df.select("src_ip", "label_id").collect()]
                assert hits == sum(guess[j] == labels[j] for j in out)


def test_a_grid_reads_every_point_from_one_run(spark):
    df, _, _ = table(spark, 200)
    train, test = df.filter("src_ip NOT LIKE '%7'").drop("fold"), df.filter("src_ip LIKE '%7'")
    got = K.boost_grid(train, test, "label", 3, {"rounds": (2, 5), "depth": (1, 3), "rate": (0.1, 0.5)}, folds=3).collect()
    assert {r.params for r in got} == {f"rounds={n} depth={d} rate={r}" for n in (2, 5) for d in (1, 3) for r in (0.1, 0.5)}
    best = max(got, key=lambda r: r.cv_f1)
    assert sum(r.is_best for r in got) == 1 and best.cv_f1 > 0.8 and best.test_f1 > 0.8
    single = K.boosted_trees(5, 3, 0.5, 3).fit(train)
    score = K.scored(single, test, "m").first()["weighted_f1"]
    assert next(r for r in got if r.params == "rounds=5 depth=3 rate=0.5").test_f1 == pytest.approx(score)


def test_tables_without_rows_or_with_one_class(spark):
    df, _, _ = table(spark, 30)
    empty, _ = B.fit_together(df.limit(0), [B.Setting(2, 2)], 3)
    assert {r.prediction for r in empty.transform(df).select("prediction").collect()} == {0.0}
    one = K.boosted_trees(2, 2).fit(df.withColumn("label_id", F.lit(0.0)))
    assert {r.prediction for r in one.transform(df).select("prediction").collect()} == {0.0}
    last = K.boosted_trees(2, 2).fit(df.withColumn("label_id", F.lit(2.0)))
    assert {r.prediction for r in last.transform(df).select("prediction").collect()} == {2.0}
    few = K.boosted_trees(3, 2).fit(df.withColumn("label_id", F.lit(1.0)))
    assert few.transform(df.limit(0)).count() == 0
