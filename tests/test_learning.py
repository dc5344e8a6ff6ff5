import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import harness
from decoylens.operators import classify as K, cluster as C, evaluate as E, features as FT
from decoylens.plans import adapters as A, learning

SF = f"{harness.DATA}/sf0.01"


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{c}-{i}", c, [float(v) for v in rng.normal(3 * c, 1.0, 4)]) for c in range(3) for i in range(60)]
    return spark.createDataFrame(rows, "src_ip string, cluster int, x array<double>").cache()


def test_cluster_indices_against_numpy(blobs):
    rows = blobs.collect()
    x, y = np.array([r.x for r in rows]), np.array([r.cluster for r in rows])
    centres = np.array([x[y == c].mean(0) for c in range(3)])
    scatter = np.array([np.linalg.norm(x[y == c] - centres[c], axis=1).mean() for c in range(3)])
    worst = [max((scatter[i] + scatter[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(3) if j != i) for i in range(3)]
    assert E.davies_bouldin(blobs).first()[0] == pytest.approx(np.mean(worst))
    between = sum((y == c).sum() * ((centres[c] - x.mean(0)) ** 2).sum() for c in range(3))
    within = sum(((x[y == c] - centres[c]) ** 2).sum() for c in range(3))
    assert E.calinski_harabasz(blobs).first()[0] == pytest.approx((between / 2) / (within / (len(x) - 3)))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    expected = {}
    for i, r in enumerate(rows):
        a = d[i][y == y[i]].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i][y == c].mean() for c in range(3) if c != y[i])
        expected[r.src_ip] = (b - a) / max(a, b)
    got = dict(E.silhouette_points(blobs, "src_ip").select("src_ip", "silhouette").collect())
    assert got == pytest.approx(expected, abs=1e-9)
    both = blobs.select(F.lit(3).alias("k"), "cluster", "x").unionByName(blobs.select(F.lit(2).alias("k"), F.least("cluster", F.lit(1)).alias("cluster"), "x"))
    assert dict(E.davies_bouldin(both, by=["k"]).collect())[3] == pytest.approx(np.mean(worst))


def test_many_centres_are_met_one_by_one(blobs, monkeypatch):
    """The salted join beyond the size of the table gives the same silhouettes, for one clustering and for several."""
    both = blobs.select(F.lit(3).alias("k"), "src_ip", "cluster", "x").unionByName(blobs.select(F.lit(2).alias("k"), "src_ip", F.least("cluster", F.lit(1)).alias("cluster"), "x"))
    small = {tuple(r)[:2]: r.silhouette for r in E.silhouette_points(both, "src_ip", by=["k"]).collect()}
    one = dict(E.silhouette_points(blobs, "src_ip").select("src_ip", "silhouette").collect())
    monkeypatch.setattr(E, "TABLE_CELLS", 3)
    large = {tuple(r)[:2]: r.silhouette for r in E.silhouette_points(both, "src_ip", by=["k"]).collect()}
    assert large == pytest.approx(small, abs=1e-9) and len(small) == 360
    assert dict(E.silhouette_points(blobs, "src_ip").select("src_ip", "silhouette").collect()) == pytest.approx(one, abs=1e-9)
    assert {ip: v for (k, ip), v in small.items() if k == 3} == pytest.approx(one, abs=1e-9)


def test_singleton_cluster_has_zero_silhouette(spark):
    df = spark.createDataFrame([("a", 0, [0.0]), ("b", 0, [1.0]), ("c", 1, [9.0])], "src_ip string, cluster int, x array<double>")
    assert dict(E.silhouette_points(df, "src_ip").select("src_ip", "silhouette").collect())["c"] == 0.0


def test_kmeans_is_repeatable_and_best_of_inits(blobs):
    vectors = C.training_set(blobs.select("src_ip", array_to_vector("x").alias("features")))
    one, many = C.best_kmeans(vectors, 3, 1), C.best_kmeans(vectors, 3, 3)
    assert many.summary.trainingCost <= one.summary.trainingCost
    assert C.best_kmeans(vectors, 3, 3).summary.trainingCost == pytest.approx(many.summary.trainingCost)
    sweep = E.consensus_k(C.k_sweep(vectors, (2, 3, 4), 1))
    assert sweep.filter("is_best = 1").first().k == 3


def test_stored_clusters_are_those_of_the_model(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"{g}-{i}", float(rng.normal(50 * g, 1)), float(rng.normal(9 * g, 1))) for g in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "src_ip string, total_attempts double, hour_entropy double")
    columns = ["total_attempts", "hour_entropy"]
    scaled, scaling = C.preprocess(df, columns)
    vectors = C.training_set(C.assemble(scaled, columns).select("src_ip", "features"))
    model = C.best_kmeans(vectors, 2, 2)
    C.store_clusters(model, scaling, df, vectors, str(tmp_path / "c"))
    again, centres, assignment = C.stored_clusters(spark, str(tmp_path / "c"))
    expected = dict(model.transform(vectors).select("src_ip", "cluster").collect())
    assert dict(assignment.select("src_ip", "cluster").collect()) == expected == dict(again.transform(vectors).select("src_ip", "cluster").collect())
    names = dict(centres.select("cluster", "cluster_label").collect())
    assert sorted(names.values()) == ["Bot", "Manual"]
    assert {r.src_ip: r.cluster_label for r in assignment.collect()} == {ip: names[c] for ip, c in expected.items()}
    assert len({(ip[0], label) for ip, label in assignment.select("src_ip", "cluster_label").collect()}) == 2


def test_centres_return_to_units(spark):
    rows = [(f"{i}", float(i % 7) * 100, float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "src_ip string, big double, small double")
    scaled, scaling = C.preprocess(df, ["big", "small"])
    assert scaling.logged == {"big"}
    model = C.best_kmeans(C.training_set(C.assemble(scaled, ["big", "small"])), 2, 2)
    for row in C.centres_in_units(model, scaling, df).collect():
        assert -1e-6 <= row.small <= 2 + 1e-6 and -1e-6 <= row.big <= 600 + 1e-6


def test_consensus_ties_go_to_the_smallest_k(spark):
    metrics = spark.createDataFrame([(2, 0.3, 1.2, 10.0), (3, 0.4, 1.3, 20.0), (4, 0.5, 1.4, 5.0)], "k int, silhouette double, davies_bouldin double, calinski_harabasz double")
    got = {r.k: (r.rank_sum, r.is_best) for r in E.consensus_k(metrics).collect()}
    assert got == {2: (3, 0), 3: (2, 1), 4: (4, 0)}
    tied = spark.createDataFrame([(2, 0.3, 1.2, 10.0), (3, 0.4, 1.3, 10.0)], metrics.schema)
    assert {r.k: r.is_best for r in E.consensus_k(tied).collect()} == {2: 1, 3: 0}


def test_roc_equals_the_evaluator(spark):
    rng = random.Random(1)
    rows = [(float(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "label double, score double")
    expected = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df)
    assert E.roc_auc(df, "label", "score").first()[0] == pytest.approx(expected)


def test_reports(spark):
    pairs = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15
    df = spark.createDataFrame(pairs, "label string, prediction string")
    assert E.agreement(df, "label", "prediction", 10).first().kappa == pytest.approx(0.4)
    row = E.agreement(df, "label", "prediction").first()
    assert (row.n, row.enough) == (50, 0) and E.agreement(df.limit(0), "label", "prediction").first().n == 0
    report = {r.label: r for r in E.class_report(df).collect()}
    assert report["a"].precision == pytest.approx(2 / 3) and report["a"].recall == pytest.approx(0.8) and report["b"].support == 25
    matrix = E.confusion_matrix(df, ["b", "a", "c"]).orderBy("position").collect()
    assert [tuple(r) for r in matrix] == [(0, "b", 15, 10, 0), (1, "a", 5, 20, 0), (2, "c", 0, 0, 0)]


def test_names_by_rank(spark):
    scores = lambda k: spark.createDataFrame([(i, float(i)) for i in range(k)], "cluster int, bot_score double")
    names = lambda k: [r.cluster_label for r in C.name_scores(scores(k)).orderBy("cluster").collect()]
    assert names(2) == ["Manual", "Bot"]
    assert names(3) == ["Manual", "Hybrid", "Bot"]
    assert names(6) == ["Manual", "Manual", "Hybrid", "Hybrid", "Bot", "Bot"]


def test_classifiers_learn(spark):
    df = FT.labelled_flows(A.flows(spark, SF)).withColumn("label", F.when(F.col("flow_count") > 300, "Bot").otherwise("Manual"))
    table = K.compare_models(df, ["flow_count", "unique_dst_ports"], "label", trees=10, rounds=3, timings=True).collect()
    assert {r.model for r in table} == {"Random Forest", "Boosted Trees", "Kernel SVM", "Logistic Regression"}
    assert [r.is_best for r in sorted(table, key=lambda r: (-r.weighted_f1, r.model))] == [1, 0, 0, 0]
    assert all(r.weighted_f1 > 0.85 and r.fit_seconds > 0 for r in table)


def test_a_grown_forest_answers_for_tighter_limits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] + x[:, 1] > 0).astype(int) + (rng.random(300) < 0.2)) % 3
    df = spark.createDataFrame([(f"p{i}", "abc"[c], float(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "src_ip string, label string, label_id double, x array<double>")
    df = C.training_set(df.withColumn("features", array_to_vector("x")))
    model = K.random_forest(12, None).fit(df)
    forest = K.GrownForest(spark, model)
    whole = {r.src_ip: int(r.prediction) for r in model.transform(df).select("src_ip", "prediction").collect()}
    settings = [(12, None, 2), (12, 2, 2), (5, None, 40), (12, 0, 2)]
    found = forest.predict(x, settings)
    assert np.mean([whole[f"p{i}"] == found[i, 0] for i in range(300)]) > 0.99  # ties may go another way

    def plain(row, trees, depth, split):
        votes = np.zeros(3)
        for tree in range(trees):
            node, level = forest.first[tree], 0
            while forest.left[node] >= 0 and forest.count[node] >= split and (depth is None or level < depth):
                node = forest.left[node] if row[forest.column[node]] <= forest.threshold[node] else forest.right[node]
                level += 1
            votes += forest.shares[node]
        return votes.argmax()

    for k, s in enumerate(settings):
        assert [plain(row, *s) for row in x] == found[:, k].tolist()
    table = K.forest_grid(df.filter("src_ip < 'p3'"), df.filter("src_ip >= 'p3'"), "label", {"trees": (4, 12), "depth": (2, None), "min_split": (2, 10)}, folds=3).collect()
    assert len(table) == 8 and sum(r.is_best for r in table) == 1 and all(0.3 < r.cv_f1 <= 1 and 0.3 < r.test_f1 <= 1 for r in table)


def test_weighted_f1_equals_the_report(spark):
    rng = random.Random(2)
    pairs = [(float(rng.randrange(3)), float(rng.randrange(3))) for _ in range(200)]
    counts = pd.DataFrame([(0, a, b, 1) for a, b in pairs], columns=["point", "label", "prediction", "n"]).groupby(["point", "label", "prediction"], as_index=False)["n"].sum()
    expected = E.weighted_scores(spark.createDataFrame(pairs, "label double, prediction double")).first()["weighted_f1"]
    assert K.weighted_f1(counts, 1)[0] == pytest.approx(expected)


def test_sequence_scenario(spark):
    table = learning.sequence_scenarios(spark, SF, epochs=10, rounds=2, only=("events actor",)).collect()
    assert {r.model for r in table} == {"Perceptron", "Boosted Trees"} and all(0 <= r.f1 <= 1 for r in table)


def test_scaling_learns_from_training_rows_only(spark):
    rows = [(str(i), float(i), "a" if i % 2 else "b") for i in range(40)]
    frame = lambda r: spark.createDataFrame(r, "src_ip string, x double, label string")
    train, test, _ = K.prepared(frame(rows), ["x"], "label", scale=True)
    before = {r.src_ip: r.features[0] for r in train.collect()}
    changed = test.select("src_ip").first().src_ip
    moved = [(i, 1e6 if i == changed else x, y) for i, x, y in rows]
    after = {r.src_ip: r.features[0] for r in K.prepared(frame(moved), ["x"], "label", scale=True)[0].collect()}
    assert before == after and changed not in after


def test_roc_of_crowded_and_unbounded_scores(spark):
    rng = random.Random(4)
    rows = [(float(rng.random() < 0.5), rng.choice([1e-9 * rng.random(), 1 - 1e-9 * rng.random(), -50 * rng.random(), 1000.0])) for _ in range(800)]
    df = spark.createDataFrame(rows, "label double, score double")
    expected = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df)
    assert E.roc_auc(df, "label", "score").first()[0] == pytest.approx(expected)


def test_all_starts_of_a_sweep_share_one_pool(spark, monkeypatch):
    """Each k had a pool of its own, and its last start kept the others waiting."""
    rng = np.random.default_rng(4)
    rows = [(str(i), Vectors.dense(rng.normal(i % 4 * 3, 1, 3))) for i in range(80)]
    vectors = C.training_set(spark.createDataFrame(rows, ["src_ip", "features"]))
    pools = []
    monkeypatch.setattr(C, "ThreadPool", lambda n, make=C.ThreadPool: pools.append(n) or make(n))
    swept = {r["k"]: r["inertia"] for r in C.k_sweep(vectors, range(2, 4), inits=3).collect()}
    assert pools == [6]
    for k, inertia in swept.items():
        costs = [KMeans(k=k, seed=42 + i, maxIter=300).fit(vectors).summary.trainingCost for i in range(3)]
        assert inertia == pytest.approx(min(costs), rel=1e-12)
    vectors.unpersist()
