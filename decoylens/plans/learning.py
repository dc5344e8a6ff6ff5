"""Registered queries: preprocessing, clustering, classification and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import bot_score
from ..operators import classify as K, cluster as C, evaluate as E, features as FT, sampling, sequences as SQ
from ..session import scratch_path
from .adapters import EV, FL, FLOW_ORDER, attack_events, flows, table, with_ctes
from .catalog import query
from .features import (
    ACT, ESF, EVENT_WINDOWS, FF, FFF, FLOW_WINDOWS, GAPS, PW, R2, R3, SEQ_LEN, SF, event_sequences, flow_sequences,
)

CLUSTERED = FT.SESSION_FEATURES


def _session_vectors(spark, sf):
    features = FT.session_features(attack_events(spark, sf))
    scaled, scaling = C.preprocess(features.persist(), CLUSTERED)
    return features, C.training_set(C.assemble(scaled, CLUSTERED).select("src_ip", "features")), scaling


def _rounded(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# --- preprocessing and clustering ----------------------------------------------------------------

_M1 = FT.FLOW_FEATURES


@query("m01_preprocess", FFF + ", m AS (SELECT " + ", ".join(f"max({c}) AS m_{c}" for c in _M1) + " FROM ff), l AS (SELECT src_ip, " + ", ".join(
    f"CAST(CASE WHEN m_{c} > 100 THEN ln(1 + {c}) ELSE {c} END AS DOUBLE) AS {c}" for c in _M1) + " FROM ff, m)\nSELECT src_ip, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}" for c in _M1) + " FROM l")
def preprocess(spark, sf):
    scaled, _ = C.preprocess(FT.flow_features(flows(spark, sf)), _M1)
    return _rounded(scaled.select("src_ip", *_M1))


@query("m02_k_sweep")
def k_sweep(spark, sf):
    _, vectors, _ = _session_vectors(spark, sf)
    return E.consensus_k(C.k_sweep(vectors, range(2, 11), inits=10))


def _labelled_points(spark, sf):
    """The given embeddings with their given labels as a clustering."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"), x.alias("x"))


_CELLS = """
WITH cells AS (SELECT vec_id, label AS cluster, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
ctr AS (SELECT cluster, dim, avg(v) AS m, count(*) AS n FROM cells GROUP BY cluster, dim)"""


@query("m03_davies_bouldin", _CELLS + """
, d AS (SELECT vec_id, cells.cluster, sqrt(sum((v - m) * (v - m))) AS d FROM cells JOIN ctr ON ctr.cluster = cells.cluster AND ctr.dim = cells.dim GROUP BY ALL),
s AS (SELECT cluster, avg(d) AS s FROM d GROUP BY cluster),
p AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist FROM ctr a JOIN ctr b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY ALL),
r AS (SELECT i, max((si.s + sj.s) / dist) AS worst FROM p JOIN s si ON si.cluster = i JOIN s sj ON sj.cluster = j GROUP BY i)
SELECT round(avg(worst), 6) AS davies_bouldin FROM r""")
def davies_bouldin(spark, sf):
    return _rounded(E.davies_bouldin(_labelled_points(spark, sf)))


@query("m04_calinski_harabasz", _CELLS + """
, g AS (SELECT dim, avg(v) AS g FROM cells GROUP BY dim),
b AS (SELECT sum(n * (m - g) * (m - g)) AS between_, count(DISTINCT cluster) AS k FROM ctr JOIN g USING (dim)),
w AS (SELECT sum((v - m) * (v - m)) AS within_, count(DISTINCT vec_id) AS n FROM cells JOIN ctr ON ctr.cluster = cells.cluster AND ctr.dim = cells.dim)
SELECT round((between_ / (k - 1)) / (within_ / (n - k)), 6) AS calinski_harabasz FROM b, w""")
def calinski_harabasz(spark, sf):
    return _rounded(E.calinski_harabasz(_labelled_points(spark, sf)))


# The twin computes the silhouette from all pairs; the Spark side never forms a pair.
@query("m05_silhouette_points", """
WITH e AS (SELECT vec_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.x, b.x) ** 2) AS total, count(*) AS n, count(*) FILTER (WHERE a.vec_id = b.vec_id) AS self
  FROM e a, e b GROUP BY ALL),
m AS (SELECT vec_id, own, max(CASE WHEN other = own THEN total / (n - 1) END) AS a, min(CASE WHEN other <> own THEN total / n END) AS b FROM d GROUP BY ALL)
SELECT vec_id, own AS cluster, round((b - a) / greatest(a, b), 5) AS silhouette FROM m""")
def silhouette_points(spark, sf):
    return E.silhouette_points(_labelled_points(spark, sf), "vec_id").withColumn("silhouette", F.round("silhouette", 5))


# The clusterings to rank, one per k: the given points by their label modulo k, so that the twin can state them.
@query("m06_consensus_k", """
WITH cells AS (SELECT k, vec_id, label % k AS cluster, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings, range(2, 11) r(k)),
ctr AS (SELECT k, cluster, dim, avg(v) AS m, count(*) AS n, avg(v * v) AS q FROM cells GROUP BY ALL),
grand AS (SELECT k, dim, avg(v) AS g FROM cells GROUP BY ALL),
d AS (SELECT c.k, vec_id, c.cluster AS own, o.cluster AS other, any_value(o.n) AS n, sum(v * v + o.q - 2 * v * o.m) AS far, sum((v - o.m) * (v - o.m)) AS near
  FROM cells c JOIN ctr o ON o.k = c.k AND o.dim = c.dim GROUP BY ALL),
s AS (SELECT k, vec_id, max(CASE WHEN own = other AND n > 1 THEN greatest(far, 0) * n / (n - 1) END) AS a, min(CASE WHEN own <> other THEN far END) AS b FROM d GROUP BY ALL),
sil AS (SELECT k, avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS silhouette FROM s GROUP BY k),
sc AS (SELECT k, own AS cluster, avg(sqrt(near)) AS s FROM d WHERE own = other GROUP BY ALL),
pr AS (SELECT a.k, a.cluster AS i, b.cluster AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist FROM ctr a JOIN ctr b ON a.k = b.k AND a.dim = b.dim AND a.cluster <> b.cluster GROUP BY ALL),
db AS (SELECT k, avg(w) AS davies_bouldin FROM (SELECT pr.k, i, max((x.s + y.s) / dist) AS w FROM pr JOIN sc x ON x.k = pr.k AND x.cluster = i JOIN sc y ON y.k = pr.k AND y.cluster = j GROUP BY ALL) GROUP BY k),
bt AS (SELECT ctr.k, sum(n * (m - g) * (m - g)) AS bt, count(DISTINCT cluster) AS kk FROM ctr JOIN grand ON grand.k = ctr.k AND grand.dim = ctr.dim GROUP BY ALL),
wt AS (SELECT k, sum(near) AS wt, count(*) AS n FROM d WHERE own = other GROUP BY k),
m AS (SELECT k, silhouette, davies_bouldin, (bt / (kk - 1)) / (wt / (n - kk)) AS calinski_harabasz FROM sil JOIN db USING (k) JOIN bt USING (k) JOIN wt USING (k)),
r AS (SELECT *, row_number() OVER (ORDER BY silhouette DESC, k) + row_number() OVER (ORDER BY davies_bouldin, k) + row_number() OVER (ORDER BY calinski_harabasz DESC, k) - 3 AS rank_sum FROM m)
SELECT CAST(k AS INT) AS k, round(silhouette, 6) AS silhouette, round(davies_bouldin, 5) AS davies_bouldin, round(calinski_harabasz, 5) AS calinski_harabasz, CAST(rank_sum AS BIGINT) AS rank_sum,
  CAST(row_number() OVER (ORDER BY rank_sum, k) = 1 AS INT) AS is_best FROM r""")
def consensus_k(spark, sf):
    points = _labelled_points(spark, sf)
    stacked = points.select(F.explode(F.sequence(F.lit(2), F.lit(10))).alias("k"), "vec_id", "cluster", "x")
    stacked = stacked.withColumn("cluster", F.col("cluster") % F.col("k"))
    ranked = E.consensus_k(E.clustering_metrics(stacked, "vec_id", ["k"]))
    return ranked.select(
        "k", F.round("silhouette", 6).alias("silhouette"), *[F.round(c, 5).alias(c) for c in ("davies_bouldin", "calinski_harabasz")],
        F.col("rank_sum").cast("bigint").alias("rank_sum"), "is_best",
    )


@query("m07_final_kmeans")
def final_kmeans(spark, sf):
    _, vectors, _ = _session_vectors(spark, sf)
    model = C.best_kmeans(vectors, 2, inits=20, max_iter=500)
    return model.transform(vectors).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.lit(model.summary.trainingCost).alias("inertia"))


@query("m08_centres_in_units")
def centres_in_units(spark, sf):
    features, vectors, scaling = _session_vectors(spark, sf)
    model = C.best_kmeans(vectors, 2, inits=20)
    centres = C.centres_in_units(model, scaling, features)
    return centres.join(C.name_clusters(centres), "cluster")


_SCORE_SQL = """ln(1 + total_attempts) / 10 + 1 / (1 + avg_time_between / 10) + least(password_reuse_ratio, 100) / 100
  + greatest(0.0, 3 - avg_password_entropy) / 3 + hour_entropy / 4 + 1 / (1 + commands_per_session)"""


@query("m09_bot_score", ESF + f"SELECT src_ip, round({_SCORE_SQL}, 6) AS bot_score FROM sf")
def bot_scores(spark, sf):
    t = FT.session_features(attack_events(spark, sf))
    return t.select("src_ip", F.round(bot_score(t.columns), 6).alias("bot_score"))


@query("m10_cluster_names", with_ctes(EV, ACT, PW, GAPS, SF) + f"""
, c AS (SELECT unique_hours % 5 AS cluster, round(avg({_SCORE_SQL}), 9) AS bot_score FROM sf GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY bot_score DESC, cluster) - 1 AS place, count(*) OVER () AS k FROM c)
SELECT CAST(cluster AS BIGINT) AS cluster, round(bot_score, 6) AS bot_score, CASE WHEN place < CASE WHEN k = 2 THEN 1 ELSE k // 3 END THEN 'Bot'
  WHEN place < CASE WHEN k = 2 THEN 1 ELSE 2 * k // 3 END THEN 'Hybrid' ELSE 'Manual' END AS cluster_label FROM r""")
def cluster_names(spark, sf):
    t = FT.session_features(attack_events(spark, sf))
    groups = t.groupBy((F.col("unique_hours") % 5).alias("cluster")).agg(F.round(F.avg(bot_score(t.columns)), 9).alias("bot_score"))
    return _rounded(C.name_scores(groups))


@query("m11_pca")
def pca(spark, sf):
    _, vectors, _ = _session_vectors(spark, sf)
    projected, ratio = C.pca_projection(vectors)
    return projected.select("src_ip", "pc1", "pc2", F.lit(ratio[0]).alias("ratio1"), F.lit(ratio[1]).alias("ratio2"))


# --- preparation of the classifiers ----------------------------------------------------------------

@query("m13_label_codes", with_ctes(EV, ACT) + f"""
, l AS (SELECT {R3} AS label FROM act WHERE total_attempts >= 10)
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS code, count(*) AS n FROM l GROUP BY label""")
def label_codes(spark, sf):
    labels = FT.threat_labels(attack_events(spark, sf), 10).select(F.col("threat_label").alias("label"))
    coded, _ = K.encode_labels(labels, "label", "code")
    return coded.groupBy("label", "code").agg(F.count(F.lit(1)).alias("n"))


@query("m14_stratified_split", with_ctes(EV, ACT) + f"""
, l AS (SELECT {R3} AS label, count(*) AS n FROM act WHERE total_attempts >= 10 GROUP BY 1)
SELECT label, n, CAST(greatest(round(n * CAST(0.2 AS DOUBLE)), CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_test FROM l""")
def stratified_split(spark, sf):
    labels = FT.threat_labels(attack_events(spark, sf), 10).select("src_ip", F.col("threat_label").alias("label"))
    split = sampling.stratified_split(labels, "label", "src_ip")
    return split.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("is_test").alias("n_test"))


def _events_table(spark, sf):
    return FT.labelled_sessions(attack_events(spark, sf)), list(FT.LOGIN_SIDE), "label"


def _early_table(spark, sf):
    return FT.early_sessions(attack_events(spark, sf)), list(FT.EARLY_EVENT_FEATURES), "threat_label"


def _flow_table(spark, sf):
    return FT.labelled_flows(flows(spark, sf)), ["flow_count", "unique_dst_ports", "unique_dst_ips"], "label"


# Boosted trees run with fewer rounds, kernel and linear machines with fewer folds and settings than the library
# defaults (see the README); every row is used.
@query("m15_random_forest")
def forest(spark, sf):
    df, columns, label = _events_table(spark, sf)
    train, test, _ = K.prepared(df.persist(), columns, label)
    return K.forest_grid(train, test, label)


@query("m16_boosted_trees")
def boosted(spark, sf):
    df, columns, label = _early_table(spark, sf)
    train, test, names = K.prepared(df, columns, label)
    return K.scored(K.boosted_trees(30, 6, 0.1, len(names)).fit(train), test, "Boosted Trees")


@query("m16b_boosted_search")
def boosted_search(spark, sf):
    df, columns, label = _flow_table(spark, sf)
    train, test, names = K.prepared(df, columns, label)
    return K.boost_grid(train, test, label, len(names), {**K.BOOST_GRID, "rounds": (10, 20)})


@query("m17_kernel_svm")
def kernel_svm(spark, sf):
    df, columns, label = _flow_table(spark, sf)
    train, test, _ = K.prepared(df, columns, label, scale=True)
    search, width, table_ = K.svm_search(train, label, len(columns), {"c": (1, 10), "gamma": ("scale",)}, folds=3)
    result = K.scored(search.bestModel, K.fourier_features(test, len(columns), width), "Kernel SVM")
    return table_.withColumn("test_f1", result.select("weighted_f1").scalar())


@query("m18_logistic_regression")
def logistic(spark, sf):
    df, columns, label = _early_table(spark, sf)
    train, test, _ = K.prepared(df, columns, label, scale=True)
    search, table_ = K.logistic_search(train, label, folds=3)
    return table_.withColumn("test_f1", K.scored(search.bestModel, test, "Logistic Regression").select("weighted_f1").scalar())


@query("m19_stratified_folds", with_ctes(FL, FF) + f"""
, l AS (SELECT {R2} AS label, count(*) AS n FROM ff GROUP BY 1)
SELECT label, CAST(f AS INT) AS fold, CAST(n // 5 + CASE WHEN f BETWEEN 1 AND n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM l, range(5) t(f)""")
def stratified_folds(spark, sf):
    folds = sampling.stratified_folds(FT.labelled_flows(flows(spark, sf)), "label", "src_ip")
    return folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


# --- evaluation over given predictions ---------------------------------------------------------------
# ``quality`` plays the label, ``toxic`` the prediction, and a hash of the id the score.

_SCORE = "((doc_id * 37) % 101) / 100.0"


def _predictions(spark, sf):
    score = ((F.col("doc_id") * 37) % 101) / 100.0
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"), score.alias("score"))


_CLASS_SQL = """
WITH p AS (SELECT quality AS label, toxic AS prediction FROM labels),
k AS (SELECT label FROM p UNION SELECT prediction FROM p),
c AS (SELECT k.label, count(*) FILTER (WHERE p.label = k.label) AS support, count(*) FILTER (WHERE p.prediction = k.label) AS predicted,
  count(*) FILTER (WHERE p.label = k.label AND p.prediction = k.label) AS hits FROM k, p GROUP BY k.label),
r AS (SELECT label, support, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)"""


@query("m20_weighted_scores", _CLASS_SQL + """
SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS weighted_precision,
  round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""")
def weighted_scores(spark, sf):
    return _rounded(E.weighted_scores(_predictions(spark, sf)))


@query("m21_confusion_matrix", """
SELECT CAST(l.label AS INT) AS position, CAST(l.label AS VARCHAR) AS label, count(*) FILTER (WHERE toxic = 0) AS pred_0, count(*) FILTER (WHERE toxic = 1) AS pred_1,
  count(*) FILTER (WHERE toxic = 2) AS pred_2 FROM (VALUES (0), (1), (2)) l(label) LEFT JOIN labels ON quality = l.label GROUP BY l.label""")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(_predictions(spark, sf), [0, 1, 2])


@query("m22_roc_points", f"""
WITH s AS (SELECT {_SCORE} AS score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS q FROM labels GROUP BY 1)
SELECT round(score, 6) AS score, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(q) OVER w / sum(q) OVER (), 6) AS fpr FROM s WINDOW w AS (ORDER BY score DESC)""")
def roc_points(spark, sf):
    points = E.roc_points(_predictions(spark, sf), "label", "score")
    return _rounded(points.select("score", "tpr", "fpr"))


@query("m22b_roc_auc", f"""
WITH s AS (SELECT {_SCORE} AS score, quality FROM labels)
SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*), 6) AS auc
FROM s a JOIN s b ON a.quality = 1 AND b.quality <> 1""")
def roc_auc(spark, sf):
    return _rounded(E.roc_auc(_predictions(spark, sf), "label", "score"))


@query("m23_class_report", _CLASS_SQL + """
SELECT CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def class_report(spark, sf):
    report = E.class_report(_predictions(spark, sf)).withColumn("label", F.col("label").cast("string"))
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    total = report.agg(
        F.lit("weighted avg").alias("label"), mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support")
    )
    return _rounded(report.unionByName(total))


@query("m24_importances")
def importances(spark, sf):
    df, columns, label = _events_table(spark, sf)
    train, _, names = K.prepared(df, columns, label)
    forest = K.importances(spark, K.GroupedForest().fit(train), columns).select(F.lit("Random Forest").alias("model"), "*")
    boosted = K.importances(spark, K.boosted_trees(30, 6, 0.1, len(names)).fit(train), columns).select(F.lit("Boosted Trees").alias("model"), "*")
    return forest.unionByName(boosted).orderBy("model", F.desc("importance"), "feature")


@query("m25_agreement", """
WITH p AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS po FROM p),
e AS (SELECT sum(x.c * y.c) / any_value(t.n) / any_value(t.n) AS pe FROM (SELECT a AS v, count(*) AS c FROM p GROUP BY 1) x JOIN (SELECT b AS v, count(*) AS c FROM p GROUP BY 1) y USING (v), t)
SELECT n, round(po * 100, 6) AS agreement_pct, round((po - pe) / (1 - pe), 6) AS kappa, CAST(n >= 100 AS INT) AS enough FROM t, e""")
def agreement(spark, sf):
    return _rounded(E.agreement(_predictions(spark, sf), "label", "prediction"))


def _stored_clusters(spark, sf):
    """The two-cluster solution, written once and read back."""
    features, vectors, scaling = _session_vectors(spark, sf)
    path = scratch_path(spark, "clusters")
    C.store_clusters(C.best_kmeans(vectors, 2, inits=20), scaling, features, vectors, path)
    return C.stored_clusters(spark, path)


@query("j05b_rule_and_cluster")
def rule_and_cluster(spark, sf):
    """Rule labels joined with the names of the stored clusters, one row per address that has both."""
    _, _, assignment = _stored_clusters(spark, sf)
    rules = FT.labelled_sessions(attack_events(spark, sf)).select("src_ip", F.col("label").alias("rule_label"))
    return rules.join(assignment.select("src_ip", "cluster_label"), "src_ip")


@query("m25b_rule_against_clusters")
def rule_against_clusters(spark, sf):
    return E.agreement(rule_and_cluster(spark, sf), "rule_label", "cluster_label")


# --- windows, sequences, comparison --------------------------------------------------------------------

@query("m26_event_window_curve")
def event_window_curve(spark, sf):
    windows = FT.session_windows(attack_events(spark, sf), EVENT_WINDOWS)
    return K.window_curve(windows, FT.WINDOW_EVENT_FEATURES, EVENT_WINDOWS)


@query("m26b_flow_window_curve")
def flow_window_curve(spark, sf):
    windows = FT.flow_windows(flows(spark, sf), FLOW_ORDER, "flow_id", FLOW_WINDOWS)
    return K.window_curve(windows, FT.EARLY_FLOW_FEATURES, FLOW_WINDOWS)


def _scenarios(spark, sf, seq_len):
    e, f = attack_events(spark, sf), flows(spark, sf)
    named = lambda t, c: t.select("src_ip", F.col(c).alias("label"))
    return (
        ("events actor", event_sequences, SQ.EVENT_DIMS, FT.labelled_sessions(e).select("src_ip", "label")),
        ("flows actor", flow_sequences, SQ.FLOW_DIMS, FT.labelled_flows(f).select("src_ip", "label")),
        ("events threat", event_sequences, SQ.EVENT_DIMS, named(FT.threat_labels(e, 10), "threat_label")),
        ("flows behaviour", flow_sequences, SQ.FLOW_DIMS, named(FT.behaviour_labels(f, 20), "behavior_label")),
    )


def sequence_scenarios(spark, sf, seq_len: int = SEQ_LEN, epochs: int = 50, rounds: int = 20, only: tuple[str, ...] = ()):
    """The four scenarios of the sequence study, both models each."""
    result = None
    for phase, build, dims, labels in _scenarios(spark, sf, seq_len):
        if only and phase not in only:
            continue
        sequences = SQ.attach_labels(build(spark, sf, seq_len, labels.select("src_ip")), labels).persist()
        rows = K.train_sequence_models(sequences, seq_len, dims, phase, epochs=epochs, rounds=rounds, depth=3)
        result = rows if result is None else result.unionByName(rows)
    return result


@query("m29_sequence_models")
def sequence_models(spark, sf):
    return sequence_scenarios(spark, sf, epochs=30)


@query("m29b_sequence_length")
def sequence_length(spark, sf):
    """The ablation over the sequence length on the hardest scenario."""
    short, long = (sequence_scenarios(spark, sf, n, epochs=20, only=("events threat",)) for n in (20, 50))
    return short.unionByName(long)


@query("m30_model_comparison")
def model_comparison(spark, sf):
    df, columns, label = _early_table(spark, sf)
    return K.compare_models(df.persist(), columns, label, rounds=20)
