"""Evaluation tables over assignments, predictions and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..session import written

#: Numbers of a table of cluster centres that every task may hold, and slices of the points beyond.
TABLE_CELLS, SALTS = 2_000_000, 64


# --- clusterings -------------------------------------------------------------------------------
# Input: one row per point with an integer cluster column and an array<double> column ``x``.

def _distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def cluster_sums(points: DataFrame, cluster: str = "cluster", x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, cluster, n, centre, within, q)``: size, mean, squared distances to the mean and mean squared norm.

    One pass over the points with a partial sum per cluster on the map side; vectors stay whole.
    """
    moments = Summarizer.metrics("mean", "variance").summary(F.col("_v"))
    norm = F.aggregate(F.col(x), F.lit(0.0), lambda s, v: s + v * v)
    sums = points.withColumn("_v", array_to_vector(x)).groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("q"), moments.alias("_m"))
    spread = F.aggregate(vector_to_array("_m.variance"), F.lit(0.0), lambda s, v: s + v)
    return sums.select(*by, cluster, "n", vector_to_array("_m.mean").alias("centre"), ((F.col("n") - 1) * spread).alias("within"), "q")


def centroids(points: DataFrame, cluster: str = "cluster", x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, cluster, n, centre)``; the shuffle carries one partial mean per cluster."""
    return cluster_sums(points, cluster, x, by).select(*by, cluster, "n", "centre")


def davies_bouldin(points: DataFrame, cluster: str = "cluster", x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """Mean over clusters of the worst (scatter_i + scatter_j) / distance of the centres.

    The pairwise part works on one array of k centres, never on the points. ``by`` holds several
    clusterings of the same points side by side.
    """
    keys = [*by, cluster]
    scatter = (
        points.join(centroids(points, cluster, x, by), keys)
        .groupBy(*keys)
        .agg(F.avg(_distance(F.col(x), F.col("centre"))).alias("s"), F.first("centre").alias("c"))
    )
    packed = scatter.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("id"), "s", "c"))).alias("all"))
    worst = F.transform(
        "all",
        lambda a: F.array_max(
            F.transform(
                F.filter("all", lambda b: b["id"] != a["id"]), lambda b: (a["s"] + b["s"]) / _distance(a["c"], b["c"])
            )
        ),
    )
    mean = F.aggregate(worst, F.lit(0.0), lambda s, v: s + v) / F.size("all")
    return packed.select(*by, mean.alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame, cluster: str = "cluster", x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """Between over within dispersion, each over its degrees of freedom, from sums only."""
    return _dispersion(cluster_sums(points, cluster, x, by), by)


def _dispersion(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """From rows per cluster: the squared norms of the centres less that of the grand mean are the between part."""
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    weighted = Summarizer.metrics("mean").summary(array_to_vector("centre"), F.col("n").cast("double"))
    parts = sums.groupBy(*by).agg(
        weighted.alias("_m"), F.sum(F.col("n") * square("centre")).alias("_norms"), F.sum("within").alias("within"),
        F.count(F.lit(1)).alias("_k"), F.sum("n").alias("n"),
    )
    between = F.col("_norms") - F.col("n") * square(vector_to_array("_m.mean"))
    score = (between / (F.col("_k") - 1)) / (F.col("within") / (F.col("n") - F.col("_k")))
    return parts.select(*by, score.alias("calinski_harabasz"))


def silhouette_points(points: DataFrame, key: str, cluster: str = "cluster", x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """Silhouette per point with squared Euclidean distance, linear in the points.

    The mean squared distance to a cluster follows from its size, mean and mean squared norm, so
    each point meets k summaries, not the other points. They travel as one row per clustering up to
    ``TABLE_CELLS`` numbers; beyond, each point meets them one by one in a join salted against hot
    clusterings, and keeps its own and its nearest other.
    """
    norm = F.aggregate(F.col(x), F.lit(0.0), lambda s, v: s + v * v)
    sums = written(cluster_sums(points, cluster, x, by), "cluster-sums")
    cells = sums.agg(F.coalesce(F.sum(F.size("centre")), F.lit(0))).first()[0]
    mean_to = lambda s: (
        F.col("_norm") + s["q"] - 2 * F.aggregate(F.zip_with(F.col(x), s["centre"], lambda p, c: p * c), F.lit(0.0), lambda a, v: a + v)
    )
    placed = points.withColumn("_norm", norm)
    summary = F.struct(F.col(cluster).alias("id"), "n", "q", "centre")
    if cells <= TABLE_CELLS:
        table = sums.groupBy(*by).agg(F.collect_list(summary).alias("_t"))
        placed = placed.join(F.broadcast(table), list(by)) if by else placed.withColumn("_t", table.select("_t").scalar())
        own = F.filter("_t", lambda s: s["id"] == F.col(cluster))[0]
        others = F.array_min(F.transform(F.filter("_t", lambda s: s["id"] != F.col(cluster)), mean_to))
        inner = placed.withColumn("_own", own).withColumn("_b", others).withColumns({"_n": F.col("_own.n"), "_to": mean_to(F.col("_own"))})
    else:
        salted = sums.select(*by, summary.alias("_s")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = placed.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, [*by, "_salt"])
        mine = F.col("_s.id") == F.col(cluster)
        met = met.select(*by, key, cluster, F.when(mine, F.col("_s.n")).alias("_n"), F.when(mine, mean_to(F.col("_s"))).alias("_to"), F.when(~mine, mean_to(F.col("_s"))).alias("_b"))
        inner = met.groupBy(*by, key, cluster).agg(F.max("_n").alias("_n"), F.max("_to").alias("_to"), F.min("_b").alias("_b"))
    a = F.greatest(F.col("_to"), F.lit(0.0)) * F.col("_n") / (F.col("_n") - 1)
    scored = inner.withColumn("_a", F.when(F.col("_n") > 1, a))
    value = F.when(F.col("_a").isNull(), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    )
    return scored.select(*by, key, cluster, value.alias("silhouette"))


def clustering_metrics(points: DataFrame, key: str, by: Sequence[str], cluster: str = "cluster", x: str = "x") -> DataFrame:
    """Silhouette, Davies-Bouldin and Calinski-Harabasz of several clusterings of the same points, told apart by ``by``."""
    silhouettes = silhouette_points(points, key, cluster, x, by).groupBy(*by).agg(F.avg("silhouette").alias("silhouette"))
    return silhouettes.join(davies_bouldin(points, cluster, x, by), list(by)).join(calinski_harabasz(points, cluster, x, by), list(by))


def consensus_k(metrics: DataFrame) -> DataFrame:
    """Rank sum over silhouette (high), Davies-Bouldin (low) and Calinski-Harabasz (high).

    One row per candidate k comes in; the smallest k wins ties.
    """
    one = Window.partitionBy(F.lit(0))
    ranks = [
        F.row_number().over(one.orderBy(F.desc("silhouette"), "k")),
        F.row_number().over(one.orderBy("davies_bouldin", "k")),
        F.row_number().over(one.orderBy(F.desc("calinski_harabasz"), "k")),
    ]
    summed = metrics.withColumn("rank_sum", sum((r - 1 for r in ranks), F.lit(0)))
    return summed.withColumn("is_best", (F.row_number().over(one.orderBy("rank_sum", "k")) == 1).cast("int"))


# --- predictions ---------------------------------------------------------------------------------

def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per label in fixed order, one column per predicted label, zero filled."""
    cells = confusion_counts(df, label, prediction)
    spark = df.sparkSession
    names = [str(v) for v in labels]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(names)], "position int, label string")
    wide = cells.groupBy(F.col("label").cast("string").alias("label")).agg(
        *[F.sum(F.when(F.col("prediction").cast("string") == v, F.col("n"))).alias(f"pred_{v}") for v in names]
    )
    filled = [F.coalesce(f"pred_{v}", F.lit(0)).cast("bigint").alias(f"pred_{v}") for v in names]
    return rows.join(wide, "label", "left").select("position", "label", *filled)


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts alone."""
    cells = confusion_counts(df, label, prediction)
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    actual = cells.groupBy("label").agg(F.sum("n").alias("support"), hits.alias("hits"))
    predicted = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    both = actual.join(predicted, "label", "full_outer").na.fill(0, ["support", "hits", "predicted"])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    rated = both.withColumns({"precision": ratio("hits", "predicted"), "recall": ratio("hits", "support")})
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    return rated.select("label", "precision", "recall", f1.alias("f1"), F.col("support").cast("bigint").alias("support"))


def weighted_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and the support-weighted precision, recall and F1, one row."""
    report = class_report(df, label, prediction)
    total = F.sum("support")
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}")
    # The support-weighted recall is the number of hits over the number of rows: the accuracy.
    return report.agg(
        (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"), mean("precision"), mean("recall"), mean("f1")
    )


def agreement(df: DataFrame, first: str, second: str, min_common: int = 100) -> DataFrame:
    """Percent agreement and Cohen's kappa; ``enough`` tells whether there are ``min_common`` common items."""
    cells = confusion_counts(df, first, second)
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy("label").agg(F.sum("n").alias("a"))
    right = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("b"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)))
    joined = total.withColumn("_ab", chance.scalar())
    po = F.col("same") / F.col("n")
    pe = F.col("_ab") / (F.col("n").cast("double") * F.col("n"))
    return joined.select(
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (po * 100).alias("agreement_pct"),
        F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)).alias("kappa"),
        (F.coalesce("n", F.lit(0)) >= min_common).cast("int").alias("enough"),
    )


def roc_points(df: DataFrame, label: str, score: str, positive=1, slices: int = 256) -> DataFrame:
    """ROC points over distinct scores, highest first: ``(score, fpr, tpr)``.

    Rows collapse to one per score, of any range. The running totals go through slices of about as many scores
    each, cut at quantiles: slice totals are accumulated in one small table, the rest inside each slice.
    """
    hit = F.col(label) == positive
    per_score = df.groupBy(F.col(score).alias("score")).agg(F.count_if(hit).alias("p"), F.count_if(~hit).alias("q"))
    borders = per_score.agg(F.percentile_approx("score", [i / slices for i in range(1, slices)], 10 * slices)).scalar()
    sliced = per_score.withColumn("_borders", borders).withColumn("_slice", F.size(F.filter("_borders", lambda b: b < F.col("score")))).drop("_borders")
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("_slice"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = sliced.groupBy("_slice").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq")).select(
        "_slice",
        F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("op"),
        F.coalesce(F.sum("sq").over(before), F.lit(0)).alias("oq"),
        F.sum("sp").over(everything).alias("tp_all"),
        F.sum("sq").over(everything).alias("fp_all"),
    )
    inside = Window.partitionBy("_slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = sliced.withColumns({"cp": F.sum("p").over(inside), "cq": F.sum("q").over(inside)}).join(offsets, "_slice")
    return run.select(
        "score",
        F.try_divide(F.col("op") + F.col("cp"), F.col("tp_all")).alias("tpr"),
        F.try_divide(F.col("oq") + F.col("cq"), F.col("fp_all")).alias("fpr"),
        "p", "q", "tp_all", "fp_all", (F.col("op") + F.col("cp")).alias("cum_p"),
    )


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Trapezoid area: each distinct score adds fp * (tp before + tp after) / 2."""
    area = F.col("q") * (2 * F.col("cum_p") - F.col("p")) / 2.0
    points = roc_points(df, label, score, positive)
    return points.agg((F.sum(area / (F.col("tp_all").cast("double") * F.col("fp_all")))).alias("auc"))
