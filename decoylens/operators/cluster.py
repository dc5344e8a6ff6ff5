"""Preprocessing, k-means, and naming of the clusters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.rules import bot_score
from ..functions.scalars import finite
from .evaluate import clustering_metrics
from .ordered import group_medians


PARALLEL_FITS = 8


@dataclass(frozen=True)
class Scaling:
    """What preprocessing did, enough to undo it: one number per feature."""

    columns: tuple[str, ...]
    logged: frozenset[str]
    mean: dict[str, float]
    std: dict[str, float]


def skewed_columns(df: DataFrame, columns: Sequence[str], limit: float = 100) -> list[str]:
    """Columns whose global maximum exceeds ``limit`` (one row of maxima reaches the driver)."""
    top = df.agg(*[F.max(c).alias(c) for c in columns]).first()
    return [c for c in columns if top[c] is not None and top[c] > limit]


def log_if_skewed(df: DataFrame, columns: Sequence[str], limit: float = 100) -> tuple[DataFrame, list[str]]:
    """log1p on the skewed columns, everything finite."""
    logged = skewed_columns(df, columns, limit)
    return df.withColumns({c: finite(F.log1p(c) if c in logged else F.col(c)) for c in columns}), logged


def preprocess(df: DataFrame, columns: Sequence[str], limit: float = 100) -> tuple[DataFrame, Scaling]:
    """log1p if skewed, NaN and infinities to 0, standardise with the population deviation.

    One pass collects maxima and the moments of both the plain and the logged columns.
    """
    plain = {c: finite(F.col(c)) for c in columns}
    logs = {c: finite(F.log1p(c)) for c in columns}
    found = df.agg(
        *[F.max(c).alias(f"max_{i}") for i, c in enumerate(columns)],
        *[
            F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")).alias(f"{kind}_{i}")
            for kind, table in (("plain", plain), ("log", logs))
            for i, x in enumerate(table.values())
        ],
    ).first()
    logged = {c for i, c in enumerate(columns) if found[f"max_{i}"] is not None and found[f"max_{i}"] > limit}
    moments = {c: found[f"log_{i}" if c in logged else f"plain_{i}"] for i, c in enumerate(columns)}
    mean = {c: m["mean"] or 0.0 for c, m in moments.items()}
    std = {c: m["std"] or 1.0 for c, m in moments.items()}
    scaling = Scaling(tuple(columns), frozenset(logged), mean, std)
    return apply_scaling(df, scaling), scaling


def apply_scaling(df: DataFrame, scaling: Scaling) -> DataFrame:
    """The same treatment for other rows than those it was learned from."""
    value = lambda c: finite(F.log1p(c) if c in scaling.logged else F.col(c))
    return df.withColumns({c: (value(c) - scaling.mean[c]) / scaling.std[c] for c in scaling.columns})


def training_set(df: DataFrame, key: str = "src_ip", partitions: int = 4) -> DataFrame:
    """Cache a training table, dealt to a given number of partitions by its key.

    Starts and samples of the fits follow the partitions, so these depend on nothing but key and number.
    """
    return df.repartition(partitions, key).persist()


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def fitted_starts(vectors: DataFrame, ks: Iterable[int], inits: int, max_iter: int = 300, seed: int = 42) -> dict[int, list[KMeansModel]]:
    """The models of ``inits`` seeds for every k, in the order of the seeds; pass a ``training_set``.

    All starts share one pool, so none waits for the last start of another k. A fit gets the rows as a view of the
    cached table: then it keeps them decoded, with their norms, while it runs.
    """
    view = vectors.select("features")
    start = lambda one: KMeans(k=one[0], seed=seed + one[1], maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(view)
    starts = [(k, i) for k in ks for i in range(inits)]
    with ThreadPool(max(1, min(len(starts), PARALLEL_FITS))) as pool:  # each start is a chain of small jobs
        models = pool.map(inheritable_thread_target(vectors.sparkSession)(start), starts, chunksize=1)
    return {k: [model for (own, _), model in zip(starts, models) if own == k] for k, _ in starts}


def best_kmeans(vectors: DataFrame, k: int, inits: int = 10, max_iter: int = 300, seed: int = 42) -> KMeansModel:
    """The model with the least training cost over ``inits`` seeds; pass a ``training_set``."""
    return min(fitted_starts(vectors, [k], inits, max_iter, seed)[k], key=lambda model: model.summary.trainingCost)


def k_sweep(vectors: DataFrame, ks: Iterable[int] = range(2, 11), inits: int = 10, key: str = "src_ip") -> DataFrame:
    """Inertia, silhouette, Davies-Bouldin and Calinski-Harabasz for each k, one row each.

    The indices are computed for all k at once over the stacked assignments.
    """
    spark = vectors.sparkSession
    fitted, stacked = [], []
    for k, models in fitted_starts(vectors, ks, inits).items():
        model = min(models, key=lambda model: model.summary.trainingCost)
        fitted.append((k, float(model.summary.trainingCost)))
        stacked.append(model.transform(vectors).select(F.lit(k).alias("k"), key, "cluster", vector_to_array("features").alias("x")))
    points = reduce(DataFrame.unionByName, stacked)
    return spark.createDataFrame(fitted, "k int, inertia double").join(clustering_metrics(points, key, ["k"]), "k")


def centres_in_units(model: KMeansModel, scaling: Scaling, like: DataFrame) -> DataFrame:
    """Cluster centres back in original units, one row per cluster."""
    spark = like.sparkSession
    rows = [(i, *map(float, centre)) for i, centre in enumerate(model.clusterCenters())]
    schema = "cluster int, " + ", ".join(f"`{c}` double" for c in scaling.columns)
    raw = spark.createDataFrame(rows, schema)

    def restored(c: str):
        value = F.col(c) * scaling.std[c] + scaling.mean[c]
        return F.expm1(value) if c in scaling.logged else value

    return raw.withColumns({c: restored(c) for c in scaling.columns})


def store_clusters(model: KMeansModel, scaling: Scaling, features: DataFrame, vectors: DataFrame, path: str, key: str = "src_ip") -> None:
    """Write a clustering for later joins: the model, its centres in units with scores and names, and every address's cluster."""
    centres = centres_in_units(model, scaling, features)
    centres = centres.join(name_clusters(centres), "cluster")
    centres.write.mode("overwrite").parquet(f"{path}/centres")
    model.write().overwrite().save(f"{path}/model")
    model.transform(vectors).select(key, "cluster").write.mode("overwrite").parquet(f"{path}/assignment")


def stored_clusters(spark: SparkSession, path: str) -> tuple[KMeansModel, DataFrame, DataFrame]:
    """``(model, centres, assignment)`` as ``store_clusters`` wrote them; the assignment carries the clusters' names."""
    centres = spark.read.parquet(f"{path}/centres")
    assignment = spark.read.parquet(f"{path}/assignment").join(centres.select("cluster", "cluster_label"), "cluster")
    return KMeansModel.load(f"{path}/model"), centres, assignment


def name_clusters(centres: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``(cluster, bot_score, cluster_label)``: rank by bot score, highest first."""
    scored = centres.select(cluster, bot_score(centres.columns).alias("bot_score"))
    return name_scores(scored, cluster)


def name_scores(scored: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Two clusters: Bot, Manual. Three: Bot, Hybrid, Manual. More: thirds. One row per cluster."""
    whole = Window.partitionBy(F.lit(0))
    place = F.row_number().over(whole.orderBy(F.desc("bot_score"), cluster)) - 1
    ranked = scored.withColumns({"_place": place, "_k": F.count(F.lit(1)).over(whole)})
    third = F.floor(F.col("_k") / 3)
    bots = F.when(F.col("_k") == 2, 1).otherwise(third)
    hybrids = F.when(F.col("_k") == 2, 1).otherwise(F.floor(F.col("_k") * 2 / 3))
    label = F.when(F.col("_place") < bots, "Bot").when(F.col("_place") < hybrids, "Hybrid").otherwise("Manual")
    return ranked.select(cluster, "bot_score", label.alias("cluster_label"))


def pca_projection(vectors: DataFrame, k: int = 2):
    """``(projected frame, explained variance ratios)`` of centred input."""
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(vectors)
    xy = vector_to_array("pcs")
    projected = model.transform(vectors).withColumns({f"pc{i + 1}": xy[i] for i in range(k)}).drop("pcs")
    return projected, [float(v) for v in model.explainedVariance]


def _long(centres: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    doubles = centres.select(cluster, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([cluster], list(columns), "feature", "value")


def normalised_profiles(centres: DataFrame, columns: Sequence[str], top: int = 8, cluster: str = "cluster") -> DataFrame:
    """Min-max per feature across clusters (0.5 where flat), for the ``top`` features by sample variance."""
    over = Window.partitionBy("feature")
    low, high = F.min("value").over(over), F.max("value").over(over)
    scaled = F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(F.lit(0.5))
    profile = _long(centres, columns, cluster).withColumn("scaled", scaled)
    leaders = (
        profile.groupBy("feature").agg(F.var_samp("scaled").alias("v")).orderBy(F.desc(F.round("v", 9)), "feature").limit(top)
    )
    return profile.join(leaders.select("feature"), "feature", "left_semi").select("feature", cluster, "scaled")


def discriminativeness(centres: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(max - min) / (mean |centre| + 1e-10) per feature."""
    score = (F.max("value") - F.min("value")) / (F.avg(F.abs("value")) + F.lit(1e-10))
    return _long(centres, columns, cluster).groupBy("feature").agg(score.alias("importance"))


def cluster_summary(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean, median, sample deviation and count per feature and cluster, long format.

    The feature table is read once for the moments and twice for the medians, hence cached.
    """
    cells = _long(df.persist(), columns, cluster)
    moments = cells.groupBy(cluster, "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")
    )
    return moments.join(group_medians(cells, [cluster, "feature"], "value"), [cluster, "feature"])
