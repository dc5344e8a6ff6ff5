"""Exact-size, repeatable samples, splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ordered import bucketed_rank, hash_slice

SEED = 42
SLICES = 4096


def sample_rows(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """A uniform sample of exactly ``min(n, rows)`` rows without replacement.

    Rows are ordered by a hash of their unique key. A histogram of the hash finds the slice in
    which the n-th row falls, so only about n rows reach the final ordering whatever the input size.
    """
    sliced = df.withColumn("_slice", hash_slice(key, slices=SLICES, seed=seed))
    upto = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last_slice = (
        sliced.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        .filter(F.col("_before") < n)
        .agg(F.max("_slice"))
        .scalar()
    )
    near = sliced.filter(F.col("_slice") <= last_slice)
    return near.orderBy("_slice", F.xxhash64(F.lit(seed + 1), key), key).limit(n).drop("_slice")


def stratified_rank(df: DataFrame, label: str, key: str, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """Add ``rank`` (a shuffled position within the label) and ``n_label`` (the label's size)."""
    order = [F.xxhash64(F.lit(seed + 1), key), F.col(key)]
    return bucketed_rank(df, [label], hash_slice(key, slices=slices, seed=seed), order, "rank", "n_label")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: per label exactly round(test * n) rows, at least one where n > 1."""
    wanted = F.greatest(F.round(F.col("n_label") * test), F.when(F.col("n_label") > 1, 1).otherwise(0))
    ranked = stratified_rank(df, label, key, seed)
    return ranked.withColumn("is_test", (F.col("rank") <= wanted).cast("int")).drop("rank", "n_label")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Add ``fold`` in 0..folds-1, balanced within every label."""
    ranked = stratified_rank(df, label, key, seed + 7)
    return ranked.withColumn("fold", F.pmod(F.col("rank"), F.lit(folds)).cast("int")).drop("rank", "n_label")


def repeat_by_weight(df: DataFrame, weight: str, cap: int | None = None) -> DataFrame:
    """Repeat each row ``weight`` times, at most ``cap`` where one is asked for; ``copy`` numbers the repeats from 1.

    Rows that carry their weight serve most uses as well and are fewer.
    """
    times = (F.col(weight) if cap is None else F.least(F.col(weight), F.lit(cap))).cast("int")
    return df.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
