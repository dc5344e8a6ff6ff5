"""Order-dependent work that stays balanced when one key holds a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one task. The helpers
here cut each key into buckets (time slices or hash slices), work inside the buckets, and carry the
few numbers that cross a bucket border in a small per-bucket table. Results equal the plain window.
Time slices that hold too many rows of one key are cut again, see ``with_time_buckets``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import MICROS, micros
from ..session import written

DAY_MICROS = 86_400 * MICROS
#: A time slice of one key with more rows than this is cut into pieces of about as many.
SLICE_ROWS = 1_000_000
#: Rows of one key and microsecond are counted in blocks of so many consecutive tie numbers.
TIE_BLOCK = 1024


def time_slice(timestamp: Column | str, seconds: int) -> Column:
    """Number of the time slice a timestamp falls into."""
    return F.floor(micros(timestamp) / F.lit(seconds * MICROS)).cast("bigint")


def hash_slice(*columns: Column | str, slices: int, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(slices))


def with_time_buckets(
    df: DataFrame, key: str, ts: str, tie: str, slice_seconds: int = 3600, target: int | None = None, name: str = "_bucket"
) -> DataFrame:
    """Add an ordered bucket such that (bucket, ts, tie) sorts like (ts, tie) and no bucket of a key holds much more
    than ``target`` rows, however many of them share an hour, a second or even one time. ``tie`` is a whole number.

    One aggregate finds the hot (key, slice) pairs, of which there is at most one per ``target`` rows; without any, the
    slice alone is the bucket. Of the hot ones the seconds are counted and gathered, in order, into pieces of about
    ``target`` rows; a second above the target is counted by microsecond and block of ties and cut in the same way.
    What was counted is written once, so that every use of a bucket sees the same borders.
    """
    target = target or SLICE_ROWS
    us, block = micros(ts), F.floor(F.col(tie) / TIE_BLOCK).cast("bigint")
    marks = {"_slice": time_slice(ts, slice_seconds), "_second": time_slice(ts, 1), "_us": us, "_block": block}
    size = F.count(F.lit(1)).alias("_size")
    cut = df.withColumns(marks)
    bucket = lambda piece, part: F.struct("_slice", piece.alias("piece"), part.alias("part")).alias(name)
    none = F.lit(0).cast("bigint")
    hot = written(cut.groupBy(key, "_slice").agg(size).filter(F.col("_size") > target).select(key, "_slice"), "hot-slices")
    if hot.isEmpty():
        return df.withColumns({"_slice": marks["_slice"], name: F.lit(None)}).select(*df.columns, bucket(none, none))

    def pieces(cells: DataFrame, within: list[str], order: list[str], number: str) -> DataFrame:
        before = Window.partitionBy(key, *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return cells.withColumn(number, F.floor(F.coalesce(F.sum("_size").over(before), F.lit(0)) / target).cast("bigint"))

    crowded = cut.join(F.broadcast(hot), [key, "_slice"])  # at most one row per ``target`` rows of the table
    seconds = pieces(crowded.groupBy(key, "_slice", "_second").agg(size), ["_slice"], ["_second"], "_piece")
    seconds = written(seconds, "hot-seconds")
    dense = F.broadcast(seconds.filter(F.col("_size") > target).select(key, "_second"))  # nor more of these
    cells = crowded.join(dense, [key, "_second"]).groupBy(key, "_second", "_us", "_block").agg(size)
    cells = written(pieces(cells, ["_second"], ["_us", "_block"], "_part"), "hot-cells")
    placed = cut.join(seconds.select(key, "_second", "_piece"), [key, "_second"], "left")
    placed = placed.join(cells.select(key, "_us", "_block", "_part"), [key, "_us", "_block"], "left")
    # A dense second ends its piece, so its parts come behind the seconds before it.
    return placed.select(*(placed[c] for c in df.columns), bucket(F.coalesce("_piece", none), F.coalesce(F.col("_part") + 1, none)))


def bucketed_rank(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Add each row's position within its key, 1-based, over ``(bucket, *order)``.

    Per-bucket counts give every bucket an offset; row numbers are taken inside a bucket only. The
    window over one key sees one row per bucket, so the largest task holds one bucket of one key.
    """
    keys = list(keys)
    sliced = df.withColumn("_bucket", bucket)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = sliced.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    columns = [F.coalesce(F.sum("_size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")]
    if total:
        columns.append(F.sum("_size").over(Window.partitionBy(*keys)).alias(total))
    offsets = offsets.select(*keys, "_bucket", *columns)
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = sliced.withColumn("_local", F.row_number().over(within)).join(offsets, [*keys, "_bucket"])
    kept = [*df.columns, (F.col("_local") + F.col("_offset")).alias(rank)]
    return ranked.select(*kept, *([total] if total else []))


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, salt: str, rank: str = "rank", salts: int = 16
) -> DataFrame:
    """The first ``n`` rows per key in the given order, with their position.

    Two passes: the first keeps n rows per (key, salt), the second n per key. Spark limits each
    group before the shuffle of either pass, so a heavy key reaches one task as n * salts rows.
    """
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", hash_slice(salt, slices=salts))
        .withColumn("_pre", F.row_number().over(within))
        .filter(F.col("_pre") <= n)
        .withColumn(rank, F.row_number().over(overall))
        .filter(F.col(rank) <= n)
        .drop("_salt", "_pre")
    )


def first_fraction(
    df: DataFrame, key: str, ts: str, tie: str, ratio: float = 0.3, least: int = 3, slice_seconds: int = 3600
) -> DataFrame:
    """The first ``max(least, int(n * ratio))`` rows of each key in time order."""
    sliced = with_time_buckets(df, key, ts, tie, slice_seconds)
    ranked = bucketed_rank(sliced, [key], F.col("_bucket"), [ts, tie], "rank", "n_rows").drop("_bucket")
    cut = F.greatest(F.lit(least), F.floor(F.col("n_rows") * F.lit(float(ratio))))
    return ranked.filter(F.col("rank") <= cut)


def gap_seconds(
    df: DataFrame, key: str, ts: str, tie: str, slice_seconds: int = 3600, name: str = "gap"
) -> DataFrame:
    """Seconds since the key's previous row (null on its first row), row by row.

    Inside a bucket this is a lag; the first row of a bucket takes the last time of the
    previous non-empty bucket from a table with one row per (key, bucket).
    """
    sliced = with_time_buckets(df, key, ts, tie, slice_seconds).withColumn("_us", micros(ts))
    ends = sliced.groupBy(key, "_bucket").agg(F.max("_us").alias("_end"))
    before = ends.select(
        key, "_bucket", F.lag("_end").over(Window.partitionBy(key).orderBy("_bucket")).alias("_before")
    )
    within = Window.partitionBy(key, "_bucket").orderBy("_us", tie)
    previous = F.coalesce(F.col("_lag"), F.col("_before"))
    return (
        sliced.withColumn("_lag", F.lag("_us").over(within))
        .join(before, [key, "_bucket"])
        .withColumn(name, (F.col("_us") - previous) / F.lit(float(MICROS)))
        .drop("_bucket", "_us", "_lag", "_before")
    )


def mean_gap(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key, the mean gap between consecutive rows, keeping gaps in (0, 1 day) only.

    No row order is needed. Equal times give zero gaps, which do not count, so within one day the
    gaps of the distinct times sum to (last - first) and number (distinct - 1), all below a day.
    Only the gap from one active day to the next needs a window, over one row per (key, day).
    """
    us = micros(ts)
    days = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(key, F.floor(us / F.lit(DAY_MICROS)).alias("_day"))
        .agg(F.min(us).alias("_first"), F.max(us).alias("_last"), F.count_distinct(us).alias("_times"))
    )
    step = F.col("_first") - F.lag("_last").over(Window.partitionBy(key).orderBy("_day"))
    counted = F.col("_step") < DAY_MICROS
    return (
        days.withColumn("_step", step)
        .groupBy(key)
        .agg(
            (F.sum(F.col("_last") - F.col("_first")) + F.coalesce(F.sum(F.when(counted, F.col("_step"))), F.lit(0))).alias("_sum"),
            (F.sum(F.col("_times") - 1) + F.count_if(counted)).alias("_n"),
        )
        .select(
            key,
            F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n") / F.lit(float(MICROS))).otherwise(F.lit(0.0)).alias("avg_time_between"),
        )
    )


def centred_mean(df: DataFrame, value: str, order: str, half: int, name: str, partition: Sequence[str] = ()) -> DataFrame:
    """Centred moving average over rows, null unless the whole frame is present.

    Meant for daily rollups: one window partition holds one row per day.
    """
    frame = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    frame = frame.orderBy(order).rowsBetween(-half, half)
    full = F.count(value).over(frame) == 2 * half + 1
    return df.withColumn(name, F.when(full, F.avg(value).over(frame)))


def share(value: Column | str, *partition: str) -> Column:
    """A row's share of its partition's total. For the grand total see ``with_total_share``."""
    value = F.col(value) if isinstance(value, str) else value
    return value / F.sum(value).over(Window.partitionBy(*partition))


def with_total_share(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add each row's share of the grand total, a scalar subquery: no task sees more than its own rows."""
    return df.withColumn(name, F.col(value) / df.agg(F.sum(value)).scalar())


def group_medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median per group in bounded memory per task.

    A mergeable quantile sketch brackets the median. Rows below the bracket are only counted; the
    narrow band inside it is collapsed to (value, count) and walked in order.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    bracket = known.groupBy(*keys).agg(
        F.percentile_approx(value, [0.498, 0.502], 10_000).alias("_band"), F.count(F.lit(1)).alias("_n")
    )
    banded = known.join(bracket, keys)
    # Everything below the band collapses into one row per group (a null value), which sorts first.
    place = F.when(F.col(value) >= F.col("_band")[0], F.col(value))
    cells = banded.filter(F.col(value) <= F.col("_band")[1]).groupBy(*keys, place.alias(value)).agg(
        F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n")
    )
    walk = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumn("_upto", F.sum("_c").over(walk)).filter(F.col(value).isNotNull())
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return placed.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("_upto") >= lower, F.col(value)))
                + F.min(F.when(F.col("_upto") >= upper, F.col(value)))
            )
            / 2
        ).alias("median")
    )
