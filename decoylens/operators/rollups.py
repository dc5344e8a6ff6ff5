"""Temporal, spatial and categorical rollups.

Every rollup is a hash aggregate with map-side combine; orderings and windows only ever see the
aggregated rows. Where rows were already counted upstream, ``weight`` names the count column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.vocabulary import WEEKDAYS
from .ordered import centred_mean, share, with_total_share


def _tally(weight: str | None) -> Column:
    return (F.sum(weight) if weight else F.count(F.lit(1))).cast("bigint")


def value_counts(df: DataFrame, column: str, top: int | None = None, weight: str | None = None) -> DataFrame:
    """Counts per non-null value, most frequent first, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(_tally(weight).alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), column).limit(top)


def pair_counts(
    df: DataFrame, first: str, second: str, top: int | None = None, weight: str | None = None
) -> DataFrame:
    known = df.dropna(subset=[first, second])
    counts = known.groupBy(first, second).agg(_tally(weight).alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), first, second).limit(top)


def top_values(df: DataFrame, column: str, top: int, weight: str | None = None) -> DataFrame:
    """The ``top`` most frequent values as a one-column table for semi joins."""
    return value_counts(df, column, top, weight).select(column)


def hour_distribution(spark: SparkSession, df: DataFrame, hour: str = "hour", weight: str | None = None) -> DataFrame:
    """24 rows, zero where an hour has none."""
    hours = spark.range(24).select(F.col("id").cast("int").alias(hour))
    counts = df.filter(F.col(hour).isNotNull()).groupBy(hour).agg(_tally(weight).alias("n"))
    return hours.join(counts, hour, "left").select(hour, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def daily_counts(df: DataFrame, date: str = "date", keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return df.filter(F.col(date).isNotNull()).groupBy(*keys, date).agg(_tally(weight).alias("n"))


def monthly_counts(df: DataFrame, date: str = "date") -> DataFrame:
    """Counts per yyyy-MM, rolled up from the days."""
    days = daily_counts(df, date)
    return days.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.sum("n").cast("bigint").alias("n"))


def day_hour_matrix(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Seven rows from Monday on, one column per hour, zero filled."""
    days = spark.range(7).select(
        (F.col("id") + 1).cast("int").alias("day_no"),
        F.element_at(F.array(*map(F.lit, WEEKDAYS)), (F.col("id") + 1).cast("int")).alias("day_of_week"),
    )
    cells = df.groupBy("day_of_week", "hour").agg(F.count(F.lit(1)).alias("n"))
    wide = cells.groupBy("day_of_week").agg(
        *[F.sum(F.when(F.col("hour") == h, F.col("n"))).alias(f"h{h:02d}") for h in range(24)]
    )
    filled = [F.coalesce(f"h{h:02d}", F.lit(0)).cast("bigint").alias(f"h{h:02d}") for h in range(24)]
    return days.join(wide, "day_of_week", "left").select("day_no", "day_of_week", *filled)


def weekly_periodicity(df: DataFrame) -> DataFrame:
    """Mean count per weekday over the observed weeks (at least one)."""
    days = df.groupBy("date", "day_of_week").agg(F.count(F.lit(1)).alias("n"))
    weekdays = days.groupBy("day_of_week").agg(
        F.sum("n").cast("bigint").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    whole = Window.partitionBy(F.lit(0))
    span = F.datediff(F.max("hi").over(whole), F.min("lo").over(whole))
    weeks = F.greatest(span / 7, F.lit(1.0))
    return weekdays.select("day_of_week", "n", (F.col("n") / weeks).alias("per_week"))


def business_hours(df: DataFrame, keys: Sequence[str] = ("dataset",), start: int = 8, end: int = 18) -> DataFrame:
    """Counts and percents inside and outside ``start <= hour < end``."""
    inside = (F.col("hour") >= start) & (F.col("hour") < end)
    counted = df.groupBy(*keys).agg(
        F.count_if(inside).alias("business"), F.count_if(~inside).alias("off_hours")
    )
    total = F.greatest(F.col("business") + F.col("off_hours"), F.lit(1))
    return counted.select(
        *keys, "business", "off_hours",
        (F.col("business") * 100.0 / total).alias("business_pct"),
        (F.col("off_hours") * 100.0 / total).alias("off_pct"),
    )


def top_hourly_profile(df: DataFrame, column: str, top: int, weight: str | None = None) -> DataFrame:
    """Hour profile of the ``top`` values, zero filled."""
    cells = pair_counts(df, column, "hour", weight=weight)
    leaders = top_values(cells, column, top, "n")
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    grid = leaders.select(column, hours)
    return grid.join(cells, [column, "hour"], "left").select(
        column, "hour", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def hourly_share_profile(df: DataFrame, column: str, top: int, weight: str | None = None) -> DataFrame:
    """Per value and hour the percent of the value's own total, for the ``top`` values, zero filled."""
    profile = top_hourly_profile(df, column, top, weight)
    return profile.withColumn("pct", share("n", column) * 100)


def top_daily_trend(df: DataFrame, column: str, top: int, weight: str | None = None) -> DataFrame:
    """Daily counts of the ``top`` values with a 3-day centred mean."""
    days = daily_counts(df.filter(F.col(column).isNotNull()), keys=[column], weight=weight)
    leaders = top_values(days, column, top, "n")
    kept = days.join(leaders, column, "left_semi")
    return centred_mean(kept, "n", "date", 1, "mean_3d", [column])


def dataset_summary(df: DataFrame, name: str, category: str) -> DataFrame:
    """Rows, columns, distinct addresses, date bounds and distinct categories of one dataset."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("src_ip").alias("n_ips"),
        F.count_distinct(category).alias("n_categories"),
        F.min("date").cast("string").alias("first_date"),
        F.max("date").cast("string").alias("last_date"),
    ).select(F.lit(name).alias("dataset"), F.lit(len(df.columns)).alias("n_columns"), "*")


def long_statistics(parts: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Stack (statistic, frame, item column, value column) parts into one long table."""
    stacked = [
        frame.select(F.lit(name).alias("statistic"), F.col(item).cast("string").alias("item"), F.col(value).cast("bigint").alias("value"))
        for name, frame, item, value in parts
    ]
    return reduce(DataFrame.unionByName, stacked)


def fold_rare(df: DataFrame, column: str, floor: float = 0.01, other: str = "Other") -> DataFrame:
    """Counts with categories below ``floor`` of the total folded into one."""
    counts = with_total_share(value_counts(df, column), "n", "_share")
    named = F.when(F.col("_share") < floor, F.lit(other)).otherwise(F.col(column))
    return counts.groupBy(named.alias(column)).agg(F.sum("n").cast("bigint").alias("n"))


def distribution(df: DataFrame, column: str, measure: str | None = None) -> DataFrame:
    """Count and percent per value; with ``measure`` also its share of the measure's total."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    if measure:
        aggregates.append(F.sum(measure).cast("double").alias("_m"))
    table = with_total_share(df.groupBy(column).agg(*aggregates), "n", "pct").withColumn("pct", F.col("pct") * 100)
    if measure:
        table = with_total_share(table, "_m", "measure_pct").withColumn("measure_pct", F.col("measure_pct") * 100).drop("_m")
    return table


def feature_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max and mean per feature in one pass, long format."""
    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.avg(c).alias("mean"),
            ).alias(c)
            for c in columns
        ]
    )
    return one.select(F.inline(F.array(*columns)))


def histogram(df: DataFrame, value: str, keys: Sequence[str], bins: int = 50, log: bool = False) -> DataFrame:
    """Equal-width bins over each group's own range; the maximum falls into the last bin.

    Equal values are counted first; a group's values then meet its range in as many parts as there are shuffle
    partitions, so a group is never one task.
    """
    keys = list(keys)
    x = F.log1p(value) if log else F.col(value).cast("double")
    points = df.filter(F.col(value).isNotNull()).select(*keys, x.alias("_x")).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))
    bounds = points.groupBy(*keys).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.floor((F.col("_x") - F.col("lo")) / width) + 1
    bin_no = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(slot, F.lit(bins)))
    if keys:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        points = points.withColumn("_part", F.pmod(F.xxhash64("_x"), F.lit(parts)))
        bounds = bounds.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
        placed = points.join(bounds, [*keys, "_part"])
    else:
        placed = points.withColumns({"lo": bounds.select("lo").scalar(), "hi": bounds.select("hi").scalar()})
    return placed.groupBy(*keys, bin_no.cast("int").alias("bin")).agg(F.sum("_n").alias("n"))
