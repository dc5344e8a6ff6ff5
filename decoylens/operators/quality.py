"""Data-quality reports: one row per finding, ``(check, subject, value, status)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _finding(check: str, subject: Column | str, value: Column, status: Column) -> Column:
    subject = F.lit(subject) if isinstance(subject, str) else subject
    return F.struct(
        F.lit(check).alias("check"),
        subject.cast("string").alias("subject"),
        value.cast("double").alias("value"),
        status.alias("status"),
    )


def _verdict(good: Column, bad: str = "warn") -> Column:
    return F.when(good, "ok").otherwise(bad)


def schema_report(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected columns, the types they have and the values they hold over all rows; absent ones are errors, others are listed.

    All columns are counted in one aggregate, so the table is read once.
    """
    types = dict(df.dtypes)
    found = [(c, types.get(c, ""), "ok" if c in types else "missing") for c in expected]
    found += [(c, t, "extra") for c, t in types.items() if c not in expected]
    count = lambda c: F.count(df[c]) if c in types else F.lit(None).cast("bigint")
    rows = [F.struct(F.lit(c).alias("subject"), F.lit(t).alias("type"), F.lit(s).alias("status"), count(c).alias("n_values")) for c, t, s in found]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).select(F.lit("schema").alias("check"), "subject", "type", "status", "n_values")


def row_count_report(df: DataFrame, name: str, low: int, high: int) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(_finding("row_count", name, n, _verdict(n.between(low, high))).alias("r")).select("r.*")


def year_report(df: DataFrame, name: str, low: int, high: int, date: str = "date") -> DataFrame:
    first, last = F.min(F.year(date)), F.max(F.year(date))
    findings = F.array(
        _finding("first_year", name, first, _verdict(first.between(low, high))),
        _finding("last_year", name, last, _verdict(last.between(low, high))),
    )
    return df.agg(findings.alias("r")).select(F.inline("r"))


def range_report(df: DataFrame, name: str) -> DataFrame:
    """Rows outside the legal range, per available column, over all rows in one pass."""
    tests = {
        "src_port": ~F.col("src_port").between(0, 65535),
        "dst_port": ~F.col("dst_port").between(0, 65535),
        "hour": ~F.col("hour").between(0, 23),
        "src_ip": ~(F.col("src_ip").contains(".") | F.col("src_ip").contains(":")),
    }
    found = []
    for column, bad in tests.items():
        if column in df.columns:
            n = F.count_if(bad)
            found.append(_finding("value_range", f"{name}.{column}", n, _verdict(n == 0, "error")))
    return df.agg(F.array(*found).alias("r")).select(F.inline("r"))


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column, long format, one pass."""
    found = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in df.columns]
    return df.agg(F.array(*found).alias("r")).select(F.inline("r"))


def null_rate_report(df: DataFrame, high: float = 50.0) -> DataFrame:
    """Null percent per column; above ``high`` and fully null columns are flagged."""
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    found = []
    for c in df.columns:
        rate = F.count_if(F.col(c).isNull()) * 100.0 / total
        status = F.when(rate == 100, "empty").when(rate > high, "warn").otherwise("ok")
        found.append(_finding("null_rate", c, rate, status))
    return df.agg(F.array(*found).alias("r")).select(F.inline("r"))


def drop_null_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop the columns without a single value. One driver row holds one count per column."""
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first().asDict()
    empty = [c for c in df.columns if filled[c] == 0]
    return df.drop(*empty), empty


def expected_values_report(
    spark: SparkSession, df: DataFrame, column: str, expected: Sequence[str], check: str, lower: bool = False
) -> DataFrame:
    """Counts per value against an expected set: ok, unexpected, or missing."""
    value = F.lower(column) if lower else F.col(column)
    actual = df.filter(F.col(column).isNotNull()).groupBy(value.alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.createDataFrame([(v,) for v in expected], "subject string").withColumn("wanted", F.lit(True))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").otherwise("ok")
    return actual.join(wanted, "subject", "full_outer").select(
        F.lit(check).alias("check"), "subject", F.coalesce("n", F.lit(0)).cast("double").alias("value"), status.alias("status")
    )


def duplicate_report(df: DataFrame, name: str, keys: Sequence[str], high: float = 50.0) -> DataFrame:
    """Percent of rows repeating an earlier key, on those key columns the table has.

    Rows collapse to (key, count) with map-side combine before anything is shuffled.
    """
    used = [k for k in keys if k in df.columns]
    groups = df.groupBy(*used).agg(F.count(F.lit(1)).alias("n"))
    rate = (F.sum("n") - F.count(F.lit(1))) * 100.0 / F.greatest(F.sum("n"), F.lit(1))
    status = F.when(rate > high, "warn").otherwise("ok")
    return groups.agg(_finding("duplicates", f"{name}({','.join(used)})", rate, status).alias("r")).select("r.*")


def sample_records(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """The first and last ``n`` records in a total order."""
    head = df.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)
