"""Stored tables: reuse, reconciliation, CSV, label discovery, the unified table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vocabulary import ADDRESS_COLUMNS


def readable(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path`` when it exists, can be read and has a row."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        return None
    return None if stored.isEmpty() else stored


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
    """Reuse the table at ``path``, or build and write it once as snappy Parquet.

    With ``partition_by`` the rows are rebalanced on those columns first: adaptive execution merges
    small partitions and splits a heavy one, so neither many tiny files nor one huge task appears.
    """
    stored = readable(spark, path)
    if stored is not None:
        return stored
    table = build()
    if partition_by:
        table = table.hint("rebalance", *partition_by)
    writer = table.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def reconcile(chunks: Sequence[DataFrame]) -> DataFrame:
    """Union of drifting chunks: columns in order of first sight, type of the first chunk whose
    column is not of null type, missing and uncastable values null."""
    types: dict[str, str] = {}
    for chunk in chunks:
        for name, dtype in chunk.dtypes:
            if types.get(name, "void") == "void":
                types[name] = dtype
    types = {name: "string" if dtype == "void" else dtype for name, dtype in types.items()}
    aligned = [
        chunk.select(*[(F.col(c).try_cast(t) if c in chunk.columns else F.lit(None).cast(t)).alias(c) for c, t in types.items()])
        for chunk in chunks
    ]
    return reduce(DataFrame.unionByName, aligned)


def first_seen_types(df: DataFrame) -> DataFrame:
    """Turn columns without any value into null-typed ones, as reconciliation expects."""
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[F.col(c) if filled[c] else F.lit(None).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def parquet_to_csv(spark: SparkSession, source: str, target: str) -> None:
    write_csv(spark.read.parquet(source), target)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def find_column(df: DataFrame, candidates: Sequence[str], what: str) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} column among {df.columns}; looked for {list(candidates)}")


def read_labels(spark: SparkSession, path: str, candidates: Sequence[str]) -> DataFrame:
    """``(src_ip, label)`` as text from a label table whose column names vary."""
    table = read_csv(spark, path)
    ip = find_column(table, ADDRESS_COLUMNS, "address")
    label = find_column(table, candidates, "label")
    return table.select(F.col(ip).cast("string").alias("src_ip"), F.col(label).cast("string").alias("label"))


def unify(flows: DataFrame, events: DataFrame, flow_tag: str = "flows", event_tag: str = "events") -> DataFrame:
    """Flows and connect events in one shape; the country column only where a side has it."""

    def side(df: DataFrame, columns: dict[str, str], tag: str) -> DataFrame:
        present = [F.col(c).alias(name) for c, name in columns.items() if c in df.columns]
        return df.select(*present, F.lit(tag).alias("dataset"))

    left = side(
        flows,
        {"timestamp": "timestamp", "src_ip": "src_ip", "dst_port": "dst_port", "proto": "protocol", "src_country_code": "src_country"},
        flow_tag,
    )
    right = side(
        events.filter(F.col("eventid") == "cowrie.session.connect"),
        {"timestamp": "timestamp", "src_ip": "src_ip", "geo_country_code": "src_country"},
        event_tag,
    )
    return left.unionByName(right, allowMissingColumns=True)


def extend_geo_cache(
    spark: SparkSession, cache_path: str, addresses: DataFrame, resolve: Callable[[DataFrame], DataFrame], ip: str = "src_ip"
) -> DataFrame:
    """The stored geography table, extended by the addresses it does not hold yet.

    Only new addresses are looked up; their rows are appended, so a lost executor can never
    damage what was already stored.
    """
    stored = readable(spark, cache_path)
    wanted = addresses.select(ip).distinct()
    if stored is None:
        resolve(wanted).write.mode("overwrite").parquet(cache_path)
    else:
        fresh = wanted.join(stored, ip, "left_anti")
        if not fresh.isEmpty():
            resolve(fresh).write.mode("append").parquet(cache_path)
    return spark.read.parquet(cache_path).dropDuplicates([ip])  # a repeated append may have left a row twice
