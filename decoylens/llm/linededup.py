"""Line dedup over levelled sorted runs.

Every line that is long enough gets a key (blanks stripped at both ends, A-Z lower-cased) and a 96-bit hash of it.
``LineRuns`` holds the hashes seen so far in sorted runs: tables bucketed and sorted by hash, so a batch meets them
in a merge join for which only the batch is shuffled. A batch anti-joins the runs; what is new becomes a run of its
own on level 0, so runs never share a key, and what was there already is noted as a repeat (more documents, perhaps a
larger last document). ``fan_in`` runs of one level are merged into one run of the next.

A key found in ``min_docs`` documents or more loses its lines except in the document with the largest id.

Defined cases: a null or empty text is one empty line; rows that repeat an id are one document; rows with a null id
are together one document, smaller than all others; a frequent line that is repeated within the kept document stays
there each time; an empty table gives no rows; other columns are carried along whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .tables import BLANKS, ascii_lower, stored, unpacked

KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def hashes(key: Column) -> Column:
    """Two hashes with nothing in common, 96 bits together."""
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def document_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, h1, h2: each line key of at least ``min_chars`` code points once per document."""
    lines = docs.select("doc_id", F.explode(F.array_distinct(split_lines(F.col("text")))).alias("line"))
    keyed = lines.select("doc_id", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", hashes(F.col("key")).alias("h")).select("doc_id", "h.*").distinct()


class LineRuns:
    """The levelled runs of one corpus, as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = 3):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeats: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy(*KEY)
        writer.option("path", scratch_path(self.spark, name)).format("parquet").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of (doc_id, h1, h2) rows, each once; its documents are in no other batch."""
        own = stored(lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")), "line-batch")
        fresh = own
        for run in self.runs():
            fresh = fresh.join(run.select(*KEY), KEY, "left_anti")
            self.repeats.append(own.join(run.select(*KEY), KEY, "left_semi"))
        self._insert(0, self._write(fresh))

    def _insert(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) < self.fan_in:
            return
        merged = self.spark.table(self.levels[level][0])
        for other in self.levels[level][1:]:
            merged = merged.unionByName(self.spark.table(other))
        # Repeats noted against the runs that go now would read tables that are gone.
        self.repeats = [stored(self._sum(self.repeats), "line-repeats")] if self.repeats else []
        compact, old = self._write(merged), self.levels[level]
        self.levels[level] = []
        self._insert(level + 1, compact)
        for table in old:
            self.spark.sql(f"DROP TABLE {table}")

    @staticmethod
    def _sum(parts: list[DataFrame]) -> DataFrame:
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def frequent(self, min_docs: int) -> DataFrame:
        """h1, h2 and the largest document of each key that ``min_docs`` documents hold."""
        runs = self.runs()
        if not runs:
            raise ValueError("no batch was added")
        again = self._sum(self.repeats).withColumnsRenamed({"n_docs": "more", "last_doc": "later"}) if self.repeats else None
        parts = []
        for run in runs:
            joined = run.join(again, KEY, "left") if again is not None else run.withColumn("more", F.lit(0)).withColumn("later", F.lit(None).cast("bigint"))
            full = joined.filter(F.col("n_docs") + F.coalesce("more", F.lit(0)) >= min_docs)
            parts.append(full.select(*KEY, F.greatest("last_doc", "later").alias("last_doc")))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def dropped_keys(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """Per document that loses lines: ``_id`` and ``_drop``, the hashes of those lines."""
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    path = scratch_path(spark, "lines")
    lines = document_lines(docs, min_chars).withColumn("batch", batch)
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, fan_in=fan_in)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).drop("batch"))
    frequent = stored(runs.frequent(min_docs), "frequent-lines")
    runs.drop()
    gone = lines.join(frequent, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct(*KEY)).alias("_drop"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """Per row: ``_doc`` (the whole row), n_lines, n_dropped and ``kept`` (the text without the dropped lines)."""
    gone = dropped_keys(docs, **options)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), F.col("doc_id").alias("_own"))
    rows = rows.join(gone, F.col("_own").eqNullSafe(F.col("_id")), "left")
    lines = split_lines(F.col("_doc.text"))
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col("_drop"), hashes(line_key(line))))
    rows = rows.select("_doc", "_drop", lines.alias("_lines"), F.when(F.col("_drop").isNotNull(), kept).alias("_kept"))
    whole = F.coalesce(F.col("_doc.text"), F.lit(""))
    text = F.when(F.col("_drop").isNull(), whole).otherwise(F.array_join("_kept", "\n"))
    n_lines = F.size("_lines").cast("long")
    n_dropped = F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_kept")).cast("long")
    return rows.select("_doc", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), text.alias("kept"))


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents with repeated lines removed from ``text``; columns as before."""
    return unpacked(deduplicate(docs, **options), docs.columns, F.col("kept"))
