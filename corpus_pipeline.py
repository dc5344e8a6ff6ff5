"""A corpus through five of the training-data operators; each stage is written as Parquet and reread by the next.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a benchmark passage go, what
is left is put in an order that mixes the sources to their target weights, and that order is written as token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from decoylens.llm import decontaminate, mixing, neardup, tokenfile, toxicity
from decoylens.llm.tables import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8) the document with the smallest id stays.

    Fingerprint groups and, for what those miss, MinHash bands find the pairs; whole shingle sets decide."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row from a benchmark text go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, sorted into mixed order; the order is that of the written files."""
    return mixing.arrange(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the files that ``docs`` was read from, else by id, as read back from them."""
    if docs.inputFiles():
        place = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        files = tokenfile.write(place, order=[F.col("_file"), F.col("_row")])
    else:
        files = tokenfile.write(docs)
    return tokenfile.read(files).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
    ("token-id output", write_tokens),
]

#: Neither a trained classifier nor XXH64 shingles can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
