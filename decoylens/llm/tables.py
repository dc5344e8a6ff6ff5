"""What the corpus operators share: table reads, word and line expressions, tables written to cut lineage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: Characters between words once A-Z are lower-cased: every ASCII character but digits and a-z.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The white space of \x09-\x0D and the space.
BLANKS = " \t\n\x0b\x0c\r"

#: For bytes of UTF-8: A-Z to a-z, every other byte of WORD_GAP to a space, digits, a-z and non-ASCII as they are.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched. ``lower`` does it where all characters are ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words of a text, lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def row_key(frame: DataFrame, text: str = "text", key: str = "doc_id") -> list[Column]:
    """Two columns that tell documents apart even where ids repeat: rows alike in both are alike in every result."""
    return [F.col(key).alias("_id"), F.xxhash64(F.col(text).isNull(), F.col(text)).alias("_text_key")]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_text_key"] == right["_text_key"])


def plain_key() -> list[Column]:
    """``_id, _text_key`` as columns without nulls, so that joins and groupings by them share one shuffle."""
    return [F.col("_id").isNull().alias("_no_id"), F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_own_id"), F.col("_text_key")]


PLAIN_KEY = ["_no_id", "_own_id", "_text_key"]


def of_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The documents among the row keys ``first`` (``_id, _text_key``), repeated rows once. Texts are shuffled once."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), *row_key(docs)).select("_doc", *plain_key())
    kept = rows.join(first.select(*plain_key()), PLAIN_KEY, "left_semi")
    return kept.dropDuplicates(PLAIN_KEY).select("_doc.*")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it again: later jobs start from files, not from lineage."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def unpacked(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns packed in ``_doc``, with another ``text``."""
    rows = rows.select("_doc", text.alias("_new"))
    return rows.select(*(F.col("_new").alias(c) if c == "text" else F.col("_doc").getField(c).alias(c) for c in columns))
