"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _doc string, key string, score string, fp string, slot string, line string"


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]], extra: bool = False) -> DataFrame:
    rows = [(i, t, None, None if i is None else f"s{i % 3}", None) for i, t in texts]
    if extra:
        return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x") for r in rows], EXTRA)
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD: list[tuple[int | None, str | None]] = [
    (1, None),
    (2, ""),
    (3, "   \n\t \n"),
    (4, "one"),
    (5, "the same words in the same order every time they are said"),
    (6, "The SAME words in the same order every time they are said"),
    (6, "The SAME words in the same order every time they are said"),
    (7, "Élan é à ü ß 漢字 emoji 😀 and plain words ÉTÉ"),
    (None, "a document without an id but with quite some words in it"),
    (None, None),
    (8, "long " * 40_000 + "end"),
    (9, "\x00 control \x1f characters\x0b and\x0c feeds\r\n"),
]
