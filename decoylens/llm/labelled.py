"""Folds and bounded training samples of the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def held_out(doc_id: Column, folds: int, out: int) -> Column:
    """Whether a document is kept from training; false for a null id, which has no label."""
    return F.coalesce(fold(doc_id, folds) == out, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, rows: int, chars: int) -> tuple[list[str], list[int], float]:
    """Texts and labels of at most ``rows`` labelled documents of each class outside the held-out fold, and the share
    of label 1 among all of that fold's labels.

    The ids are drawn from the labels by hash, so the same documents come whatever the partitioning; drawn documents
    that are missing, null or over ``chars`` long are left out. The driver gets at most 2 x rows x chars characters.
    A document with contradictory labels is not drawn.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, out))
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_top")).filter("y = _top").select("doc_id", "y")
    order = F.xxhash64(F.lit(7), F.col("doc_id"))
    drawn = known.filter("y = 0").orderBy(order).limit(rows).unionByName(known.filter("y = 1").orderBy(order).limit(rows))
    drawn = {r["doc_id"]: r["y"] for r in drawn.collect()}  # at most 2 x rows numbers
    share = known.agg(F.avg("y")).first()[0] or 0.0
    texts = docs.filter(F.col("doc_id").isin(list(drawn)) & F.col("text").isNotNull() & (F.char_length("text") <= chars))
    found = {r["doc_id"]: r["text"] for r in texts.groupBy("doc_id").agg(F.min("text").alias("text")).collect()} if drawn else {}
    ids = sorted(found)
    return [found[i] for i in ids], [drawn[i] for i in ids], share
