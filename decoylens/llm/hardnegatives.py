"""Hard negatives by a secondary-sort shuffle over integer inner products.

An anchor's positives are the rows of its label with the highest scores; a negative of a positive is a row of another
label whose score lies between a share of the positive's score and that score itself.

Anchors and rows are packed into blocks, and each pair of blocks is one matrix product. Pass one sends, per anchor and
block, the best rows of its label; pass two, now that the positives are known, the first rows of other labels under
each of their scores: no other pair of the block can be in the result. Both passes pack what they send into byte keys
(anchor, descending score, kind, id), and ``repartitionAndSortWithinPartitions`` brings them into order. An iterator
runs down each anchor's keys once: a positive opens a window, a negative goes to each open window that it lies in, and
a window closes when it is full or the scores have fallen below it. It holds the open windows and nothing else.

Anchors are broadcast to the blocks up to ``BROADCAST_BYTES``; beyond, anchor blocks are joined to row blocks on a
salted number, which gives the same rows.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; of rows of
one id the smallest by label, then vector, stands; vectors may differ in length, missing components count as zero (as
all do in an empty vector); scaled components beyond +-2^26 count as that; ties in the score go to the smaller id; an
empty table, one label or no anchors give no rows; texts do not occur; other columns do not matter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .tables import stored

BLOCK_ROWS, ANCHOR_ROWS, CHUNK_ROWS = 8192, 4096, 256
BROADCAST_BYTES = 32_000_000
#: Largest size of a scaled component: products over up to 2^10 components fit into 63 bits.
LARGEST = 2**26
POSITIVE, NEGATIVE = 0, 1
_KEY = struct.Struct(">QQBQ")
_TOP, _MASK = 1 << 63, (1 << 64) - 1

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def packed(anchor: int, score: int, kind: int, row: int) -> bytes:
    """A key whose byte order is anchor, descending score, kind, id."""
    return _KEY.pack(anchor + _TOP, (~score + _TOP) & _MASK, kind, row + _TOP)


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = _KEY.unpack(key)
    return anchor - _TOP, ~(score - _TOP), kind, row - _TOP


def _place(key: bytes) -> int:
    """The partition of a key, by its anchor alone."""
    x = int.from_bytes(key[:8], "big")
    x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & _MASK
    return x ^ x >> 32


def members(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """``id, label, cells``: the rows that take part, one for each id, their vectors in scaled integers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    kept = rows.select(F.col(key).cast("long").alias("id"), F.struct(label.cast("long").alias("label"), scaled.alias("cells")).alias("x"), finite.alias("ok"))
    kept = kept.filter(F.col("ok") & F.col("id").isNotNull() & F.col("x.label").isNotNull())
    return kept.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.label", "x.cells")


def _packed_rows(rows: pa.RecordBatch | pa.Table) -> tuple[list[pa.Array], np.ndarray]:
    """Ids, labels and cells of the rows as bytes, ascending by id so that ties come out in order, and that order."""
    ids, labels, cells = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in map(rows.column, ("id", "label", "cells")))
    order = np.argsort(ids.to_numpy(), kind="stable")
    lengths = np.diff(cells.offsets.to_numpy())
    matrix = np.zeros((len(order), int(lengths.max(initial=0))), np.int32)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = cells.flatten().to_numpy()
    packs = ((ids.to_numpy(), "<i8"), (labels.to_numpy(), "<i8"), (matrix, "<i4"))
    return [pa.array([a[order].astype(kind).tobytes()], pa.binary()) for a, kind in packs], order


def _blocks(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                columns, _ = _packed_rows(batch.slice(at, size))
                yield pa.record_batch([pa.array([part << 32 | number], pa.int64()), *columns], names=["block", "ids", "labels", "cells"])
                number += 1

    return pack


def blocks(frame: DataFrame, size: int) -> DataFrame:
    """Up to ``size`` rows in one record: ids, labels and cells as bytes, ascending by id; cells padded with zeros."""
    return frame.mapInArrow(_blocks(size), "block long, ids binary, labels binary, cells binary")


def _matrix(cells: bytes, n: int) -> np.ndarray:
    return np.frombuffer(cells, "<i4").reshape(n, -1).astype(np.float64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; the longer rows' further components meet zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width
    if largest < 2**53:  # exact in doubles
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _pairs(row) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per few anchors of a pair of blocks: their ids and places, and row ids, scores and sameness of label, best first."""
    ids, labels = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.labels, "<i8")
    anchors, kinds = np.frombuffer(row.a_ids, "<i8"), np.frombuffer(row.a_labels, "<i8")
    own, cells = _matrix(row.a_cells, len(anchors)), _matrix(row.cells, len(ids))
    for at in range(0, len(anchors), CHUNK_ROWS):
        to = slice(at, at + CHUNK_ROWS)
        found = scores(own[to], cells)
        order = np.argsort(-found, axis=1, kind="stable")
        found = np.take_along_axis(found, order, axis=1)
        same = (labels[None, :] == kinds[to, None])[np.arange(len(found))[:, None], order]
        yield anchors[to], np.arange(len(anchors))[to], ids[order], found, same


def best_positives(row, count: int) -> Iterator[tuple[bytes, None]]:
    """Pass one: of each anchor, the best ``count`` rows of its label in the block."""
    for anchors, _, ids, found, same in _pairs(row):
        same &= ids != anchors[:, None]
        keep = same & (np.cumsum(same, axis=1) <= count)
        for i, j in zip(*np.nonzero(keep)):
            yield packed(int(anchors[i]), int(found[i, j]), POSITIVE, int(ids[i, j])), None


def window_negatives(row, per_positive: int, share: tuple[int, int]) -> Iterator[tuple[bytes, None]]:
    """Pass two: of each anchor, the first rows of other labels in the block in the window of any of its positives."""
    tops = np.frombuffer(row.tops, "<i8").reshape(-1, row.n_tops)  # positives' scores, repeated where there are fewer
    least = np.array([-(-share[0] * int(t) // share[1]) for t in tops.flat], np.int64).reshape(tops.shape)
    for anchors, places, ids, found, same in _pairs(row):
        other, keep = ~same, np.zeros(same.shape, bool)
        for top, bottom in zip(tops[places].T, least[places].T):
            inside = other & (found <= top[:, None]) & (found >= bottom[:, None])
            keep |= inside & (np.cumsum(inside, axis=1) <= per_positive)
        for i, j in zip(*np.nonzero(keep)):
            yield packed(int(anchors[i]), int(found[i, j]), NEGATIVE, int(ids[i, j])), None


def first_positives(keys: Iterator[tuple[bytes, None]], count: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, positive, score) of the first ``count`` keys of each anchor."""
    last, seen = None, 0
    for key, _ in keys:
        anchor, score, _, row = unpacked(key)
        seen = seen + 1 if anchor == last else 1
        last = anchor
        if seen <= count:
            yield anchor, row, score


def negatives(keys: Iterator[tuple[bytes, None]], per_positive: int, share: tuple[int, int]) -> Iterator[tuple[int, ...]]:
    """Result rows from one partition's sorted keys; holds the open windows of one anchor."""
    low, whole = share
    last, windows = None, []
    for key, _ in keys:
        anchor, score, kind, row = unpacked(key)
        if anchor != last:
            last, windows = anchor, []
        if kind == POSITIVE:
            windows.append([row, score, 0])
            continue
        windows = [w for w in windows if w[2] < per_positive and whole * score >= low * w[1]]
        for window in windows:
            if score <= window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], row, window[1], score


def mine(
    rows: DataFrame,
    anchors: Column,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    scale: int = 256,
    positives: int = 5,
    per_positive: int = 5,
    share: tuple[int, int] = (80, 100),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``anchors`` is a condition on ``id``."""
    spark = rows.sparkSession
    named = F.col(label) if isinstance(label, str) else label
    kept = stored(members(rows, key, vector, named, scale), "negative-rows")
    row_blocks = stored(blocks(kept, BLOCK_ROWS), "negative-blocks")
    asked = kept.filter(anchors)
    count = asked.count()
    n_groups = -(-count // ANCHOR_ROWS)
    width = asked.agg(F.max(F.size("cells"))).first()[0] or 0
    small = count * (width * 4 + 16 + positives * 8) <= BROADCAST_BYTES
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = 1 if small else parts

    def paired(anchor_blocks: DataFrame) -> DataFrame:
        """Each block of rows with each block of anchors."""
        numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(n_groups, 1) - 1).cast("bigint")))
        left = row_blocks.withColumn("a_group", numbers).withColumn("a_salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
        right = anchor_blocks.withColumn("a_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        return left.join(F.broadcast(right) if small else right, ["a_group", "a_salt"])

    def in_blocks(frame: DataFrame) -> DataFrame:
        """Anchors of one group as one record, with the scores of their positives where those are known."""

        def pack(table: pa.Table) -> pa.Table:
            columns, order = _packed_rows(table)
            tops = table.column("tops").to_pylist() if "tops" in table.column_names else [[0]] * len(order)
            deep = max(map(len, tops))
            tops = np.array([(tops[i] + tops[i][-1:] * deep)[:deep] for i in order], "<i8")
            group = table.column("a_group")[:1].combine_chunks()
            return pa.table([group, *columns, pa.array([tops.tobytes()], pa.binary()), pa.array([deep], pa.int32())], names=names)

        names = ["a_group", "a_ids", "a_labels", "a_cells", "tops", "n_tops"]
        schema = "a_group long, a_ids binary, a_labels binary, a_cells binary, tops binary, n_tops int"
        grouped = frame.withColumn("a_group", F.pmod(F.xxhash64("id"), F.lit(max(n_groups, 1))))
        return grouped.groupBy("a_group").applyInArrow(pack, schema)

    def ordered(pairs):
        return pairs.repartitionAndSortWithinPartitions(parts, _place)

    asked_blocks = stored(in_blocks(asked), "anchor-blocks")
    sent = paired(asked_blocks).rdd.flatMap(lambda r: best_positives(r, positives))
    opened = ordered(sent).mapPartitions(lambda keys: first_positives(keys, positives))
    opened = stored(spark.createDataFrame(opened, "anchor long, row long, score long", verifySchema=False), "positives")
    tops = opened.groupBy("anchor").agg(F.sort_array(F.collect_list("score"), asc=False).alias("tops"))
    known = asked.join(tops, asked["id"] == tops["anchor"]).select("id", "label", "cells", "tops")
    known_blocks = stored(in_blocks(known), "anchor-blocks-with-positives")
    sent = paired(known_blocks).rdd.flatMap(lambda r: window_negatives(r, per_positive, share))
    windows = opened.rdd.map(lambda r: (packed(r.anchor, r.score, POSITIVE, r.row), None))
    found = ordered(sent.union(windows)).mapPartitions(lambda keys: negatives(keys, per_positive, share))
    return spark.createDataFrame(found, RESULT, verifySchema=False)

