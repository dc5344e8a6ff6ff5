"""Near-duplicate groups by the Jaccard similarity of word shingles: fingerprints and MinHash bands find pairs, whole sets decide.

Two documents are linked if their sets of five-word shingles (XXH64, seed 42, words as in ``simhash``) overlap by at
least four fifths of their union; groups are what links connect. Equal sets are one node.

The fingerprints of ``simhash`` (three words, radius 3) are linked first: documents of one of its groups are a bucket,
however far apart. They miss some pairs, so buckets of MinHash bands add to them.

Each node enters ``BANDS`` buckets, one per band of ``BAND_ROWS`` MinHash values. Two sets of similarity s share no
bucket with a chance of (1 - s^4)^30: 1.4e-7 at 0.8, less above. Every pair of a bucket is decided on the whole sets,
however large the bucket: one above the limit of nodes or shingles is dealt in slices, and each pair of slices is a
task of its own. Only the links that connect a task's nodes leave it. Bands that meet the same nodes are one task.

Defined cases: null texts have no words, like empty ones, and no shingles; all of them are one node. A text of fewer
words than a shingle is one shingle; rows with a null id take part and stay only where a group has no other; repeated
rows are one document; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from . import simhash
from .simhash import SEED, shingle_hashes
from .tables import PLAIN_KEY, of_rows, plain_key, row_key, stored

SHINGLE = 5
#: Least overlap as a part of the union, in whole numbers.
PART, WHOLE = 4, 5
BANDS, BAND_ROWS = 30, 4
SLICE_NODES, SLICE_SHINGLES = 1024, 4_000_000
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND_ROWS), np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of one text, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def node_of(hashes: np.ndarray) -> int:
    """A set's number; sets are told apart by it."""
    import xxhash

    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED) if len(hashes) else 0


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """One number per band; a set without shingles has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        x = (hashes[None, at : at + 1024] ^ _MIX[0][:, None]) * (_MIX[1][:, None] | np.uint64(1))
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    code = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND_ROWS):
        code = (code ^ rows[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
        code ^= code >> np.uint64(33)
    return code.view(np.int64)


def _sketches(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    nodes = np.array([node_of(s) for s in sets], np.uint64).astype(np.int64)
    return pd.DataFrame({"node": nodes, "n": [len(s) for s in sets], "bands": [bands_of(s) for s in sets]})


def _sets(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    return pd.DataFrame({"node": np.array([node_of(s) for s in sets], np.uint64).astype(np.int64), "set": [s.astype("<u8").tobytes() for s in sets]})


def links_within(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that connect all nodes whose sets overlap enough, perhaps through others."""
    sizes = np.array([len(s) for s in sets], np.int64)
    left, heads, tails = np.argsort(-sizes, kind="stable"), [], []
    while len(left) > 1:
        head, left, front = left[0], left[1:], [left[0]]
        while front and len(left):
            one = front.pop()
            # Sets of other sizes than these cannot overlap enough.
            able = left[(sizes[left] * WHOLE >= sizes[one] * PART) & (sizes[one] * WHOLE >= sizes[left] * PART)]
            if not len(able):
                continue
            own, every = sets[one], np.concatenate([sets[i] for i in able])
            place = np.minimum(np.searchsorted(own, every), len(own) - 1)
            starts = np.cumsum(sizes[able]) - sizes[able]
            both = np.add.reduceat((own[place] == every).astype(np.int64), starts)
            near = able[both * WHOLE >= (sizes[able] + sizes[one] - both) * PART]
            heads += [int(nodes[head])] * len(near)
            tails += nodes[near].tolist()
            front += near.tolist()
            left = left[~np.isin(left, near)]
    return heads, tails


def links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], groups: DataFrame | None = None) -> DataFrame:
    """Links ``a, b`` of distinct ``node, n, bands``; ``texts`` gives a ``text`` of each of the ``node`` it gets.

    ``groups``, distinct ``node, n, key``, are more buckets.
    """
    entries = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    if groups is not None:
        entries = entries.unionByName(groups.select("node", "n", F.lit(BANDS).alias("band"), "key"))
    sizes = entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).filter("size > 1")
    slices = F.greatest(F.ceil(F.col("size") / SLICE_NODES), F.ceil(F.col("total") / SLICE_SHINGLES))
    sizes = stored(sizes.select("band", "key", slices.alias("slices")), "band-sizes")
    dealt = entries.join(sizes, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col("slices")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    key = ["band", "key", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t")]
    tasks = dealt.select(*key, "node").groupBy("band", "key", "s", "t").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    tasks = tasks.filter(F.size("nodes") > 1).select("nodes").distinct()
    tasks = stored(tasks.select(F.xxhash64("nodes").alias("task"), F.explode("nodes").alias("node")), "band-tasks")

    def connect(rows: pa.Table) -> pa.Table:
        ids, first = np.unique(rows.column("node").to_numpy(), return_index=True)
        binary = rows.column("set")
        sets = [np.frombuffer(binary[int(i)].as_py(), "<u8") for i in first]
        a, b = links_within(ids, sets)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sets = texts(tasks.select("node").distinct())
    sets = sets.select(F.pandas_udf(_sets, "node long, set binary")(F.col("text")).alias("x")).select("x.node", "x.set")
    return tasks.join(sets, "node").groupBy("task").applyInArrow(connect, "a long, b long")


def sketch_column(text: Column) -> Column:
    return F.pandas_udf(_sketches, "node long, n long, bands array<long>")(text)


def groups(docs: DataFrame) -> DataFrame:
    """Per row: ``_id, _text_key`` (see ``row_key``) and ``group``, a node of its group."""
    rows = docs.select(*row_key(docs), sketch_column(F.col("text")).alias("x"))
    rows = stored(rows.select("_id", "_text_key", "x.*"), "sketches")
    one = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_text_key")).alias("one")
    nodes = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), one)
    nodes = stored(nodes, "sketch-nodes")
    first = nodes.select("node", "one._id", "one._text_key").select("node", *plain_key())
    keyed = docs.select(*row_key(docs), "text").select("text", *plain_key())

    def texts(wanted: DataFrame) -> DataFrame:
        few = first.join(wanted, "node").select(*PLAIN_KEY)
        return keyed.join(few, PLAIN_KEY, "left_semi").dropDuplicates(PLAIN_KEY).select("text")

    prints = simhash.groups(docs).select("_id", "_text_key", F.col("group").alias("key")).distinct()
    near = rows.filter("n > 0").join(prints, rows["_id"].eqNullSafe(prints["_id"]) & (rows["_text_key"] == prints["_text_key"]))
    near = stored(near.select("node", "n", "key").distinct(), "fingerprint-buckets")
    roots = components(links(nodes.select("node", "n", "bands"), texts, near))
    named = nodes.select(F.col("node").alias("own")).join(roots, F.col("own") == roots["node"], "left")
    named = named.select(F.col("own").alias("node"), F.coalesce("root", "own").alias("group"))
    return rows.join(named, "node").select("_id", "_text_key", "group")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id (null only where there is no other); columns as before."""
    member = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_text_key")
    first = groups(docs).groupBy("group").agg(F.min(member).alias("first")).select("first._id", "first._text_key")
    return of_rows(docs, first)
