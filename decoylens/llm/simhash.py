"""Near-duplicate groups by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint bit is set if more than half of the shingle hashes (XXH64, seed 42) have it. Documents whose
fingerprints differ in at most ``radius`` bits are linked; groups are what links connect. Equal fingerprints are
one node, so copies are never compared.

Covering hashing: bit i gets a non-zero vector m(i) of radius + 1 bits, and each non-zero vector v of that length
gives the mask of all bits with odd <m(i), v>. At most ``radius`` differing bits span less than the whole space, so
some v is orthogonal to all of them: that mask sees both fingerprints alike. Every pair in reach meets in at least
one of the 2^(radius+1) - 1 tables. A bucket of more than ``bucket_limit`` fingerprints is split by a second family
of masks over the bits that its own mask leaves open, and so on; the guarantee holds on each level, and after a few
levels so few bits are open that a bucket is small by itself. Within a bucket all pairs are compared on whole
fingerprints, and only the links that connect the bucket leave it.

Defined cases: null texts have no words, like empty ones, and get fingerprint zero, which links like any other;
a text of fewer words than a shingle is one shingle; rows with a null id take part and never name a group that has
other ids; repeated rows each keep their result row; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .tables import of_rows, row_key, stored

BITS = 64
SEED = 42
_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle of one text, in order. ``bytes.lower`` and ``bytes.split`` know ASCII only."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of one text as an unsigned number."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return prints(text)


def covering_masks(positions: list[int], radius: int, seed: int) -> list[int]:
    """Masks over the given bit positions; any ``radius`` of them are all unseen by at least one mask."""
    order = np.random.default_rng(seed).permutation(len(positions))
    vector = {p: 1 + int(order[i]) % (2 ** (radius + 1) - 1) for i, p in enumerate(positions)}
    masks = {sum(1 << p for p in positions if bin(vector[p] & v).count("1") % 2) for v in range(1, 2 ** (radius + 1))}
    return sorted(masks)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << BITS - 1 else mask


def _links_within(fingerprints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from the first fingerprint of each connected part to the others of that part."""
    left, heads, tails = fingerprints, [], []
    while len(left) > 1:
        head, rest = left[0], left[1:]
        front, reached = left[:1], []
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for i in range(0, len(front), 64):
                near |= (np.bitwise_count(front[i : i + 64, None] ^ rest[None, :]) <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            reached.append(front)
        if reached:
            part = np.concatenate(reached)
            heads.append(np.full(len(part), head)), tails.append(part)
        left = rest
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *heads]), np.concatenate([empty, *tails])


def links(fingerprints: DataFrame, radius: int = 3, bucket_limit: int = 1024) -> DataFrame:
    """Links ``a, b`` that connect all of the distinct ``fp`` within ``radius`` of each other, perhaps through others."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_links_within(np.asarray(group.values, np.int64).view(np.uint64), radius) for group in batch.column(0)]
            a = np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            b = np.concatenate([f[1] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    if not 1 <= radius <= 4:
        raise ValueError("the radius is from 1 to 4")
    bucket_limit = max(bucket_limit, 2 ** (2**radius - 1))  # with fewer fingerprints a bucket may have no bit left to split by
    spark = fingerprints.sparkSession
    masks = {0: 0}  # path of masks taken so far: bits seen
    rows, result, level = fingerprints.select("fp"), None, 0
    while True:
        steps = [
            (path, path * 2 ** (radius + 1) + i + 1, _signed(seen | mask))
            for path, seen in masks.items()
            for i, mask in enumerate(covering_masks([p for p in range(BITS) if not seen >> p & 1], radius, 1000 * level + path % 997))
        ]
        if level == 0:
            first = F.array(*(F.struct(F.lit(n).cast("bigint").alias("next"), F.lit(m).alias("mask")) for _, n, m in steps))
            rows = rows.select("fp", F.explode(first).alias("step")).select("fp", "step.next", "step.mask")
        else:  # 225 rows, then 3375
            rows = rows.join(F.broadcast(spark.createDataFrame(steps, "path bigint, next bigint, mask bigint")), "path")
        rows = rows.select(F.col("next").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sizes = stored(sizes, f"bucket-sizes-{level}")
        small = rows.join(sizes.filter(F.col("size") <= bucket_limit), ["path", "key"]).groupBy("path", "key").agg(F.collect_list("fp").alias("group"))
        found = small.select("group").mapInArrow(connect, "a bigint, b bigint")
        result = found if result is None else result.unionByName(found)
        large = sizes.filter(F.col("size") > bucket_limit)
        if large.isEmpty():
            return result
        rows = stored(rows.join(large, ["path", "key"]).select("path", "fp"), f"large-buckets-{level}")
        taken = {r[0] for r in large.select("path").distinct().collect()}  # at most 15^level numbers
        masks = {path: mask % (1 << BITS) for _, path, mask in steps if path in taken}
        level += 1


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, bucket_limit: int = 1024) -> DataFrame:
    """Per row: ``_id, _text_key`` (see ``row_key``), ``fp``, ``group`` (a fingerprint), ``component_id`` (its smallest id)."""
    rows = stored(docs.select(*row_key(docs), fingerprint_column(F.col("text"), shingle).alias("fp")), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("_id").alias("first_id")), "fingerprint-classes")
    roots = components(links(classes, radius, bucket_limit))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("group"), "first_id")
    smallest = named.groupBy("group").agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(smallest, "group").select("fp", "group", "component_id"), "fingerprint-groups")
    return rows.join(named, "fp").select("_id", "_text_key", "fp", "group", "component_id")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, the one with the smallest id (null only where there is no other); columns as before."""
    member = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_text_key")
    first = groups(docs, **options).groupBy("group").agg(F.min(member).alias("first")).select("first._id", "first._text_key")
    return of_rows(docs, first)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
