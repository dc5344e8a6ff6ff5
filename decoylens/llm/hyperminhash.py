"""Near-duplicate groups by HyperMinHash sketches: compressed registers find pairs, whole shingle sets decide.

A document's set holds the XXH64 hashes (seed 42) of its distinct four-word shingles. Its sketch has ``REGISTERS``
buckets; each keeps the smallest hash dealt to it, compressed to the count of its leading zeros and the ``MANTISSA``
bits behind the first one. A register of 0 is empty.

Banding: empty registers borrow from others (each in a fixed random order of its own), so that short texts have whole
bands too, and each run of ``BAND_ROWS`` registers is a bucket key. Two sets of similarity s agree in a register with
chance s, so with 40 bands of 4 they share no bucket with a chance of (1 - s^4)^40: 6e-10 at 0.8, less above.

Estimate: the registers of a pair that agree, less those expected to agree by accident at these set sizes, are held
against the fewest that a pair of similarity 0.8 shows but once in 10^9 cases. Pairs that pass are verified on whole
sets. Equal sets are one node, told apart by 128 bits; nodes are numbered as they are written, to be short.

A bucket of up to ``TASK_NODES`` nodes is one task, and buckets of the same nodes are one. In a task, links are walked
outwards from a node, and what was reached is not compared again. A larger bucket is dealt in slices that all hold the
same ``PIVOTS`` nodes, so what hangs together with one pivot in any slice hangs together. The largest such part of a bucket is
connected; all other nodes (leftovers, those that hang together with other pivots too) are compared with all other
slices. So a crowd of near copies costs a pass over it and one over its loners.

Defined cases: null texts, empty ones and those without words have no shingles, link with nothing and are components of
their own; a text of fewer words than a shingle is one shingle; rows with a null id take part and never name a
component that has other ids; repeated rows each keep their result row; very long texts are taken whole, and count by
their shingles where tasks are dealt; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components
from .simhash import SEED, shingle_hashes
from .tables import row_key, same_key, stored

SHINGLE = 4
#: Least overlap as a part of the union, in whole numbers.
PART, WHOLE = 80, 100
REGISTERS, MANTISSA, BAND_ROWS = 160, 10, 4
BANDS = REGISTERS // BAND_ROWS
TASK_NODES, TASK_SHINGLES, PIVOTS = 1024, 4_000_000, 32
#: Chance to lose a pair of the least overlap by its estimate.
LOSS = 1e-9
_BORROW = np.argsort(np.random.default_rng(SEED).random((REGISTERS, REGISTERS)), axis=1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of one text, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def name_of(hashes: np.ndarray) -> bytes | None:
    """A set's name; the empty set has none."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes(), SEED) if len(hashes) else None


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of one set: per bucket leading zeros + 1 and mantissa bits of its smallest hash, 0 if it has none."""
    bucket = ((hashes >> np.uint64(40)) * np.uint64(REGISTERS) >> np.uint64(24)).astype(np.int64)
    mixed = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(11)
    least = np.full(REGISTERS, 1 << 53, np.uint64)
    np.minimum.at(least, bucket, mixed)
    bits = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # of 53; exact below 2^53
    zeros = np.minimum(53 - bits, 62)
    mantissa = least << (54 - np.clip(bits, 1, 53)).astype(np.uint64) & np.uint64((1 << 53) - 1)
    packed = (zeros + 1 << MANTISSA) | (mantissa >> np.uint64(53 - MANTISSA)).astype(np.int64)
    return np.where(least < np.uint64(1 << 53), packed, 0).astype("<u2")


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One number per band of the sketch, empty registers filled from others; an empty sketch has none."""
    full = sketch > 0
    if not full.any():
        return np.zeros(0, np.int64)
    source = np.where(full, np.arange(REGISTERS), _BORROW[np.arange(REGISTERS), full[_BORROW].argmax(axis=1)])
    filled = (source.astype(np.uint64) << np.uint64(16) | sketch[source].astype(np.uint64)).reshape(BANDS, BAND_ROWS)
    code = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND_ROWS):
        code = (code ^ filled[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
        code ^= code >> np.uint64(33)
    return code.view(np.int64)


@functools.cache
def _cell_chances(size: int) -> np.ndarray:
    """Chance of each register value but empty, for a set of ``size``."""
    octave = 0.5 ** np.arange(1, 54)[:, None]
    low = octave * (1 + np.arange(2**MANTISSA) / 2**MANTISSA)
    high = octave * (1 + np.arange(1, 2**MANTISSA + 1) / 2**MANTISSA)
    above = lambda x: np.exp(size * np.log1p(-x / REGISTERS))
    return above(low) - above(high)


@functools.lru_cache(100_000)
def accidents(a: int, b: int) -> float:
    """Registers that two sets without a common shingle share by accident; sizes 1.1^a and 1.1^b."""
    return float(REGISTERS * (_cell_chances(round(1.1**a)) * _cell_chances(round(1.1**b))).sum())


@functools.cache
def least_agreeing() -> np.ndarray:
    """By number of registers that either has: the fewest agreeing ones to accept."""
    least, s = [0], PART / WHOLE
    for n in range(1, REGISTERS + 1):
        below, c = (1 - s) ** n, 0
        while below <= LOSS:
            c += 1
            below += math.comb(n, c) * s**c * (1 - s) ** (n - c)
        least.append(c)
    return np.array(least)


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.rint(np.log(np.maximum(sizes, 1)) / math.log(1.1)).astype(np.int64)


def similarity(sketch: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Agreeing registers, less the accidental ones, and registers that either has; their ratio estimates Jaccard."""
    agree = ((others == sketch) & (sketch > 0)).sum(axis=1)
    either = ((others > 0) | (sketch > 0)).sum(axis=1)
    classes, own = np.unique(size_class(sizes), return_inverse=True)
    expected = np.array([accidents(int(size_class(np.array([size]))[0]), int(c)) for c in classes])[own]
    return agree - expected * (1 - agree / np.maximum(either, 1)), either


class Group:
    """The nodes of one task: names, sets and sketches."""

    def __init__(self, names: list[int], sets: list[np.ndarray], sketches: np.ndarray) -> None:
        self.names, self.sets, self.sketches = names, sets, sketches
        self.sizes = np.array([len(s) for s in sets], np.int64)

    @classmethod
    def of(cls, rows: pa.Table) -> Group:
        """The distinct nodes of the rows."""
        names, first = np.unique(rows.column("node").to_numpy(), return_index=True)
        cell = lambda c, i: rows.column(c)[int(i)].as_py()
        sets = [np.frombuffer(cell("set", i), "<u8") for i in first]
        sketches = np.array([np.frombuffer(cell("registers", i), "<u2") for i in first]).reshape(-1, REGISTERS)
        return cls(names.tolist(), sets, sketches)

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that overlap enough with one: by size, then by estimate, then by whole sets."""
        sizes, size = self.sizes, self.sizes[one]
        others = others[(sizes[others] * WHOLE >= size * PART) & (size * WHOLE >= sizes[others] * PART)]
        if len(others):
            agree, either = similarity(self.sketches[one], self.sketches[others], int(size), sizes[others])
            others = others[agree >= least_agreeing()[either] - 1]
        if not len(others):
            return others
        own, every = self.sets[one], np.concatenate([self.sets[i] for i in others])
        place = np.minimum(np.searchsorted(own, every), len(own) - 1)
        starts = np.cumsum(sizes[others]) - sizes[others]
        both = np.add.reduceat((own[place] == every).astype(np.int64), starts)
        return others[both * WHOLE >= (sizes[others] + size - both) * PART]

    def walk(self, order: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """In this order of heads: each with all nodes that hang together with it."""
        left, parts = order, []
        while len(left):
            head, left, front, reached = int(left[0]), left[1:], [int(left[0])], []
            while front and len(left):
                near = self.near(front.pop(), left)
                front += near.tolist()
                reached.append(near)
                left = left[~np.isin(left, near)]
            parts.append((head, np.concatenate([np.zeros(0, np.int64), *reached])))
        return parts


LINKS = "a long, b long"


def _link_table(pairs: list[tuple[int, int]], **more: list[int]) -> pa.Table:
    """Links, then rows of other columns."""
    extra = [None] * max((len(v) for v in more.values()), default=0)
    columns = {"a": [p[0] for p in pairs] + extra, "b": [p[1] for p in pairs] + extra, **{k: [None] * len(pairs) + v for k, v in more.items()}}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def connect(rows: pa.Table) -> pa.Table:
    """Links that connect all nodes of one small bucket that overlap enough, perhaps through others."""
    group = Group.of(rows)
    parts = group.walk(np.argsort(-group.sizes, kind="stable"))
    return _link_table([(group.names[h], group.names[i]) for h, part in parts for i in part])


def connect_slice(rows: pa.Table) -> pa.Table:
    """Links within a slice; then each ``node`` dealt to it, and each of its pivots, with the ``head`` it hangs together with."""
    group = Group.of(rows)
    flags = list(zip(rows.column("node").to_pylist(), rows.column("pivot").to_pylist()))
    marked, dealt = {n for n, p in flags if p}, {n for n, p in flags if not p}
    pivot = np.array([n in marked for n in group.names])
    parts = group.walk(np.argsort(~pivot, kind="stable"))
    pairs = [(group.names[h], group.names[i]) for h, part in parts for i in part]
    heads = [(i, h) for h, part in parts for i in (h, *part)]
    told = [(i, h, p) for i, h in heads for p, of in ((0, dealt), (1, marked)) if group.names[i] in of]
    key, piece = (rows.column(c)[0].as_py() for c in ("key", "slice"))
    return _link_table(
        pairs, key=[key] * len(told), slice=[piece] * len(told), node=[group.names[i] for i, _, _ in told],
        n=[int(group.sizes[i]) for i, _, _ in told], head=[group.names[h] for _, h, _ in told],
        hung=[int(pivot[h]) for _, h, _ in told], pivot=[p for _, _, p in told],
    )


def connect_left(rows: pa.Table) -> pa.Table:
    """Links between the leftovers of a chunk and the nodes of a slice that hang together with other heads."""
    group = Group.of(rows)
    columns = [rows.column(c).to_pylist() for c in ("node", "pivot", "head")]
    marked, head = {n for n, p, _ in zip(*columns) if p}, {n: h for n, _, h in zip(*columns)}
    heads = np.array([head[n] for n in group.names])
    left = [i for i, n in enumerate(group.names) if n in marked]
    return _link_table([(group.names[i], group.names[j]) for i in left for j in group.near(i, np.flatnonzero(heads != heads[i]))])


def links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``a, b`` of distinct ``node, n, registers, bands``; ``texts`` gives ``node, text`` for the ``node`` it gets."""
    entries = nodes.select("node", "n", F.explode("bands").alias("key"))
    slices = F.greatest(F.ceil(F.count(F.lit(1)) / TASK_NODES), F.ceil(F.sum("n") / TASK_SHINGLES)).alias("slices")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), slices).filter("size > 1")
    sizes = stored(sizes.select("key", "slices"), "bucket-sizes")

    def with_sets(rows: DataFrame) -> DataFrame:
        sets = texts(rows.select("node").distinct())
        sets = sets.select("node", F.pandas_udf(_sets, "binary")(F.col("text")).alias("set"))
        return rows.join(sets.join(nodes.select("node", "registers"), "node"), "node")

    entries = entries.drop("n")
    small = entries.join(sizes.filter("slices = 1").select("key"), "key")
    small = small.groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    small = stored(small.select(F.xxhash64("nodes").alias("task"), F.explode("nodes").alias("node")), "bucket-tasks")
    result = with_sets(small).groupBy("task").applyInArrow(connect, LINKS)

    large = sizes.filter("slices > 1")
    if large.isEmpty():
        return result
    rank = lambda c: F.xxhash64(F.lit(SEED), c)
    members = stored(entries.join(large, "key").withColumn("pivot", F.lit(False)), "large-buckets")
    first = F.row_number().over(Window.partitionBy("key").orderBy(rank("node"), "node"))
    pivots = members.withColumn("_first", first).filter(F.col("_first") <= PIVOTS).drop("_first", "pivot")
    pivots = pivots.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))).withColumn("pivot", F.lit(True))
    cut = members.withColumn("slice", F.pmod(rank("node"), F.col("slices")))
    dealt = cut.unionByName(pivots).select("key", "slice", "node", "pivot")
    told = f"{LINKS}, key long, slice long, node long, n long, head long, hung long, pivot long"
    found = stored(with_sets(dealt).groupBy("key", "slice").applyInArrow(connect_slice, told), "slice-links")
    result = result.unionByName(found.filter("node is null").select("a", "b"))

    # All slices hold the same pivots, so what hangs together with one of them in any slice hangs together: of each
    # bucket the largest such part is connected. All other nodes have yet to meet the other slices.
    dealt = found.filter("pivot = 0")
    core = dealt.filter("hung = 1").groupBy("key", "head").agg(F.count(F.lit(1)).alias("size"))
    core = core.groupBy("key").agg(F.max(F.struct("size", "head"))["head"].alias("node"))
    core = found.filter("pivot = 1").join(core, ["key", "node"]).select("key", "slice", F.col("head").alias("core"))
    left = dealt.join(core, ["key", "slice"]).filter("head <> core").select("key", "node", "n", "head", F.col("slice").alias("own"))
    left = stored(left, "slice-leftovers")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / TASK_NODES), F.ceil(F.sum("n") / TASK_SHINGLES)).alias("chunks")
    chunks = stored(left.groupBy("key").agg(chunks), "left-chunks")
    if chunks.isEmpty():
        return result
    number = lambda column: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(column) - 1))
    loners = left.join(chunks, "key").join(large, "key").withColumn("chunk", F.pmod(F.xxhash64(F.lit(SEED + 1), "node"), F.col("chunks")))
    loners = loners.withColumn("slice", number("slices")).filter("slice <> own").withColumn("pivot", F.lit(True))
    others = dealt.drop("pivot").withColumn("pivot", F.lit(False)).join(chunks, "key").withColumn("chunk", number("chunks"))
    names = ["key", "slice", "chunk", "node", "pivot", "head"]
    pairs = with_sets(loners.select(names).unionByName(others.select(names)))
    return result.unionByName(pairs.groupBy("key", "slice", "chunk").applyInArrow(connect_left, LINKS))


def _sketches(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    sketches = [registers(s) for s in sets]
    return pd.DataFrame({"name": [name_of(s) for s in sets], "n": [len(s) for s in sets], "registers": [r.tobytes() for r in sketches], "bands": [band_keys(r) for r in sketches]})


def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).astype("<u8").tobytes() for t in texts])


def sketch_column(text: Column) -> Column:
    return F.pandas_udf(_sketches, "name binary, n long, registers binary, bands array<long>")(text)


def groups(docs: DataFrame) -> DataFrame:
    """Per row: ``_id, _text_key`` (see ``row_key``), ``n_shingles`` and ``component_id``, its component's smallest id."""
    rows = docs.select(*row_key(docs), sketch_column(F.col("text")).alias("x"))
    rows = stored(rows.select("_id", "_text_key", "x.*"), "sketches")
    one = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_text_key")).alias("one")
    nodes = rows.filter("name is not null").groupBy("name").agg(*(F.first(c).alias(c) for c in ("n", "registers", "bands")), one)
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    first = nodes.select("node", F.col("one._id").alias("_id"), F.col("one._text_key").alias("_text_key"))
    keyed = docs.select(*row_key(docs), "text")

    def texts(wanted: DataFrame) -> DataFrame:
        few = first.join(wanted, "node")
        return keyed.join(few, same_key(keyed, few)).select("node", "text").dropDuplicates(["node"])

    roots = components(links(nodes, texts))
    named = nodes.select("name", "node", F.col("one._id").alias("first_id")).join(roots.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left")
    named = named.select("name", F.coalesce("root", "node").alias("root"), "first_id")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(smallest, "root").select(F.col("name").alias("_name"), "component_id"), "sketch-groups")
    full = rows.join(named, rows["name"] == named["_name"], "left")
    component = F.when(F.col("name").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return full.select("_id", "_text_key", F.col("n").alias("n_shingles"), component.alias("component_id"))
