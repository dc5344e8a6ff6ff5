"""K-means by dimension-sharded Lloyd rounds, in exact integers.

Vectors are packed into blocks of rows, and each block is cut into shards of ``SHARD_COLUMNS`` columns; a record holds
one shard of one block. A round: column-block tasks compute the squared distances of their columns to their own slice
of the centroids; ``reduceByKey`` adds the shards of a block and the argmin names each vector's cluster; the clusters
go back to the shards, each of which sums its own columns by cluster and replaces its own slice by the floors of the
means. No task sees whole vectors and whole centroids together, so neither wide vectors nor many clusters need to fit.

Slices are broadcast to the tasks up to ``BROADCAST_BYTES``; beyond, they are joined on shard and a salt, with the same
result. The blocks are a table bucketed by shard and block, so that only clusters move back to them, no vectors. Each
round's slices are written to the shared folder.

Defined cases: vectors that are null, of another length than ``width`` or with a null or non-finite component take no
part; rows with a null id take part and start a centroid only if there are too few others; repeated rows each keep
their result row; scaled components beyond +-2^26 count as that, so that sums are exact; ties go to the smaller
cluster; with fewer vectors than clusters each is a start; inertia beyond a long is null; an empty table gives no rows;
other columns do not matter.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .tables import stored

SHARD_COLUMNS, BLOCK_ROWS = 32, 512
BROADCAST_BYTES = 64_000_000
LARGEST = 2**26


def members(rows: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """``id, cells``: the vectors that take part, in scaled integers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter((F.size(vector) == width) & finite)
    scaled = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return kept.select(F.col(key).cast("long").alias("id"), scaled.alias("cells"))


def starts(vectors: DataFrame, clusters: int, seed: str) -> DataFrame:
    """``cluster, cells``: the vectors whose ``sha256(seed:id)`` is smallest, numbered in that order."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select(draw.alias("draw"), "cells").orderBy(F.col("draw").asc_nulls_last(), "cells").limit(clusters)
    first = first.agg(F.array_sort(F.collect_list(F.struct(F.col("draw").isNull().alias("no_id"), "draw", "cells"))).alias("all"))
    return first.select(F.posexplode("all").alias("cluster", "x")).select("cluster", "x.cells")


def blocks(vectors: DataFrame, width: int) -> DataFrame:
    """``block, shard, n, ids, cells``: each shard of up to ``BLOCK_ROWS`` vectors; ids (with a mask of nulls) at shard 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                cells = piece.column("cells").flatten().to_numpy().reshape(piece.num_rows, width)
                cuts = [np.ascontiguousarray(cells[:, c : c + SHARD_COLUMNS]).astype("<i4").tobytes() for c in range(0, width, SHARD_COLUMNS)]
                k = len(cuts)
                ids = [piece.column("id").to_pylist()] + [None] * (k - 1)
                columns = [pa.array([part << 32 | number] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([piece.num_rows] * k, pa.int32())]
                yield pa.record_batch([*columns, pa.array(ids, pa.list_(pa.int64())), pa.array(cuts, pa.binary())], names=["block", "shard", "n", "ids", "cells"])
                number += 1

    return vectors.mapInArrow(pack, "block long, shard int, n int, ids array<long>, cells binary")


def partial_distances(cells: bytes, n: int, piece: np.ndarray) -> np.ndarray:
    """Squared distances (rows x clusters) of one shard of a block to one slice of the centroids, exact."""
    own = np.frombuffer(cells, "<i4").reshape(n, -1).astype(np.int64)
    largest = max(int(np.abs(own).max(initial=0)), int(np.abs(piece).max(initial=0)))
    if 4 * largest * largest * own.shape[1] < 2**53:  # exact in doubles
        a, b = own.astype(np.float64), piece.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((own - c) ** 2).sum(axis=1) for c in piece], axis=1)


def assigned(distances: np.ndarray) -> tuple[bytes, bytes]:
    """Clusters and distances of a block's vectors."""
    best = distances.argmin(axis=1)
    return best.astype("<i4").tobytes(), distances[np.arange(len(best)), best].astype("<i8").tobytes()


def shard_sums(cells: bytes, n: int, chosen: bytes, clusters: int) -> np.ndarray:
    """By cluster, the sums of a shard's columns, then the count."""
    own, to = np.frombuffer(cells, "<i4").reshape(n, -1), np.frombuffer(chosen, "<i4")
    sums = np.zeros((clusters, own.shape[1] + 1), np.int64)
    np.add.at(sums, to, np.concatenate([own, np.ones((n, 1), np.int32)], axis=1))
    return sums


def moved(piece: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A slice after its round; clusters without vectors stay."""
    count = sums[:, -1:]
    return np.where(count > 0, sums[:, :-1] // np.maximum(count, 1), piece)


def cluster(
    rows: DataFrame, clusters: int = 16, rounds: int = 3, *, key: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 64, seed: str = "1"
) -> tuple[DataFrame, DataFrame]:
    """Assignments ``id, cluster, distance`` to the final centroids, and these: ``cluster, cells``."""
    spark = rows.sparkSession
    vectors = members(rows, key, vector, width, scale)
    first = stored(starts(vectors, clusters, seed), "centroid-starts")
    clusters = first.count()
    shards = -(-width // SHARD_COLUMNS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lloyd_{uuid.uuid4().hex}"
    packed = blocks(vectors, width).write.bucketBy(parts, "shard", "block").option("path", scratch_path(spark, "vector-blocks"))
    packed.saveAsTable(name)
    cut = spark.table(name)

    small = clusters * width * 8 <= BROADCAST_BYTES
    salts = 1 if small else parts
    SLICES = "shard int, cells binary"

    def with_slices(pieces: DataFrame) -> DataFrame:
        right = pieces.select("shard", F.col("cells").alias("piece")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        left = cut.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
        return left.join(F.broadcast(right) if small else right, ["shard", "salt"])

    def matrix(cells: bytes) -> np.ndarray:
        return np.frombuffer(cells, "<i8").reshape(clusters, -1)

    def assign(pieces: DataFrame) -> DataFrame:
        """``block, chosen, distances``, the latter two as bytes."""
        near = with_slices(pieces).select("block", "n", "cells", "piece").rdd
        near = near.map(lambda r: (r[0], partial_distances(r[2], r[1], matrix(r[3])))).reduceByKey(operator.add, parts)
        return spark.createDataFrame(near.map(lambda x: (x[0], *assigned(x[1]))), "block long, chosen binary, distances binary", verifySchema=False)

    def update(pieces: DataFrame, chosen: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        back = cut.join(chosen.select("block", "chosen", every), ["shard", "block"])
        sums = back.select("shard", "n", "cells", "chosen").rdd.map(lambda r: (r[0], shard_sums(r[2], r[1], r[3], clusters))).reduceByKey(operator.add, shards)
        both = pieces.rdd.map(lambda r: (r[0], matrix(r[1]))).join(sums, shards)
        return spark.createDataFrame(both.map(lambda x: (x[0], moved(*x[1]).astype("<i8").tobytes())), SLICES, verifySchema=False)

    def slices(row) -> Iterator[tuple[int, tuple[int, bytes]]]:
        for shard in range(shards):
            yield shard, (row[0], np.array(row[1][shard * SHARD_COLUMNS :][:SHARD_COLUMNS], "<i8").tobytes())

    pieces = first.select("cluster", "cells").rdd.flatMap(slices).groupByKey(shards).mapValues(lambda own: b"".join(c for _, c in sorted(own)))
    pieces = stored(spark.createDataFrame(pieces, SLICES, verifySchema=False), "slices")
    for turn in range(rounds):
        pieces = stored(update(pieces, assign(pieces)), f"slices-{turn}")
    chosen = assign(pieces)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own, far in zip(batch.column("ids"), batch.column("chosen").to_pylist(), batch.column("distances").to_pylist()):
                yield pa.record_batch([ids.values, pa.array(np.frombuffer(own, "<i4")), pa.array(np.frombuffer(far, "<i8"))], names=["id", "cluster", "distance"])

    result = cut.filter("shard = 0").select("block", "ids").join(chosen, "block").select("ids", "chosen", "distances")
    result = result.mapInArrow(named, "id long, cluster int, distance long")

    by_cluster = pieces.rdd.flatMap(lambda r: ((k, (r[0], cells.tolist())) for k, cells in enumerate(matrix(r[1])))).groupByKey()
    centroids = by_cluster.map(lambda x: (x[0], [v for _, cells in sorted(x[1]) for v in cells]))
    return result, spark.createDataFrame(centroids, "cluster int, cells array<long>", verifySchema=False)


def report(assignments: DataFrame, centroids: DataFrame) -> DataFrame:
    """Per vector: its cluster and distance, that cluster's inertia and the whole one, and its centroid's digest."""
    assignments = stored(assignments, "assignments")
    far = F.sum(F.col("distance").cast("decimal(38,0)"))
    by_cluster = assignments.groupBy("cluster").agg(far.alias("far"))
    total = assignments.agg(F.expr("try_cast(sum(CAST(distance AS decimal(38,0))) AS bigint)")).scalar()
    digests = centroids.select("cluster", F.sha2(F.array_join("cells", ","), 256).alias("centroid_sha256"))
    facts = stored(by_cluster.join(digests, "cluster").select("cluster", F.expr("try_cast(far AS bigint)").alias("cluster_inertia"), "centroid_sha256"), "cluster-facts")
    facts = F.broadcast(facts) if facts.count() * 200 <= BROADCAST_BYTES else facts
    return assignments.join(facts, "cluster").select("id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
