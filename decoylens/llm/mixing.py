"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_rows`` documents in a random but fixed order. In the ideal order each source
that still has blocks gets its weight's part of every slot, the others' weights left out. Block k is released at the
slot in which the ideal order begins it and due at the slot in which the ideal order ends it; each slot goes to the
released block that is due first. The ideal order itself shows that all blocks fit, so none is late, and after any
number of slots a source has less than one block more or less than its ideal number: with target weight w, w t while
all sources last. All documents are placed; none is dropped or repeated.

The ideal order has a closed form. In a time v in which every source issues blocks at its weight, a source with weight
w and B blocks ends at B / w, and the slots used by v are the sum of min(w v, B) over the sources. Weights are taken as
the exact ratios that the given numbers are, so releases and deadlines are exact whole numbers for any count of slots.

The driver takes one step per block and holds one row per source and ``CHUNK`` blocks, which it writes to the shared
folder; documents find their slot by a join. Each source has its own weight and blocks, however many there are; only where
``max_sources`` is given, more sources than that are folded into that many by hash.

Defined cases: null is a source of its own; a source of weight 0 comes after all others; repeated rows and rows with a
null id are documents like others, ties in the random order are broken by id and text; an empty table gives no rows;
other columns are carried along.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordered import bucketed_rank
from .tables import stored

#: Documents of one source that one slice of its random order holds: many small slices fill all tasks alike.
SLICE_ROWS = 1_000
#: Blocks in one row of the plan, in one piece of it on the driver, and in a plan that is surely small enough to broadcast.
PART, CHUNK, BROADCAST = 4096, 500_000, 1_000_000
SEED = 9


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole shares of the period by largest remainders, at least one each; they add up to the period."""
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    result = {s: max(1, int(x)) for s, x in exact.items()}
    while (short := period - sum(result.values())) > 0:
        for s in sorted(exact, key=lambda s: (result[s] - exact[s], s))[:short]:
            result[s] += 1
    while sum(result.values()) > period:  # what the least shares took
        result[max((s for s in result if result[s] > 1), key=lambda s: (result[s] - exact[s], s))] -= 1
    return result


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int]]:
    """(source, block) of each slot in turn, earliest deadline first; ties go to the larger weight, then by name."""
    ratios = {s: Fraction(weights[s]) for s in blocks if weights[s] > 0}
    scale = math.lcm(*(r.denominator for r in ratios.values()))
    whole = {s: int(r * scale) for s, r in ratios.items()}
    # Slots used by the time k / w: the least of the lines (active weight) k / w + (blocks of ended sources).
    ends = sorted((Fraction(blocks[s], w), w, blocks[s]) for s, w in whole.items())
    times, lines = [float(e) for e, _, _ in ends], [(sum(whole.values()), 0)]
    for _, w, n in ends:
        lines.append((lines[-1][0] - w, lines[-1][1] + n))

    def used(k: int, w: int) -> tuple[int, int]:
        """Slots used when a source of weight w has issued k blocks, rounded down and up."""
        at = bisect_right(times, k / w)
        near = min(active * k + ended * w for active, ended in lines[max(0, at - 1) : at + 2])
        return near // w, -(-near // w)

    ready: list[tuple[int, int, str, int, int]] = []
    waiting = [(0, s, 0) for s in whole if blocks[s]]
    heapq.heapify(waiting)
    for slot in range(sum(blocks[s] for s in whole)):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            following, due = used(k + 1, whole[s])
            heapq.heappush(ready, (due, -whole[s], s, k, following))
        _, _, s, k, following = heapq.heappop(ready)
        yield s, k
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (following, s, k + 1))
    rest = {s: n for s, n in blocks.items() if s not in whole}
    if rest:
        yield from schedule(rest, dict.fromkeys(rest, 1))


def period_slots(share: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source within one period in which each has as many blocks as its share."""
    slots: dict[str, list[int]] = {s: [] for s in share}
    for slot, (s, _) in enumerate(schedule(share, share)):
        slots[s].append(slot)
    return slots


def planned(spark: SparkSession, counts: Mapping[str, int], weights: Mapping[str, float], block_rows: int) -> DataFrame:
    """Rows (mix_group, _part, _places): slot and first position of up to ``PART`` blocks of a source, in order."""
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    kind = "mix_group string, block bigint, slot bigint, start bigint"
    plan, start, rows = None, 0, []
    total = sum(blocks.values())
    for slot, (s, k) in enumerate(schedule(blocks, weights)):
        rows.append((s, k, slot, start))
        start += min(block_rows, counts[s] - k * block_rows)  # the last block of a source may be short
        if len(rows) == CHUNK or slot + 1 == total:
            columns = [pa.array(c) for c in zip(*rows)]
            piece = stored(spark.createDataFrame(pa.table(columns, names=["mix_group", "block", "slot", "start"]), kind), "mixing-plan")
            plan, rows = piece if plan is None else plan.unionByName(piece), []
    if plan is None:
        plan = spark.createDataFrame([], kind)
    part = F.floor(F.col("block") / PART).alias("_part")
    places = F.array_sort(F.collect_list(F.struct("block", "slot", "start"))).alias("_places")
    plan = plan.groupBy("mix_group", part).agg(places)
    return F.broadcast(plan) if total <= BROADCAST else plan


def softened(counts: Mapping[str, int], power: float) -> dict[str, float]:
    """Weights between natural (power 1) and equal (power 0)."""
    return {s: n**power for s, n in counts.items()}


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    source: str = "source",
    block_rows: int = 64,
    power: float = 0.7,
    max_sources: int | None = None,
) -> DataFrame:
    """Per row: ``_doc`` (the whole row), ``mix_group``, ``block``, ``slot`` and ``position`` (from 0, over all rows).

    ``weights`` by source name, null's under ""; every source needs one. None: softened document counts.
    """
    if weights is not None and not all(0 <= w < math.inf for w in weights.values()):
        raise ValueError("weights are finite and not below zero")
    spark = docs.sparkSession
    # The text is a column of its own, so that sorting by it needs no second copy.
    rest = F.struct(*(docs[c] for c in docs.columns if c.lower() != "text")).alias("_rest")
    rows = docs.select(rest, docs["text"].alias("_text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_group"))
    counted = rows.groupBy("mix_group").agg(F.count(F.lit(1)).alias("n"))
    if weights is None and max_sources and len(counted.limit(max_sources + 1).take(max_sources + 1)) > max_sources:
        folded = F.pmod(F.xxhash64("mix_group"), F.lit(max_sources)).cast("string")
        rows = rows.withColumn("mix_group", folded)
        counted = rows.groupBy("mix_group").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["mix_group"]: r["n"] for r in counted.collect()}  # one row per source
    if weights is not None and not counts.keys() <= weights.keys():
        raise ValueError("a source of the documents has no weight")
    weights = weights or softened(counts, power)
    sizes = F.broadcast(spark.createDataFrame([(s, max(1, -(-n // SLICE_ROWS))) for s, n in counts.items()], "mix_group string, _slices bigint"))
    plan = planned(spark, counts, weights, block_rows).withColumnRenamed("mix_group", "_group")
    rows = rows.join(sizes, "mix_group").withColumn("_order", F.xxhash64(F.lit(SEED), F.col("_rest.doc_id")))
    slice_of = F.floor(F.shiftrightunsigned("_order", 33) * F.col("_slices") / F.lit(1 << 31))
    ranked = bucketed_rank(rows, ["mix_group"], slice_of, ["_order", "_rest.doc_id", "_text"], rank="_rank")
    ranked = ranked.withColumn("_at", F.col("_rank") - 1).withColumn("block", F.floor(F.col("_at") / block_rows))
    placed = ranked.join(plan, (F.col("mix_group") == F.col("_group")) & (F.floor(F.col("block") / PART) == F.col("_part")))
    placed = placed.withColumn("_place", F.get("_places", F.pmod("block", F.lit(PART)).cast("int")))
    position = F.col("_place.start") + F.pmod("_at", F.lit(block_rows))
    doc = F.struct(*((F.col("_text") if c.lower() == "text" else F.col("_rest").getField(c)).alias(c) for c in docs.columns))
    return placed.select(doc.alias("_doc"), "mix_group", F.col("block").cast("bigint").alias("block"), F.col("_place.slot").alias("slot"), position.cast("bigint").alias("position"))


def arrange(docs: DataFrame, **options) -> DataFrame:
    """The documents in mixed order, sorted over all partitions; columns as before."""
    return mix(docs, **options).orderBy("position").select("_doc.*")


def window_error(mixed: DataFrame, weights: Mapping[str, float]) -> Column:
    """How far a row's block number is from its source's ideal ``weight x slot``, while all sources last."""
    total = sum(weights.values())
    ideal = F.lit(0.0)
    for s, w in weights.items():
        ideal = F.when(mixed["mix_group"] == s, F.lit(w / total)).otherwise(ideal)
    return mixed["block"] - ideal * mixed["slot"]
