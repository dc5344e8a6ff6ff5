"""Mixing against the given weights."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from decoylens.llm import mixing


@pytest.mark.parametrize("n", [20, 100, 256])
def test_no_source_drifts_from_its_weight(n):
    weights = {"big": 0.5, **{f"s{i}": 0.5 / (n - 1) for i in range(n - 1)}}
    total = sum(map(Fraction, weights.values()))
    done, slots = dict.fromkeys(weights, 0), 20_000
    blocks = {s: int(slots * w) + 100 for s, w in weights.items()}
    for t, (s, k) in zip(range(1, slots + 1), mixing.schedule(blocks, weights)):
        assert k == done[s]
        done[s] += 1
        if t % 37 == 0:
            assert all(abs(done[x] - Fraction(weights[x]) / total * t) < 1 for x in ("big", "s0", s))
    assert all(abs(done[x] - Fraction(w) / total * slots) < 1 for x, w in weights.items())
    assert abs(mixing.shares(weights, 1000)["big"] - 500) <= 1


def test_sources_that_end_leave_their_part_to_the_others():
    rng = random.Random(3)
    for _ in range(20):
        weights = {f"s{i}": rng.choice([rng.random(), 1.0, 1e-6]) for i in range(rng.randrange(1, 12))}
        blocks = {s: rng.randrange(1, 60) for s in weights}
        ideal, done, exact = dict.fromkeys(weights, Fraction(0)), dict.fromkeys(weights, 0), {s: Fraction(w) for s, w in weights.items()}
        order = list(mixing.schedule(blocks, weights))
        assert sorted(order) == sorted((s, k) for s, n in blocks.items() for k in range(n))
        for s, _ in order:
            done[s] += 1
            room = Fraction(1)
            while room:
                left = [x for x in weights if ideal[x] < blocks[x]]
                rate = sum(exact[x] for x in left)
                step = min(room, *((blocks[x] - ideal[x]) * rate / exact[x] for x in left))
                for x in left:
                    ideal[x] += step * exact[x] / rate
                room -= step
            assert all(abs(done[x] - ideal[x]) < 1 for x in weights)


def test_plan_in_pieces(spark, monkeypatch):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.concat(F.lit("s"), F.pmod("id", F.lit(7))).alias("source"))
    whole = sorted(tuple(r) for r in mixing.mix(docs, block_rows=4).drop("_doc").collect())
    for name, value in (("PART", 8), ("CHUNK", 50), ("BROADCAST", 0)):
        monkeypatch.setattr(mixing, name, value)
    assert sorted(tuple(r) for r in mixing.mix(docs, block_rows=4).drop("_doc").collect()) == whole
    assert sorted(r[3] for r in whole) == list(range(900))


def test_window_error_is_below_one_block(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("s"), F.pmod("id", F.lit(20))).alias("source"))
    weights = {f"s{i}": 1.0 if i else 19.0 for i in range(20)}
    mixed = mixing.mix(docs, weights, block_rows=1).filter("slot < 390")
    assert mixed.select(F.max(F.abs(mixing.window_error(mixed, weights)))).first()[0] < 1


def test_sources_without_weight_come_last():
    order = [s for s, _ in mixing.schedule({"a": 3, "b": 2, "c": 2}, {"a": 0, "b": 1.0, "c": 0.5})]
    assert order[4:] == ["a"] * 3


@pytest.mark.parametrize("given", [False, True])
def test_each_of_many_sources_keeps_its_own_weight(spark, given):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 1500, "big").otherwise(F.concat(F.lit("s"), F.pmod("id", F.lit(300)))).alias("source"))
    weights = {"big": 300.0, **{f"s{i}": 1.0 for i in range(300)}} if given else None
    rows = mixing.mix(docs, weights, block_rows=1).select("_doc.source", "mix_group", "slot", "block", "position").collect()
    assert all(r["source"] == r["mix_group"] for r in rows) and len({r["mix_group"] for r in rows}) == 301
    assert sorted(r["position"] for r in rows) == list(range(3000))
    w = weights or mixing.softened({"big": 1500, **{f"s{i}": 5 for i in range(300)}}, 0.7)
    part = w["big"] / sum(w.values())
    first = sorted(r["slot"] for r in rows if r["mix_group"] == "big")
    assert all(abs(k - part * (slot + 1)) < 2 for k, slot in enumerate(first[:100]))


def test_one_source_is_dealt_in_many_slices_without_a_second_copy_of_its_texts(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(docs, block_rows=64)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "_doc.text" not in plan and "_rest.text" not in plan
    assert mixing.SLICE_ROWS <= 2000
    assert sorted(r[0] for r in mixed.select("position").collect()) == list(range(20_000))


def test_columns_keep_their_order_and_ties_are_broken_by_text(spark):
    docs = spark.createDataFrame([("b", 1, "s"), ("a", 1, "s"), (None, 1, "s"), ("c", None, None)], "text string, doc_id long, source string")
    found = mixing.mix(docs, block_rows=1)
    assert found.schema["_doc"].dataType.names == ["text", "doc_id", "source"]
    rows = sorted((r["mix_group"], r["block"], r["_doc"]["text"]) for r in found.collect())
    assert rows == [("", 0, "c"), ("s", 0, None), ("s", 1, "a"), ("s", 2, "b")]
