"""Skew-safe ordered operators against plain single-window results, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from decoylens.operators import ordered as O, rollups as R, sampling


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        data.append((key, i, rng.choice([0.0, rng.uniform(0, 4e5), float(rng.randrange(0, 4000) * 100)])))
    return spark.createDataFrame(data, "src_ip string, id bigint, s double").withColumn(
        "timestamp", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint"))
    ).cache()


def whole_key():
    return Window.partitionBy("src_ip").orderBy("timestamp", "id")


def _set(df):
    return sorted(tuple(r) for r in df.collect())


def test_bucketed_rank(rows):
    plain = rows.select("id", F.row_number().over(whole_key()).alias("r"), F.count("*").over(Window.partitionBy("src_ip")).alias("n"))
    for width in (60, 3600, 10**7):
        ranked = O.bucketed_rank(rows, ["src_ip"], O.time_slice("timestamp", width), ["timestamp", "id"], "r", "n")
        assert _set(ranked.select("id", "r", "n")) == _set(plain)


def test_first_n_and_group_limit(rows):
    plain = rows.withColumn("rank", F.row_number().over(whole_key())).filter("rank <= 7").select("id", "rank")
    first = O.first_n(rows, ["src_ip"], ["timestamp", "id"], 7, "id")
    assert _set(first.select("id", "rank")) == _set(plain)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2, "both passes must limit groups before their shuffle"


def test_gaps(rows):
    us = F.unix_micros("timestamp")
    plain = rows.select("src_ip", "id", ((us - F.lag(us).over(whole_key())) / 1e6).alias("gap"))
    got = {r[0]: r[1] for r in O.gap_seconds(rows, "src_ip", "timestamp", "id").select("id", "gap").collect()}
    assert got == {r[1]: r[2] for r in plain.collect()}
    kept = F.when((F.col("gap") > 0) & (F.col("gap") < 86400), F.col("gap"))
    means = {r[0]: r[1] or 0.0 for r in plain.groupBy("src_ip").agg(F.avg(kept)).collect()}
    for key, value in O.mean_gap(rows, "src_ip", "timestamp").collect():
        assert value == pytest.approx(means[key], rel=1e-9), key


def test_mean_gap_drops_zero_and_long_gaps(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 10), ("a", 100000), ("b", 5)], "src_ip string, s bigint")
    got = dict(O.mean_gap(df.withColumn("timestamp", F.timestamp_seconds("s")), "src_ip", "timestamp").collect())
    assert got == {"a": 10.0, "b": 0.0}


def test_first_fraction(rows):
    counted = rows.withColumn("rank", F.row_number().over(whole_key())).withColumn("n", F.count("*").over(Window.partitionBy("src_ip")))
    plain = counted.filter("rank <= greatest(3, floor(n * 0.3D))").select("id")
    assert _set(O.first_fraction(rows, "src_ip", "timestamp", "id").select("id")) == _set(plain)


@pytest.fixture(scope="module")
def flood(spark):
    """One key with all its rows in one hour: spread over it, within one second, and at one microsecond."""
    rng = random.Random(11)
    data = [("hot", i, 7200 * 10**6 + u) for i, u in enumerate([rng.randrange(3600 * 10**6) for _ in range(400)] + [rng.randrange(10**6) for _ in range(600)] + [5] * 700)]
    rng.shuffle(data)
    data += [(f"k{i % 5}", 5000 + i, rng.randrange(10**11)) for i in range(200)]
    return spark.createDataFrame(data, "src_ip string, id bigint, us bigint").withColumn("timestamp", F.timestamp_micros("us")).cache()


@pytest.mark.parametrize("target", [50, 300])
def test_a_flood_is_cut_into_pieces(flood, monkeypatch, target):
    monkeypatch.setattr(O, "SLICE_ROWS", target)
    monkeypatch.setattr(O, "TIE_BLOCK", 16)
    cut = O.with_time_buckets(flood, "src_ip", "timestamp", "id")
    assert cut.columns == [*flood.columns, "_bucket"]
    assert cut.groupBy("src_ip", "_bucket").count().agg(F.max("count")).first()[0] <= 2 * target + 16
    plain, mine = whole_key(), Window.partitionBy("src_ip").orderBy("_bucket", "timestamp", "id")
    assert cut.filter(F.lit(True)).select(F.row_number().over(plain).alias("a"), F.row_number().over(mine).alias("b")).filter("a <> b").count() == 0
    us = F.unix_micros("timestamp")
    gaps = O.gap_seconds(flood, "src_ip", "timestamp", "id")
    assert _set(gaps.select("id", "gap").fillna(-1.0)) == _set(flood.select("id", ((us - F.lag(us).over(plain)) / 1e6).alias("gap")).fillna(-1.0))
    counted = flood.withColumn("rank", F.row_number().over(plain)).withColumn("n", F.count("*").over(Window.partitionBy("src_ip")))
    kept = O.first_fraction(flood, "src_ip", "timestamp", "id").select("id", "rank")
    assert _set(kept) == _set(counted.filter("rank <= greatest(3, floor(n * 0.3D))").select("id", "rank"))


def test_slices_below_the_target_are_left_alone(rows):
    cut = O.with_time_buckets(rows, "src_ip", "timestamp", "id")
    assert cut.select("_bucket.piece", "_bucket.part").distinct().collect() == [(0, 0)]


def test_centred_mean(spark):
    days = spark.createDataFrame([(i, float(i)) for i in range(1, 10)], "d int, v double")
    got = [r[0] for r in O.centred_mean(days, "v", "d", 3, "m").orderBy("d").select("m").collect()]
    assert got == [None] * 3 + [4.0, 5.0, 6.0] + [None] * 3


def test_medians_are_exact(spark):
    rng = random.Random(3)
    data = [("a", float(rng.randrange(50))) for _ in range(6001)] + [("b", rng.gauss(0, 1)) for _ in range(6002)]
    data += [("c", 4.0), ("d", 1.0), ("d", 2.0), ("e", None), ("f", 1.0), ("f", 5.0), ("f", 9.0), ("f", 9.0)]
    df = spark.createDataFrame(data, "g string, v double")
    plain = dict(df.filter("v is not null").groupBy("g").agg(F.percentile("v", 0.5)).collect())
    assert dict(O.group_medians(df, ["g"], "v").collect()) == plain


def test_sample_is_exact_and_repeatable(rows):
    once = _set(sampling.sample_rows(rows, "id", 100).select("id"))
    again = _set(sampling.sample_rows(rows.repartition(5).orderBy(F.desc("s")), "id", 100).select("id"))
    assert len(once) == 100 and once == again
    assert sampling.sample_rows(rows, "id", 10**6).count() == 3000


def test_split_and_folds(spark):
    data = [(f"x{i}", "a") for i in range(101)] + [(f"y{i}", "b") for i in range(10)] + [("z", "c")]
    df = spark.createDataFrame(data, "src_ip string, label string")
    split = sampling.stratified_split(df, "label", "src_ip")
    assert dict(split.groupBy("label").agg(F.sum("is_test")).collect()) == {"a": 20, "b": 2, "c": 0}
    assert split.count() == len(data)
    sizes = sampling.stratified_folds(df, "label", "src_ip").groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in sizes if r.label == "a") == [20, 20, 20, 20, 21]
    assert {r["count"] for r in sizes if r.label == "b"} == {2}


def test_rollup_details(spark):
    df = spark.createDataFrame([("a",)] * 990 + [("b",)] * 10 + [("c",)] * 9 + [(None,)], "p string")
    assert dict(R.fold_rare(df, "p").collect()) == {"a": 990, "Other": 19}
    assert [tuple(r) for r in R.value_counts(df, "p", 2).collect()] == [("a", 990), ("b", 10)]
    hist = R.histogram(spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "v double"), "v", [], bins=10)
    assert dict(hist.collect()) == {1: 1, 2: 1, 10: 1}
    flat = R.histogram(spark.createDataFrame([("g", 2.0), ("g", 2.0)], "k string, v double"), "v", ["k"])
    assert [tuple(r) for r in flat.collect()] == [("g", 1, 2)]
