import math

import pytest
from pyspark.sql import functions as F

from decoylens.functions import rules, scalars as S
from decoylens.functions.entropy import entropy_of_counts, list_entropy, shannon_entropy
from decoylens.functions.vocabulary import STATE_CODES, lookup


@pytest.mark.parametrize(
    "text, bits", [("", 0.0), (None, 0.0), ("aaaa", 0.0), ("aab", 0.918296), ("şifre1", 2.584963), ("a.b|c$", 2.584963), ("😀a😀b", 1.5)]
)
def test_string_entropy(spark, text, bits):
    row = spark.createDataFrame([(text,)], "s string").select(shannon_entropy("s")).first()
    assert row[0] == pytest.approx(bits, abs=1e-6)
    assert math.copysign(1, row[0]) == 1


def test_list_and_count_entropy(spark):
    df = spark.createDataFrame([([1, 1, 2],), ([],), (None,)], "a array<int>")
    assert [round(r[0], 6) for r in df.select(list_entropy("a")).collect()] == [0.918296, 0.0, 0.0]
    counts = spark.createDataFrame([("k", 2), ("k", 1), ("k", 0), ("e", 0)], "g string, c bigint")
    got = {r[0]: round(r[1], 6) for r in counts.groupBy("g").agg(entropy_of_counts(F.col("c"))).collect()}
    assert got == {"k": 0.918296, "e": 0.0}


def test_counters_and_addresses(spark):
    df = spark.createDataFrame([("5", "1.2.3.4"), ("3000000000", "10.0.0.1"), ("x", "172.20.0.1"), (None, "hash"), ("7.9", "::1")], "n string, ip string")
    rows = df.select(S.as_count(F.col("n")), S.address_number("ip"), S.is_private("ip"), S.is_private("ip", rfc1918=True)).collect()
    assert [r[0] for r in rows] == [5, 3_000_000_000, 0, 0, 7]
    assert [r[1] for r in rows] == [16909060, 167772161, 2886991873, None, None]
    assert [r[2] for r in rows] == [False, True, False, False, False]
    assert [r[3] for r in rows] == [False, True, True, False, False]


def test_guards(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.5,)], "x double")
    assert [r[0] for r in df.select(S.finite(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 2.5]
    one = spark.range(1)
    assert one.select(S.per(F.lit(6), F.lit(0)), S.clamp(F.lit(99.0), 5, 30), S.has_part(F.lit(None).cast("string"), "login")).first()[:] == (6.0, 30.0, False)
    assert one.select(lookup(STATE_CODES, F.lit("REJ"), 12), lookup(STATE_CODES, F.lit("?"), 12)).first()[:] == (3, 12)


def test_time_columns(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in S.time_columns(S.from_epoch(F.lit(1712016000.25))).items()]).first()
    assert (str(row.date), row.hour, row.day_of_week, row.timestamp.microsecond) == ("2024-04-02", 0, "Tuesday", 250000)


def _rule(spark, column):
    return spark.range(1).select(column).first()[0]


def test_rules(spark):
    v = F.lit
    assert _rule(spark, rules.session_actor(v(3), v(0), v(0), v(11.0), v(0.1))) == "Manual"
    assert _rule(spark, rules.session_actor(v(0), v(4), v(0), v(11.0), v(0.5))) == "Bot"
    assert _rule(spark, rules.flow_actor(v(0.49), v(1))) == "Bot"
    assert _rule(spark, rules.flow_actor(v(0.5), v(1))) == "Manual"
    assert _rule(spark, rules.threat_level(v(1), v(0), v(1), v(10), v(0.0))) == "High"
    assert _rule(spark, rules.threat_level(v(0), v(0), v(2), v(10), v(0.0))) == "Medium"
    assert _rule(spark, rules.threat_level(v(0), v(1), v(0), v(51), v(5.1))) == "Medium"
    assert _rule(spark, rules.threat_level(v(1), v(1), v(0), v(50), v(9.0))) == "Low"
    assert _rule(spark, rules.flow_behaviour(v(21), v(501))) == "Aggressive"
    assert _rule(spark, rules.flow_behaviour(v(21), v(500))) == "Recon"
    assert _rule(spark, rules.flow_behaviour(v(5), v(11))) == "Targeted"
    assert _rule(spark, rules.flow_behaviour(v(5), v(10))) == "Recon"
    assert _rule(spark, rules.window_threat(v(0), v(0), v(1))) == "Medium"
