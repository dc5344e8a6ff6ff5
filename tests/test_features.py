"""Feature tables: row order must not matter, edge cases have fixed answers."""

import ipaddress
import random

from pyspark.sql import functions as F

import harness
from decoylens.functions import scalars as S
from decoylens.operators import features as FT, geo as G, sampling, sequences as SQ
from decoylens.plans import adapters as A

SF = f"{harness.DATA}/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_row_order_does_not_matter(spark):
    events = A.attack_events(spark, SF)
    mixed = events.orderBy(F.xxhash64("event_id")).repartition(3)
    doubles = lambda df: df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})
    for build in (FT.session_features, FT.early_sessions, lambda e: FT.session_windows(e, (3, 5))):
        assert _rows(doubles(build(events))) == _rows(doubles(build(mixed)))


def test_login_cap_is_optional(spark):
    logins = FT.logins_of(A.attack_events(spark, SF))
    assert _rows(FT.login_gaps(logins, max_logins=500)) == _rows(FT.login_gaps(logins))
    assert _rows(FT.login_gaps(logins, max_logins=3)) != _rows(FT.login_gaps(logins))


def test_address_with_bare_events(spark):
    """No password, no session, no duration: every feature still has a value."""
    base = spark.createDataFrame(
        [("9.9.9.9", i, "cowrie.login.failed", None, None, None) for i in range(5)],
        "src_ip string, event_id bigint, eventid string, username string, password string, duration double",
    )
    events = base.withColumn("timestamp", F.timestamp_seconds("event_id")).withColumn("hour", F.hour("timestamp"))
    row = FT.session_features(events).first()
    assert (row.total_attempts, row.unique_passwords, row.unique_combos, row.password_reuse_ratio) == (5, 0, 0, 5.0)
    assert (row.avg_time_between, row.hour_entropy, row.duration_mean, row.has_file_download) == (1.0, 0.0, 0.0, 0)
    assert FT.session_features(events.limit(4)).count() == 0


def test_merge_counts_common_addresses(spark):
    sessions = spark.createDataFrame([(str(i), i) for i in range(10)], "src_ip string, n int")
    flows = spark.createDataFrame([(str(i), i) for i in range(5)], "src_ip string, n int")
    merged, common = FT.merge_features(sessions, flows)
    assert merged.columns == ["src_ip", "n", "n_ctu"] and merged.count() == 10 and common.first()["n_common"] == 5
    assert FT.merge_features(sessions, flows.limit(0))[0].columns == merged.columns


def test_numeric_features(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 3, "x")], "src_ip string, early_n int, rate double, _ref int, label string")
    assert FT.numeric_features(df) == ["early_n", "rate"]
    assert FT.numeric_features(df, prefix="early_") == ["early_n"]


def test_lookup_tiers_and_private(spark):
    defaults = {k: v for k, v in G.GEO_DEFAULTS.items()}
    row = lambda ip, code: (ip, *[code if k == "country_code" else v for k, v in defaults.items()])
    schema = "src_ip string, country_code string, country_name string, city string, latitude double, longitude double, continent_code string, continent_name string, region string, accuracy_radius_km int"
    first = spark.createDataFrame([row("1.1.1.1", "AA"), row("2.2.2.2", "XX")], schema)
    second = spark.createDataFrame([row("2.2.2.2", "BB"), row("1.1.1.1", "ZZ")], schema)
    seen = []

    def tier(table):
        def look_up(addresses):
            seen.append(sorted(r[0] for r in addresses.collect()))
            return addresses.join(table, "src_ip")
        return look_up

    ips = spark.createDataFrame([("1.1.1.1",), ("2.2.2.2",), ("3.3.3.3",), ("10.0.0.9",), ("1.1.1.1",)], "src_ip string")
    got = {r.src_ip: (r.country_code, r.tier) for r in G.lookup_tiers(ips, [tier(first), tier(second)]).collect()}
    assert got == {"1.1.1.1": ("AA", "tier1"), "2.2.2.2": ("BB", "tier2"), "3.3.3.3": ("XX", "default"), "10.0.0.9": ("--", "private")}
    assert seen == [["1.1.1.1", "2.2.2.2", "3.3.3.3"], ["2.2.2.2", "3.3.3.3"]]


def test_raw_rows_are_not_parsed_in_the_lookup(spark):
    flows = A.flows(spark, SF)
    plan = G.block_lookup(flows, A.geo_blocks(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    scan = plan[plan.index("l_partkey"):]
    assert "isnotnull(shiftright" not in scan.lower()


def test_sequence_padding_and_zscore(spark):
    steps = spark.createDataFrame([("a", 1, [1.0, 5.0]), ("a", 2, [3.0, 5.0]), ("b", 1, [2.0, 5.0])], "src_ip string, rank int, vec array<double>")
    seq = SQ.pad_sequences(steps, 3, 2)
    got = {r.src_ip: (r.n_steps, r.seq) for r in seq.collect()}
    assert got["a"] == (2, [[0.0, 0.0], [1.0, 5.0], [3.0, 5.0]])
    assert got["b"] == (1, [[0.0, 0.0], [0.0, 0.0], [2.0, 5.0]])
    z = {r.src_ip: r.seq for r in SQ.standardise_sequences(seq, F.lit(True)).collect()}
    assert z["b"][:2] == [[0.0, 0.0], [0.0, 0.0]]
    assert round(z["a"][1][0], 4) == -1.2247 and round(z["a"][1][1], 4) == 0.0


def test_place_comes_from_a_column_or_a_lookup(spark):
    df = spark.createDataFrame([("1", 3, "EU"), ("2", 3, None), ("1", 4, "EU")], "src_ip string, hour int, geo_continent string")
    look_up = lambda a: a.distinct().select("src_ip", F.lit("AS").alias("continent_code"))
    by_column = G.counts_by_place(df, ("missing", "geo_continent"), ["hour"], look_up, "continent_code")
    assert _rows(by_column) == [("EU", 3, 1), ("EU", 4, 1)]
    by_address = G.counts_by_place(df, ("missing",), ["hour"], look_up, "continent_code").groupBy("continent_code").agg(F.sum("weight").alias("n"))
    assert _rows(by_address) == [("AS", 3)]


def test_more_rows_never_lose_rows(spark):
    """No cap hides in the early table, the weighted points or the repeats."""
    events = spark.createDataFrame(
        [("1.1.1.1", i, "cowrie.login.failed", f"u{i}", f"p{i}", None) for i in range(1000)],
        "src_ip string, event_id bigint, eventid string, username string, password string, duration double",
    ).withColumn("timestamp", F.timestamp_seconds("event_id")).withColumn("hour", F.hour("timestamp"))
    row = FT.early_sessions(events).first()
    assert (row.early_attempt_count, row.early_unique_passwords, row.early_unique_users) == (300, 300, 300)
    assert FT.early_sessions(events, history=200).first().early_attempt_count == 60
    counts = spark.createDataFrame([("a", h % 24, 1.0 + h % 50, 2.0, 1000) for h in range(5000)], "src_ip string, hour int, latitude double, longitude double, weight long")
    points = G.hourly_points(counts)
    assert points.agg(F.sum("weight")).first()[0] == 5_000_000 and G.hourly_points(counts, limit=3).count() == 72
    assert sampling.repeat_by_weight(counts.limit(1), "weight").count() == 1000


def test_private_and_odd_addresses_resolve(spark):
    schema = "start_ip long, end_ip long, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in G.GEO_DEFAULTS.items())
    blocks = spark.createDataFrame([(0, 2**32, *[{"country_code": "C1"}.get(k, v) for k, v in G.GEO_DEFAULTS.items()])], schema)
    addresses = spark.createDataFrame([("10.1.2.3",), ("192.168.1.1",), ("8.8.8.8",), ("8.8.8.256",), ("x",)], "src_ip string")
    codes = {r.src_ip: (r.country_code, r.country_name) for r in G.resolve(addresses, blocks).collect()}
    assert codes["10.1.2.3"] == codes["192.168.1.1"] == ("--", "Private")
    assert codes["8.8.8.8"][0] == "C1" and codes["8.8.8.256"][0] == codes["x"][0] == "XX"


SIX = [
    "::", "::1", "2001:db8::1", "2001:DB8:0:0:1::f", "1:2:3:4:5:6:7:8", "fe80::", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1.2.3.4", "255.255.255.255",
    "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::1", ":::", "", "1.2.3", "1.2.3.256", "::1.2.3.300", "1:2:3:4:5:6:7::8", "fe80::1%eth0", " ::1", "::1.2.3.4:5",
]


def test_addresses_as_bits(spark):
    def expected(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        return f"{int(a) + (0xFFFF << 32 if a.version == 4 else 0):032x}"

    rng = random.Random(2)
    texts = SIX + [str(ipaddress.ip_address(rng.getrandbits(128) & rng.getrandbits(128) << rng.choice([0, 16, 64]))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    # Eight groups next to a double colon are no address to Python before 3.13; here a double colon stands for one group at least.
    got = {r.a: r.h for r in df.select("a", S.address_hex("a").alias("h")).collect()}
    assert {t: h for t, h in got.items() if t not in ("fe80::1%eth0", "1:2:3:4:5:6:7::8")} == {t: expected(t) for t in got if t not in ("fe80::1%eth0", "1:2:3:4:5:6:7::8")}
    assert got["fe80::1%eth0"] is None


def test_the_longest_network_stands(spark):
    rng = random.Random(3)
    nets = {str(ipaddress.ip_network((rng.getrandbits(24) << 104, n), strict=False)): n for n in [0, 3, 5, 7, 8, 9, 13, 16, 21, 24] for _ in range(6)}
    nets |= {"10.0.0.0/7": 103, "11.5.0.0/17": 113, "11.5.64.0/23": 119, "2001:db8:1::/130": 0, "nonsense/8": 0}
    networks = spark.createDataFrame([(n, n) for n in nets], "network string, code string")
    texts = [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(200)] + ["11.5.65.1", "11.5.1.1", "11.6.1.1", "12.1.1.1", "x"]

    def longest(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        own = [ipaddress.ip_network(n) for n in nets if n not in ("2001:db8:1::/130", "nonsense/8")]
        own = [n for n in own if n.version == a.version and a in n]
        return str(max(own, key=lambda n: n.prefixlen)) if own else None

    rows = G.network_lookup(spark.createDataFrame([(t,) for t in texts], "src_ip string"), networks, how="left").collect()
    assert {r.src_ip: r.code for r in rows} == {t: longest(t) for t in texts}
    assert G.network_lookup(spark.createDataFrame([("::1",)], "src_ip string"), networks.limit(0), how="left").collect() == [("::1", None)]


def test_a_country_is_the_rows_own_or_the_addresss(spark):
    countries = spark.createDataFrame([("TR", "TUR", "Turkey"), ("DE", "DEU", "Germany")], "code2 string, code3 string, name string")
    rows = [("a", " tur", 1), ("a", "DE", 1), ("a", None, 1), ("a", "germany", 2), ("b", "QQQ", 1), ("b", None, 1), ("c", None, 1), (None, "TUR", 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "src_ip string, geo_country_code string, hour int")
    asked = []

    def look_up(addresses):
        asked.extend(sorted({r[0] for r in addresses.collect()}, key=str))
        return spark.createDataFrame([("a", "DE"), ("b", "FR"), ("c", "XX")], "src_ip string, country_code string")

    counts = G.counts_by_country(df, ["hour"], countries, look_up).groupBy("country_code", "origin", "hour").agg(F.sum("weight").alias("n"))
    assert sorted(map(tuple, counts.select("country_code", "origin", "hour", "n").collect())) == sorted([("TR", "own", 1, 2), ("DE", "own", 1, 1), ("DE", "address", 1, 1), ("DE", "own", 2, 1), ("FR", "address", 1, 2), ("XX", "unknown", 1, 2)])
    assert set(asked) == {None, "a", "b", "c"}
    assert G.with_country(df, countries, look_up).count() == len(rows)
