import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from decoylens.sources import logs as L, tables as T


def _flow(**extra):
    return json.dumps({"ts": 1711929600.5, "id.orig_h": "1.2.3.4", "id.orig_p": 5, "id.resp_h": "9.9.9.9", "id.resp_p": 22, "proto": "tcp", **extra})


@pytest.mark.parametrize("packed", [False, True])
def test_flow_logs(spark, tmp_path, packed):
    cut = _flow(orig_bytes=1)[:-5]
    text = "\n".join([_flow(orig_bytes=7), "", "#comment", cut, _flow(), _flow(orig_bytes=3_000_000_000), _flow(orig_bytes="-", duration="1.5")]) + "\n"
    name = tmp_path / ("conn.2024-04-01.log" + (".gz" if packed else ""))
    name.write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    flows, rejected = L.read_flow_logs(spark, str(tmp_path))
    assert sorted(r.orig_bytes for r in flows.collect()) == [0, 0, 7, 3_000_000_000]
    assert rejected.count() == 3  # the blank line, too
    (tmp_path / "dns.2024-04-01.log").write_text(_flow() + "\n")
    (tmp_path / "conn.2024-04-02.log").write_text("  " + _flow(orig_bytes=9) + " \n")
    flows, rejected = L.read_flow_logs(spark, str(tmp_path))
    assert sorted(r.orig_bytes for r in flows.collect()) == [0, 0, 7, 9, 3_000_000_000] and rejected.count() == 3
    row = flows.filter("orig_bytes = 7").first()
    assert (row.src_ip, row.dst_port, row.hour, row.day_of_week, str(row.date)) == ("1.2.3.4", 22, 0, "Monday", "2024-04-01")
    both = L.type_flows(L.parse_flow_lines(spark.read.text(str(tmp_path))), keep_skipped=True)
    assert dict(both.groupBy("ok").count().collect()) == {True: 6, False: 3}


def test_file_selection(spark, tmp_path):
    for sensor, day, name in [("s1", "d1", "conn.1.log"), ("s1", "d2", "conn.2.log.gz"), ("s1", "d3", "conn.3.log"), ("s2", "d2", "dns.2.log"), ("s2", "d9", "x.json")]:
        folder = tmp_path / sensor / day
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("{}")
    chosen = L.first_days(L.list_files(spark, str(tmp_path)), 2).collect()
    assert sorted((r.sensor, r.day) for r in chosen) == [("s1", "d1"), ("s1", "d2"), ("s2", "d9")]


def test_session_logs(spark, tmp_path):
    event = lambda **e: {"eventid": "cowrie.login.failed", "timestamp": "2019-05-01T10:00:00.000000Z", "src_ip_identifier": "h1", **e}
    good = [
        {"s1": [event(geolocation_data={"country_code3": "TUR", "location": {"lat": 1.5, "lon": 2.5}}), event(eventid="cowrie.client.version")]},
        {"s2": [event(src_ip="own", geolocation_data={"latitude": 3.0, "longitude": 4.0}), event(duration=2.5, eventid="cowrie.session.closed")]},
        {"note": "not a list"},
    ]
    (tmp_path / "sessions_2019-05-01.json").write_text(json.dumps(good))
    (tmp_path / "sessions_2019-05-02.json").write_text(json.dumps(good)[:-9])
    events, rejected = L.read_session_logs(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in rejected.collect()] == ["sessions_2019-05-02.json"]
    assert events.count() == 4 + 4  # the cut file lost its last member only
    events, rejected = L.read_session_logs(spark, str(tmp_path / "sessions_2019-05-01.json"))
    events = L.allow_listed(events)
    got = sorted((r.session, r.src_ip, r.geo_country_code, r.geo_latitude, r.geo_longitude, r.duration) for r in events.fillna("-", ["geo_country_code"]).collect() if r.geo_latitude)
    assert got == [("s1", "h1", "TUR", 1.5, 2.5, None), ("s2", "own", "-", 3.0, 4.0, None)]
    assert events.count() == 3 and rejected.count() == 0


SIGNS = ["}", "{", "[", "]", '"', "\\", "\\\\", '\\"', ",", "é", "漢", "\n", "a", "b:", " "]


def _sessions(rng, n):
    """Session objects whose strings hold brackets, quotes and backslashes, next to members of other shapes."""
    word = lambda: "".join(rng.choices(SIGNS, k=rng.randrange(12)))
    event = lambda i: {"eventid": "cowrie.login.failed", "username": f"{i}", "password": word(), "geolocation_data": {"country_name": word(), "location": {"lat": 1.5, "lon": i}}, "extra": [[word()], {word(): {}}]}
    members = []
    for i in range(n):
        members += rng.choice([[], [], [], [{"note": word()}], [{}], [7, "x}{"], [[{"a": 1}]], [{"s": {"not": "a list"}}]])
        members.append({f"s{i}{word()}": [event(f"{i}-{j}") for j in range(rng.randrange(4))], f"t{i}": [event(f"{i}-t"), 3, None]})
    return members


def _events_of(members):
    lists = [(sid, e) for m in members if isinstance(m, dict) for sid, events in m.items() if isinstance(events, list) for e in events if isinstance(e, dict)]
    return sorted((sid, e["username"], e["password"], e["geolocation_data"]["country_name"]) for sid, e in lists)


@pytest.mark.parametrize("indent", [None, 1])
def test_session_files_are_read_in_ranges(spark, tmp_path, indent):
    rng = random.Random(17)
    whole = {f"sessions_{k}.json": _sessions(rng, n) for k, n in enumerate((0, 1, 40, 150))}
    for name, members in whole.items():
        (tmp_path / name).write_text(json.dumps(members, indent=indent, ensure_ascii=False), encoding="utf-8")
    with gzip.open(tmp_path / "sessions_9.json.gz", "wt", encoding="utf-8") as packed:
        json.dump(whole["sessions_2.json"], packed)
    expected = sorted(x for m in [*whole.values(), whole["sessions_2.json"]] for x in _events_of(m))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        pieces = L.session_pieces(spark, str(tmp_path))
        assert pieces.rdd.getNumPartitions() > 20 and pieces.select("path", "block").distinct().count() > 20
        events, cut = L.read_session_logs(spark, str(tmp_path))
        assert sorted(map(tuple, events.select("session", "username", "password", "geo_country_name").collect())) == expected
        assert cut.count() == 0
        text, members = (tmp_path / "sessions_3.json").read_text(encoding="utf-8"), whole["sessions_3.json"]
        folder = tmp_path / "cut"
        folder.mkdir()
        kept = {}
        for at in rng.sample(range(1, len(text) - 3), 12):
            (folder / f"c{at}.json").write_text(text[:at], encoding="utf-8")
            kept[at] = []
            for n in range(len(members), 0, -1):  # the members that are there in full
                start = json.dumps(members[:n], indent=indent, ensure_ascii=False).rstrip("]").rstrip("\n")
                if len(start) <= at:
                    kept[at] = members[:n]
                    break
        events, cut = L.read_session_logs(spark, str(folder))
        assert sorted(map(tuple, events.select("session", "username", "password", "geo_country_name").collect())) == sorted(x for m in kept.values() for x in _events_of(m))
        assert sorted(r.path.rsplit("/", 1)[1] for r in cut.collect()) == sorted(f"c{at}.json" for at in kept)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_days_of_each_sensor_are_read(spark, tmp_path):
    for sensor, day, port in [("s1", "d1", 1), ("s1", "d2", 2), ("s1", "d3", 4), ("s2", "d2", 8), ("s2", "d9", 16), ("s3", "d7", 32)]:
        folder = tmp_path / sensor / day
        folder.mkdir(parents=True)
        (folder / "conn.log.log").write_text(_flow(orig_bytes=port) + "\n")
        (folder / "x.json").write_text(json.dumps([{"s": [{"eventid": "e", "username": f"{port}"}]}]))
    flows, _ = L.read_flow_logs(spark, str(tmp_path), max_days=1)
    assert sorted(r.orig_bytes for r in flows.filter("orig_bytes > 0").collect()) == [1, 8, 32]
    events, cut = L.read_session_logs(spark, [r.path for r in L.list_files(spark, str(tmp_path)).filter("path LIKE '%.json'").collect()], max_days=2)
    assert sorted(int(r.username) for r in events.collect()) == [1, 2, 8, 16, 32] and cut.count() == 0
    with pytest.raises(ValueError):
        L.selected(spark, str(tmp_path / "s1" / "d1" / "x.json"), 0)


def test_reconcile(spark):
    a = spark.createDataFrame([(1,)], "x int").withColumn("y", F.lit(None))
    b = spark.createDataFrame([("7", 1.0), ("bad", 2.0)], "x string, z double")
    c = spark.createDataFrame([("t",)], "y string")
    table = T.reconcile([T.first_seen_types(a), b, c])
    assert table.dtypes == [("x", "int"), ("y", "string"), ("z", "double")]
    assert sorted(tuple(r) for r in table.fillna(-1).fillna("-").collect()) == [(-1, "-", 2.0), (-1, "t", -1.0), (1, "-", -1.0), (7, "-", 1.0)]


def test_materialize_builds_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return spark.range(5).withColumn("d", F.col("id") % 2)

    assert T.materialize(spark, path, build, ["d"]).count() == 5
    assert T.materialize(spark, path, build, ["d"]).count() == 5
    assert calls == [1]


def test_csv_and_labels(spark, tmp_path):
    source, target = str(tmp_path / "p"), str(tmp_path / "c")
    spark.createDataFrame([("1.1.1.1", "Bot")], "ip string, cluster_label string").write.parquet(source)
    T.parquet_to_csv(spark, source, target)
    assert T.read_labels(spark, target, ("label", "cluster_label")).collect() == [("1.1.1.1", "Bot")]
    with pytest.raises(ValueError):
        T.read_labels(spark, target, ("threat",))


def test_geo_cache_only_resolves_new_addresses(spark, tmp_path):
    asked = []

    def resolve(addresses):
        asked.append(sorted(r[0] for r in addresses.collect()))
        return addresses.withColumn("country_code", F.lit("AA"))

    ips = lambda *v: spark.createDataFrame([(x,) for x in v], "src_ip string")
    path = str(tmp_path / "geo")
    T.extend_geo_cache(spark, path, ips("1", "2"), resolve)
    assert T.extend_geo_cache(spark, path, ips("2", "3"), resolve).count() == 3
    assert T.extend_geo_cache(spark, path, ips("3"), resolve).count() == 3
    assert asked == [["1", "2"], ["3"]]
