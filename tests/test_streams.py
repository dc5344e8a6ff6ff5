"""Streams fed file by file, one file late, against the batch results."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import harness
from decoylens.operators import classify as K, features as FT, ordered as O
from decoylens.plans import adapters as A
from decoylens.streaming import jobs as J, snapshots

SF = f"{harness.DATA}/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in four files by time, written in time order."""
    root = tmp_path_factory.mktemp("stream")
    raw = spark.read.parquet(f"{SF}/events.parquet")
    n = raw.count()
    for i in range(4):
        low, high = i * n // 4, (i + 1) * n // 4
        raw.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(str(root / "in"))
    return str(root / "in"), raw


def _stream(spark, parts):
    folder, raw = parts
    return A.events_from(J.file_stream(spark, folder, raw.schema, max_files=1))


def _run(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    J.to_parquet(stream, out, str(tmp_path / "check")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_first_n_over_several_triggers(spark, parts, tmp_path):
    got = _run(spark, J.sequence_stream(_stream(spark, parts), 8), tmp_path)
    events = A.events_from(parts[1])
    batch = O.first_n(events, ["src_ip"], ["timestamp", "event_id"], 8, "event_id")
    columns = ["src_ip", "rank", "timestamp", "eventid", "hour"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_early_warning_equals_the_window_table(spark, parts, tmp_path):
    rows = _run(spark, J.early_warning_stream(_stream(spark, parts), 5), tmp_path)
    features = J.early_warning_features(rows, 5)
    batch = FT.session_windows(A.events_from(parts[1]), (5,), "event_id")
    columns = list(FT.WINDOW_EVENT_FEATURES)
    key = lambda df: {r[0]: [round(float(v), 5) for v in r[1:]] for r in df.select("src_ip", *columns).collect()}
    mine, expected = key(features), key(batch)
    assert expected and all(mine[ip] == pytest.approx(row, abs=2e-5) for ip, row in expected.items())


def test_idle_addresses_leave_the_state(spark, tmp_path):
    """The watermark is the clock: what is idle for two hours goes, its next rows start anew."""
    folder = tmp_path / "in"
    files = (
        [("a", 0), ("a", 10), ("b", 5), ("c", 20), ("c", 30), ("c", 40)],  # c is complete
        [("a", 6000)],  # within two hours of 10: a stays
        [("z", 40_000)],  # the watermark passes a, b and c
        [("z", 40_001)],
        [("a", 41_000), ("b", 41_001), ("b", 41_002), ("c", 41_000)],
        [("b", 41_003), ("a", 41_004), ("c", 41_005), ("c", 41_006)],
        [("c", 41_007)],  # c was emitted again and counts no more
    )
    for i, rows in enumerate(files):
        frame = spark.createDataFrame([(ip, s, 100 * i + j) for j, (ip, s) in enumerate(rows)], "src_ip string, s bigint, event_id bigint")
        frame.withColumn("timestamp", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(folder))
    schema = "src_ip string, s bigint, event_id bigint, timestamp timestamp"
    stream = J.file_stream(spark, str(folder), schema, max_files=1)
    got = _run(spark, J.first_n_stream(stream, 3, F.col("s").cast("string"), idle="2 hours", lateness="1 minute"), tmp_path)
    sets = sorted((r.src_ip, r.items) for r in got.groupBy("src_ip", F.floor(F.col("us") / 4e10).alias("run")).agg(F.sort_array(F.collect_list("item")).alias("items")).collect())
    assert sets == [("b", ["41001", "41002", "41003"]), ("c", ["20", "30", "40"]), ("c", ["41000", "41005", "41006"])]
    keep = J.first_n_stream(J.file_stream(spark, str(folder), schema, max_files=1), 3, F.col("s").cast("string"))
    (tmp_path / "kept").mkdir()
    kept = _run(spark, keep, tmp_path / "kept").groupBy("src_ip").agg(F.sort_array(F.collect_list("item")).alias("items")).collect()
    assert sorted((r.src_ip, r["items"]) for r in kept) == [("a", ["0", "10", "6000"]), ("b", ["41001", "41002", "5"]), ("c", ["20", "30", "40"])]


def test_addresses_of_an_earlier_run_stay_out(spark, parts, tmp_path):
    first = _run(spark, J.early_warning_stream(_stream(spark, parts), 5), tmp_path)
    done = spark.createDataFrame(sorted(first.select("src_ip").distinct().collect())[:3])
    (tmp_path / "again").mkdir()
    again = _run(spark, J.early_warning_stream(_stream(spark, parts), 5, done=done), tmp_path / "again")
    assert set(again.select("src_ip").collect()) == set(first.select("src_ip").collect()) - set(done.collect())


def test_scores_of_the_stream_equal_those_of_the_batch(spark, parts, tmp_path):
    columns = ["unique_passwords", "avg_time_between", "password_entropy"]
    windows = FT.session_windows(A.events_from(parts[1]), (5,), "event_id")
    coded, names = K.encode_labels(windows.withColumn("label", F.when(F.col("unique_passwords") > 3, "many").otherwise("few")), "label")
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), K.random_forest(5, 4)]).fit(coded)
    out = str(tmp_path / "scores")
    J.scored_warnings(_stream(spark, parts), 5, model, out, str(tmp_path / "check"), names).awaitTermination()
    expected = {r.src_ip: names[int(r.prediction)] for r in model.transform(coded).collect()}
    assert dict(spark.read.parquet(out).select("src_ip", "predicted").collect()) == expected


def test_counts_survive_triggers(spark, parts, tmp_path):
    path = str(tmp_path / "counts")
    J.latest_counts(J.running_counts(_stream(spark, parts), "eventid"), path, str(tmp_path / "check"), ["eventid"]).awaitTermination()
    expected = A.events_from(parts[1]).groupBy("eventid").count().collect()
    assert sorted(J.current_counts(spark, path, ["eventid"]).collect()) == sorted(expected)


def test_runs_are_merged_and_replays_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FAN", 3)
    table, truth = snapshots.Snapshots(spark, str(tmp_path / "t"), ["k"]), {}
    assert table.read() is None
    frame = lambda rows: spark.createDataFrame(rows, "k string, n bigint").coalesce(1)
    for batch in range(20):
        rows = [(f"k{batch % 4}", batch), ("all", batch)]
        truth |= dict(rows)
        table.add(frame(rows), batch)
        if batch % 5 == 0:  # the same batch again, and an old one
            table.add(frame([("all", -1)]), batch)
            table.add(frame([("all", -1)]), batch // 2)
        assert dict(table.read().collect()) == truth
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("run-")]
    assert len(table.state()["runs"]) <= 6 and len(folders) <= 6 + len(table.state()["gone"])
    # A run that was written before a failure, but not pointed to, is written anew.
    frame([("all", -5)]).withColumn("_batch", F.lit(20).cast("bigint")).write.parquet(str(tmp_path / "t" / "run-0-20-20"))
    assert dict(table.read().collect()) == truth
    table.add(frame([("all", 99)]), 20)
    assert dict(table.read().collect()) == truth | {"all": 99}


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    ts = lambda *s: spark.createDataFrame([(v,) for v in s], "s bigint").select(F.timestamp_seconds("s").alias("timestamp"))
    day = 86_400
    # A trigger drops what lies behind the watermark its predecessor worked with.
    for rows in ((10, 20, day + 5), (5 * day,), (5 * day + 7,), (30, 5 * day + 10), (9 * day,)):
        ts(*rows).coalesce(1).write.mode("append").parquet(str(folder))
    stream = J.file_stream(spark, str(folder), "timestamp timestamp", max_files=1)
    got = _run(spark, J.event_time_counts(stream, "1 day", "1 day"), tmp_path)
    assert sorted((r.start.day - 1, r.n) for r in got.collect()) == [(0, 2), (1, 1), (5, 3)]


def test_ingest(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "conn.1.log").write_text('{"ts": 1.5, "id.orig_h": "1.1.1.1", "id.resp_p": 22}\n#skip\n\n{"ts": 2.5, "id.orig_h": "2.2.2.2"}\n')
    (folder / "dns.1.log").write_text('{"ts": 1.5, "id.orig_h": "3.3.3.3"}\n')
    got = _run(spark, J.flow_line_stream(spark, str(folder)), tmp_path).collect()
    assert sorted((r.src_ip, r.dst_port) for r in got if r.ok) == [("1.1.1.1", 22), ("2.2.2.2", 0)]
    assert sum(not r.ok for r in got) == 2  # the comment and the blank line
