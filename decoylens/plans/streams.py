"""Registered queries: the streaming jobs, run over the given tables until everything is processed."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..operators import classify as K, features as FT, sequences as SQ
from ..session import scratch_path, tune
from ..streaming import jobs as J
from .adapters import EV, FL, attack_events, events_from, with_ctes
from .catalog import query
from .features import ENTROPY, EVENT_STEPS, LOGINS
from .sources import flow_lines, written_as

E_ = with_ctes(EV)
N_WARNING = 10


def _events(spark, sf):
    """The events table as a stream of files."""
    tune(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return events_from(J.file_stream(spark, sf, schema, "events.parquet"))


def _finish(spark, stream, name):
    """Run a stream to its end into Parquet and return what it wrote."""
    path = scratch_path(spark, name)
    J.to_parquet(stream, path, scratch_path(spark, name + "-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("st1_sequence_stream", with_ctes(EV, EVENT_STEPS) + """
SELECT src_ip, count(*) AS n_steps, round(sum(v0 + v1 + v2 + v3 + v4 + v5 + v6), 4) AS total FROM st GROUP BY src_ip HAVING count(*) = 20""")
def sequence_stream(spark, sf):
    rows = _finish(spark, J.sequence_stream(_events(spark, sf), 20), "sequences")
    steps = rows.select("src_ip", "rank", F.array(SQ._log_delta(), *[c.cast("double") for c in SQ.event_vector()]).alias("vec"))
    packed = SQ.pad_sequences(steps, 20, SQ.EVENT_DIMS)
    total = F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, v: a + v)
    return packed.select("src_ip", "n_steps", F.round(total, 4).alias("total"))


@query("st2_early_warning", with_ctes(EV, LOGINS) + f"""
, w AS (SELECT * FROM lgg WHERE rank <= {N_WARNING} AND n_logins >= {N_WARNING}),
p AS (SELECT src_ip, avg({ENTROPY.format('password')}) AS pe, avg(length(password)) AS pl FROM (SELECT DISTINCT src_ip, password FROM w WHERE password IS NOT NULL) GROUP BY src_ip),
s AS (SELECT src_ip, count(DISTINCT password) AS pw, coalesce(avg(gap) / 1e6, 0.0) AS ga, coalesce(stddev_pop(gap) / 1e6, 0.0) AS gs FROM w GROUP BY src_ip)
SELECT s.src_ip, pw AS unique_passwords, round(ga + 1e-7, 5) AS avg_time_between, round(gs + 1e-7, 5) AS std_time_between, round(coalesce(pe, 0.0), 5) AS password_entropy,
  round(coalesce(pl, 0.0) + 1e-7, 5) AS password_length, round({N_WARNING} / greatest(pw, 1) + 1e-7, 5) AS password_reuse FROM s LEFT JOIN p USING (src_ip)""")
def early_warning(spark, sf):
    rows = _finish(spark, J.early_warning_stream(_events(spark, sf), N_WARNING), "warnings")
    features = J.early_warning_features(rows, N_WARNING)
    nudged = ("avg_time_between", "std_time_between", "password_length", "password_reuse")
    return features.select(
        "src_ip", "unique_passwords", *[F.round(F.col(c) + 1e-7, 5).alias(c) for c in nudged], F.round("password_entropy", 5).alias("password_entropy")
    )


@query("st2b_scored_warnings")
def scored_warnings(spark, sf):
    """A forest learns the threat level from the first logins of each address, in batch, and scores the stream."""
    events = attack_events(spark, sf)
    columns = ["unique_passwords", "avg_time_between", "std_time_between", "password_entropy", "password_length", "password_reuse"]
    windows = FT.session_windows(events, (N_WARNING,)).select("src_ip", F.col("label").alias("label"), *columns)
    coded, names = K.encode_labels(windows, "label")
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), K.random_forest(50, 10)]).fit(coded)
    path = scratch_path(spark, "scored")
    J.scored_warnings(_events(spark, sf), N_WARNING, model, path, scratch_path(spark, "scored-checkpoint"), names).awaitTermination()
    return spark.read.parquet(path).select("src_ip", *[F.round(c, 5).alias(c) for c in columns], "predicted")


@query("st3_running_counts", E_ + "SELECT eventid, count(*) AS n FROM ev GROUP BY eventid")
def running_counts(spark, sf):
    path = scratch_path(spark, "running")
    J.latest_counts(J.running_counts(_events(spark, sf), "eventid"), path, scratch_path(spark, "running-checkpoint"), ["eventid"]).awaitTermination()
    return J.current_counts(spark, path, ["eventid"])


# Days that end before the watermark (newest time minus one day) are closed and written.
@query("st4_event_time_counts", E_ + """
SELECT CAST(date AS VARCHAR) AS day, count(*) AS n FROM ev GROUP BY date
HAVING CAST(date AS TIMESTAMP) + INTERVAL 2 DAY <= (SELECT date_trunc('millisecond', max("timestamp")) FROM ev)""")
def event_time_counts(spark, sf):
    closed = _finish(spark, J.event_time_counts(_events(spark, sf), "1 day"), "daily")
    return closed.select(F.to_date("start").cast("string").alias("day"), "n")


@query("st4b_hourly_latest", E_ + """
SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H') AS hour, count(*) AS n FROM ev GROUP BY 1""")
def hourly_latest(spark, sf):
    """Hourly counts as they stand, open hours included: their sum is that of the batch counts."""
    path = scratch_path(spark, "hourly")
    J.latest_counts(J.event_time_counts(_events(spark, sf), "1 hour", "60 days"), path, scratch_path(spark, "hourly-checkpoint"), ["start"]).awaitTermination()
    return J.current_counts(spark, path, ["start"]).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n")


# Lines that are no flow are kept as rows without a date.
@query("st5_stream_ingest", with_ctes(FL) + """
SELECT CASE WHEN src_port % 20 > 2 THEN CAST(date AS VARCHAR) END AS date, count(*) AS n, CAST(sum(CASE WHEN src_port % 20 > 2 THEN dst_port ELSE 0 END) AS BIGINT) AS ports FROM fl GROUP BY 1""")
def stream_ingest(spark, sf):
    raw = scratch_path(spark, "raw-logs")
    written_as(flow_lines(spark, sf), f"{raw}/sensor-1", "conn.{0}.log")
    written_as(flow_lines(spark, sf).limit(50), f"{raw}/sensor-2", "dns.{0}.log")
    stored = _finish(spark, J.flow_line_stream(spark, raw), "ingest")
    date = F.when(F.col("ok"), F.col("date").cast("string"))
    return stored.groupBy(date.alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("dst_port").alias("ports"))
