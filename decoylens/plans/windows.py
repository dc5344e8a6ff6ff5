"""Registered queries: gaps, first-N, first-fraction, rank consensus, normalised profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C, evaluate as EV_, features as FT, ordered as O
from .adapters import EV, FL, attack_events, flows, with_ctes
from .catalog import query

E_ = with_ctes(EV)
F_ = with_ctes(FL)


@query("n03_event_gaps", E_ + """
, g AS (SELECT src_ip, event_id, (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY src_ip ORDER BY "timestamp", event_id)) / 1e6 AS gap FROM ev)
SELECT src_ip, event_id, round(CASE WHEN gap > 0 AND gap < 86400 THEN gap ELSE -1 END, 6) AS gap FROM g""")
def event_gaps(spark, sf):
    gaps = O.gap_seconds(attack_events(spark, sf).select("src_ip", "event_id", "timestamp"), "src_ip", "timestamp", "event_id")
    kept = F.when((F.col("gap") > 0) & (F.col("gap") < 86400), F.col("gap")).otherwise(F.lit(-1.0))
    return gaps.select("src_ip", "event_id", F.round(kept, 6).alias("gap"))


@query("n04_first_n", F_ + """
, r AS (SELECT src_ip, flow_id, row_number() OVER (PARTITION BY src_ip ORDER BY "timestamp", flow_id) AS rank FROM fl)
SELECT src_ip, flow_id, rank FROM r WHERE rank <= 10""")
def first_n(spark, sf):
    rows = flows(spark, sf).select("src_ip", "flow_id", "timestamp")
    return O.first_n(rows, ["src_ip"], ["timestamp", "flow_id"], 10, "flow_id").select("src_ip", "flow_id", "rank")


@query("n05_first_fraction", E_ + """
, r AS (SELECT src_ip, event_id, row_number() OVER (PARTITION BY src_ip ORDER BY "timestamp", event_id) AS rank, count(*) OVER (PARTITION BY src_ip) AS n_rows
  FROM ev WHERE contains(eventid, 'login'))
SELECT src_ip, event_id, rank, n_rows FROM r WHERE rank <= greatest(3, floor(n_rows * CAST(0.3 AS DOUBLE)))""")
def first_fraction(spark, sf):
    logins = FT.logins_of(attack_events(spark, sf)).select("src_ip", "event_id", "timestamp")
    return O.first_fraction(logins, "src_ip", "timestamp", "event_id").select("src_ip", "event_id", "rank", "n_rows")


# Candidate k is the event hour modulo 8, its metrics are rollups of that slice of the events.
_METRICS_SQL = E_ + """
, m AS (SELECT hour % 8 + 2 AS k, round(avg(duration), 1) AS silhouette, round(avg(length(password)), 1) AS davies_bouldin, CAST(count(*) // 50 AS DOUBLE) AS calinski_harabasz FROM ev GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY silhouette DESC, k) + row_number() OVER (ORDER BY davies_bouldin, k) + row_number() OVER (ORDER BY calinski_harabasz DESC, k) - 3 AS rank_sum FROM m)
SELECT k, CAST(rank_sum AS BIGINT) AS rank_sum, CAST(row_number() OVER (ORDER BY rank_sum, k) = 1 AS INT) AS is_best FROM r"""


def _consensus(spark, sf):
    metrics = attack_events(spark, sf).groupBy((F.col("hour") % 8 + 2).alias("k")).agg(
        F.round(F.avg("duration"), 1).alias("silhouette"),
        F.round(F.avg(F.length("password")), 1).alias("davies_bouldin"),
        F.floor(F.count(F.lit(1)) / 50).cast("double").alias("calinski_harabasz"),
    )
    return EV_.consensus_k(metrics).select("k", F.col("rank_sum").cast("bigint").alias("rank_sum"), "is_best")


query("n07_rank_consensus", _METRICS_SQL)(_consensus)

PROFILE = ("n", "bytes", "duration", "ports")
_CENTRES_SQL = F_ + """
, c AS (SELECT conn_state AS cluster, CAST(count(*) AS DOUBLE) AS n, avg(orig_bytes) AS bytes, avg(duration) AS duration, CAST(count(DISTINCT dst_port) AS DOUBLE) AS ports FROM fl GROUP BY 1),
u AS (UNPIVOT c ON n, bytes, duration, ports INTO NAME feature VALUE value)"""


def state_centres(spark, sf):
    return flows(spark, sf).groupBy(F.col("conn_state").alias("cluster")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("orig_bytes").alias("bytes"), F.avg("duration").alias("duration"),
        F.count_distinct("dst_port").cast("double").alias("ports"),
    )


@query("n08_normalised_profiles", _CENTRES_SQL + """
, s AS (SELECT feature, cluster, CASE WHEN max(value) OVER f > min(value) OVER f THEN (value - min(value) OVER f) / (max(value) OVER f - min(value) OVER f) ELSE 0.5 END AS scaled
  FROM u WINDOW f AS (PARTITION BY feature)),
t AS (SELECT feature FROM s GROUP BY feature ORDER BY round(var_samp(scaled), 9) DESC, feature LIMIT 3)
SELECT feature, cluster, round(scaled, 6) AS scaled FROM s WHERE feature IN (SELECT feature FROM t)""")
def normalised_profiles(spark, sf):
    return C.normalised_profiles(state_centres(spark, sf), PROFILE, top=3).withColumn("scaled", F.round("scaled", 6))


@query("m12_discriminativeness", _CENTRES_SQL + """
SELECT feature, round((max(value) - min(value)) / (avg(abs(value)) + 1e-10), 6) AS importance FROM u GROUP BY feature""")
def discriminativeness(spark, sf):
    return C.discriminativeness(state_centres(spark, sf), PROFILE).withColumn("importance", F.round("importance", 6))
