"""Registered queries: the data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocabulary import PROTOCOL_CODES, TARGET_EVENTS
from ..operators import quality as Q
from .adapters import EV, FL, attack_events, flows, with_ctes
from .catalog import query

E_ = with_ctes(EV)
F_ = with_ctes(FL)
EF = with_ctes(EV, FL)

FLOW_COLUMNS = (
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "service", "conn_state", "duration", "hour", "date", "day_of_week",
)


_FLOW_TYPES = {"timestamp": "timestamp", "date": "date", "duration": "double", "hour": "int", "src_port": "int", "dst_port": "int", "orig_bytes": "bigint", "resp_bytes": "bigint"}


@query("v01_schema_report", F_ + "\nUNION ALL ".join(
    f"""SELECT 'schema' AS "check", '{c}' AS subject, '{'' if c == 'service' else _FLOW_TYPES.get(c, 'string')}' AS type, '{status}' AS status, {'CAST(nullif(count(*), count(*)) AS BIGINT)' if c == 'service' else f'count("{c}")'} AS n_values FROM fl"""
    for names, status in ((FLOW_COLUMNS, "ok"), (("flow_id", "orig_bytes", "resp_bytes"), "extra")) for c, status in [(n, "missing" if n == "service" else status) for n in names]))
def schema_report(spark, sf):
    return Q.schema_report(flows(spark, sf), FLOW_COLUMNS)


@query("v02_row_count", EF + """
SELECT 'row_count' AS "check", 'flows' AS subject, CAST(count(*) AS DOUBLE) AS value, CASE WHEN count(*) BETWEEN 1000000 AND 50000000 THEN 'ok' ELSE 'warn' END AS status FROM fl
UNION ALL SELECT 'row_count', 'events', CAST(count(*) AS DOUBLE), CASE WHEN count(*) BETWEEN 1000 AND 200000000 THEN 'ok' ELSE 'warn' END FROM ev""")
def row_count(spark, sf):
    left = Q.row_count_report(flows(spark, sf), "flows", 1_000_000, 50_000_000)
    return left.unionByName(Q.row_count_report(attack_events(spark, sf), "events", 1_000, 200_000_000))


@query("v03_date_years", F_ + """
SELECT 'first_year' AS "check", 'flows' AS subject, CAST(min(year(date)) AS DOUBLE) AS value, CASE WHEN min(year(date)) BETWEEN 1995 AND 2001 THEN 'ok' ELSE 'warn' END AS status FROM fl
UNION ALL SELECT 'last_year', 'flows', CAST(max(year(date)) AS DOUBLE), CASE WHEN max(year(date)) BETWEEN 1995 AND 2001 THEN 'ok' ELSE 'warn' END FROM fl""")
def date_years(spark, sf):
    return Q.year_report(flows(spark, sf), "flows", 1995, 2001)


@query("v04_value_ranges", with_ctes(FL.replace("fl AS (", "fl_all AS (")) + """
, fl AS (SELECT src_port * 2 AS src_port, dst_port, hour, CASE WHEN src_port % 50 = 0 THEN 'hash' ELSE src_ip END AS src_ip FROM fl_all),
c AS (SELECT 'src_port' AS col, count(*) FILTER (WHERE NOT src_port BETWEEN 0 AND 65535) AS n FROM fl
 UNION ALL SELECT 'dst_port', count(*) FILTER (WHERE NOT dst_port BETWEEN 0 AND 65535) FROM fl
 UNION ALL SELECT 'hour', count(*) FILTER (WHERE NOT hour BETWEEN 0 AND 23) FROM fl
 UNION ALL SELECT 'src_ip', count(*) FILTER (WHERE NOT (contains(src_ip, '.') OR contains(src_ip, ':'))) FROM fl)
SELECT 'value_range' AS "check", 'flows.' || col AS subject, CAST(n AS DOUBLE) AS value, CASE WHEN n = 0 THEN 'ok' ELSE 'error' END AS status FROM c""")
def value_ranges(spark, sf):
    odd = flows(spark, sf).select(
        (F.col("src_port") * 2).alias("src_port"), "dst_port", "hour",
        F.when(F.col("src_port") % 50 == 0, "hash").otherwise(F.col("src_ip")).alias("src_ip"),
    )
    return Q.range_report(odd, "flows")


_NULLABLE = ("src_ip", "eventid", "username", "password", "duration")


@query("v05_null_rates", E_ + "SELECT 'null_rate' AS \"check\", subject, round(value, 6) AS value, CASE WHEN value = 100 THEN 'empty' WHEN value > 50 THEN 'warn' ELSE 'ok' END AS status FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS subject, (count(*) - count({c})) * 100.0 / count(*) AS value FROM ev" for c in _NULLABLE)
    + " UNION ALL SELECT 'geo_city', 100.0)")
def null_rates(spark, sf):
    events = attack_events(spark, sf).select(*_NULLABLE, F.nullif("src_ip", "src_ip").alias("geo_city"))
    return Q.null_rate_report(events).withColumn("value", F.round("value", 6))


_EXPECTED_EVENTS = (*TARGET_EVENTS[:-1], "cowrie.client.version")


def _expected_sql(source: str, column: str, values, check: str) -> str:
    wanted = ", ".join(f"('{v}')" for v in values)
    return f"""
SELECT '{check}' AS "check", coalesce(a.v, w.v) AS subject, CAST(coalesce(n, 0) AS DOUBLE) AS value,
  CASE WHEN a.v IS NULL THEN 'missing' WHEN w.v IS NULL THEN 'unexpected' ELSE 'ok' END AS status
FROM (SELECT {column} AS v, count(*) AS n FROM {source} GROUP BY 1) a FULL OUTER JOIN (VALUES {wanted}) w(v) ON a.v = w.v"""


@query("v06_event_types", E_ + _expected_sql("ev", "eventid", _EXPECTED_EVENTS, "event_type"))
def event_types(spark, sf):
    return Q.expected_values_report(spark, attack_events(spark, sf), "eventid", _EXPECTED_EVENTS, "event_type")


@query("v07_protocols", F_ + _expected_sql("(SELECT CASE WHEN src_port % 7 = 0 THEN upper(proto) WHEN src_port % 11 = 0 THEN 'sctp' ELSE proto END AS p FROM fl)", "lower(p)", PROTOCOL_CODES, "protocol"))
def protocols(spark, sf):
    c = F.col
    odd = F.when(c("src_port") % 7 == 0, F.upper("proto")).when(c("src_port") % 11 == 0, "sctp").otherwise(c("proto"))
    return Q.expected_values_report(spark, flows(spark, sf).select(odd.alias("proto")), "proto", tuple(PROTOCOL_CODES), "protocol", lower=True)


@query("v08_duplicates", F_ + """
, g AS (SELECT count(*) AS n FROM fl GROUP BY src_ip, dst_ip, dst_port)
SELECT 'duplicates' AS "check", 'flows(src_ip,dst_ip,dst_port)' AS subject, round((sum(n) - count(*)) * 100.0 / sum(n), 6) AS value,
  CASE WHEN (sum(n) - count(*)) * 100.0 / sum(n) > 50 THEN 'warn' ELSE 'ok' END AS status FROM g""")
def duplicates(spark, sf):
    report = Q.duplicate_report(flows(spark, sf), "flows", ("src_ip", "dst_ip", "dst_port", "session"))
    return report.withColumn("value", F.round("value", 6))


@query("v09_sample_records", E_ + """
SELECT * FROM (SELECT 'head' AS part, event_id, src_ip, eventid FROM ev ORDER BY "timestamp", event_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'tail', event_id, src_ip, eventid FROM ev ORDER BY "timestamp" DESC, event_id DESC LIMIT 3)""")
def sample_records(spark, sf):
    return Q.sample_records(attack_events(spark, sf), ["timestamp", "event_id"]).select("part", "event_id", "src_ip", "eventid")
