"""Registered queries: projections, predicates, rollups, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..functions.vocabulary import TARGET_EVENTS
from ..operators import features as FT, quality as Q, rollups as R, sampling
from ..operators.ordered import centred_mean, first_n, share, with_total_share
from ..sources.logs import is_allowed
from .adapters import EV, FL, attack_events, flows, table, with_ctes
from .catalog import query

E_ = with_ctes(EV)
F_ = with_ctes(FL)
EF = with_ctes(EV, FL)


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _text_date(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# --- projections and predicates ----------------------------------------------------------------

@query("p01_equality_filter", E_ + """
SELECT src_ip, count(*) AS n FROM ev WHERE eventid = 'cowrie.session.connect' GROUP BY src_ip""")
def equality_filter(spark, sf):
    connects = attack_events(spark, sf).filter(F.col("eventid") == "cowrie.session.connect")
    return connects.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))


PARTS = ("login", "login.success", "login.failed", "session.connect", "command.input", "file_download", "session.closed")


@query("p02_event_substrings", E_ + "\nUNION ALL ".join(
    f"SELECT '{p}' AS part, count(*) FILTER (WHERE contains(eventid, '{p}')) AS n FROM ev" for p in PARTS))
def event_substrings(spark, sf):
    counts = attack_events(spark, sf).agg(
        F.array(*[F.struct(F.lit(p).alias("part"), F.count_if(S.has_part("eventid", p)).alias("n")) for p in PARTS]).alias("r")
    )
    return counts.select(F.inline("r"))


@query("p03_drop_nulls", E_ + """
SELECT count(*) AS n, count(DISTINCT password) AS passwords FROM ev WHERE username IS NOT NULL AND password IS NOT NULL""")
def drop_nulls(spark, sf):
    known = attack_events(spark, sf).select("username", "password").dropna(subset=["username", "password"])
    return known.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("password").alias("passwords"))


_POINTS = """
pts AS (
  SELECT l_orderkey, CAST(l_partkey % 241 - 120 AS DOUBLE) AS latitude, CAST(l_suppkey % 401 - 200 AS DOUBLE) AS longitude FROM lineitem
)"""


def _points(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 241 - 120).cast("double").alias("latitude"),
        (F.col("l_suppkey") % 401 - 200).cast("double").alias("longitude"),
    )


@query("p04_valid_coordinates", with_ctes(_POINTS) + """
SELECT count(*) AS n_valid, round(sum(latitude), 3) AS sum_lat, round(sum(longitude), 3) AS sum_lon FROM pts
WHERE latitude <> 0 AND longitude <> 0 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180""")
def valid_coordinates(spark, sf):
    valid = _points(spark, sf).filter(S.valid_point("latitude", "longitude"))
    return valid.agg(
        F.count(F.lit(1)).alias("n_valid"), F.round(F.sum("latitude"), 3).alias("sum_lat"), F.round(F.sum("longitude"), 3).alias("sum_lon")
    )


# Address beginnings that cover every branch of the private test.
HEADS = ("10.", "172.16.", "172.20.", "192.168.", "127.", "0.", "8.8.", "101.")
_HEADS_SQL = "[" + ", ".join(f"'{h}'" for h in HEADS) + "]"


@query("p05_private_addresses", f"""
WITH a AS (SELECT {_HEADS_SQL}[CAST((l_orderkey + l_linenumber) % {len(HEADS)} + 1 AS INT)] || CAST(l_suppkey % 250 AS VARCHAR) || '.1' AS ip FROM lineitem),
c AS (SELECT CASE WHEN ip LIKE '10.%' OR ip LIKE '172.16.%' OR ip LIKE '192.168.%' OR ip LIKE '127.%' OR ip LIKE '0.%' THEN '--' ELSE 'open' END AS code,
  CASE WHEN regexp_matches(ip, '^(10\\.|192\\.168\\.|127\\.|0\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') THEN '--' ELSE 'open' END AS rfc_code FROM a)
SELECT code, rfc_code, count(*) AS n FROM c GROUP BY code, rfc_code""")
def private_addresses(spark, sf):
    position = ((F.col("l_orderkey") + F.col("l_linenumber")) % len(HEADS) + 1).cast("int")
    head = F.element_at(F.array(*map(F.lit, HEADS)), position)
    ip = F.concat(head, (F.col("l_suppkey") % 250).cast("string"), F.lit(".1"))
    addresses = table(spark, sf, "lineitem").select(ip.alias("ip"))
    return addresses.groupBy(
        F.when(S.is_private("ip"), "--").otherwise("open").alias("code"),
        F.when(S.is_private("ip", rfc1918=True), "--").otherwise("open").alias("rfc_code"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("p06_drop_null_columns", E_ + """
SELECT 'geo_city' AS dropped, count(*) AS n, count(username) AS usernames FROM ev""")
def drop_null_columns(spark, sf):
    events = attack_events(spark, sf).select("src_ip", "username", F.nullif("src_ip", "src_ip").alias("geo_city"))
    kept, empty = Q.drop_null_columns(events)
    return kept.agg(F.lit(",".join(empty)).alias("dropped"), F.count(F.lit(1)).alias("n"), F.count("username").alias("usernames"))


@query("p07_numeric_features", F_ + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(CAST(sum({c}) AS DOUBLE), 3) AS total FROM fl" for c in ("src_port", "dst_port", "duration", "orig_bytes", "resp_bytes")))
def numeric_features(spark, sf):
    """The columns fit for a model, chosen by type and name, with what they hold."""
    rows = flows(spark, sf).withColumn("_reference", F.lit(1))
    chosen = FT.numeric_features(rows, exclude=("hour",))
    totals = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.round(F.sum(c).cast("double"), 3).alias("total")) for c in chosen]
    return rows.agg(F.array(*totals).alias("r")).select(F.inline("r"))


@query("p09_top_set_filter", F_ + """
, top AS (SELECT dst_port FROM fl GROUP BY dst_port ORDER BY count(*) DESC, dst_port LIMIT 10)
SELECT src_ip, count(*) AS n FROM fl WHERE dst_port IN (SELECT dst_port FROM top) GROUP BY src_ip""")
def top_set_filter(spark, sf):
    rows = flows(spark, sf)
    top = R.top_values(rows, "dst_port", 10)
    return rows.select("src_ip", "dst_port").join(top, "dst_port", "left_semi").groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))


# --- rollups -------------------------------------------------------------------------------------

@query("a01_value_counts", E_ + "SELECT eventid, count(*) AS n FROM ev GROUP BY eventid")
def value_counts(spark, sf):
    return R.value_counts(attack_events(spark, sf), "eventid")


@query("a02_filtered_value_counts", E_ + """
SELECT username, count(*) AS n FROM ev WHERE contains(eventid, 'login') AND username IS NOT NULL GROUP BY username""")
def filtered_value_counts(spark, sf):
    return R.value_counts(attack_events(spark, sf).filter(S.is_login()), "username")


@query("a03_pair_counts", F_ + """
SELECT src_ip, dst_port, count(*) AS n FROM fl WHERE proto = 'tcp' GROUP BY src_ip, dst_port ORDER BY n DESC, src_ip, dst_port LIMIT 200""")
def pair_counts(spark, sf):
    return R.pair_counts(flows(spark, sf).filter(F.col("proto") == "tcp"), "src_ip", "dst_port", 200)


@query("a04_hour_distribution", E_ + """
SELECT CAST(h AS INT) AS hour, count(ev.event_id) AS n FROM range(24) t(h) LEFT JOIN ev ON ev.hour = h AND eventid = 'cowrie.session.file_download' GROUP BY h""")
def hour_distribution(spark, sf):
    downloads = attack_events(spark, sf).filter(F.col("eventid") == "cowrie.session.file_download")
    return R.hour_distribution(spark, downloads)


@query("a05_daily_counts", E_ + "SELECT CAST(date AS VARCHAR) AS date, count(*) AS n FROM ev GROUP BY date")
def daily_counts(spark, sf):
    return _text_date(R.daily_counts(attack_events(spark, sf)), "date")


@query("a06_monthly_counts", F_ + "SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM fl GROUP BY month")
def monthly_counts(spark, sf):
    return R.monthly_counts(flows(spark, sf))


_DAYS_SQL = "(VALUES " + ", ".join(
    f"({i}, '{d}')" for i, d in enumerate(("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"), 1)
) + ") d(day_no, day_of_week)"


@query("a07_day_hour_matrix", E_ + "SELECT d.day_no, d.day_of_week, " + ", ".join(
    f"count(*) FILTER (WHERE ev.hour = {h}) AS h{h:02d}" for h in range(24)
) + f" FROM {_DAYS_SQL} LEFT JOIN ev USING (day_of_week) GROUP BY d.day_no, d.day_of_week")
def day_hour_matrix(spark, sf):
    return R.day_hour_matrix(spark, attack_events(spark, sf))


@query("a08_weekly_periodicity", F_ + """
, w AS (SELECT greatest(date_diff('day', min(date), max(date)) / 7, 1.0) AS weeks FROM fl)
SELECT day_of_week, count(*) AS n, round(count(*) / any_value(weeks), 6) AS per_week FROM fl, w GROUP BY day_of_week""")
def weekly_periodicity(spark, sf):
    return R.weekly_periodicity(flows(spark, sf)).select("day_of_week", "n", _r("per_week"))


def _both_hours(spark, sf):
    left = flows(spark, sf).select(F.lit("flows").alias("dataset"), "hour")
    return left.unionByName(attack_events(spark, sf).select(F.lit("events").alias("dataset"), "hour"))


@query("a09_business_hours", EF + """
, b AS (SELECT 'flows' AS dataset, hour FROM fl UNION ALL SELECT 'events', hour FROM ev),
c AS (SELECT dataset, count(*) FILTER (WHERE hour >= 8 AND hour < 18) AS business, count(*) FILTER (WHERE NOT (hour >= 8 AND hour < 18)) AS off_hours FROM b GROUP BY dataset)
SELECT dataset, business, off_hours, round(business * 100.0 / (business + off_hours), 6) AS business_pct,
  round(off_hours * 100.0 / (business + off_hours), 6) AS off_pct FROM c""")
def business_hours(spark, sf):
    return R.business_hours(_both_hours(spark, sf)).select("dataset", "business", "off_hours", _r("business_pct"), _r("off_pct"))


@query("a13_dataset_summary", EF + """
SELECT 'flows' AS dataset, 14 AS n_columns, count(*) AS n_rows, count(DISTINCT src_ip) AS n_ips, count(DISTINCT proto) AS n_categories,
  CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM fl
UNION ALL SELECT 'events', 10, count(*), count(DISTINCT src_ip), count(DISTINCT eventid), CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR) FROM ev""")
def dataset_summary(spark, sf):
    left = R.dataset_summary(flows(spark, sf), "flows", "proto")
    return left.unionByName(R.dataset_summary(attack_events(spark, sf), "events", "eventid"))


@query("a14_headline_statistics", EF + """
SELECT 'flows' AS statistic, 'all' AS item, count(*) AS value FROM fl
UNION ALL SELECT 'flow_ips', 'all', count(DISTINCT src_ip) FROM fl
UNION ALL SELECT 'sessions', 'all', count(*) FROM ev WHERE eventid = 'cowrie.session.connect'
UNION ALL SELECT 'event_ips', 'all', count(DISTINCT src_ip) FROM ev
UNION ALL SELECT * FROM (SELECT 'top_port', CAST(dst_port AS VARCHAR), count(*) FROM fl GROUP BY dst_port ORDER BY count(*) DESC, dst_port LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'top_username', username, count(*) FROM ev WHERE contains(eventid, 'login') AND username IS NOT NULL GROUP BY username ORDER BY count(*) DESC, username LIMIT 5)""")
def headline_statistics(spark, sf):
    f, e = flows(spark, sf), attack_events(spark, sf)
    flow_totals = f.agg(F.count(F.lit(1)).alias("v"), F.count_distinct("src_ip").alias("ips")).withColumn("item", F.lit("all"))
    event_totals = e.agg(
        F.count_if(F.col("eventid") == "cowrie.session.connect").alias("v"), F.count_distinct("src_ip").alias("ips")
    ).withColumn("item", F.lit("all"))
    return R.long_statistics(
        [
            ("flows", flow_totals, "item", "v"),
            ("flow_ips", flow_totals, "item", "ips"),
            ("sessions", event_totals, "item", "v"),
            ("event_ips", event_totals, "item", "ips"),
            ("top_port", R.value_counts(f, "dst_port", 10), "dst_port", "n"),
            ("top_username", R.value_counts(e.filter(S.is_login()), "username", 5), "username", "n"),
        ]
    )


@query("a15_null_counts", E_ + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM ev"
    for c in ("event_id", "src_ip", "eventid", "username", "password", "duration")))
def null_counts(spark, sf):
    return Q.null_counts(attack_events(spark, sf).select("event_id", "src_ip", "eventid", "username", "password", "duration"))


@query("a16_rare_folding", F_ + """
, c AS (SELECT CAST(dst_port AS VARCHAR) AS port, count(*) AS n FROM fl GROUP BY dst_port),
s AS (SELECT port, n, n / sum(n) OVER () AS share FROM c)
SELECT CASE WHEN share < 0.01 THEN 'Other' ELSE port END AS port, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1""")
def rare_folding(spark, sf):
    return R.fold_rare(flows(spark, sf).select(F.col("dst_port").cast("string").alias("port")), "port")


@query("a17_top_lists", EF + """
SELECT * FROM (SELECT 'port' AS statistic, CAST(dst_port AS VARCHAR) AS item, count(*) AS value FROM fl GROUP BY dst_port ORDER BY value DESC, dst_port LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'username', username, count(*) AS n FROM ev WHERE username IS NOT NULL GROUP BY username ORDER BY n DESC, username LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'password', password, count(*) AS n FROM ev WHERE password IS NOT NULL GROUP BY password ORDER BY n DESC, password LIMIT 20)
UNION ALL SELECT 'event', replace(eventid, 'cowrie.', ''), count(*) FROM ev GROUP BY eventid""")
def top_lists(spark, sf):
    f, e = flows(spark, sf), attack_events(spark, sf)
    kinds = R.value_counts(e, "eventid").withColumn("eventid", F.replace("eventid", F.lit("cowrie."), F.lit("")))
    return R.long_statistics(
        [
            ("port", R.value_counts(f, "dst_port", 20), "dst_port", "n"),
            ("username", R.value_counts(e, "username", 20), "username", "n"),
            ("password", R.value_counts(e, "password", 20), "password", "n"),
            ("event", kinds, "eventid", "n"),
        ]
    )


# --- moving means and shares ---------------------------------------------------------------------

@query("n01_centred_mean_7d", E_ + """
, d AS (SELECT date, count(*) AS n FROM ev GROUP BY date)
SELECT CAST(date AS VARCHAR) AS date, n, CASE WHEN count(*) OVER w = 7 THEN round(avg(n) OVER w, 6) END AS mean_7d
FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def centred_mean_7d(spark, sf):
    days = R.daily_counts(attack_events(spark, sf))
    return _text_date(centred_mean(days, "n", "date", 3, "mean_7d"), "date").select("date", "n", _r("mean_7d"))


@query("n02_centred_mean_3d", E_ + """
, d AS (SELECT eventid, date, count(*) AS n FROM ev GROUP BY eventid, date)
SELECT eventid, CAST(date AS VARCHAR) AS date, n, CASE WHEN count(*) OVER w = 3 THEN round(avg(n) OVER w, 6) END AS mean_3d
FROM d WINDOW w AS (PARTITION BY eventid ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def centred_mean_3d(spark, sf):
    days = R.daily_counts(attack_events(spark, sf), keys=["eventid"])
    return _text_date(centred_mean(days, "n", "date", 1, "mean_3d", ["eventid"]), "date").select("eventid", "date", "n", _r("mean_3d"))


@query("n06_shares", E_ + """
, c AS (SELECT eventid, hour, count(*) AS n FROM ev GROUP BY eventid, hour)
SELECT eventid, hour, n, round(n / sum(n) OVER (PARTITION BY eventid), 6) AS share_of_event, round(n / sum(n) OVER (), 6) AS share_of_all FROM c""")
def shares(spark, sf):
    cells = R.pair_counts(attack_events(spark, sf), "eventid", "hour")
    cells = with_total_share(cells, "n", "share_of_all").withColumn("share_of_event", F.round(share("n", "eventid"), 6))
    return cells.withColumn("share_of_all", F.round("share_of_all", 6))


# --- sorts, limits, samples, sets ----------------------------------------------------------------

@query("t01_top_n", F_ + "SELECT dst_port, count(*) AS n FROM fl GROUP BY dst_port ORDER BY n DESC, dst_port LIMIT 20")
def top_n(spark, sf):
    return R.value_counts(flows(spark, sf), "dst_port", 20)


@query("t02_full_sort", F_ + "SELECT CAST(date AS VARCHAR) AS date, count(*) AS n FROM fl GROUP BY date ORDER BY n DESC, date")
def full_sort(spark, sf):
    return _text_date(R.daily_counts(flows(spark, sf)), "date").orderBy(F.desc("n"), "date")


@query("t03_arg_max", F_ + """
, c AS (SELECT src_ip, dst_port, count(*) AS n FROM fl GROUP BY src_ip, dst_port),
m AS (SELECT src_ip, dst_port, n, row_number() OVER (PARTITION BY src_ip ORDER BY n DESC, dst_port) AS r FROM c)
SELECT src_ip, dst_port AS top_port, n AS top_n FROM m WHERE r = 1""")
def arg_max(spark, sf):
    pairs = R.pair_counts(flows(spark, sf), "src_ip", "dst_port")
    best = F.max(F.struct("n", (-F.col("dst_port")).alias("p")))
    return pairs.groupBy("src_ip").agg(best.alias("b")).select("src_ip", (-F.col("b.p")).alias("top_port"), F.col("b.n").alias("top_n"))


@query("t04_uniform_sample")
def uniform_sample(spark, sf):
    return sampling.sample_rows(flows(spark, sf).select("flow_id", "src_ip", "dst_port"), "flow_id", 1000)


@query("t04b_sample_facts", F_ + "SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS n_distinct, least(count(*), 1000) AS n_members, count(*) AS n_source FROM fl")
def sample_facts(spark, sf):
    """The sample's size, that no row is in it twice, and that all its rows are the source's."""
    source = flows(spark, sf).select("flow_id", "src_ip", "dst_port")
    return sample_facts_of(uniform_sample(spark, sf), source)


def sample_facts_of(sample, source):
    """Size, distinct rows and rows of the source of a sample, and the source's size."""
    keyed = sample.join(source.select("flow_id", F.lit(1).alias("_in")), "flow_id", "left")
    facts = keyed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("flow_id").alias("n_distinct"), F.count("_in").alias("n_members"))
    return facts.select("*", source.agg(F.count(F.lit(1))).scalar().alias("n_source"))


@query("t05_group_cap", F_ + """
, r AS (SELECT proto, flow_id, row_number() OVER (PARTITION BY proto ORDER BY "timestamp", flow_id) AS rank FROM fl)
SELECT proto, flow_id, rank FROM r WHERE rank <= 200""")
def group_cap(spark, sf):
    rows = flows(spark, sf).select("proto", "flow_id", "timestamp")
    return first_n(rows, ["proto"], ["timestamp", "flow_id"], 200, "flow_id").select("proto", "flow_id", "rank")


@query("u01_union_by_name", EF + """
SELECT kind, count(*) AS n, count(dst_port) AS with_port, count(eventid) AS with_event FROM (
  SELECT 'flows' AS kind, src_ip, dst_port, NULL AS eventid FROM fl UNION ALL SELECT 'events', src_ip, NULL, eventid FROM ev) GROUP BY kind""")
def union_by_name(spark, sf):
    left = flows(spark, sf).select(F.lit("flows").alias("kind"), "src_ip", "dst_port")
    right = attack_events(spark, sf).select(F.lit("events").alias("kind"), "src_ip", "eventid")
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("dst_port").alias("with_port"), F.count("eventid").alias("with_event")
    )


@query("u02_common_addresses", EF + "SELECT src_ip AS ip FROM ev INTERSECT SELECT src_ip FROM fl")
def common_addresses(spark, sf):
    return attack_events(spark, sf).select(F.col("src_ip").alias("ip")).intersect(flows(spark, sf).select("src_ip"))


@query("u03_all_addresses", EF + "SELECT src_ip FROM ev UNION SELECT src_ip FROM fl")
def all_addresses(spark, sf):
    return attack_events(spark, sf).select("src_ip").union(flows(spark, sf).select("src_ip")).distinct()


@query("u04_missing_values", E_ + "SELECT v AS eventid FROM (VALUES "
       + ", ".join(f"('{v}')" for v in (*TARGET_EVENTS, "cowrie.client.version")) + ") t(v) EXCEPT SELECT eventid FROM ev")
def missing_values(spark, sf):
    expected = spark.createDataFrame([(v,) for v in (*TARGET_EVENTS, "cowrie.client.version")], "eventid string")
    return expected.exceptAll(attack_events(spark, sf).select("eventid").distinct())


@query("u05_distinct_keys", F_ + "SELECT DISTINCT src_ip, dst_port, proto FROM fl")
def distinct_keys(spark, sf):
    return flows(spark, sf).select("src_ip", "dst_port", "proto").distinct()


@query("s04_event_allow_list", """
WITH e AS (SELECT CASE event_type WHEN 'signup' THEN 'cowrie.session.connect' WHEN 'view' THEN 'cowrie.session.closed' WHEN 'click' THEN 'cowrie.login.failed' ELSE 'cowrie.' || event_type END AS eventid FROM events)
SELECT eventid IN ('cowrie.session.connect','cowrie.login.success','cowrie.login.failed','cowrie.command.input','cowrie.session.closed','cowrie.session.file_download') AS kept_flag, count(*) AS n FROM e GROUP BY 1"""
       .replace("AS kept_flag", "::INT AS kept"))
def event_allow_list(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "signup", "session.connect").when(kind == "view", "session.closed").when(kind == "click", "login.failed").otherwise(kind)
    raw = table(spark, sf, "events").select(F.concat(F.lit("cowrie."), name).alias("eventid"))
    return raw.groupBy(is_allowed().cast("int").alias("kept")).agg(F.count(F.lit(1)).alias("n"))
