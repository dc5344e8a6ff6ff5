"""Registered queries: per-address features, label rules, scalar expressions and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, scalars as S
from ..functions.entropy import entropy_of_counts, list_entropy, shannon_entropy
from ..functions.vocabulary import COMMON_PORTS, EVENT_CODES, PROTOCOL_CODES, STATE_CODES
from ..operators import cluster as C, features as FT, rollups as R, sequences as SQ
from .adapters import EV, FL, FLOW_ORDER, attack_events, flows, table, with_ctes
from .catalog import query

E_ = with_ctes(EV)
F_ = with_ctes(FL)
EF = with_ctes(EV, FL)

ENTROPY = "coalesce(list_entropy(list_filter(string_split({0}, ''), lambda x: x <> '')), 0.0)"

# Per-address pieces over the whole history.
ACT = """
act AS (
  SELECT src_ip, count(*) FILTER (WHERE contains(eventid, 'login')) AS total_attempts,
    count(*) FILTER (WHERE contains(eventid, 'login.success')) AS n_success,
    count(*) FILTER (WHERE contains(eventid, 'session.connect')) AS session_count,
    count(*) FILTER (WHERE contains(eventid, 'command.input')) AS n_commands,
    count(*) FILTER (WHERE contains(eventid, 'file_download')) AS n_downloads,
    coalesce(avg(duration) FILTER (WHERE contains(eventid, 'session.closed')), 0.0) AS duration_mean,
    count(DISTINCT hour) FILTER (WHERE contains(eventid, 'login')) AS unique_hours,
    coalesce(entropy(hour) FILTER (WHERE contains(eventid, 'login')), 0.0) AS hour_entropy,
    count(DISTINCT username) AS unique_usernames, count(DISTINCT password) AS unique_passwords
  FROM ev GROUP BY src_ip
)"""
PW = f"""
pw AS (
  SELECT src_ip, avg({ENTROPY.format('password')}) AS avg_password_entropy, avg(length(password)) AS avg_password_length
  FROM (SELECT DISTINCT src_ip, password FROM ev WHERE password IS NOT NULL) GROUP BY src_ip
)"""
GAPS = """
gaps AS (
  SELECT src_ip, coalesce(avg(gap) FILTER (WHERE gap > 0 AND gap < 86400000000) / 1e6, 0.0) AS avg_time_between
  FROM (SELECT src_ip, epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY src_ip ORDER BY "timestamp", event_id) AS gap
        FROM ev WHERE contains(eventid, 'login')) GROUP BY src_ip
)"""
SF = """
sf AS (
  SELECT act.src_ip, total_attempts, unique_usernames, unique_passwords,
    least(unique_usernames * unique_passwords, total_attempts) AS unique_combos,
    n_success / greatest(total_attempts, 1) AS success_rate, coalesce(avg_time_between, 0.0) AS avg_time_between, session_count,
    n_commands / greatest(session_count, 1) AS commands_per_session, unique_hours, hour_entropy,
    coalesce(avg_password_entropy, 0.0) AS avg_password_entropy, coalesce(avg_password_length, 0.0) AS avg_password_length,
    total_attempts / greatest(unique_passwords, 1) AS password_reuse_ratio, duration_mean,
    CAST(n_downloads > 0 AS INT) AS has_file_download, n_success, n_commands, n_downloads
  FROM act LEFT JOIN pw USING (src_ip) LEFT JOIN gaps USING (src_ip) WHERE total_attempts >= 5
)"""
ESF = with_ctes(EV, ACT, PW, GAPS, SF)
FF = """
ff AS (
  SELECT src_ip, count(*) AS flow_count, count(DISTINCT dst_port) AS unique_dst_ports, count(DISTINCT dst_ip) AS unique_dst_ips,
    coalesce(avg(duration), 0.0) AS avg_flow_duration, count(DISTINCT proto) AS proto_diversity
  FROM fl GROUP BY src_ip HAVING count(*) >= 5
)"""
FFF = with_ctes(FL, FF)

DOUBLES = {
    "success_rate", "avg_time_between", "commands_per_session", "hour_entropy", "avg_password_entropy", "avg_password_length",
    "password_reuse_ratio", "duration_mean", "avg_flow_duration",
}


# Means of whole microseconds often end in exactly half a digit; the nudge makes both engines round
# such ties the same way.
NUDGE = 1e-9


def _sql(columns) -> str:
    return ", ".join(f"round({c} + {NUDGE}, 6) AS {c}" if c in DOUBLES else c for c in columns)


def _steady(name: str):
    return F.round(F.col(name) + NUDGE, 6).alias(name)


def _cols(columns):
    return [_steady(c) if c in DOUBLES else F.col(c) for c in columns]


# --- F1 to F13: the features, each by the cheapest plan that yields it --------------------------------

@query("f01_total_attempts", E_ + "SELECT src_ip, count(*) AS total_attempts FROM ev WHERE contains(eventid, 'login') GROUP BY src_ip HAVING count(*) >= 5")
def total_attempts(spark, sf):
    counts = FT.logins_of(attack_events(spark, sf)).groupBy("src_ip").agg(F.count(F.lit(1)).alias("total_attempts"))
    return counts.filter(F.col("total_attempts") >= 5)


@query("f02_unique_credentials", E_ + "SELECT src_ip, count(DISTINCT username) AS unique_usernames, count(DISTINCT password) AS unique_passwords FROM ev WHERE contains(eventid, 'login') GROUP BY src_ip")
def unique_credentials(spark, sf):
    return FT.credentials(FT.logins_of(attack_events(spark, sf))).select("src_ip", "unique_usernames", "unique_passwords")


def _session_query(name: str, *columns: str) -> None:
    def run(spark, sf):
        return FT.session_features(attack_events(spark, sf)).select("src_ip", *_cols(columns))

    query(name, ESF + f"SELECT src_ip, {_sql(columns)} FROM sf")(run)


_session_query("f03_unique_combos", "unique_combos")
_session_query("f04_success_rate", "success_rate")


@query("f05_avg_time_between", with_ctes(EV, GAPS) + "SELECT src_ip, round(avg_time_between + 1e-9, 6) AS avg_time_between FROM gaps")
def avg_time_between(spark, sf):
    return FT.login_gaps(FT.logins_of(attack_events(spark, sf))).select("src_ip", *_cols(["avg_time_between"]))


_session_query("f06_sessions_and_commands", "session_count", "commands_per_session")
_session_query("f07_hour_diversity", "unique_hours", "hour_entropy")


@query("f08_password_strength", with_ctes(EV, PW) + "SELECT src_ip, round(avg_password_entropy + 1e-9, 6) AS avg_password_entropy, round(avg_password_length + 1e-9, 6) AS avg_password_length FROM pw")
def password_strength(spark, sf):
    strength = FT.credentials(FT.logins_of(attack_events(spark, sf))).filter(F.col("unique_passwords") > 0)
    return strength.select("src_ip", *_cols(["avg_password_entropy", "avg_password_length"]))


_session_query("f09_password_reuse", "password_reuse_ratio")
_session_query("f10_duration_mean", "duration_mean")
_session_query("f11_file_download", "has_file_download")
_session_query("f12_session_features", *FT.SESSION_FEATURES)


@query("f13_flow_features", FFF + f"SELECT src_ip, {_sql(FT.FLOW_FEATURES)} FROM ff")
def flow_features(spark, sf):
    return FT.flow_features(flows(spark, sf)).select("src_ip", *_cols(FT.FLOW_FEATURES))


# --- labels and label tables ---------------------------------------------------------------------

R1 = "CASE WHEN CAST(n_commands / greatest(session_count, 1) >= 1 AS INT) + CAST(n_downloads > 0 AS INT) + CAST(duration_mean > 10 AS INT) + CAST(success_rate > 0.5 AS INT) >= 2 THEN 'Manual' ELSE 'Bot' END"
R2 = "CASE WHEN avg_flow_duration < 0.5 AND proto_diversity <= 1 THEN 'Bot' ELSE 'Manual' END"
R3 = "CASE WHEN (n_commands > 0 OR n_downloads > 0) AND n_success > 0 THEN 'High' WHEN (n_success > 0 AND n_commands = 0) OR (total_attempts > 50 AND duration_mean > 5) THEN 'Medium' ELSE 'Low' END"
R4 = "CASE WHEN unique_dst_ports > 20 AND flow_count > 500 THEN 'Aggressive' WHEN unique_dst_ports > 20 THEN 'Recon' WHEN unique_dst_ports <= 5 AND flow_count > 10 THEN 'Targeted' ELSE 'Recon' END"
R5 = "CASE WHEN (n_commands > 0 OR n_downloads > 0) AND n_success > 0 THEN 'High' WHEN n_success > 0 THEN 'Medium' ELSE 'Low' END"


@query("f14_labelled_sessions", ESF + f"""
SELECT src_ip, {_sql(FT.LOGIN_SIDE)}, {R1} AS label, n_commands AS _commands, n_downloads AS _downloads, session_count AS _sessions,
  round(duration_mean + 1e-9, 6) AS _duration_mean, round(success_rate + 1e-9, 6) AS _success_rate FROM sf WHERE session_count >= 1""")
def labelled_sessions(spark, sf):
    t = FT.labelled_sessions(attack_events(spark, sf))
    return t.select(
        "src_ip", *_cols(FT.LOGIN_SIDE), "label", "_commands", "_downloads", "_sessions",
        _steady("_duration_mean"), _steady("_success_rate"),
    )


@query("f15_labelled_flows", FFF + f"""
SELECT src_ip, flow_count, unique_dst_ports, unique_dst_ips, {R2} AS label, round(avg_flow_duration + 1e-9, 6) AS _avg_duration, proto_diversity AS _proto_diversity FROM ff""")
def labelled_flows(spark, sf):
    return FT.labelled_flows(flows(spark, sf)).withColumn("_avg_duration", _steady("_avg_duration"))


@query("r01_session_actor", ESF + f"SELECT {R1} AS label, count(*) AS n FROM sf GROUP BY 1")
def session_actor(spark, sf):
    t = FT.session_features(attack_events(spark, sf), keep_counts=True)
    c = F.col
    label = rules.session_actor(c("n_commands"), c("session_count"), c("n_downloads"), c("duration_mean"), c("success_rate"))
    return t.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("r02_flow_actor", FFF + f"SELECT {R2} AS label, count(*) AS n FROM ff GROUP BY 1")
def flow_actor(spark, sf):
    return FT.labelled_flows(flows(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("r03_threat_level", with_ctes(EV, ACT) + f"SELECT src_ip, {R3} AS label FROM act WHERE total_attempts >= 10")
def threat_level(spark, sf):
    return FT.threat_labels(attack_events(spark, sf), 10).select("src_ip", F.col("threat_label").alias("label"))


@query("r04_flow_behaviour", FFF + f"SELECT src_ip, {R4} AS label FROM ff WHERE flow_count >= 20")
def flow_behaviour(spark, sf):
    return FT.behaviour_labels(flows(spark, sf), 20).select("src_ip", F.col("behavior_label").alias("label"))


@query("r05_window_threat", with_ctes(EV, ACT) + f"SELECT src_ip, {R5} AS label FROM act WHERE total_attempts >= 10")
def window_threat(spark, sf):
    return FT.threat_labels(attack_events(spark, sf), 10).select("src_ip", F.col("window_label").alias("label"))


# --- early windows --------------------------------------------------------------------------------

LOGINS = """
lg AS (
  SELECT src_ip, event_id, "timestamp", hour, eventid, nullif(username, '') AS username, nullif(password, '') AS password,
    row_number() OVER w AS rank, count(*) OVER (PARTITION BY src_ip) AS n_logins,
    epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER w AS gap0
  FROM ev WHERE contains(eventid, 'login') WINDOW w AS (PARTITION BY src_ip ORDER BY "timestamp", event_id)
), lgg AS (SELECT *, CASE WHEN gap0 > 0 AND gap0 < 86400000000 THEN gap0 END AS gap FROM lg)"""


@query("f16_early_sessions", with_ctes(EV, ACT, LOGINS) + f"""
, e AS (SELECT * FROM lgg WHERE rank <= greatest(3, floor(n_logins * CAST(0.3 AS DOUBLE)))),
p AS (SELECT src_ip, avg({ENTROPY.format('password')}) AS pe, avg(length(password)) AS pl FROM (SELECT DISTINCT src_ip, password FROM e WHERE password IS NOT NULL) GROUP BY src_ip),
s AS (SELECT src_ip, count(*) AS n, count(DISTINCT username) AS u, count(DISTINCT password) AS pw, count(*) FILTER (WHERE contains(eventid, 'login.success')) AS wins,
  coalesce(avg(gap) / 1e6, 0.0) AS ga, coalesce(min(gap) / 1e6, 0.0) AS gm, coalesce(stddev_pop(gap) / 1e6, 0.0) AS gs, count(DISTINCT hour) AS hrs FROM e GROUP BY src_ip)
SELECT s.src_ip, n AS early_attempt_count, u AS early_unique_users, pw AS early_unique_passwords, round(wins / n + 1e-9, 6) AS early_success_rate,
  round(ga + 1e-9, 6) AS early_avg_time_between, round(gm + 1e-9, 6) AS early_min_time_between, round(gs + 1e-9, 6) AS early_std_time_between,
  round(coalesce(pe, 0.0) + 1e-9, 6) AS early_password_entropy, round(coalesce(pl, 0.0) + 1e-9, 6) AS early_password_length, round(n / greatest(pw, 1) + 1e-9, 6) AS early_password_reuse,
  hrs AS early_unique_hours, {R3} AS threat_label, total_attempts AS _total_logins, n_commands AS _total_commands, n_downloads AS _total_downloads,
  n_success AS _total_success, round(duration_mean + 1e-9, 6) AS _avg_duration
FROM s LEFT JOIN p USING (src_ip) JOIN act USING (src_ip) WHERE total_attempts >= 10""")
def early_sessions(spark, sf):
    t = FT.early_sessions(attack_events(spark, sf))
    doubles = [c for c, d in t.dtypes if d == "double"]
    return t.withColumns({c: _steady(c) for c in doubles})


_COMMON_SQL = "(" + ", ".join(map(str, COMMON_PORTS)) + ")"
FIRST_FLOWS = """
r AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY "timestamp", flow_id) AS rank FROM fl)"""
_FLOW_AGG = f"""count(DISTINCT dst_port) AS early_unique_ports, round(coalesce(avg(duration), 0.0) + 1e-9, 6) AS early_avg_duration,
  round(coalesce(stddev_pop(duration), 0.0) + 1e-9, 6) AS early_std_duration, count(DISTINCT proto) AS early_proto_diversity,
  round(coalesce(entropy(dst_port), 0.0) + 1e-9, 6) AS early_port_entropy,
  round(count(*) FILTER (WHERE dst_port IN {_COMMON_SQL}) / count(dst_port) + 1e-9, 6) AS early_common_port_ratio"""


@query("f17_early_flows", with_ctes(FL, FF, FIRST_FLOWS) + f"""
, s AS (SELECT src_ip, {_FLOW_AGG} FROM r WHERE rank <= 10 GROUP BY src_ip)
SELECT s.*, {R4} AS behavior_label, flow_count AS _total_flows, unique_dst_ports AS _all_unique_ports, unique_dst_ips AS _all_unique_ips,
  round(avg_flow_duration + 1e-9, 6) AS _all_avg_duration FROM s JOIN ff USING (src_ip) WHERE flow_count >= 20""")
def early_flows(spark, sf):
    t = FT.early_flows(flows(spark, sf), FLOW_ORDER, "flow_id")
    return t.withColumns({c: _steady(c) for c, d in t.dtypes if d == "double"})


EVENT_WINDOWS = (3, 5, 10)


@query("f18_session_windows", with_ctes(EV, ACT, LOGINS) + f"""
, w AS (SELECT lgg.*, CAST(n AS INT) AS window_n FROM lgg JOIN (VALUES (3), (5), (10)) v(n) ON rank <= n),
p AS (SELECT src_ip, window_n, avg({ENTROPY.format('password')}) AS pe, avg(length(password)) AS pl FROM (SELECT DISTINCT src_ip, window_n, password FROM w WHERE password IS NOT NULL) GROUP BY ALL),
s AS (SELECT src_ip, window_n, count(DISTINCT password) AS pw, coalesce(avg(gap) / 1e6, 0.0) AS ga, coalesce(stddev_pop(gap) / 1e6, 0.0) AS gs FROM w GROUP BY ALL)
SELECT s.src_ip, s.window_n, pw AS unique_passwords, round(ga + 1e-9, 6) AS avg_time_between, round(gs + 1e-9, 6) AS std_time_between, round(coalesce(pe, 0.0) + 1e-9, 6) AS password_entropy,
  round(coalesce(pl, 0.0) + 1e-9, 6) AS password_length, round(s.window_n / greatest(pw, 1) + 1e-9, 6) AS password_reuse, {R5} AS label
FROM s LEFT JOIN p ON p.src_ip = s.src_ip AND p.window_n = s.window_n JOIN act ON act.src_ip = s.src_ip WHERE total_attempts >= 15""")
def session_windows(spark, sf):
    t = FT.session_windows(attack_events(spark, sf), EVENT_WINDOWS)
    return t.withColumns({c: _steady(c) for c, d in t.dtypes if d == "double"})


FLOW_WINDOWS = (5, 10, 20, 30, 50)


@query("f19_flow_windows", with_ctes(FL, FF, FIRST_FLOWS) + f"""
, w AS (SELECT r.*, CAST(n AS INT) AS window_n FROM r JOIN (VALUES (5), (10), (20), (30), (50)) v(n) ON rank <= n),
s AS (SELECT src_ip, window_n, {_FLOW_AGG} FROM w GROUP BY src_ip, window_n)
SELECT s.*, {R4} AS label FROM s JOIN ff USING (src_ip) WHERE flow_count >= 60""")
def flow_windows(spark, sf):
    t = FT.flow_windows(flows(spark, sf), FLOW_ORDER, "flow_id", FLOW_WINDOWS)
    return t.withColumns({c: _steady(c) for c, d in t.dtypes if d == "double"})


# --- joins of feature and label tables --------------------------------------------------------------

@query("j04_feature_merge", with_ctes(EV, ACT, PW, GAPS, SF, FL, FF) + """
, common AS (SELECT count(*) AS n FROM (SELECT src_ip FROM sf INTERSECT SELECT src_ip FROM ff))
SELECT sf.src_ip, total_attempts, flow_count, ff.proto_diversity, common.n AS n_common FROM common, sf LEFT JOIN ff ON ff.src_ip = sf.src_ip""")
def feature_merge(spark, sf):
    merged, common = FT.merge_features(FT.session_features(attack_events(spark, sf)), FT.flow_features(flows(spark, sf)))
    return merged.select("src_ip", "total_attempts", "flow_count", "proto_diversity", common.scalar().alias("n_common"))


@query("j05_label_merge", with_ctes(EV, ACT) + f"""
SELECT src_ip, {R3} AS rule_label, {R5} AS other_label FROM act WHERE total_attempts >= 10""")
def label_merge(spark, sf):
    labels = FT.threat_labels(attack_events(spark, sf), 10)
    first = labels.select("src_ip", F.col("threat_label").alias("rule_label"))
    second = labels.select("src_ip", F.col("window_label").alias("other_label"))
    return first.join(second, "src_ip")


@query("j06_labelled_events", with_ctes(EV, ACT) + """
SELECT eventid, count(*) AS n FROM ev WHERE src_ip IN (SELECT src_ip FROM act WHERE (total_attempts >= 10 AND n_success > 0) OR n_downloads > 0) GROUP BY eventid""")
def labelled_events(spark, sf):
    events = attack_events(spark, sf)
    profile = FT.activity(events)
    first = profile.filter((F.col("total_attempts") >= 10) & (F.col("n_success") > 0)).select("src_ip")
    valid = first.union(profile.filter(F.col("n_downloads") > 0).select("src_ip")).distinct()
    return R.value_counts(events.select("src_ip", "eventid").join(valid, "src_ip", "left_semi"), "eventid")


# --- profiles of the feature tables -------------------------------------------------------------------

@query("a23_feature_profile", ESF + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round(CAST(min({c}) AS DOUBLE) + 1e-9, 6) AS min, round(CAST(max({c}) AS DOUBLE) + 1e-9, 6) AS max, round(avg({c}) + 1e-9, 6) AS mean FROM sf"
    for c in FT.SESSION_FEATURES))
def feature_profile(spark, sf):
    profile = R.feature_profile(FT.session_features(attack_events(spark, sf)), FT.SESSION_FEATURES)
    return profile.select("feature", *[_steady(c) for c in ("min", "max", "mean")])


@query("a24_label_distribution", ESF + f"""
, l AS (SELECT {R1} AS label, total_attempts FROM sf WHERE session_count >= 1)
SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct, round(sum(total_attempts) * 100.0 / sum(sum(total_attempts)) OVER (), 6) AS measure_pct FROM l GROUP BY label""")
def label_distribution(spark, sf):
    t = R.distribution(FT.labelled_sessions(attack_events(spark, sf)), "label", "total_attempts")
    return t.select("label", "n", F.round("pct", 6).alias("pct"), F.round("measure_pct", 6).alias("measure_pct"))


SUMMARY = ("total_attempts", "avg_time_between", "hour_entropy", "password_reuse_ratio")


@query("a25_cluster_summary", with_ctes(EV, ACT, PW, GAPS, SF) + f"""
, l AS (SELECT {R1} AS cluster, * FROM sf WHERE session_count >= 1)
""" + "\nUNION ALL ".join(
    f"SELECT cluster, '{c}' AS feature, round(avg({c}) + 1e-9, 6) AS mean, round(median(CAST({c} AS DOUBLE)) + 1e-9, 6) AS median, round(stddev_samp({c}) + 1e-9, 6) AS std, count(*) AS n FROM l GROUP BY cluster"
    for c in SUMMARY))
def cluster_summary(spark, sf):
    t = FT.labelled_sessions(attack_events(spark, sf)).withColumnRenamed("label", "cluster")
    s = C.cluster_summary(t, SUMMARY)
    return s.select("cluster", "feature", *[_steady(c) for c in ("mean", "median", "std")], "n")


@query("a26_histogram", FFF + f"""
, x AS (SELECT {R2} AS label, ln(1 + orig_bytes) AS v FROM fl JOIN ff USING (src_ip)),
b AS (SELECT label, min(v) AS lo, max(v) AS hi FROM x GROUP BY label)
SELECT x.label, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((v - lo) / ((hi - lo) / 50)) + 1, 50) END AS INT) AS bin, count(*) AS n FROM x JOIN b ON b.label = x.label GROUP BY 1, 2""")
def histogram(spark, sf):
    f = flows(spark, sf)
    labelled = f.select("src_ip", "orig_bytes").join(FT.labelled_flows(f).select("src_ip", "label"), "src_ip")
    return R.histogram(labelled, "orig_bytes", ["label"], 50, log=True)


# --- scalar expressions ---------------------------------------------------------------------------

@query("x01_string_entropy", f"SELECT doc_id, round({ENTROPY.format('text')}, 6) AS entropy FROM documents")
def string_entropy(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(shannon_entropy("text"), 6).alias("entropy"))


@query("x02_distribution_entropy", F_ + """
SELECT src_ip, round(entropy(dst_port), 6) AS port_entropy, round(entropy(proto), 6) AS proto_entropy FROM fl GROUP BY src_ip""")
def distribution_entropy(spark, sf):
    cells = flows(spark, sf).groupBy("src_ip", "dst_port", "proto").agg(F.count(F.lit(1)).alias("n"))
    port = cells.groupBy("src_ip", "dst_port").agg(F.sum("n").alias("n")).groupBy("src_ip").agg(F.round(entropy_of_counts(F.col("n")), 6).alias("port_entropy"))
    proto = cells.groupBy("src_ip", "proto").agg(F.sum("n").alias("n")).groupBy("src_ip").agg(F.round(entropy_of_counts(F.col("n")), 6).alias("proto_entropy"))
    return port.join(proto, "src_ip")


@query("x02b_list_entropy", with_ctes(FL, FIRST_FLOWS) + """
SELECT src_ip, round(entropy(dst_port), 6) AS port_entropy FROM r WHERE rank <= 20 GROUP BY src_ip""")
def bounded_list_entropy(spark, sf):
    first = FT.first_flows(flows(spark, sf), 20, FLOW_ORDER, "flow_id")
    return first.groupBy("src_ip").agg(F.round(list_entropy(F.collect_list("dst_port")), 6).alias("port_entropy"))


@query("x03_strings", E_ + """
SELECT event_id, upper(lower(eventid)) AS shouted, CAST(starts_with(username, 'user1') AS INT) AS one, length(coalesce(password, '')) AS size,
  replace(eventid, 'cowrie.', '') AS short, substring(eventid, 8, 5) AS part, src_ip || '/' || eventid AS joined FROM ev WHERE username IS NOT NULL""")
def strings(spark, sf):
    e = attack_events(spark, sf).filter(F.col("username").isNotNull())
    return e.select(
        "event_id", F.upper(F.lower("eventid")).alias("shouted"), F.startswith("username", F.lit("user1")).cast("int").alias("one"),
        F.length(F.coalesce("password", F.lit(""))).alias("size"), F.replace("eventid", F.lit("cowrie."), F.lit("")).alias("short"),
        F.substring("eventid", 8, 5).alias("part"), F.concat("src_ip", F.lit("/"), "eventid").alias("joined"),
    )


@query("x04_dates", F_ + """
SELECT flow_id, CAST(date AS VARCHAR) AS date, hour, day_of_week, strftime(date, '%Y-%m') AS month, date_diff('day', DATE '1995-01-01', date) AS days,
  CAST(epoch_us("timestamp") // 1000000 AS BIGINT) AS seconds FROM fl""")
def dates(spark, sf):
    return flows(spark, sf).select(
        "flow_id", F.col("date").cast("string").alias("date"), "hour", "day_of_week", S.month_key("date").alias("month"),
        F.datediff("date", F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"),
        F.floor(S.micros("timestamp") / 1_000_000).cast("bigint").alias("seconds"),
    )


@query("x05_math", F_ + """
SELECT flow_id, round(ln(1 + duration), 6) AS log1p_d, round(exp(duration) - 1, 4) AS expm1_d, round(log2(orig_bytes + 1), 6) AS log2_b, round(log10(resp_bytes + 1), 6) AS log10_b,
  round(sqrt(orig_bytes), 6) AS root, abs(dst_port - 8000) AS away, round(least(greatest(duration, 1.0), 5.0), 6) AS clamped,
  round(orig_bytes / greatest(resp_bytes - 1003, 1), 6) AS ratio, CASE WHEN duration > 5 THEN 0.0 ELSE round(duration, 6) END AS finite_d FROM fl""")
def math(spark, sf):
    c = F.col
    odd = F.when(c("duration") > 9, F.lit(float("nan"))).when(c("duration") > 5, F.lit(float("inf"))).otherwise(c("duration"))
    return flows(spark, sf).select(
        "flow_id", F.round(F.log1p("duration"), 6).alias("log1p_d"), F.round(F.expm1("duration"), 4).alias("expm1_d"),
        F.round(F.log2(c("orig_bytes") + 1), 6).alias("log2_b"), F.round(F.log10(c("resp_bytes") + 1), 6).alias("log10_b"),
        F.round(F.sqrt("orig_bytes"), 6).alias("root"), F.abs(c("dst_port") - 8000).alias("away"),
        F.round(S.clamp(c("duration"), 1, 5), 6).alias("clamped"), F.round(S.per(c("orig_bytes"), c("resp_bytes") - 1003), 6).alias("ratio"),
        F.round(S.finite(odd), 6).alias("finite_d"),
    )


@query("x08_json_fields", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def json_fields(spark, sf):
    parsed = F.from_json("props", "k double, missing string")
    rows = table(spark, sf, "events").select("event_id", parsed.alias("p"))
    return rows.select("event_id", F.col("p").getField("k").alias("k"), F.coalesce(F.col("p").getField("missing"), F.lit("none")).alias("missing"))


_X9 = ("flow_count", "unique_dst_ports", "avg_flow_duration", "proto_diversity")


@query("x09_log_if_skewed", FFF + ", m AS (SELECT " + ", ".join(f"max({c}) AS m_{c}" for c in _X9) + " FROM ff)\nSELECT src_ip, " + ", ".join(
    f"round(CASE WHEN m_{c} > 100 THEN ln(1 + {c}) ELSE {c} END, 6) AS {c}" for c in _X9) + " FROM ff, m")
def log_if_skewed(spark, sf):
    t, _ = C.log_if_skewed(FT.flow_features(flows(spark, sf)), _X9)
    return t.select("src_ip", *[F.round(c, 6).alias(c) for c in _X9])


# --- sequences ------------------------------------------------------------------------------------

SEQ_LEN = 20


def _case(column: str, mapping: dict, default: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


EVENT_STEPS = f"""
st0 AS (
  SELECT *, row_number() OVER w AS rank, lag("timestamp") OVER w AS prev FROM ev WINDOW w AS (PARTITION BY src_ip ORDER BY "timestamp", event_id)
), st AS (
  SELECT src_ip, rank, ln(1 + coalesce((epoch_us("timestamp") - epoch_us(prev)) / 1e6, 0.0)) AS v0, hour / 23.0 AS v1,
    length(coalesce(username, '')) / 32.0 AS v2, length(coalesce(password, '')) / 32.0 AS v3,
    {ENTROPY.format('password')} / 8.0 AS v4, CAST(CAST(eventid = 'cowrie.login.success' AS INT) AS DOUBLE) AS v5,
    {_case('eventid', EVENT_CODES, 0)} / 7.0 AS v6
  FROM st0 WHERE rank <= {SEQ_LEN}
)"""
FLOW_STEPS = f"""
st0 AS (
  SELECT *, row_number() OVER w AS rank, lag("timestamp") OVER w AS prev FROM fl WINDOW w AS (PARTITION BY src_ip ORDER BY "timestamp", flow_id)
), st AS (
  SELECT src_ip, rank, ln(1 + coalesce((epoch_us("timestamp") - epoch_us(prev)) / 1e6, 0.0)) AS v0, hour / 23.0 AS v1, ln(1 + duration) AS v2,
    ln(1 + orig_bytes) AS v3, ln(1 + resp_bytes) AS v4, dst_port / 65535.0 AS v5, {_case('proto', PROTOCOL_CODES, 3)} / 3.0 AS v6,
    {_case('conn_state', STATE_CODES, 12)} / 12.0 AS v7
  FROM st0 WHERE rank <= {SEQ_LEN}
)"""


def _steps_sql(dims: int) -> str:
    return "SELECT src_ip, rank, " + ", ".join(f"round(v{i}, 6) AS v{i}" for i in range(dims)) + " FROM st"


def _steps(df, dims: int):
    return df.select("src_ip", "rank", *[F.round(F.col("vec")[i], 6).alias(f"v{i}") for i in range(dims)])


@query("x06_event_vectors", with_ctes(EV, EVENT_STEPS) + _steps_sql(7))
def event_vectors(spark, sf):
    return _steps(SQ.first_steps(attack_events(spark, sf), "events", SEQ_LEN, ["timestamp", "event_id"], "event_id"), 7)


@query("x06b_flow_vectors", with_ctes(FL, FLOW_STEPS) + _steps_sql(8))
def flow_vectors(spark, sf):
    return _steps(SQ.first_steps(flows(spark, sf), "flows", SEQ_LEN, FLOW_ORDER, "flow_id"), 8)


def event_sequences(spark, sf, seq_len: int = SEQ_LEN, valid=None):
    return SQ.build_sequences(attack_events(spark, sf), "events", seq_len, ["timestamp", "event_id"], "event_id", valid)


def flow_sequences(spark, sf, seq_len: int = SEQ_LEN, valid=None):
    return SQ.build_sequences(flows(spark, sf), "flows", seq_len, FLOW_ORDER, "flow_id", valid)


def _total(array):
    return F.aggregate(F.flatten(array), F.lit(0.0), lambda a, v: a + v)


@query("x07_padded_sequences", with_ctes(FL, FLOW_STEPS) + f"""
SELECT src_ip, count(*) AS n_steps, {SEQ_LEN} AS seq_len, round(sum(v0 + v1 + v2 + v3 + v4 + v5 + v6 + v7), 4) AS total,
  CASE WHEN count(*) = {SEQ_LEN} THEN round(arg_min(v3, rank), 6) ELSE 0.0 END AS first_v3 FROM st GROUP BY src_ip""")
def padded_sequences(spark, sf):
    s = flow_sequences(spark, sf)
    return s.select("src_ip", "n_steps", F.size("seq").alias("seq_len"), F.round(_total("seq"), 4).alias("total"), F.round(F.col("seq")[0][3], 6).alias("first_v3"))


@query("j07_labelled_sequences", with_ctes(EV, ACT, EVENT_STEPS) + f"""
SELECT st.src_ip, {R3} AS label, count(*) AS n_steps, round(sum(v0 + v1 + v2 + v3 + v4 + v5 + v6), 4) AS total
FROM st JOIN act USING (src_ip) WHERE total_attempts >= 10 GROUP BY ALL""")
def labelled_sequences(spark, sf):
    labels = FT.threat_labels(attack_events(spark, sf), 10).select("src_ip", F.col("threat_label").alias("label"))
    s = SQ.attach_labels(event_sequences(spark, sf, valid=labels.select("src_ip")), labels)
    return s.select("src_ip", "label", "n_steps", F.round(_total("seq"), 4).alias("total"))


@query("m27_sequence_zscore", with_ctes(FL, FLOW_STEPS) + ", m AS (SELECT " + ", ".join(
    f"avg(v{i}) AS a{i}, stddev_pop(v{i}) + 1e-8 AS d{i}" for i in range(8)
) + " FROM st WHERE coalesce(TRY_CAST(split_part(src_ip, '.', 2) AS INT) % 5 <> 0, true))\nSELECT src_ip, count(*) AS n_steps, "
    + ", ".join(f"round(sum((v{i} - a{i}) / d{i}), 4) AS z{i}" for i in (0, 1, 3, 5)) + " FROM st, m GROUP BY src_ip")
def sequence_zscore(spark, sf):
    training = F.coalesce(F.get(F.split("src_ip", r"\."), F.lit(1)).try_cast("int") % 5 != 0, F.lit(True))
    z = SQ.standardise_sequences(flow_sequences(spark, sf), training)
    total = lambda i: F.aggregate(F.transform("seq", lambda s: s[i]), F.lit(0.0), lambda a, v: a + v)
    return z.select("src_ip", "n_steps", *[F.round(total(i), 4).alias(f"z{i}") for i in (0, 1, 3, 5)])


@query("m28_class_weights", with_ctes(EV, ACT) + f"""
, c AS (SELECT {R3} AS label, count(*) AS n FROM act WHERE total_attempts >= 10 GROUP BY 1),
w AS (SELECT label, n, sqrt(sum(n) OVER () / (count(*) OVER () * n)) AS raw FROM c)
SELECT label, n, round(raw / avg(raw) OVER (), 6) AS weight FROM w""")
def class_weights(spark, sf):
    labels = FT.threat_labels(attack_events(spark, sf), 10).select(F.col("threat_label").alias("label"))
    return SQ.class_weights(labels).withColumn("weight", F.round("weight", 6))
