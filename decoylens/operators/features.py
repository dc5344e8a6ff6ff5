"""Behaviour features per source address, from session events and from network flows.

All tables are built from algebraic aggregates with map-side combine. Distinct credentials are
collapsed on (address, kind, value) before they are counted per address, so a heavy address is
spread over many tasks until only its summary is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules
from ..functions.entropy import entropy_of_counts, list_entropy, shannon_entropy
from ..functions.scalars import MICROS, has_part, is_login, micros, per
from ..functions.vocabulary import COMMON_PORTS
from .ordered import DAY_MICROS, first_fraction, first_n, gap_seconds, mean_gap

SESSION_FEATURES = (
    "total_attempts", "unique_usernames", "unique_passwords", "unique_combos", "success_rate",
    "avg_time_between", "session_count", "commands_per_session", "unique_hours", "hour_entropy",
    "avg_password_entropy", "avg_password_length", "password_reuse_ratio", "duration_mean", "has_file_download",
)
FLOW_FEATURES = ("flow_count", "unique_dst_ports", "unique_dst_ips", "avg_flow_duration", "proto_diversity")
LOGIN_SIDE = (
    "total_attempts", "unique_usernames", "unique_passwords", "unique_combos", "avg_time_between",
    "unique_hours", "hour_entropy", "avg_password_entropy", "avg_password_length", "password_reuse_ratio",
)
EARLY_EVENT_FEATURES = (
    "early_attempt_count", "early_unique_users", "early_unique_passwords", "early_success_rate",
    "early_avg_time_between", "early_min_time_between", "early_std_time_between", "early_password_entropy",
    "early_password_length", "early_password_reuse", "early_unique_hours",
)
EARLY_FLOW_FEATURES = (
    "early_unique_ports", "early_avg_duration", "early_std_duration",
    "early_proto_diversity", "early_port_entropy", "early_common_port_ratio",
)
WINDOW_EVENT_FEATURES = (
    "unique_passwords", "avg_time_between", "std_time_between", "password_entropy", "password_length", "password_reuse",
)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def logins_of(events: DataFrame) -> DataFrame:
    return events.filter(is_login("eventid") & F.col("src_ip").isNotNull())


# --- full-history pieces -------------------------------------------------------------------------

def activity(events: DataFrame) -> DataFrame:
    """Counts per address over all event types, with hour diversity of the logins.

    The first aggregate is per (address, hour): at most 24 rows per address leave it.
    """
    e = F.col("eventid")
    closed = F.when(has_part(e, "session.closed"), F.col("duration"))
    per_hour = (
        events.filter(F.col("src_ip").isNotNull())
        .groupBy("src_ip", "hour")
        .agg(
            F.count_if(is_login(e)).alias("logins"),
            F.count_if(has_part(e, "login.success")).alias("success"),
            F.count_if(has_part(e, "session.connect")).alias("sessions"),
            F.count_if(has_part(e, "command.input")).alias("commands"),
            F.count_if(has_part(e, "file_download")).alias("downloads"),
            F.sum(closed).alias("dur_sum"),
            F.count(closed).alias("dur_n"),
        )
    )
    return per_hour.groupBy("src_ip").agg(
        F.sum("logins").alias("total_attempts"),
        F.sum("success").alias("n_success"),
        F.sum("sessions").alias("session_count"),
        F.sum("commands").alias("n_commands"),
        F.sum("downloads").alias("n_downloads"),
        _zero(F.sum("dur_sum") / F.nullif(F.sum("dur_n"), F.lit(0))).alias("duration_mean"),
        F.count_if((F.col("logins") > 0) & F.col("hour").isNotNull()).alias("unique_hours"),
        entropy_of_counts(F.when(F.col("hour").isNotNull(), F.col("logins"))).alias("hour_entropy"),
    )


def credentials(logins: DataFrame) -> DataFrame:
    """Distinct usernames and passwords per address, with mean entropy and length of the passwords.

    One scan: each login gives a username row and a password row, duplicates collapse before and
    after the shuffle on (address, kind, value), and entropy runs once per distinct password.
    """
    kinds = F.inline(
        F.array(
            F.struct(F.lit("user").alias("kind"), F.col("username").alias("value")),
            F.struct(F.lit("password").alias("kind"), F.col("password").alias("value")),
        )
    )
    distinct = logins.select("src_ip", kinds).filter(F.col("value").isNotNull()).distinct()
    password = F.col("kind") == "password"
    return distinct.groupBy("src_ip").agg(
        F.count_if(F.col("kind") == "user").alias("unique_usernames"),
        F.count_if(password).alias("unique_passwords"),
        _zero(F.avg(F.when(password, shannon_entropy("value")))).alias("avg_password_entropy"),
        _zero(F.avg(F.when(password, F.length("value")))).alias("avg_password_length"),
    )


def login_gaps(logins: DataFrame, max_logins: int | None = None, tie: str = "event_id") -> DataFrame:
    """Mean seconds between logins; ``max_logins`` restricts it to each address's first logins."""
    if max_logins is not None:
        logins = first_n(logins, ["src_ip"], ["timestamp", tie], max_logins, tie)
    return mean_gap(logins, "src_ip", "timestamp")


def session_features(events: DataFrame, min_logins: int = 5, max_logins: int | None = None, keep_counts: bool = False) -> DataFrame:
    """The 15 session features of every address with at least ``min_logins`` logins."""
    logins = logins_of(events)
    base = activity(events).filter(F.col("total_attempts") >= min_logins)
    table = base.join(credentials(logins), "src_ip", "left").join(login_gaps(logins, max_logins), "src_ip", "left")
    c = F.col
    users, passwords = F.coalesce("unique_usernames", F.lit(0)), F.coalesce("unique_passwords", F.lit(0))
    columns = {
        "total_attempts": c("total_attempts"),
        "unique_usernames": users,
        "unique_passwords": passwords,
        "unique_combos": F.least(users * passwords, c("total_attempts")),
        "success_rate": per(c("n_success"), c("total_attempts")),
        "avg_time_between": _zero(c("avg_time_between")),
        "session_count": c("session_count"),
        "commands_per_session": per(c("n_commands"), c("session_count")),
        "unique_hours": c("unique_hours"),
        "hour_entropy": c("hour_entropy"),
        "avg_password_entropy": _zero(c("avg_password_entropy")),
        "avg_password_length": _zero(c("avg_password_length")),
        "password_reuse_ratio": per(c("total_attempts"), passwords),
        "duration_mean": c("duration_mean"),
        "has_file_download": (c("n_downloads") > 0).cast("int"),
    }
    counts = ["n_success", "n_commands", "n_downloads"] if keep_counts else []
    return table.select("src_ip", *[v.alias(k) for k, v in columns.items()], *counts)


def flow_features(flows: DataFrame, min_flows: int = 5) -> DataFrame:
    """The five flow features of every address with at least ``min_flows`` flows."""
    return (
        flows.filter(F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(
            F.count(F.lit(1)).alias("flow_count"),
            F.count_distinct("dst_port").alias("unique_dst_ports"),
            F.count_distinct("dst_ip").alias("unique_dst_ips"),
            _zero(F.avg("duration")).alias("avg_flow_duration"),
            F.count_distinct("proto").alias("proto_diversity"),
        )
        .filter(F.col("flow_count") >= min_flows)
    )


# --- independent feature and label tables ----------------------------------------------------------

def labelled_sessions(events: DataFrame, min_logins: int = 5, min_sessions: int = 1) -> DataFrame:
    """Login-side features with an actor label that comes from the session side only (R1)."""
    table = session_features(events, min_logins, keep_counts=True).filter(F.col("session_count") >= min_sessions)
    label = rules.session_actor(
        F.col("n_commands"), F.col("session_count"), F.col("n_downloads"), F.col("duration_mean"), F.col("success_rate")
    )
    return table.select(
        "src_ip", *LOGIN_SIDE, label.alias("label"),
        F.col("n_commands").alias("_commands"), F.col("n_downloads").alias("_downloads"),
        F.col("session_count").alias("_sessions"), F.col("duration_mean").alias("_duration_mean"),
        F.col("success_rate").alias("_success_rate"),
    )


def labelled_flows(flows: DataFrame, min_flows: int = 5) -> DataFrame:
    """Scan features with an actor label from duration and protocol (R2)."""
    label = rules.flow_actor(F.col("avg_flow_duration"), F.col("proto_diversity"))
    return flow_features(flows, min_flows).select(
        "src_ip", "flow_count", "unique_dst_ports", "unique_dst_ips", label.alias("label"),
        F.col("avg_flow_duration").alias("_avg_duration"), F.col("proto_diversity").alias("_proto_diversity"),
    )


def threat_labels(events: DataFrame, min_logins: int) -> DataFrame:
    """R3 and R5 labels from the full history, with the counts behind them."""
    c = F.col
    return (
        activity(events)
        .filter(c("total_attempts") >= min_logins)
        .select(
            "src_ip",
            rules.threat_level(c("n_commands"), c("n_downloads"), c("n_success"), c("total_attempts"), c("duration_mean")).alias("threat_label"),
            rules.window_threat(c("n_commands"), c("n_downloads"), c("n_success")).alias("window_label"),
            c("total_attempts").alias("_total_logins"),
            c("n_commands").alias("_total_commands"),
            c("n_downloads").alias("_total_downloads"),
            c("n_success").alias("_total_success"),
            c("duration_mean").alias("_avg_duration"),
        )
    )


def behaviour_labels(flows: DataFrame, min_flows: int) -> DataFrame:
    """R4 label from the full history, with the counts behind it."""
    table = flow_features(flows, min_flows)
    return table.select(
        "src_ip",
        rules.flow_behaviour(F.col("unique_dst_ports"), F.col("flow_count")).alias("behavior_label"),
        F.col("flow_count").alias("_total_flows"),
        F.col("unique_dst_ports").alias("_all_unique_ports"),
        F.col("unique_dst_ips").alias("_all_unique_ips"),
        F.col("avg_flow_duration").alias("_all_avg_duration"),
    )


# --- early windows -----------------------------------------------------------------------------

def with_login_gap(first: DataFrame) -> DataFrame:
    """Microseconds since the previous row of a bounded first-N table, null outside (0, 1 day)."""
    step = micros("timestamp") - F.lag(micros("timestamp")).over(Window.partitionBy("src_ip").orderBy("rank"))
    return first.withColumn("_step", step).withColumn(
        "gap_us", F.when((F.col("_step") > 0) & (F.col("_step") < DAY_MICROS), F.col("_step"))
    ).drop("_step")


def _mean_over(items: Column, measure) -> Column:
    """Mean of a per-item measure over a bounded array, 0 when it is empty."""
    total = F.aggregate(F.transform(items, lambda x: measure(x).cast("double")), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(F.lit(0.0))


def _gap_columns(prefix: str = "") -> list[Column]:
    seconds = lambda value: _zero(value / F.lit(float(MICROS)))
    return [
        seconds(F.avg("gap_us")).alias(f"{prefix}avg_time_between"),
        seconds(F.min("gap_us")).alias(f"{prefix}min_time_between"),
        seconds(F.stddev_pop("gap_us")).alias(f"{prefix}std_time_between"),
    ]


def early_sessions(
    events: DataFrame, ratio: float = 0.3, history: int | None = None, min_logins: int = 10, least: int = 3, tie: str = "event_id"
) -> DataFrame:
    """Features of the first ``max(least, ratio * n)`` logins with the R3 label.

    ``history`` counts n up to that many logins only, where it is asked for. Gaps, distinct names and
    distinct passwords are aggregates over the rows, so the early part of an address may be of any length.
    """
    labels = threat_labels(events, min_logins).drop("window_label")
    logins = logins_of(events).select("src_ip", "timestamp", "hour", "eventid", "username", "password", tie)
    early = first_fraction(gap_seconds(logins, "src_ip", "timestamp", tie), "src_ip", "timestamp", tie, ratio, least)
    if history is not None:
        early = early.filter(F.col("rank") <= max(least, int(history * ratio)))
    early = early.withColumn("gap_us", F.when((F.col("gap") > 0) & (F.col("gap") < DAY_MICROS / MICROS), F.col("gap") * F.lit(float(MICROS))))
    summary = early.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("early_attempt_count"),
        F.count_if(has_part("eventid", "login.success")).alias("_wins"),
        *_gap_columns("early_"),
    )
    kinds = F.inline(
        F.array(
            F.struct(F.lit("user").alias("kind"), F.nullif("username", F.lit("")).alias("value")),
            F.struct(F.lit("password").alias("kind"), F.nullif("password", F.lit("")).alias("value")),
            F.struct(F.lit("hour").alias("kind"), F.col("hour").cast("string").alias("value")),
        )
    )
    values = early.select("src_ip", kinds).filter(F.col("value").isNotNull()).distinct()
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    distinct = values.groupBy("src_ip").agg(
        F.count(of("user", F.lit(1))).alias("early_unique_users"),
        F.count(of("password", F.lit(1))).alias("early_unique_passwords"),
        F.avg(of("password", shannon_entropy(F.col("value")))).alias("_entropy"),
        F.avg(of("password", F.length("value"))).alias("_length"),
        F.count(of("hour", F.lit(1))).alias("early_unique_hours"),
    )
    features = summary.join(distinct, "src_ip", "left").select(
        "src_ip", "early_attempt_count", F.coalesce("early_unique_users", F.lit(0)).cast("int").alias("early_unique_users"),
        F.coalesce("early_unique_passwords", F.lit(0)).cast("int").alias("early_unique_passwords"),
        per(F.col("_wins"), F.col("early_attempt_count")).alias("early_success_rate"),
        "early_avg_time_between", "early_min_time_between", "early_std_time_between",
        _zero(F.col("_entropy")).alias("early_password_entropy"),
        _zero(F.col("_length")).alias("early_password_length"),
        per(F.col("early_attempt_count"), F.coalesce("early_unique_passwords", F.lit(0))).alias("early_password_reuse"),
        F.coalesce("early_unique_hours", F.lit(0)).alias("early_unique_hours"),
    )
    return features.join(labels, "src_ip")


def _flow_window_columns() -> list[Column]:
    """Aggregates of the early flow features over a bounded window; ports travel as a bounded list."""
    return [
        F.size(F.collect_set("dst_port")).alias("early_unique_ports"),
        _zero(F.avg("duration")).alias("early_avg_duration"),
        _zero(F.stddev_pop("duration")).alias("early_std_duration"),
        F.size(F.collect_set("proto")).alias("early_proto_diversity"),
        list_entropy(F.collect_list("dst_port")).alias("early_port_entropy"),
        per(F.count_if(F.col("dst_port").isin(*COMMON_PORTS)), F.count("dst_port")).alias("early_common_port_ratio"),
    ]


def first_flows(flows: DataFrame, n: int, order: Sequence[str], salt: str) -> DataFrame:
    needed = ["src_ip", "timestamp", "dst_port", "duration", "proto", *order, salt]
    return first_n(flows.select(*dict.fromkeys(needed)), ["src_ip"], list(order), n, salt)


def early_flows(flows: DataFrame, order: Sequence[str], salt: str, n: int = 10, min_flows: int = 20) -> DataFrame:
    """Features of the first ``n`` flows with the R4 label."""
    summary = first_flows(flows, n, order, salt).groupBy("src_ip").agg(*_flow_window_columns())
    return summary.join(behaviour_labels(flows, min_flows), "src_ip")


def _per_window(first: DataFrame, windows: Sequence[int]) -> DataFrame:
    """One copy of a first-N row for every window it belongs to."""
    sizes = F.array(*[F.lit(int(n)) for n in sorted(windows)])
    fitting = F.filter(sizes, lambda n: n >= F.col("rank"))
    return first.withColumn("window_n", F.explode(fitting))


def session_windows(events: DataFrame, windows: Sequence[int] = (3, 5, 10, 20, 50), tie: str = "event_id") -> DataFrame:
    """Early features for several window sizes at once, over one population, with the R5 label."""
    first = first_n(
        logins_of(events).select("src_ip", "timestamp", "password", tie), ["src_ip"], ["timestamp", tie], max(windows), tie
    )
    rows = _per_window(with_login_gap(first), windows)
    passwords = F.col("_passwords")
    summary = rows.groupBy("src_ip", "window_n").agg(
        F.collect_set(F.nullif("password", F.lit(""))).alias("_passwords"), *_gap_columns()
    )
    features = summary.select(
        "src_ip", "window_n", F.size(passwords).alias("unique_passwords"),
        "avg_time_between", "std_time_between",
        _mean_over(passwords, shannon_entropy).alias("password_entropy"),
        _mean_over(passwords, F.length).alias("password_length"),
        per(F.col("window_n"), F.size(passwords)).alias("password_reuse"),
    )
    labels = threat_labels(events, max(windows) + 5).select("src_ip", F.col("window_label").alias("label"))
    return features.join(labels, "src_ip")


def flow_windows(
    flows: DataFrame, order: Sequence[str], salt: str, windows: Sequence[int] = (5, 10, 20, 30, 50)
) -> DataFrame:
    """Early flow features for several window sizes at once with the R4 label."""
    rows = _per_window(first_flows(flows, max(windows), order, salt), windows)
    summary = rows.groupBy("src_ip", "window_n").agg(*_flow_window_columns())
    labels = behaviour_labels(flows, max(windows) + 10).select("src_ip", F.col("behavior_label").alias("label"))
    return summary.join(labels, "src_ip")


# --- merging the two sources -----------------------------------------------------------------------

# Fixed value: suffix of flow features whose name clashes with a session feature.
CLASH_SUFFIX = "_ctu"


def merge_features(sessions: DataFrame, flows: DataFrame, suffix: str = CLASH_SUFFIX) -> tuple[DataFrame, DataFrame]:
    """The session features with the flow features joined on where an address has both, and one row ``n_common``.

    Whether the common addresses are enough is for the caller to say; the columns do not depend on it.
    """
    clashes = {c: c + suffix for c in flows.columns if c != "src_ip" and c in sessions.columns}
    common = sessions.select("src_ip").join(flows.select("src_ip"), "src_ip", "left_semi")
    merged = sessions.join(flows.withColumnsRenamed(clashes), "src_ip", "left")
    return merged, common.agg(F.count(F.lit(1)).alias("n_common"))


def numeric_features(df: DataFrame, exclude: Sequence[str] = (), prefix: str | None = None) -> list[str]:
    """Numeric columns fit for a model: no key or label, no reference column (leading underscore)."""
    numeric = {"int", "bigint", "smallint", "tinyint", "float", "double"}
    return [
        c for c, t in df.dtypes
        if t in numeric and c not in exclude and not c.startswith("_") and (prefix is None or c.startswith(prefix))
    ]
