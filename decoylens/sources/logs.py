"""Raw log readers: flow logs (one JSON object per line) and nested session logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.scalars import as_count, from_epoch, time_columns
from ..functions.vocabulary import TARGET_EVENTS

# Raw flow fields and the names they get.
FLOW_RENAMES = {
    "id.orig_h": "src_ip",
    "id.orig_p": "src_port",
    "id.resp_h": "dst_ip",
    "id.resp_p": "dst_port",
}
# The text and counter fields of a flow, and below the fields of an event and its geography.
FLOW_TEXT = ("proto", "service", "conn_state")
FLOW_COUNTERS = (
    "src_port", "dst_port", "orig_bytes", "resp_bytes", "missed_bytes",
    "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes",
)
# Every raw field is read as text, so one odd value never rejects its whole line.
FLOW_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "ts", *FLOW_RENAMES, *FLOW_TEXT, "duration",
            *[c for c in FLOW_COUNTERS if not c.endswith("_port")],
        )
    ]
    + [T.StructField("_bad", T.StringType())]
)

GEO_SCHEMA = T.StructType(
    [
        T.StructField("country_code3", T.StringType()),
        T.StructField("country_name", T.StringType()),
        T.StructField("continent_code", T.StringType()),
        T.StructField("location", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("city_name", T.StringType()),
        T.StructField("region_name", T.StringType()),
    ]
)
EVENT_SCHEMA = T.StructType(
    [
        *[
            T.StructField(name, T.StringType())
            for name in ("eventid", "timestamp", "src_ip", "src_ip_identifier", "username", "password", "protocol")
        ],
        T.StructField("duration", T.DoubleType()),
        T.StructField("geolocation_data", GEO_SCHEMA),
    ]
)

# The first name of a member that begins right at its text, without escapes or control signs, between what surrounds it.
FIRST_NAME = r'^(\s*[\[,]?\s*\{\s*)"([^"\\\x00-\x1f]+)"(?=\s*:)'


# --- file selection ------------------------------------------------------------------------------

def is_target_log(path: Column) -> Column:
    """``*.json[.gz]``, and ``*.log[.gz]`` only where the name starts with ``conn.``"""
    name = F.lower(F.substring_index(path, "/", -1))
    return name.rlike(r"\.json(\.gz)?$") | name.rlike(r"^conn\..*\.log(\.gz)?$")


def first_days(paths: DataFrame, max_days: int | None = None, path: str = "path") -> DataFrame:
    """Target logs laid out as ``.../sensor/day/file``, the first ``max_days`` days of every sensor."""
    part = lambda from_end: F.substring_index(F.substring_index(path, "/", -from_end), "/", 1)
    logs = paths.filter(is_target_log(F.col(path))).select(path, part(3).alias("sensor"), part(2).alias("day"))
    if max_days is None:
        return logs
    days = logs.select("sensor", "day").distinct()
    numbered = days.withColumn("_n", F.row_number().over(Window.partitionBy("sensor").orderBy("day")))
    return logs.join(numbered.filter(F.col("_n") <= max_days), ["sensor", "day"], "left_semi").select(path, "sensor", "day")


def list_files(spark: SparkSession, root: str | Sequence[str]) -> DataFrame:
    """All files below a folder, by path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def selected(spark: SparkSession, paths: str | Sequence[str], max_days: int | None = None) -> str | list[str]:
    """The paths as they are, or the files of the first ``max_days`` days of each sensor below them.

    The driver gets the chosen files' names, as it does for any scan.
    """
    if max_days is None:
        return paths if isinstance(paths, str) else list(paths)
    chosen = [r["path"] for r in first_days(list_files(spark, paths), max_days).collect()]
    if not chosen:
        raise ValueError(f"no log files below {paths}")
    return chosen


# --- flow logs ---------------------------------------------------------------------------------------

def parse_flow_lines(lines: DataFrame) -> DataFrame:
    """Parse ``value`` lines, blanks at both ends left out. ``ok`` tells good lines from skipped ones, blank ones included."""
    text = F.btrim("value", F.lit(" \t\r\n"))
    record = F.from_json(text, FLOW_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    kept = lines.withColumn("r", record)
    ok = text.startswith("{") & F.col("r").isNotNull() & F.col("r._bad").isNull()
    judged = kept.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return judged.select("ok", F.when(F.col("ok"), F.col("r")).alias("r"), "value")


def type_flows(parsed: DataFrame, keep_skipped: bool = False) -> DataFrame:
    """Typed flow rows of the good lines: renamed, counters coerced to BIGINT, time columns derived.

    ``keep_skipped`` leaves the skipped lines in as empty rows next to an ``ok`` column, so that
    one pass can count both kinds.
    """
    lines = parsed if keep_skipped else parsed.filter("ok")
    fields = [F.col(f"r.`{f.name}`").alias(f.name) for f in FLOW_SCHEMA if f.name != "_bad"]
    named = lines.select("ok", *fields).withColumnsRenamed(FLOW_RENAMES)
    times = time_columns(from_epoch(F.col("ts").try_cast("double")))
    return named.select(
        *(["ok"] if keep_skipped else []),
        *[c.alias(name) for name, c in times.items()],
        "src_ip", "dst_ip", *FLOW_TEXT, F.col("duration").try_cast("double").alias("duration"),
        *[as_count(F.col(c)).alias(c) for c in FLOW_COUNTERS],
    )


def read_target_lines(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """``value`` and ``path`` of all lines (or whole files) of the files that ``is_target_log`` accepts."""
    lines = spark.read.text(paths, recursiveFileLookup=True, **options).withColumn("path", F.col("_metadata.file_path"))
    return lines.filter(is_target_log(F.col("path")))


def read_flow_logs(spark: SparkSession, paths: str | Sequence[str], max_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(flows, rejected lines)`` of the flow logs below the paths, other files left alone; gz files are read as they are.

    ``max_days`` keeps the first days of each sensor, where files lie as ``.../sensor/day/file``.
    """
    parsed = parse_flow_lines(read_target_lines(spark, selected(spark, paths, max_days)))
    return type_flows(parsed), parsed.filter("NOT ok").select("value")


# --- session logs ------------------------------------------------------------------------------------

def session_pieces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``value, path, block, pos``: session files cut at every closing brace, in order by (path, block, pos).

    Cutting at a byte lets Spark read byte ranges of one file in many tasks; a piece belongs to the range it begins in.
    """
    place = {"path": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "pos": F.monotonically_increasing_id()}
    pieces = spark.read.text(paths, recursiveFileLookup=True, lineSep="}").select("value", *[c.alias(n) for n, c in place.items()])
    return pieces.filter(is_target_log(F.col("path")))


def session_objects(pieces: DataFrame) -> DataFrame:
    """``path, member, text, closed``: the members ``{session: [event, ...]}`` of each file's array, numbered, as text.

    Brackets nest and strings hide them, so what a brace closes depends on all text before it. Each piece has its change
    of string state and, for either state before it, of bracket depth. They are summed within a byte range for both
    states the range may begin in; a table with one row per range then carries the true state and depth from range to
    range. A member ends where the depth falls back to one. Text behind the last member has ``closed`` false; it is a
    bracket in a whole file, and in a cut one the begun member.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # an escaped sign neither ends a string nor nests
    outside = lambda text: F.regexp_replace(text, r'"[^"]*("|$)', "")
    number = lambda text, sign: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))
    level = lambda text: number(text, "{") + number(text, "[") - number(text, "]")  # noqa: E731  # a piece has no closing brace
    marked = pieces.withColumn("_bare", bare).withColumn("_all", level(F.col("_bare"))).withColumn("_outer", outside(F.col("_bare")))
    marked = marked.withColumn("_odd", F.pmod(number(F.col("_bare"), '"'), F.lit(2))).withColumn("_outer", level(F.col("_outer")))
    closes = lambda before: (F.pmod(F.col("_odd") + before, F.lit(2)) == 0).cast("int")
    marked = marked.select(
        "value", "path", "block", "pos", "_odd",
        (F.col("_outer") - closes(0)).alias("_plain"),
        (F.col("_all") - F.col("_outer") - closes(1)).alias("_quoted"),  # what one state takes for a string is outside in the other
    )
    block = ["path", "block"]
    order = Window.partitionBy(*block).orderBy("pos")
    before, upto = (order.rowsBetween(Window.unboundedPreceding, last) for last in (-1, 0))
    marked = marked.withColumn("_in", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2)
    change = lambda first: F.when(F.col("_in") == first, F.col("_plain")).otherwise(F.col("_quoted"))
    summed = marked.withColumns({"_from0": F.sum(change(0)).over(upto), "_from1": F.sum(change(1)).over(upto)})

    across = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda column: F.coalesce(F.sum(column).over(across), F.lit(0))
    ranges = marked.groupBy(*block).agg(F.sum("_odd").alias("_odds"), F.sum(change(0)).alias("_sum0"), F.sum(change(1)).alias("_sum1"))
    ranges = ranges.withColumn("_state", carried("_odds") % 2).withColumn("_sum", F.when(F.col("_state") == 0, F.col("_sum0")).otherwise(F.col("_sum1")))
    placed = summed.join(ranges.select(*block, "_state", carried("_sum").alias("_depth")), block)
    depth = F.col("_depth") + F.when(F.col("_state") == 0, F.col("_from0")).otherwise(F.col("_from1"))
    ends = (depth == 1) & ((F.col("_state") + F.col("_in") + F.col("_odd")) % 2 == 0)
    placed = placed.select("value", "path", "block", "pos", ends.cast("int").alias("_ends"))

    counts = placed.groupBy(*block).agg(F.sum("_ends").alias("_ended"))
    counts = counts.select(*block, carried("_ended").alias("_earlier"))
    within = F.coalesce(F.sum("_ends").over(before), F.lit(0))
    numbered = placed.withColumn("_own", within).join(counts, block).withColumn("member", F.col("_own") + F.col("_earlier"))
    gathered = numbered.groupBy("path", "member").agg(
        F.array_sort(F.collect_list(F.struct("block", "pos", "value"))).alias("_pieces"), (F.max("_ends") == 1).alias("closed")
    )
    text = F.concat(F.array_join(F.col("_pieces.value"), "}"), F.when(F.col("closed"), "}").otherwise(""))
    return gathered.select("path", "member", text.alias("text"), "closed")


def parse_session_objects(objects: DataFrame) -> DataFrame:
    """``path, ok, session, e``: a row per event, and one with ``ok`` false per text that is no member.

    Members of another shape than ``{session: [event, ...]}`` are skipped without a word.
    """
    # Spark's parser keeps a table of all field names and copies it for each new one, so a plain session name is taken out first.
    objects = objects.withColumn("_name", F.regexp_extract("text", FIRST_NAME, 2))
    text = F.when(F.col("_name") == "", F.col("text")).otherwise(F.regexp_replace("text", FIRST_NAME, '$1"session"'))
    opened = F.ltrim("text").startswith("[") & (F.col("member") == 0)
    array = F.when(opened, F.concat(text, F.lit("]"))).otherwise(F.concat(F.lit("[null"), text, F.lit("]")))
    whole = F.when(F.col("closed"), F.from_json(array, T.ArrayType(T.StringType())))
    # Behind the last member: the closing bracket, or the text of an array without members.
    ending = ~F.col("closed") & (F.col("text").rlike(r"^\s*\]\s*$") | (opened & F.from_json("text", T.ArrayType(T.StringType())).isNotNull()))
    judged = objects.select("path", ((F.col("closed") & whole.isNotNull()) | ending).alias("ok"))
    lists = F.from_json("_m", T.MapType(T.StringType(), T.StringType()))
    # No test on a parsed column, not even the one that comes with its explosion: Spark would parse once more for each.
    members = objects.select("path", "_name", F.explode(whole).alias("_m")).filter(F.ltrim("_m").startswith("{"))
    lists = members.select("path", "_name", F.posexplode(lists).alias("_at", "_key", "_body")).filter(F.col("_body").startswith("["))
    named = F.when((F.col("_at") == 0) & (F.col("_name") != ""), F.col("_name")).otherwise(F.col("_key"))
    bodies = lists.select("path", named.alias("session"), "_body")
    texts = bodies.select("path", "session", F.explode(F.from_json("_body", T.ArrayType(T.StringType()))).alias("_e"))
    events = texts.filter(F.col("_e").startswith("{")).select("path", "session", F.from_json("_e", EVENT_SCHEMA).alias("e"))
    good = events.select("path", F.lit(True).alias("ok"), "session", "e")
    bad = judged.filter("NOT ok").select("path", "ok", F.lit(None).cast("string").alias("session"), F.lit(None).cast(EVENT_SCHEMA).alias("e"))
    return good.unionByName(bad)


def flatten_event(events: DataFrame) -> DataFrame:
    """Typed event rows: address fallback, flattened geography, derived time columns."""
    g = lambda path: F.col(f"geolocation_data.{path}")
    times = time_columns(F.col("timestamp").try_cast("timestamp"))
    keep = [c for c in ("session", "event_id") if c in events.columns]
    return events.select(
        *keep,
        *[c.alias(name) for name, c in times.items()],
        F.coalesce("src_ip", "src_ip_identifier").alias("src_ip"),
        "eventid", "username", "password", "duration", "protocol",
        g("country_code3").alias("geo_country_code"),
        g("country_name").alias("geo_country_name"),
        g("continent_code").alias("geo_continent"),
        F.coalesce(g("location.lat"), g("latitude")).alias("geo_latitude"),
        F.coalesce(g("location.lon"), g("longitude")).alias("geo_longitude"),
        g("city_name").alias("geo_city"),
        g("region_name").alias("geo_region"),
    )


def is_allowed(eventid: str = "eventid") -> Column:
    return F.coalesce(F.col(eventid).isin(*TARGET_EVENTS), F.lit(False))


def allow_listed(events: DataFrame) -> DataFrame:
    return events.filter(is_allowed())


def read_session_logs(spark: SparkSession, paths: str | Sequence[str], max_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(events, files)`` of session files of any size: typed events of every kind (see ``allow_listed``), and the paths
    of files that are cut or not well-formed. Of those, all members before the break are kept.

    One member must stay below 2 GB. gz files are read by one task each.
    """
    rows = parse_session_objects(session_objects(session_pieces(spark, selected(spark, paths, max_days))))
    events = flatten_event(rows.filter("ok").select("session", "e.*"))
    return events, rows.filter("NOT ok").select("path").distinct()
