"""Registered queries: raw ingest, schema work, stored tables. Raw logs are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import as_count, from_epoch, time_columns
from ..operators import features as FT, geo as G
from ..session import scratch_path
from ..sources import logs as L, tables as T
from .adapters import BLOCKS, EV, FL, attack_events, countries, flows, geo_blocks, geo_networks, resolved_sql, table, with_ctes
from .catalog import query
from .features import ACT, R3

E_ = with_ctes(EV)
F_ = with_ctes(FL)


def written_as(lines, folder, name, per_file: int = 0):
    """Write lines as text files with names of their own, each of ``per_file`` lines if given; only names go through the driver."""
    spark = lines.sparkSession
    lines.write.option("maxRecordsPerFile", per_file).text(folder)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in store.listStatus(root) if s.getPath().getName().startswith("part-")]
    for number, part in enumerate(sorted(parts, key=str)):
        store.rename(part, jvm.org.apache.hadoop.fs.Path(root, name.format(number)))


def written_by(lines, folder, by, name):
    """Write lines in one pass as text files in a folder per values of ``by``; only names go through the driver."""
    spark = lines.sparkSession
    lines.write.partitionBy(*by).text(folder)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    below = [root]
    for _ in by:  # a folder ``column=value`` becomes ``value``
        found = [s.getPath() for at in below for s in store.listStatus(at) if s.isDirectory()]
        below = [jvm.org.apache.hadoop.fs.Path(at.getParent(), at.getName().partition("=")[2]) for at in found]
        for old, new in zip(found, below):
            store.rename(old, new)
    for at in below:
        for number, part in enumerate(sorted((s.getPath() for s in store.listStatus(at)), key=str)):
            store.rename(part, jvm.org.apache.hadoop.fs.Path(at, name.format(number)))


def flow_lines(spark, sf, *more):
    """The flows as raw log lines, with indented, comment, blank and cut-off lines among them, and ``more`` columns."""
    c = F.col
    f = flows(spark, sf).withColumn("odd", F.pmod(F.col("src_port"), F.lit(20)))
    line = F.to_json(
        F.struct(
            (F.unix_micros("timestamp") / 1_000_000).alias("ts"), c("src_ip").alias("id.orig_h"), c("src_port").alias("id.orig_p"),
            c("dst_ip").alias("id.resp_h"), c("dst_port").alias("id.resp_p"), "proto", "conn_state", "duration",
            F.when(c("odd") == 3, "-").otherwise((c("orig_bytes") * 100_000).cast("string")).alias("orig_bytes"),
            F.when(c("odd") != 5, c("resp_bytes")).alias("resp_bytes"),
        )
    )
    value = F.when(c("odd") == 0, F.concat(F.lit("#"), line)).when(c("odd") == 1, F.substring(line, F.lit(1), F.length(line) - 7)).when(c("odd") == 2, "").when(c("odd") == 7, F.concat(F.lit(" \t"), line, F.lit(" "))).otherwise(line)
    return f.select(value.alias("value"), *more)


@query("s01_flow_lines", F_ + """
, o AS (SELECT *, src_port % 20 AS odd FROM fl)
SELECT CAST(odd > 2 AS INT) AS ok, count(*) AS n, CAST(sum(CASE WHEN odd > 3 THEN orig_bytes * 100000 ELSE 0 END) AS BIGINT) AS orig_bytes,
  CAST(sum(CASE WHEN odd > 2 AND odd <> 5 THEN resp_bytes ELSE 0 END) AS BIGINT) AS resp_bytes,
  count(DISTINCT CASE WHEN odd > 2 THEN date END) AS dates, count(DISTINCT CASE WHEN odd > 2 THEN src_ip END) AS ips FROM o GROUP BY 1""")
def flow_line_scan(spark, sf):
    path = scratch_path(spark, "flow-logs")
    written_as(flow_lines(spark, sf), f"{path}/sensor-1", "conn.{0}.log")
    written_as(flow_lines(spark, sf).limit(50), f"{path}/sensor-2", "dns.{0}.log")  # not a flow log
    rows = L.type_flows(L.parse_flow_lines(L.read_target_lines(spark, path)), keep_skipped=True)
    return rows.groupBy(F.col("ok").cast("int").alias("ok")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("orig_bytes").alias("orig_bytes"), F.sum("resp_bytes").alias("resp_bytes"),
        F.count_distinct("date").alias("dates"), F.count_distinct("src_ip").alias("ips"),
    )


_NAMES = ("conn.{0}.log.gz", "conn.{0}.log", "dns.{0}.log.gz", "sessions_{0}.json.gz", "sessions_{0}.json", "notes.txt")
_NAME_SQL = "CASE orderkey % 6 " + " ".join(
    f"WHEN {i} THEN '" + n.replace("{0}", "' || day || '") + "'" for i, n in enumerate(_NAMES)) + " END"


@query("s02_file_selection", f"""
WITH p AS (SELECT DISTINCT 'sensor-' || CAST(l_suppkey % 8 AS VARCHAR) AS sensor, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_orderkey AS orderkey FROM lineitem),
f AS (SELECT sensor, day, {_NAME_SQL} AS name, orderkey FROM p),
t AS (SELECT DISTINCT sensor, day, name FROM f WHERE orderkey % 6 IN (0, 1, 3, 4)),
d AS (SELECT *, dense_rank() OVER (PARTITION BY sensor ORDER BY day) AS r FROM t)
SELECT '/logs/' || sensor || '/' || day || '/' || name AS path, sensor, day FROM d WHERE r <= 5""")
def file_selection(spark, sf):
    li = table(spark, sf, "lineitem")
    day = F.to_date("l_shipdate").cast("string")
    sensor = F.concat(F.lit("sensor-"), (F.col("l_suppkey") % 8).cast("string"))
    name = F.element_at(F.array(*[F.concat(*[F.lit(p) if p else day for p in _split(n)]) for n in _NAMES]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    paths = li.select(F.concat_ws("/", F.lit("/logs"), sensor, day, name).alias("path")).distinct()
    return L.first_days(paths, 5)


@query("s02b_first_days_read", F_ + """
, d AS (SELECT *, src_port % 20 AS odd, CAST(substr(dst_ip, 11) AS INT) % 3 AS sensor, CAST(strftime(date, '%Y') AS INT) AS year FROM fl),
k AS (SELECT *, dense_rank() OVER (PARTITION BY sensor ORDER BY year) AS r FROM d)
SELECT CAST(year AS INT) AS year, count(*) AS n, count(DISTINCT src_ip) AS ips FROM k WHERE r <= 2 AND odd > 2 GROUP BY 1""")
def first_days_read(spark, sf):
    """Flow logs laid out as sensor/day/file (here a year's flows are a day's), read for the first two days of each sensor."""
    root = scratch_path(spark, "sensor-logs")
    lines = flow_lines(spark, sf, "dst_ip", F.year("date").alias("year"))
    sensor = F.substring("dst_ip", 11, 9).cast("int") % 3
    lines = lines.filter("year is not null").select("value", F.concat(F.lit("sensor-"), sensor.cast("string")).alias("sensor"), "year")
    written_by(lines, root, ["sensor", "year"], "conn.{0}.log")
    rows, _ = L.read_flow_logs(spark, root, max_days=2)
    return rows.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src_ip").alias("ips"))


def _split(name: str) -> list[str]:
    """Literal parts of a file name, an empty part where the day goes."""
    head, _, tail = name.partition("{0}")
    return [head, "", tail] if tail else [name]


def session_documents(spark, sf, per_document: int = 500):
    """The events as nested session documents of at most ``per_document`` events each."""
    c = F.col
    e = attack_events(spark, sf).withColumn("doc", F.floor(c("event_id") / per_document))
    lat = (c("event_id") % 90).cast("double")
    geo = F.struct(
        F.concat(F.lit("C"), (c("event_id") % 25).cast("string")).alias("country_code3"),
        F.when(c("event_id") % 3 == 0, F.struct(lat.alias("lat"), (lat + 1).alias("lon"))).alias("location"),
        F.when(c("event_id") % 3 == 1, lat).alias("latitude"), F.when(c("event_id") % 3 == 1, lat + 1).alias("longitude"),
    )
    event = F.struct(
        "eventid", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), c("src_ip").alias("src_ip_identifier"),
        "username", "password", "duration", F.when(c("event_id") % 3 != 2, geo).alias("geolocation_data"),
    )
    sessions = e.groupBy("doc", "src_ip").agg(F.collect_list(event).alias("events"))
    ordered = F.array_sort(F.collect_list(F.struct("src_ip", "events")))
    documents = sessions.groupBy("doc").agg(ordered.alias("s")).select("doc", F.to_json(F.transform("s", lambda s: F.create_map(s["src_ip"], s["events"]))).alias("value"))
    # Every fifth document gets a member of another shape, every eleventh is cut short, in its last member.
    stray = F.concat(F.lit('[{"note":"text"},'), F.substring("value", F.lit(2), F.length("value")))
    cut = F.substring("value", F.lit(1), F.length("value") - 20)
    return documents.select("doc", F.when(c("doc") % 11 == 10, cut).when(c("doc") % 5 == 0, stray).otherwise(c("value")).alias("value"))


def session_files(spark, sf):
    """A folder with one file per session document, and another that is no session log."""
    path = scratch_path(spark, "session-logs")
    written_as(session_documents(spark, sf).select("value"), f"{path}/sensor-1", "sessions_{0}.json", per_file=1)
    written_as(spark.range(1).select(F.lit("[{").alias("value")), f"{path}/sensor-2", "notes.{0}.txt")
    return path


# Of a cut file the members before the break are kept; here that is all but the last.
_KEPT = """
, doc AS (SELECT *, event_id // 500 AS doc FROM ev), m AS (SELECT doc, max(src_ip) AS last_ip FROM doc GROUP BY doc),
good AS (SELECT doc.* FROM doc JOIN m USING (doc) WHERE doc % 11 <> 10 OR src_ip <> last_ip)"""


@query("s03_session_documents", E_ + _KEPT + """
SELECT 'event' AS kind, src_ip AS session, count(*) AS n, count(username) AS usernames, round(sum(coalesce(duration, 0)), 4) AS duration, CAST(max(epoch_us("timestamp")) AS BIGINT) AS last_us FROM good GROUP BY src_ip
UNION ALL SELECT 'rejected', '', count(DISTINCT event_id // 500), 0, 0.0, 0 FROM ev WHERE (event_id // 500) % 11 = 10""")
def session_scan(spark, sf):
    every, rejected = L.read_session_logs(spark, session_files(spark, sf))
    events = L.allow_listed(every)
    per_session = events.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), F.count("username").alias("usernames"), F.round(F.sum(F.coalesce("duration", F.lit(0.0))), 4).alias("duration"),
        F.max(F.unix_micros("timestamp")).alias("last_us"),
    ).select(F.lit("event").alias("kind"), "*")
    bad = rejected.agg(
        F.lit("rejected").alias("kind"), F.lit("").alias("session"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("usernames"),
        F.lit(0.0).alias("duration"), F.lit(0).cast("bigint").alias("last_us"),
    )
    return per_session.unionByName(bad)


@query("s05_geo_flattening", E_ + _KEPT + """
, g AS (SELECT event_id, event_id % 3 AS m, CAST(event_id % 90 AS DOUBLE) AS lat FROM good)
SELECT CASE WHEN m < 2 THEN 'C' || CAST(event_id % 25 AS VARCHAR) ELSE 'none' END AS geo_country_code, count(*) AS n,
  round(sum(CASE WHEN m < 2 THEN lat ELSE 0.0 END), 3) AS lat_sum, round(sum(CASE WHEN m < 2 THEN lat + 1 ELSE 0.0 END), 3) AS lon_sum FROM g GROUP BY 1""")
def geo_flattening(spark, sf):
    events, _ = L.read_session_logs(spark, session_files(spark, sf))
    return events.groupBy(F.coalesce("geo_country_code", F.lit("none")).alias("geo_country_code")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("geo_latitude", F.lit(0.0))), 3).alias("lat_sum"),
        F.round(F.sum(F.coalesce("geo_longitude", F.lit(0.0))), 3).alias("lon_sum"),
    )


@query("s06_time_derivation", """
SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS us, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) AS INT) AS hour, dayname(ts) AS day_of_week, 1 AS same FROM events""")
def time_derivation(spark, sf):
    stamped = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    epoch = (F.unix_micros("t") / 1_000_000).cast("double")
    text = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    times = time_columns(from_epoch(epoch))
    return stamped.select(
        "event_id", F.unix_micros(times["timestamp"]).alias("us"), times["date"].cast("string").alias("date"), times["hour"].alias("hour"),
        times["day_of_week"].alias("day_of_week"), (text.try_cast("timestamp") == from_epoch(epoch)).cast("int").alias("same"),
    )


@query("s07_numeric_coercion", """
SELECT l_orderkey % 4 AS kind, CAST(sum(CASE l_orderkey % 4 WHEN 0 THEN l_partkey * 3000000000 WHEN 1 THEN 0 WHEN 2 THEN l_partkey ELSE 0 END) AS BIGINT) AS total, count(*) AS n FROM lineitem GROUP BY 1""")
def numeric_coercion(spark, sf):
    c = F.col
    kind = c("l_orderkey") % 4
    text = (
        F.when(kind == 0, (c("l_partkey") * 3_000_000_000).cast("string")).when(kind == 1, "n/a")
        .when(kind == 2, F.concat(c("l_partkey").cast("string"), F.lit(".75")))
    )
    counted = table(spark, sf, "lineitem").select(kind.alias("kind"), as_count(text).cast("decimal(28,0)").alias("v"))  # a total may pass BIGINT
    return counted.groupBy("kind").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


@query("s09_schema_reconciliation", """
SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'a' WHEN l_linenumber % 3 = 1 THEN 'b' ELSE 'c' END AS chunk, count(*) AS n,
  CAST(sum(CASE WHEN l_linenumber % 3 = 0 OR (l_linenumber % 3 = 1 AND l_partkey % 2 = 0) THEN l_partkey ELSE 0 END) AS BIGINT) AS x,
  count(*) FILTER (WHERE l_linenumber % 3 = 1) AS with_y, count(*) FILTER (WHERE l_linenumber % 3 = 2) AS with_z FROM lineitem GROUP BY 1""")
def schema_reconciliation(spark, sf):
    c = F.col
    li = table(spark, sf, "lineitem")
    chunk = lambda i: li.filter(c("l_linenumber") % 3 == i)
    a = chunk(0).select(F.lit("a").alias("chunk"), c("l_partkey").alias("x"), F.lit(None).alias("y"))
    b = chunk(1).select(F.lit("b").alias("chunk"), F.when(c("l_partkey") % 2 == 0, c("l_partkey").cast("string")).otherwise("bad").alias("x"), c("l_returnflag").alias("y"))
    d = chunk(2).select(F.lit("c").alias("chunk"), c("l_quantity").alias("z"))
    return T.reconcile([a, b, d]).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("x", F.lit(0))).alias("x"), F.count("y").alias("with_y"), F.count("z").alias("with_z")
    )


@query("s10_materialize", E_ + "SELECT CAST(date AS VARCHAR) AS date, count(*) AS n, count(DISTINCT src_ip) AS ips FROM ev GROUP BY date")
def materialize(spark, sf):
    path = scratch_path(spark, "events")
    T.materialize(spark, path, lambda: attack_events(spark, sf), ["date"])
    again = T.materialize(spark, path, lambda: attack_events(spark, sf).limit(0), ["date"])
    return again.groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src_ip").alias("ips"))


@query("s12_csv_export", F_ + "SELECT proto, count(*) AS n, CAST(sum(orig_bytes) AS BIGINT) AS bytes, CAST(sum(dst_port) AS BIGINT) AS ports FROM fl GROUP BY proto")
def csv_export(spark, sf):
    source, target = scratch_path(spark, "flows"), scratch_path(spark, "flows-csv")
    flows(spark, sf).select("flow_id", "proto", "dst_port", "orig_bytes").write.parquet(source)
    T.parquet_to_csv(spark, source, target)
    back = T.read_csv(spark, target, "flow_id string, proto string, dst_port int, orig_bytes bigint")
    return back.groupBy("proto").agg(F.count(F.lit(1)).alias("n"), F.sum("orig_bytes").alias("bytes"), F.sum("dst_port").alias("ports"))


@query("s13_result_csv", E_ + "SELECT username, count(*) AS n FROM ev WHERE username IS NOT NULL GROUP BY username")
def result_csv(spark, sf):
    path = scratch_path(spark, "counts-csv")
    known = attack_events(spark, sf).filter(F.col("username").isNotNull())
    T.write_csv(known.groupBy("username").agg(F.count(F.lit(1)).alias("n")), path)
    return T.read_csv(spark, path, "username string, n bigint")


@query("s14_label_discovery", with_ctes(EV, ACT) + f"SELECT src_ip, {R3} AS label FROM act WHERE total_attempts >= 10")
def label_discovery(spark, sf):
    path = scratch_path(spark, "labels-csv")
    labels = FT.threat_labels(attack_events(spark, sf), 10)
    T.write_csv(labels.select(F.col("src_ip").alias("source_ip"), F.col("threat_label").alias("level"), "_total_logins"), path)
    return T.read_labels(spark, path, ("threat_label", "level", "label"))


@query("s15_unified_table", with_ctes(EV, FL, BLOCKS, resolved_sql("ge", "ev"), resolved_sql("gf", "fl")) + """
, u AS (SELECT 'flows' AS dataset, src_ip, dst_port, proto AS protocol, gf.country_code AS src_country FROM fl JOIN gf USING (src_ip)
  UNION ALL SELECT 'events', ev.src_ip, NULL, NULL, coalesce(d.country_code, ge.country_code) FROM ev JOIN ge USING (src_ip)
    LEFT JOIN dim d ON ev.own_code = d.country_code || 'N' WHERE eventid = 'cowrie.session.connect')
SELECT dataset, coalesce(protocol, 'none') AS protocol, coalesce(src_country, 'none') AS src_country, count(*) AS n, count(DISTINCT src_ip) AS ips, count(dst_port) AS ports FROM u GROUP BY ALL""")
def unified_table(spark, sf):
    """Both logs on one key space: the events' own three-letter codes become the two letters of the address lookup."""
    look_up = lambda addresses: G.resolve(addresses.select("src_ip"), geo_blocks(spark, sf), geo_networks(spark, sf))
    events = G.with_country(attack_events(spark, sf, located=True), countries(spark, sf), look_up, name="_code")
    rows = flows(spark, sf)
    unified = T.unify(G.enrich(rows, look_up(rows)), events.drop("geo_country_code").withColumnRenamed("_code", "geo_country_code"))
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return unified.groupBy("dataset", none("protocol"), none("src_country")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("src_ip").alias("ips"), F.count("dst_port").alias("ports")
    )


@query("s16_geo_cache", with_ctes(EV, FL, BLOCKS) + """
, a AS (SELECT src_ip, ip_num, six FROM ev UNION SELECT src_ip, ip_num, six FROM fl)
SELECT a.src_ip, CASE WHEN a.src_ip LIKE '10.%' THEN '--' ELSE coalesce(g.country_code, d.country_code, 'XX') END AS country_code
FROM a LEFT JOIN blocks g ON a.ip_num BETWEEN g.start_ip AND g.end_ip LEFT JOIN dim d ON d.nationkey = six""")
def geo_cache(spark, sf):
    path = scratch_path(spark, "geo")
    look_up = lambda addresses: G.resolve(addresses, geo_blocks(spark, sf), geo_networks(spark, sf))
    T.extend_geo_cache(spark, path, attack_events(spark, sf), look_up)
    return T.extend_geo_cache(spark, path, flows(spark, sf), look_up).select("src_ip", "country_code")
