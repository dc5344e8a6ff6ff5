"""Registered queries: lookups, joins and spatial rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocabulary import CONTINENTS, EVENT_CODES, PROTOCOL_CODES, STATE_CODES, lookup
from ..functions.scalars import valid_point
from ..operators import features as FT, geo as G, rollups as R, sampling
from .adapters import (
    BLOCKS, CITIES, EV, FL, SECOND, attack_events, countries, flows, geo_blocks, geo_networks, resolved_sql, second_blocks, sensor_cities, with_ctes,
)
from .catalog import query
from .rollups import sample_facts_of

E_ = with_ctes(EV)
EG = with_ctes(EV, BLOCKS, resolved_sql("ge", "ev"))
FG = with_ctes(FL, BLOCKS, resolved_sql("gf", "fl"))
EFG = with_ctes(EV, FL, BLOCKS, resolved_sql("ge", "ev"), resolved_sql("gf", "fl"))


def _resolved(spark, sf, df):
    return G.resolve(df.select("src_ip"), geo_blocks(spark, sf), geo_networks(spark, sf))


def _event_counts(spark, sf, *keys):
    """Events per country and keys: by the code that an event brings, else by its address."""
    events = attack_events(spark, sf, located=True)
    return G.counts_by_country(events, list(keys), countries(spark, sf), lambda addresses: _resolved(spark, sf, addresses))


# Events with their country: their own code, else their address's.
_PLACED = """
, pe AS (SELECT ev.*, coalesce(d.country_code, ge.country_code) AS country_code FROM ev JOIN ge USING (src_ip) LEFT JOIN dim d ON ev.own_code = d.country_code || 'N')"""


# --- lookups and joins ---------------------------------------------------------------------------

@query("j01_geo_enrichment", FG + """
SELECT geo.country_code AS geo_country_code, geo.country_name AS geo_country_name, geo.city AS geo_city, geo.latitude AS geo_latitude,
  geo.longitude AS geo_longitude, geo.continent_code AS geo_continent_code, geo.continent_name AS geo_continent_name, geo.region AS geo_region,
  geo.accuracy_radius_km AS geo_accuracy_radius_km, geo.country_code AS src_country_code, geo.country_name AS src_country_name,
  count(*) AS n, CAST(sum(orig_bytes) AS BIGINT) AS bytes
FROM fl JOIN gf geo USING (src_ip) GROUP BY ALL""")
def geo_enrichment(spark, sf):
    rows = flows(spark, sf)
    enriched = G.enrich(rows.select("src_ip", "orig_bytes"), _resolved(spark, sf, rows))
    columns = [*["geo_" + c for c in G.GEO_DEFAULTS], "src_country_code", "src_country_name"]
    return enriched.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.sum("orig_bytes").alias("bytes"))


@query("j02_two_tier_lookup", with_ctes(FL, BLOCKS, SECOND) + """
, a AS (SELECT DISTINCT src_ip, ip_num, six FROM fl),
g AS (SELECT a.src_ip, coalesce(b1.country_code, d.country_code) AS c1, b2.country_code AS c2 FROM a
  LEFT JOIN blocks b1 ON ip_num BETWEEN b1.start_ip AND b1.end_ip LEFT JOIN dim d ON d.nationkey = six LEFT JOIN blocks2 b2 ON ip_num BETWEEN b2.start_ip AND b2.end_ip)
SELECT src_ip, CASE WHEN src_ip LIKE '10.%' THEN '--' ELSE coalesce(c1, c2, 'XX') END AS country_code, CASE WHEN src_ip LIKE '10.%' THEN 'private' WHEN c1 IS NOT NULL THEN 'tier1' WHEN c2 IS NOT NULL THEN 'tier2' ELSE 'default' END AS tier FROM g""")
def two_tier_lookup(spark, sf):
    rows = flows(spark, sf).select("src_ip")
    tables = ((geo_blocks(spark, sf), geo_networks(spark, sf)), (second_blocks(spark, sf), None))
    tiers = [lambda a, t=pair: G.lookup(a, *t) for pair in tables]
    return G.lookup_tiers(rows, tiers).select("src_ip", "country_code", "tier")


@query("j03_sensor_city", with_ctes(FL, BLOCKS, CITIES) + """
SELECT coalesce(city, 'Unknown') AS honeypot_city, count(*) AS n FROM fl LEFT JOIN cities USING (dst_ip) GROUP BY 1""")
def sensor_city(spark, sf):
    placed = G.sensor_city(flows(spark, sf).select("dst_ip"), sensor_cities(spark, sf))
    return placed.groupBy("honeypot_city").agg(F.count(F.lit(1)).alias("n"))


@query("j08_weighted_points", EG + """
, c AS (SELECT src_ip, count(*) AS weight FROM ev GROUP BY src_ip)
SELECT ge.latitude, ge.longitude, count(*) AS addresses, CAST(sum(weight) AS BIGINT) AS weight
FROM c JOIN ge USING (src_ip) WHERE ge.latitude <> 0 AND ge.longitude <> 0 AND ge.latitude BETWEEN -90 AND 90 AND ge.longitude BETWEEN -180 AND 180
GROUP BY 1, 2""")
def weighted_points(spark, sf):
    events = attack_events(spark, sf)
    counts = events.groupBy("src_ip").agg(F.count(F.lit(1)).alias("weight"))
    points = G.weighted_points(counts, _resolved(spark, sf, events))
    return points.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("addresses"), F.sum("weight").alias("weight"))


_CENTROID = """(SELECT country_code, avg(latitude) AS latitude, avg(longitude) AS longitude FROM {0}
  WHERE latitude <> 0 AND longitude <> 0 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 GROUP BY country_code)"""


@query("j09_filled_centroids", EFG + f"""
, a AS {_CENTROID.format('gf')}, b AS {_CENTROID.format('ge')}
SELECT country_code, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM a
UNION ALL SELECT country_code, round(latitude, 6), round(longitude, 6) FROM b WHERE country_code NOT IN (SELECT country_code FROM a)""")
def filled_centroids(spark, sf):
    primary = G.country_centroids(_resolved(spark, sf, flows(spark, sf)))
    secondary = G.country_centroids(_resolved(spark, sf, attack_events(spark, sf)))
    return G.fill_centroids(primary, secondary).select(
        "country_code", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude")
    )


@query("j10_population", E_ + """
, l AS (SELECT src_ip, count(*) AS logins FROM ev WHERE contains(eventid, 'login') GROUP BY src_ip),
s AS (SELECT src_ip, count(*) AS sessions FROM ev WHERE contains(eventid, 'session.connect') GROUP BY src_ip)
SELECT src_ip, logins, sessions FROM l JOIN s USING (src_ip) WHERE logins >= 5 AND sessions >= 1""")
def population(spark, sf):
    both = FT.activity(attack_events(spark, sf)).filter((F.col("total_attempts") >= 5) & (F.col("session_count") >= 1))
    return both.select("src_ip", F.col("total_attempts").alias("logins"), F.col("session_count").alias("sessions"))


def _case(column: str, mapping: dict, default) -> str:
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {literal(v)}" for k, v in mapping.items()) + f" ELSE {literal(default)} END"


@query("j11_code_maps", with_ctes(EV, FL, BLOCKS, resolved_sql("gf", "fl")) + f"""
SELECT 'event' AS kind, CAST({_case('eventid', EVENT_CODES, 0)} AS VARCHAR) AS code, count(*) AS n FROM ev GROUP BY 2
UNION ALL SELECT 'proto', CAST({_case('proto', PROTOCOL_CODES, 3)} AS VARCHAR), count(*) FROM fl GROUP BY 2
UNION ALL SELECT 'state', CAST({_case('conn_state', STATE_CODES, 12)} AS VARCHAR), count(*) FROM fl GROUP BY 2
UNION ALL SELECT 'continent', {_case('gf.continent_code', CONTINENTS, 'Unknown')}, count(*) FROM fl JOIN gf USING (src_ip) GROUP BY 2""")
def code_maps(spark, sf):
    e, f = attack_events(spark, sf), flows(spark, sf)
    events = e.select(F.lit("event").alias("kind"), lookup(EVENT_CODES, F.col("eventid"), 0).cast("string").alias("code"))
    protos = f.select(F.lit("proto").alias("kind"), lookup(PROTOCOL_CODES, F.col("proto"), 3).cast("string").alias("code"))
    states = f.select(F.lit("state").alias("kind"), lookup(STATE_CODES, F.col("conn_state"), 12).cast("string").alias("code"))
    plain = events.unionByName(protos).unionByName(states).groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n"))
    places = G.counts_with_geo(f, [], _resolved(spark, sf, f))
    name = lookup(CONTINENTS, F.col("continent_code"), "Unknown")
    return plain.unionByName(places.groupBy(F.lit("continent").alias("kind"), name.alias("code")).agg(F.sum("weight").alias("n")))


# --- spatial rollups -------------------------------------------------------------------------------

@query("a10_country_hourly", EG + _PLACED + """
, c AS (SELECT country_code, hour, count(*) AS n FROM pe GROUP BY 1, 2),
t AS (SELECT country_code FROM c GROUP BY 1 ORDER BY sum(n) DESC, country_code LIMIT 10)
SELECT t.country_code, CAST(h AS INT) AS hour, coalesce(n, 0) AS n FROM t CROSS JOIN range(24) r(h) LEFT JOIN c ON c.country_code = t.country_code AND c.hour = h""")
def country_hourly(spark, sf):
    return R.top_hourly_profile(_event_counts(spark, sf, "hour"), "country_code", 10, "weight")


@query("a11_continent_hourly", EG + """
, c AS (SELECT continent_code, hour, count(*) AS n FROM ev JOIN ge USING (src_ip) GROUP BY 1, 2),
t AS (SELECT continent_code FROM c GROUP BY 1 ORDER BY sum(n) DESC, continent_code LIMIT 6),
g AS (SELECT t.continent_code, CAST(h AS INT) AS hour, coalesce(n, 0) AS n FROM t CROSS JOIN range(24) r(h) LEFT JOIN c ON c.continent_code = t.continent_code AND c.hour = h)
SELECT continent_code, hour, n, round(n * 100.0 / sum(n) OVER (PARTITION BY continent_code), 6) AS pct FROM g""")
def continent_hourly(spark, sf):
    look_up = lambda addresses: _resolved(spark, sf, addresses)
    counts = G.counts_by_place(attack_events(spark, sf), ("geo_continent", "geo_continent_code"), ["hour"], look_up, "continent_code")
    profile = R.hourly_share_profile(counts, "continent_code", 6, "weight")
    return profile.withColumn("pct", F.round("pct", 6))


@query("a12_country_daily", EG + _PLACED + """
, c AS (SELECT country_code, date, count(*) AS n FROM pe GROUP BY 1, 2),
t AS (SELECT country_code FROM c GROUP BY 1 ORDER BY sum(n) DESC, country_code LIMIT 5)
SELECT country_code, CAST(date AS VARCHAR) AS date, n, CASE WHEN count(*) OVER w = 3 THEN round(avg(n) OVER w, 6) END AS mean_3d
FROM c WHERE country_code IN (SELECT country_code FROM t) WINDOW w AS (PARTITION BY country_code ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def country_daily(spark, sf):
    trend = R.top_daily_trend(_event_counts(spark, sf, "date"), "country_code", 5, "weight")
    return trend.select("country_code", F.col("date").cast("string").alias("date"), "n", F.round("mean_3d", 6).alias("mean_3d"))


@query("a18_city_rollup", with_ctes(FL, BLOCKS, CITIES) + """
, p AS (SELECT city, arg_min(latitude, dst_ip) AS latitude, arg_min(longitude, dst_ip) AS longitude FROM cities GROUP BY city),
c AS (SELECT coalesce(city, 'Unknown') AS honeypot_city, count(*) AS flows, count(DISTINCT src_ip) AS n_ips FROM fl LEFT JOIN cities USING (dst_ip) GROUP BY 1)
SELECT honeypot_city, flows, n_ips, latitude, longitude, round(least(greatest(log10(flows + 1) * 5, 5), 30), 6) AS radius FROM c LEFT JOIN p ON p.city = honeypot_city""")
def city_rollup(spark, sf):
    cities = sensor_cities(spark, sf)
    placed = G.sensor_city(flows(spark, sf).select("src_ip", "dst_ip"), cities)
    return G.city_rollup(placed, cities).withColumn("radius", F.round("radius", 6))


@query("a19_country_intensity", EFG + _PLACED + """
, u AS (SELECT country_code, count(*) AS n FROM fl JOIN gf USING (src_ip) GROUP BY 1 UNION ALL SELECT country_code, count(*) FROM pe GROUP BY 1),
s AS (SELECT country_code, CAST(sum(n) AS BIGINT) AS n, log10(sum(n) + 1) AS log_n FROM u GROUP BY 1)
SELECT country_code, n, round(log_n, 6) AS log_n, round(log_n / max(log_n) OVER (), 6) AS intensity, round(least(greatest(4 * log_n, 3), 25), 6) AS radius FROM s""")
def country_intensity(spark, sf):
    f = flows(spark, sf)
    both = G.counts_with_geo(f, [], _resolved(spark, sf, f)).select("country_code", "weight").unionByName(_event_counts(spark, sf).select("country_code", "weight"))
    table = G.country_intensity(both.select("country_code", F.col("weight").alias("n")))
    return table.select("country_code", "n", *[F.round(c, 6).alias(c) for c in ("log_n", "intensity", "radius")])


@query("a20_country_centroids", FG + f"""
SELECT country_code, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM {_CENTROID.format('gf')}""")
def country_centroids(spark, sf):
    table = G.country_centroids(_resolved(spark, sf, flows(spark, sf)))
    return table.select("country_code", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("a21_hourly_points", FG + """
SELECT hour, latitude, longitude, count(*) AS weight FROM fl JOIN gf USING (src_ip)
WHERE latitude <> 0 AND longitude <> 0 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 GROUP BY ALL""")
def hourly_points(spark, sf):
    rows = flows(spark, sf).select("src_ip", "hour")
    return G.hourly_points(G.counts_with_geo(rows, ["hour"], _resolved(spark, sf, rows)))


@query("a22_resolution_stats", FG + """
SELECT count(*) AS total, count(*) FILTER (WHERE country_code NOT IN ('XX', '--')) AS resolved, count(*) FILTER (WHERE country_code IN ('XX', '--')) AS unresolved,
  count(DISTINCT country_code) FILTER (WHERE country_code NOT IN ('XX', '--')) AS countries,
  round(count(*) FILTER (WHERE country_code NOT IN ('XX', '--')) / count(*), 6) AS resolve_ratio FROM fl JOIN gf USING (src_ip)""")
def resolution_stats(spark, sf):
    f = flows(spark, sf)
    counted = G.counts_with_geo(f, [], _resolved(spark, sf, f))
    return G.resolution_stats(counted, weight="weight").withColumn("resolve_ratio", F.round("resolve_ratio", 6))


def _valid_points(spark, sf):
    rows = flows(spark, sf).select("flow_id", "src_ip")
    points = rows.join(_resolved(spark, sf, rows).select("src_ip", "latitude", "longitude"), "src_ip")
    return points.filter(valid_point("latitude", "longitude"))


@query("a27_sampled_points")
def sampled_points(spark, sf):
    return sampling.sample_rows(_valid_points(spark, sf), "flow_id", 5000)


@query("a27b_sample_facts", FG + """
, p AS (SELECT flow_id FROM fl JOIN gf USING (src_ip) WHERE latitude <> 0 AND longitude <> 0 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
SELECT least(count(*), 5000) AS n, least(count(*), 5000) AS n_distinct, least(count(*), 5000) AS n_members, count(*) AS n_source FROM p""")
def sampled_point_facts(spark, sf):
    return sample_facts_of(sampled_points(spark, sf), _valid_points(spark, sf))
