"""Address geography: range lookup, fallback tiers, sensor cities, country tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import address_hex, address_number, clamp, hex_prefix, is_private, valid_point

# Columns of a geography row and what they hold when nothing is known.
GEO_DEFAULTS = {
    "country_code": "XX",
    "country_name": "Unknown",
    "city": "Unknown",
    "latitude": 0.0,
    "longitude": 0.0,
    "continent_code": "XX",
    "continent_name": "Unknown",
    "region": "Unknown",
    "accuracy_radius_km": 0,
}
# What a private address holds instead.
PRIVATE = {"country_code": "--", "country_name": "Private"}
UNRESOLVED = ("XX", "--")
PREFIX_BITS = 16


def block_lookup(addresses: DataFrame, blocks: DataFrame, ip: str = "src_ip", how: str = "inner") -> DataFrame:
    """Range join of distinct addresses with disjoint ``blocks(start_ip, end_ip, <geography>)``.

    Blocks are spread over the address prefixes they cover, which turns the range condition into an
    equi-join on the prefix plus a residual test. No side is forced to broadcast: Spark picks by size.
    Addresses that do not parse become -1 rather than null, or the null check of the join key would
    be pushed below the distinct and every raw row would be parsed.
    """
    span = F.sequence(F.shiftright("start_ip", PREFIX_BITS), F.shiftright("end_ip", PREFIX_BITS))
    spread = blocks.withColumn("_prefix", F.explode(span))
    numbered = (
        addresses.select(ip)
        .distinct()
        .withColumn("_ip", F.coalesce(address_number(ip), F.lit(-1).cast("bigint")))
        .withColumn("_prefix", F.shiftright("_ip", PREFIX_BITS))
    )
    inside = F.col("_ip").between(F.col("start_ip"), F.col("end_ip"))
    found = numbered.join(spread, (numbered["_prefix"] == spread["_prefix"]) & inside, how)
    return found.select(ip, *[c for c in blocks.columns if c not in ("start_ip", "end_ip")])


def network_lookup(addresses: DataFrame, networks: DataFrame, ip: str = "src_ip", how: str = "inner") -> DataFrame:
    """Longest-prefix lookup of distinct IPv6 and IPv4 addresses in ``networks(network, <geography>)``, text like
    ``2001:db8::/32``; networks may nest, and an IPv4 address is in IPv4 networks only.

    Each address becomes one row per prefix length that occurs (129 at most), which makes the lookup one equi-join on
    length and prefix; the longest hit stands.
    """
    fields = [c for c in networks.columns if c != "network"]
    base, bits = F.substring_index("network", "/", 1), F.substring_index("network", "/", -1).try_cast("int")
    # 1 for IPv6, 0 for IPv4, -1 for text that is neither: the prefix of no bits is empty for all of them.
    kind = lambda text: F.when(F.col("_hex") == "", -1).otherwise(F.coalesce(text.contains(":"), F.lit(False)).cast("int"))
    # No null is left in what is joined: a test for it would be pushed down and repeat the parsing.
    keyed = networks.withColumn("_hex", F.coalesce(address_hex(base), F.lit(""))).withColumn("_six", kind(base)).withColumn("_bits", F.when(base.contains(":"), bits).otherwise(bits + 96))
    lengths = sorted(r[0] for r in keyed.filter(F.col("_bits").between(0, 128)).select("_bits").distinct().collect())
    prefixes = F.array(*[F.struct(F.lit(n).alias("_bits"), hex_prefix(F.col("_hex"), n).alias("_prefix")) for n in lengths or [128]])
    spread = addresses.select(ip).distinct().withColumn("_hex", F.coalesce(address_hex(ip), F.lit("")))
    spread = spread.select(ip, kind(F.col(ip)).alias("_six"), F.inline(prefixes))
    # A network has the prefix of its own length among those of all lengths.
    right = keyed.select("_six", F.col("_bits").alias("_own"), F.struct(*fields).alias("_place"), F.inline(prefixes))
    right = right.filter((F.col("_own") == F.col("_bits")) & (F.col("_six") >= 0)).drop("_own").dropDuplicates(["_six", "_bits", "_prefix"])
    found = spread.join(right, ["_six", "_bits", "_prefix"], how)
    best = found.groupBy(ip).agg(F.max_by("_place", F.when(F.col("_place").isNotNull(), F.col("_bits"))).alias("_place"))
    return best.select(ip, *[F.col("_place").getField(c).alias(c) for c in fields])


def lookup(addresses: DataFrame, blocks: DataFrame, networks: DataFrame | None = None, ip: str = "src_ip", how: str = "inner") -> DataFrame:
    """Dotted addresses from ``blocks``, those with a colon from ``networks`` where these are given."""
    if networks is None:
        return block_lookup(addresses, blocks, ip, how)
    six = F.coalesce(F.col(ip).contains(":"), F.lit(False))
    four = block_lookup(addresses.filter(~six), blocks, ip, how)
    return four.unionByName(network_lookup(addresses.filter(six), networks, ip, how).select(four.columns))


def lookup_tiers(addresses: DataFrame, tiers: Sequence[Callable[[DataFrame], DataFrame]], ip: str = "src_ip") -> DataFrame:
    """Geography and ``tier`` per distinct address: private prefixes first, then tier after tier.

    A tier maps an address table to ``(ip, geography)``. It only sees the addresses that all
    earlier tiers left open; a row with code XX counts as not found. The address table is cached
    per tier, since both the open part and the whole are read.
    """
    table = addresses.select(ip).distinct().withColumn("tier", F.when(is_private(ip), F.lit("private")))
    table = table.withColumns(
        {k: F.when(F.col("tier").isNotNull(), F.lit(PRIVATE.get(k, v))) for k, v in GEO_DEFAULTS.items()}
    )
    for number, tier in enumerate(tiers, 1):
        table = table.persist()
        found = tier(table.filter(F.col("tier").isNull()).select(ip)).filter(~F.col("country_code").isin(*UNRESOLVED))
        hit = found.select(ip, *[F.col(c).alias("_" + c) for c in GEO_DEFAULTS], F.lit(f"tier{number}").alias("_tier"))
        columns = ("tier", *GEO_DEFAULTS)
        table = table.join(hit, ip, "left").select(ip, *[F.coalesce(c, "_" + c).alias(c) for c in columns])
    filled = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in {"tier": "default", **GEO_DEFAULTS}.items()}
    return table.withColumns(filled)


def resolve(addresses: DataFrame, blocks: DataFrame, networks: DataFrame | None = None, ip: str = "src_ip") -> DataFrame:
    """One geography row per distinct address: the private ones as such, sentinels where no block or network holds it."""
    own = lambda k, v: F.when(is_private(ip), F.lit(PRIVATE.get(k, v))).otherwise(F.coalesce(F.col(k), F.lit(v)))
    return lookup(addresses, blocks, networks, ip, "left").select(ip, *[own(k, v).alias(k) for k, v in GEO_DEFAULTS.items()])


def enrich(df: DataFrame, resolved: DataFrame, ip: str = "src_ip", prefix: str = "geo_") -> DataFrame:
    """Left join the geography columns on, prefixed, plus the ``src_country_*`` pair.

    The resolved table is keyed by address, so a heavy address only makes the left side skewed,
    which the adaptive skew join splits.
    """
    side = resolved.select(ip, *[F.col(c).alias(prefix + c) for c in GEO_DEFAULTS])
    joined = df.join(side, ip, "left")
    return joined.withColumns(
        {
            **{prefix + k: F.coalesce(F.col(prefix + k), F.lit(v)) for k, v in GEO_DEFAULTS.items()},
            "src_country_code": F.coalesce(F.col(prefix + "country_code"), F.lit("XX")),
            "src_country_name": F.coalesce(F.col(prefix + "country_name"), F.lit("Unknown")),
        }
    )


def counts_with_geo(df: DataFrame, keys: Sequence[str], resolved: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Count per (address, keys) first and attach geography to the counts.

    Rollups by country need no join of the raw rows: the join sees one row per address and key.
    """
    counted = df.groupBy(ip, *keys).agg(F.count(F.lit(1)).alias("weight"))
    return counted.join(resolved, ip, "left")


def counts_by_place(
    df: DataFrame, candidates: Sequence[str], keys: Sequence[str], look_up: Callable[[DataFrame], DataFrame], field: str, ip: str = "src_ip"
) -> DataFrame:
    """``(field, *keys, weight)``: from the first candidate column the table has, else by address lookup."""
    for column in candidates:
        if column in df.columns:
            known = df.filter(F.col(column).isNotNull())
            return known.groupBy(F.col(column).alias(field), *keys).agg(F.count(F.lit(1)).alias("weight"))
    return counts_with_geo(df, keys, look_up(df.select(ip)), ip).select(field, *keys, "weight")


def country_map(pairs: DataFrame, countries: DataFrame, look_up: Callable[[DataFrame], DataFrame], own: str, ip: str = "src_ip") -> DataFrame:
    """``(ip, own, country_code, origin)`` of distinct pairs: the row's own code, else the address's country, else XX.

    ``countries(code2, code3, name)`` is the one key table: an own value may be any of the three, in any case, and
    becomes the two-letter code. Only addresses whose rows bring no known code are looked up.
    """
    keys = countries.select(F.upper("code2").alias("_key"), "code2")
    for other in ("code3", "name"):
        keys = keys.unionByName(countries.select(F.upper(other).alias("_key"), "code2"))
    keys = keys.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("code2").alias("_own"))
    known = pairs.select(ip, own).distinct().withColumn("_key", F.upper(F.trim(own))).join(keys, "_key", "left")
    places = look_up(known.filter(F.col("_own").isNull()).select(ip)).select(ip, F.col("country_code").alias("_place"))
    both = known.join(places, ip, "left")
    origin = F.when(F.col("_own").isNotNull(), "own").when(~F.col("_place").isin(*UNRESOLVED), "address").otherwise("unknown")
    return both.select(ip, own, F.coalesce("_own", "_place", F.lit("XX")).alias("country_code"), origin.alias("origin"))


def counts_by_country(
    df: DataFrame, keys: Sequence[str], countries: DataFrame, look_up: Callable[[DataFrame], DataFrame], own: str = "geo_country_code", ip: str = "src_ip"
) -> DataFrame:
    """``(country_code, origin, *keys, weight)``: rows are counted per (address, own code, keys) before any join."""
    counted = df.groupBy(ip, own, *keys).agg(F.count(F.lit(1)).alias("weight"))
    return _joined(counted, country_map(counted, countries, look_up, own, ip), own, ip).select("country_code", "origin", *keys, "weight")


def with_country(
    df: DataFrame, countries: DataFrame, look_up: Callable[[DataFrame], DataFrame], own: str = "geo_country_code", ip: str = "src_ip", name: str = "src_country_code"
) -> DataFrame:
    """Every row with its country by ``country_map``."""
    found = country_map(df, countries, look_up, own, ip)
    return _joined(df, found, own, ip).select(*df.columns, F.col("country_code").alias(name))


def _joined(df: DataFrame, found: DataFrame, own: str, ip: str) -> DataFrame:
    side = found.select(F.col(ip).alias("_ip"), F.col(own).alias("_code"), "country_code", "origin")
    return df.join(side, df[ip].eqNullSafe(side["_ip"]) & df[own].eqNullSafe(side["_code"])).drop("_ip", "_code")


def sensor_city(df: DataFrame, cities: DataFrame, ip: str = "dst_ip", name: str = "honeypot_city") -> DataFrame:
    """Attach the city of the sensor that was addressed, ``Unknown`` when it is not listed."""
    side = cities.select(ip, F.col("city").alias(name))
    return df.join(side, ip, "left").withColumn(name, F.coalesce(F.col(name), F.lit("Unknown")))


def city_rollup(df: DataFrame, places: DataFrame, city: str = "honeypot_city") -> DataFrame:
    """Flows, distinct sources, one representative coordinate and a marker radius per city."""
    counted = df.groupBy(city).agg(F.count(F.lit(1)).alias("flows"), F.count_distinct("src_ip").alias("n_ips"))
    spots = places.groupBy(F.col("city").alias(city)).agg(
        F.min_by("latitude", "dst_ip").alias("latitude"), F.min_by("longitude", "dst_ip").alias("longitude")
    )
    radius = clamp(F.log10(F.col("flows") + 1) * 5, 5, 30)
    return counted.join(spots, city, "left").withColumn("radius", radius)


def country_intensity(counts: DataFrame, code: str = "country_code", weight: str = "n") -> DataFrame:
    """Summed counts per country on a log scale, relative to the strongest, with a radius."""
    table = counts.groupBy(code).agg(F.sum(weight).cast("bigint").alias("n")).withColumn("log_n", F.log10(F.col("n") + 1))
    strongest = F.max("log_n").over(Window.partitionBy(F.lit(0)))
    return table.withColumns(
        {"intensity": F.col("log_n") / strongest, "radius": clamp(4 * F.col("log_n"), 3, 25)}
    )


def country_centroids(resolved: DataFrame, code: str = "country_code") -> DataFrame:
    """Mean coordinate over the distinct addresses of a country, zero coordinates left out."""
    usable = resolved.filter(valid_point("latitude", "longitude"))
    return usable.groupBy(code).agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def fill_centroids(primary: DataFrame, secondary: DataFrame, code: str = "country_code") -> DataFrame:
    """Rows of ``secondary`` for countries ``primary`` does not have."""
    return primary.unionByName(secondary.join(primary, code, "left_anti"))


def weighted_points(counts: DataFrame, resolved: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Valid coordinates with the number of rows behind each address."""
    places = resolved.filter(valid_point("latitude", "longitude")).select(ip, "latitude", "longitude")
    return counts.join(places, ip)


def hourly_points(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """``(hour, latitude, longitude, weight)`` of the valid points, from counts per (address, hour) with geography.

    All rows are in the weights. ``limit`` keeps the heaviest points of each hour, only where it is asked for.
    """
    points = counts.filter(valid_point("latitude", "longitude")).groupBy("hour", "latitude", "longitude")
    points = points.agg(F.sum("weight").cast("bigint").alias("weight"))
    if limit is None:
        return points
    heaviest = Window.partitionBy("hour").orderBy(F.desc("weight"), "latitude", "longitude")
    return points.withColumn("_n", F.row_number().over(heaviest)).filter(F.col("_n") <= limit).drop("_n")


def resolution_stats(df: DataFrame, code: str = "country_code", weight: str | None = None) -> DataFrame:
    """Totals, resolved and unresolved counts, distinct countries and the resolve ratio."""
    one = F.col(weight) if weight else F.lit(1)
    resolved = ~F.col(code).isin(*UNRESOLVED)
    stats = df.agg(
        F.sum(one).cast("bigint").alias("total"),
        F.sum(F.when(resolved, one).otherwise(0)).cast("bigint").alias("resolved"),
        F.count_distinct(F.when(resolved, F.col(code))).alias("countries"),
    )
    return stats.select(
        "total", "resolved", (F.col("total") - F.col("resolved")).alias("unresolved"), "countries",
        (F.col("resolved") / F.greatest("total", F.lit(1))).alias("resolve_ratio"),
    )
