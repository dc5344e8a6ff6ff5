"""Small scalar expressions: time, addresses, strings, guarded arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .vocabulary import PRIVATE_PREFIXES

MICROS = 1_000_000


def has_part(eventid: Column | str, part: str) -> Column:
    """Substring test on an event id; null counts as false."""
    eventid = F.col(eventid) if isinstance(eventid, str) else eventid
    return F.coalesce(eventid.contains(part), F.lit(False))


def is_login(eventid: Column | str = "eventid") -> Column:
    return has_part(eventid, "login")


def per(numerator: Column, denominator: Column) -> Column:
    """Division guarded as ``x / max(y, 1)``."""
    return numerator / F.greatest(denominator, F.lit(1))


def finite(value: Column) -> Column:
    """NaN, infinities and nulls become 0."""
    value = value.cast("double")
    usable = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(usable, value).otherwise(F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds (double) to a timestamp, at microsecond precision."""
    return F.timestamp_micros(F.round(seconds * MICROS).cast("bigint"))


def micros(timestamp: Column | str) -> Column:
    timestamp = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.unix_micros(timestamp)


def time_columns(timestamp: Column) -> dict[str, Column]:
    """The derived time columns every log row carries (session zone is UTC)."""
    return {
        "timestamp": timestamp,
        "date": F.to_date(timestamp),
        "hour": F.hour(timestamp),
        "day_of_week": F.date_format(timestamp, "EEEE"),
    }


def month_key(date: Column | str) -> Column:
    return F.date_format(date, "yyyy-MM")


def as_count(value: Column) -> Column:
    """Counter field to BIGINT: unparsable and missing become 0, decimals are cut."""
    whole = F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))
    return F.coalesce(whole, F.lit(0).cast("bigint"))


def address_number(address: Column | str) -> Column:
    """Dotted IPv4 text to its number; null when it is not four numbers from 0 to 255."""
    address = F.col(address) if isinstance(address, str) else address
    parts = F.split(address, r"\.")
    octets = [F.get(parts, position).try_cast("bigint") for position in range(4)]
    number, valid = F.lit(0).cast("bigint"), F.size(parts) == 4
    for octet in octets:
        number, valid = number * 256 + octet, valid & octet.between(0, 255)
    return F.when(valid, number)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: the expression holds it once, however often ``use`` does."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def address_hex(address: Column | str) -> Column:
    """IPv6 or dotted IPv4 text as the 32 hex digits of its 128 bits, IPv4 in its mapped form; null for anything else."""
    address = F.lower(F.col(address) if isinstance(address, str) else address)

    def plain(text: Column) -> Column:
        """A dotted end as two groups; one that is no address leaves a text that is none either."""
        number = lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")
        four = bound(F.regexp_extract(text, r"([0-9.]+)$", 1), address_number)
        groups = bound(number(four), lambda d: F.concat(F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
        return F.when(text.contains("."), F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), groups)).otherwise(text)

    def digits(sides: Column) -> Column:
        groups = lambda side: F.when(F.length(side) > 0, F.split(side, ":")).otherwise(F.array().cast("array<string>"))
        pair = F.struct(groups(F.get(sides, F.lit(0))).alias("left"), groups(F.get(sides, F.lit(1))).alias("right"), F.size(sides).alias("n"))
        return bound(pair, filled)

    def filled(p: Column) -> Column:
        missing = 8 - F.size(p["left"]) - F.size(p["right"])
        valid = F.when(p["n"] == 2, missing >= 1).otherwise((p["n"] == 1) & (missing == 0))
        whole = F.concat(p["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), p["right"])
        good = bound(whole, lambda w: F.when(F.forall(w, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(w, lambda g: F.lpad(g, 4, "0")), "")))
        return F.when(valid, good)

    mapped = bound(address, lambda a: F.when(~a.contains(":"), F.concat(F.lit("::ffff:"), a)).otherwise(a))
    return bound(bound(mapped, plain), lambda text: bound(F.split(text, "::"), digits))


def hex_prefix(digits: Column, bits: int) -> Column:
    """The first ``bits`` bits of hex digits, as hex digits, the last one filled with zero bits."""
    whole, rest = divmod(bits, 4)
    head = F.substring(digits, 1, whole)
    if not rest:
        return head
    masked = "".join(f"{i & (15 << 4 - rest & 15):x}" for i in range(16))
    return F.concat(head, F.translate(F.substring(digits, whole + 1, 1), "0123456789abcdef", masked))


def is_private(address: Column | str, rfc1918: bool = False) -> Column:
    """Private address by string prefix; ``rfc1918`` adds 172.17 to 172.31."""
    address = F.col(address) if isinstance(address, str) else address
    prefixes = list(PRIVATE_PREFIXES)
    if rfc1918:
        prefixes += [f"172.{second}." for second in range(17, 32)]
    test = F.lit(False)
    for prefix in prefixes:
        test = test | address.startswith(prefix)
    return F.coalesce(test, F.lit(False))


def valid_point(latitude: Column | str, longitude: Column | str) -> Column:
    """Coordinates that are present, non-zero and on the globe."""
    lat = F.col(latitude) if isinstance(latitude, str) else latitude
    lon = F.col(longitude) if isinstance(longitude, str) else longitude
    inside = (lat != 0) & (lon != 0) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(inside, F.lit(False))
