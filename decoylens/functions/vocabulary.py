"""Fixed values the results depend on, stated plainly."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Event ids kept at ingest.
TARGET_EVENTS = (
    "cowrie.session.connect",
    "cowrie.login.success",
    "cowrie.login.failed",
    "cowrie.command.input",
    "cowrie.session.closed",
    "cowrie.session.file_download",
)

# Event codes of the sequence vectors; anything else is 0.
EVENT_CODES = {
    "cowrie.login.success": 1,
    "cowrie.login.failed": 2,
    "cowrie.session.connect": 3,
    "cowrie.session.closed": 4,
    "cowrie.command.input": 5,
    "cowrie.command.failed": 6,
    "cowrie.client.version": 7,
}

# Protocol codes; anything else is 3.
PROTOCOL_CODES = {"tcp": 0, "udp": 1, "icmp": 2}

# Connection-state codes; anything else is 12.
STATE_CODES = {
    "S0": 0, "S1": 1, "SF": 2, "REJ": 3, "S2": 4, "S3": 5, "RSTO": 6,
    "RSTR": 7, "RSTOS0": 8, "RSTRH": 9, "SH": 10, "SHR": 11, "OTH": 12,
}

# Ports counted as common targets.
COMMON_PORTS = (22, 23, 80, 443, 445, 3389, 8080, 8443)

# String prefixes of private addresses.
PRIVATE_PREFIXES = ("10.", "172.16.", "192.168.", "127.", "0.")

# Continent display names.
CONTINENTS = {
    "AF": "Africa", "AN": "Antarctica", "AS": "Asia", "EU": "Europe",
    "NA": "North America", "OC": "Oceania", "SA": "South America",
}

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Candidate column names of label tables.
ADDRESS_COLUMNS = ("src_ip", "ip", "source_ip", "orig_h")


def lookup(mapping: dict, key: Column, default) -> Column:
    """``mapping[key]`` with a default, as a literal map inside the plan."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
