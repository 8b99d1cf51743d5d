"""The functions that users of SQL miss most, as temporary SQL functions: Catalyst puts their bodies in place of the calls.

``register(spark)`` makes them known to a session; each is the SQL form of a Column builder of this package.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .http import FARE_API, FARE_SEGMENTS
from .net import IPV4, PORTS, PRIVATE, PUBLIC_INSIDE, cidr

_PARTS = ", ".join(f"try_cast(try_element_at(split(ip, r'\\.'), {i}) AS BIGINT)" for i in (1, 2, 3, 4))
_STATIC = r"""s -> s <> '' AND NOT s RLIKE r'^\d+$' AND NOT (length(s) <= 4 AND upper(s) = s AND lower(s) <> s)
    AND NOT (length(s) >= 7 AND s RLIKE r'\d' AND s RLIKE '[A-Za-z]') AND NOT s RLIKE '^[0-9a-fA-F]{6,}$'"""
_LOOSE = "aggregate(array(" + _PARTS + "), 0L, (a, x) -> a * 256 + x)"
_NETS = " OR ".join(f"n BETWEEN {net} AND {net + (1 << (32 - plen)) - 1}" for net, plen in map(cidr, PRIVATE))
_INSIDE = ", ".join(str(cidr(x)[0]) for x in PUBLIC_INSIDE)

#: Name: (arguments, result, body).
FUNCTIONS = {
    "ip_number": ("ip STRING", "BIGINT", f"CASE WHEN ip RLIKE r'{IPV4}' AND array_max(array({_PARTS})) <= 255 THEN {_LOOSE} END"),
    "ip_number_loose": ("ip STRING", "BIGINT", _LOOSE),
    "network_of": ("number BIGINT, plen INT", "BIGINT", "number - number % CAST(pow(2D, 32 - plen) AS BIGINT)"),
    "is_public_number": ("n BIGINT", "BOOLEAN", f"n IS NOT NULL AND (NOT ({_NETS}) OR n IN ({_INSIDE}))"),
    "protocol_of": ("port INT", "STRING", "CASE port " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in PORTS.items()) + " END"),
    "uri_segments": ("uri STRING", "ARRAY<STRING>", "filter(split(uri, '/'), p -> p <> '')"),
    "api_of": ("uri STRING", "STRING", f"CASE WHEN size(filter(split(uri, '/'), p -> p <> '')) < 3 THEN uri WHEN exists(split(uri, '/'), p -> lower(p) IN ({', '.join(repr(x) for x in FARE_SEGMENTS)})) THEN '{FARE_API}' ELSE concat('/', array_join(slice(filter(split(uri, '/'), p -> p <> ''), 1, 3), '/')) END"),
    "mask_ids": ("text STRING", "STRING", r"regexp_replace(regexp_replace(text, r'\b[0-9a-fA-F]{8,}\b', '<HEXID>'), r'\d{5,}', '<ID>')"),
    "static_segments": ("path STRING", "STRING", f"array_join(filter(split(path, '/'), {_STATIC}), '/')"),
    "host_of": ("url STRING", "STRING", "lower(try_parse_url(url, 'HOST'))"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
