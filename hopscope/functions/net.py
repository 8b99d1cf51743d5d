"""Addresses, subnets, sockets and ports as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol names by port.
PORTS = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 67: "dhcp", 68: "dhcp", 80: "http", 110: "pop3",
    111: "rpcbind", 123: "ntp", 143: "imap", 161: "snmp", 162: "snmptrap", 389: "ldap", 443: "https", 445: "smb", 500: "isakmp",
    514: "syslog", 554: "rtsp", 587: "smtp-submission", 631: "ipp", 636: "ldaps", 873: "rsync", 1883: "mqtt", 3306: "mysql",
    5432: "pgsql", 6379: "redis", 8080: "http-alt", 8443: "https-alt", 9092: "kafka", 9200: "elasticsearch", 11211: "memcache",
    27017: "mongodb", 27018: "mongodb", 27019: "mongodb",
}
# IPv4 networks that are not public.
PRIVATE = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
PUBLIC_INSIDE = ["192.0.0.9", "192.0.0.10"]
IPV4 = r"^(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})$"


def ip_number(ip: Column, strict: bool = True) -> Column:
    """A dotted quad as a number. Strict: null unless each part is 0 to 255 without leading zeros; loose: any four numbers."""
    parts = [F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    value = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    if not strict:
        return value
    return F.when(ip.rlike(IPV4) & (F.greatest(*parts) <= 255), value)


def cidr(text: str) -> tuple[int, int]:
    """(network, prefix length) of a CIDR literal, host bits cleared; a bare address is a /32."""
    ip, _, plen = text.partition("/")
    a, b, c, d = map(int, ip.split("."))
    n = int(plen) if plen else 32
    return ((a << 24 | b << 16 | c << 8 | d) >> (32 - n)) << (32 - n), n


def network(number: Column, plen: Column | int) -> Column:
    """The address with all bits after ``plen`` cleared."""
    shift = F.lit(32) - plen
    size = F.pow(F.lit(2.0), shift).cast("bigint")
    return number - number % size


def in_networks(number: Column, nets: list[str]) -> Column:
    """Whether an address number lies in one of a few networks; null lies in none."""

    def inside(n: Column) -> Column:
        out = F.lit(False)
        for text in nets:
            low, plen = cidr(text)
            out = out | ((n >= low) & (n < low + (1 << (32 - plen))))
        return F.coalesce(out, F.lit(False))

    return F.exists(F.array(number), inside)  # so that the number is worked out once


def is_public(ip: Column) -> Column:
    """A valid address outside the special-purpose networks."""
    n = ip_number(ip)
    exempt = [cidr(x)[0] for x in PUBLIC_INSIDE]
    return F.exists(F.array(n), lambda v: v.isNotNull() & (~in_networks(v, PRIVATE) | v.isin(exempt)))


def socket(ip: Column, port: Column) -> Column:
    """``ip:port``; null where the port is missing or 0."""
    return F.when(port.isNotNull() & (port != 0), F.concat_ws(":", ip, port.cast("string")))


def biflow(a: Column, b: Column) -> Column:
    """Both directions of a flow under one name: the lesser end first, as text."""
    return F.concat(F.least(a, b), F.lit(" <-> "), F.greatest(a, b))


def first_socket(line: Column) -> tuple[Column, Column]:
    """(ip, port) of a line's first ``ip:port``; nulls where there is none."""
    pattern = r"(\d{1,3}(?:\.\d{1,3}){3}):(\d+)"
    ip = F.regexp_extract(line, pattern, 1)
    return F.when(ip != "", ip), F.when(ip != "", F.regexp_extract(line, pattern, 2).try_cast("bigint"))


def all_sockets(line: Column) -> Column:
    """All ``ip`` and ``ip:port`` of a line."""
    return F.regexp_extract_all(line, F.lit(r"\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?"), 0)


def first_ip(line: Column) -> Column:
    ip = F.regexp_extract(line, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0)
    return F.when(ip != "", ip)


def protocol(port: Column, default: str | None = None) -> Column:
    """The port's protocol name, or ``default``."""
    names = F.create_map(*[F.lit(x) for item in PORTS.items() for x in item])
    return F.coalesce(names[port.cast("int")], F.lit(default))


def is_unicast(mac: Column) -> Column:
    """The lowest bit of the first octet is 0."""
    return F.conv(F.substring(mac, 1, 2), 16, 10).cast("int").bitwiseAND(1) == 0
