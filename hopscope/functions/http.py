"""HTTP start lines, URIs, headers and fingerprints as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Methods of requests, path segments of the fare enquiry, and what they become.
METHODS = ["GET", "POST", "PUT", "HEAD", "OPTIONS", "DELETE", "PATCH"]
FARE_SEGMENTS = ["avlfarenquiry", "avlfareenquiry", "fareenquiry", "fareenq", "avlfrq"]
FARE_API = "/eticketing/avlFarenquiry"
HTTP_PORTS = [80, 8080, 8000, 8888]
SNIPPET = 512


def is_request(payload: Column) -> Column:
    return payload.rlike("^(" + "|".join(METHODS) + ") ")


def is_response(payload: Column) -> Column:
    return payload.startswith("HTTP/")


def api_of(uri: Column) -> Column:
    """A URI's API: its first three path segments, or the fare enquiry; URIs of fewer segments stay."""
    parts = F.filter(F.split(uri, "/"), lambda p: p != "")
    fare = F.exists(parts, lambda p: F.lower(p).isin(FARE_SEGMENTS))
    return F.when(F.size(parts) < 3, uri).when(fare, FARE_API).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, 3), "/")))


def mask_ids(text: Column) -> Column:
    """Words of 8 or more hex digits, then runs of 5 or more digits, become placeholders."""
    return F.regexp_replace(F.regexp_replace(text, r"\b[0-9a-fA-F]{8,}\b", "<HEXID>"), r"\d{5,}", "<ID>")


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


def request_line(line: Column) -> tuple[Column, Column, Column]:
    """(METHOD, masked path without query, protocol); a line of one token is (lower-cased line, '', '')."""
    t = _tokens(line)
    short = F.size(t) < 2
    path = mask_ids(F.regexp_replace(F.get(t, F.lit(1)), r"\?.*$", ""))
    return F.when(short, F.lower(F.trim(line))).otherwise(F.upper(F.get(t, F.lit(0)))), F.when(short, "").otherwise(path), F.when(short, "").otherwise(F.coalesce(F.get(t, F.lit(2)), F.lit("")))


def response_line(line: Column) -> tuple[Column, Column]:
    """(status, protocol), or two empty strings."""
    t = _tokens(line)
    short = F.size(t) < 2
    return F.when(short, "").otherwise(F.get(t, F.lit(1))), F.when(short, "").otherwise(F.get(t, F.lit(0)))


def decode_url(text: Column) -> Column:
    """Percent-decode (plus signs stay, a bad escape leaves the text as it is) and take out schemes."""
    plain = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return F.replace(F.replace(plain, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))


def header_signature(block: Column) -> Column:
    """The distinct lower-cased header names of a block, sorted and joined; a line without a colon counts as it is."""
    lines = F.filter(F.split(block, "\r\n"), lambda x: F.trim(x) != "")
    names = F.transform(lines, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))))
    return F.array_join(F.array_sort(F.array_distinct(names)), "|")


def split_message(message: Column) -> tuple[Column, Column, Column]:
    """(start line, header block with the start line, rest); nulls until the headers are complete."""
    at = F.locate("\r\n\r\n", message)
    block = F.when(at > 0, F.substring(message, F.lit(1), at - 1))
    return F.substring_index(block, "\r\n", 1), block, F.when(at > 0, F.substring(message, at + 4, F.length(message)))


def fingerprint(message: Column) -> Column:
    """sha256 of the normalised start line, header names and first body characters."""
    start, block, rest = split_message(message)
    method, path, proto = request_line(start)
    status, version = response_line(start)
    head = F.when(is_response(start), F.concat(status, F.lit(" "), version)).otherwise(F.concat_ws(" ", method, path, proto))
    body = F.lower(mask_ids(F.regexp_replace(F.substring(rest, 1, SNIPPET), r"\s+", " ")))
    whole = F.concat(head, F.lit("\n"), header_signature(block), F.lit("\n"), F.coalesce(body, F.lit("")))
    return F.sha2(mask_ids(whole), 256)


def content_length(value: Column) -> Column:
    """The digits of a header value as a number; none: 0; more than fit: null."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))


def host_of(url: Column) -> Column:
    """Lower-cased host without port; null without a scheme."""
    return F.lower(F.parse_url(url, F.lit("HOST")))


def is_static_segment(seg: Column) -> Column:
    """A path segment that belongs to an API rather than to one request."""
    return (
        (seg != "")
        & ~seg.rlike(r"^\d+$")
        & ~((F.length(seg) <= 4) & (F.upper(seg) == seg) & (F.lower(seg) != seg))
        & ~((F.length(seg) >= 7) & seg.rlike(r"\d") & seg.rlike(r"[A-Za-z]"))
        & ~seg.rlike("^[0-9a-fA-F]{6,}$")
    )


def base_url(url: Column) -> Column:
    """Scheme, host and static path segments of a URL; ``http://`` is added where it is missing."""
    full = F.trim(F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("http://"), url)))
    bare = F.regexp_replace(full, r"[?#].*$", "")
    root = F.regexp_extract(bare, r"^([^:/]+://[^/]*)", 1)
    path = F.substring(bare, F.length(root) + 1, F.length(bare))
    kept = F.filter(F.split(path, "/"), is_static_segment)
    clean = F.concat(F.array_join(kept, "/"), F.when(path.endswith("/") & (F.size(kept) > 0), "/").otherwise(""))
    return F.concat(root, F.when(clean != "", F.concat(F.lit("/"), clean)).otherwise(""))


def safe_name(text: Column) -> Column:
    """Other characters than ASCII letters and digits become underscores; the last 100 stay."""
    return F.right(F.regexp_replace(text, "[^A-Za-z0-9]", "_"), F.lit(100))
