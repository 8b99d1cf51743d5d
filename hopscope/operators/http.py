"""HTTP over captures: requests and responses in packets, round-trip times, API and fingerprint counts.

``frames`` has the columns of ``schemas.PACKETS`` that are used: capture, frame, ts_us, ethertype, ip_proto,
src, sport, dst, dport, seq, ack, payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http
from ..scratch import cut, few
from ..sources.reassembly import http_messages
from . import aggregate, pairing

#: How a start line of any method, and of a response, looks.
REQUEST, RESPONSE = r"^([A-Z_]+)\s+(\S+)\s+HTTP\S*\s*?\r?\n", r"^HTTP\S*\s+(\d+)(?:[ \t]+([^\r\n]*?))?[ \t]*\r?\n"


def _text(frames: DataFrame) -> DataFrame:
    """TCP segments with payload, and it as latin-1 text."""
    kept = frames.where((F.col("ethertype") == 2048) & (F.col("ip_proto") == 6) & (F.octet_length("payload") > 0))
    return kept.withColumn("_text", F.decode("payload", "ISO-8859-1"))


def since_first(frames: DataFrame) -> DataFrame:
    """One row for each capture: when its first frame came."""
    return frames.groupBy("capture").agg(F.min_by("ts_us", "frame").alias("t0"))


def http_extract(frames: DataFrame, ports: list[int] | None = None) -> DataFrame:
    """Requests and responses on HTTP ports: capture, frame, ts_rel, client, server, pkt_len, method, reason, direction.

    A packet counts if its start line is whole; client and server swap where a response is.
    """
    ports = ports or http.HTTP_PORTS
    kept = _text(frames.where(F.col("sport").isin(ports) | F.col("dport").isin(ports)))
    method, back = F.regexp_extract("_text", REQUEST, 1), F.col("_text").rlike(RESPONSE)
    ends = [F.concat_ws(":", F.col(a), F.col(p).cast("string")) for a, p in (("src", "sport"), ("dst", "dport"))]
    rows = kept.withColumn("_back", back).where((method != "") | back)
    out = rows.join(few(cut(since_first(frames))), "capture")  # a row for each capture
    return out.select(
        "capture", "frame", ((F.col("ts_us") - F.col("t0")) / 1e6).alias("ts_rel"), F.when(F.col("_back"), ends[1]).otherwise(ends[0]).alias("client"), F.when(F.col("_back"), ends[0]).otherwise(ends[1]).alias("server"),
        F.octet_length("payload").alias("pkt_len"), F.when(~F.col("_back"), method).alias("method"), F.when(F.col("_back"), F.regexp_extract("_text", RESPONSE, 2)).alias("reason"), F.when(F.col("_back"), "response").otherwise("request").alias("direction"),
    )


def outcome_counts(events: DataFrame) -> DataFrame:
    """Requests by method and responses by reason phrase: direction, what, n."""
    return events.groupBy("direction", F.coalesce("method", "reason").alias("what")).agg(F.count("*").alias("n"))


def api_groups(frames: DataFrame, methods: list[str]) -> DataFrame:
    """Requests of ``methods`` by method and API: method, api, n, example (the URI of the first one)."""
    rows = _text(frames).select("frame", F.regexp_extract("_text", REQUEST, 1).alias("method"), F.regexp_extract("_text", REQUEST, 2).alias("uri")).where(F.col("method").isin(methods))
    return rows.groupBy("method", http.api_of(F.col("uri")).alias("api")).agg(F.count("*").alias("n"), F.min_by("uri", "frame").alias("example"))


def messages_by_packet(frames: DataFrame) -> DataFrame:
    """Requests and responses that begin a packet, each with its connection as the client sees it, for FIFO pairing."""
    rows = _text(frames)
    kind = F.when(http.is_request(F.col("_text")), "REQ").when(http.is_response(F.col("_text")), "RESP")
    line = F.split(F.trim(F.substring_index("_text", "\r\n", 1)), r"\s+")
    swap = lambda a, b: F.when(F.col("kind") == "REQ", F.col(a)).otherwise(F.col(b))
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select(
        "capture", swap("src", "dst").alias("client_ip"), swap("sport", "dport").alias("client_port"), swap("dst", "src").alias("server_ip"), swap("dport", "sport").alias("server_port"), "frame", "ts_us", "kind",
        (F.col("seq") + F.octet_length("payload")).alias("seq_end"), "ack", F.coalesce(F.get(line, F.lit(0)), F.lit("")).alias("method"), F.coalesce(F.get(line, F.lit(1)), F.lit("")).alias("uri"), F.octet_length("payload").alias("size"),
    )


CONNECTION = ["capture", "client_ip", "client_port", "server_ip", "server_port"]


def paired(frames: DataFrame) -> DataFrame:
    """Requests with their responses, first in first out on each connection, once acknowledged."""
    return pairing.fifo_pairs(messages_by_packet(frames), CONNECTION, ["method", "uri", "size"])


def http_rtt(frames: DataFrame) -> DataFrame:
    """The round-trip table (``schemas.HTTP_RTT``); times count from the capture's first frame."""
    pairs = paired(frames).join(few(cut(since_first(frames))), "capture")  # a row for each capture
    at = lambda c: (F.col(c) - F.col("t0")) / 1e6
    return pairs.select(
        F.col("req_method").alias("method"), "client_ip", "client_port", "server_ip", "server_port", F.col("req_uri").alias("uri"), at("req_ts_us").alias("request_time_rel"), at("res_ts_us").alias("response_time_rel"),
        F.col("delay_s").alias("rtt"), F.col("req_size").alias("request_size"), F.col("res_size").alias("response_size"),
    )


def run_summary(frames: DataFrame, ports: list[int] | None = None) -> DataFrame:
    """Packets, packets on HTTP ports, and requests that a response was found for; one row."""
    ports = ports or http.HTTP_PORTS
    packets = frames.agg(F.count("*").alias("packets"), F.count_if(F.col("sport").isin(ports) | F.col("dport").isin(ports)).alias("http_packets"))
    return packets.crossJoin(paired(frames).agg(F.count("*").alias("matched")))  # two single rows


def fingerprint_counts(frames: DataFrame) -> DataFrame:
    """Fingerprints of reassembled messages: kind, sha, n, example (of the first one, cut), and the kind's messages (total) and fingerprints (kinds)."""
    m = http_messages(frames).select("kind", "capture", "frame", "src", "dst", "n", "message", http.fingerprint(F.col("message")).alias("sha"))
    first = F.min_by(F.substring("message", 1, http.SNIPPET), F.struct("frame", "capture", "src", "dst", F.col("n")))
    counts = m.groupBy("kind", "sha").agg(F.count("*").alias("n"), first.alias("example"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return counts.join(F.broadcast(totals), "kind")  # two rows


def top_fingerprints(counts: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent fingerprints of each kind: kind, rank, n, sha."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "sha"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("kind", "rank", "n", "sha")


def request_sizes(rtt: DataFrame) -> DataFrame:
    """The sizes of both sides of a round-trip table, stacked: one column size."""
    return rtt.select(F.explode(F.array("request_size", "response_size")).alias("size"))


def length_bins(rows: DataFrame, size: str, parts: int = 50) -> DataFrame:
    """Counts in bins of a ``parts``-th of the greatest size, 1 at least: bin, low, n."""
    width = rows.agg(F.greatest(F.lit(1), F.floor(F.max(size) / parts)).cast("bigint").alias("w"))
    b = F.floor(F.col(size) / F.col("w")).cast("bigint")
    return rows.where(F.col(size).isNotNull()).crossJoin(F.broadcast(width)).groupBy(b.alias("bin"), (b * F.col("w")).alias("low")).agg(F.count("*").alias("n"))  # one row


def matched_addresses(frames: DataFrame, prefixes: DataFrame, address: Column) -> DataFrame:
    """Distinct public addresses with asn, name and plen of their longest prefix, nulls where there is none."""
    from ..functions import net
    from . import enrich

    ips = frames.select(address.alias("ip")).distinct().where(net.is_public(F.col("ip"))).withColumn("_n", net.ip_number(F.col("ip")))
    return enrich.longest_prefix(ips, prefixes, "_n", ["asn", "name"]).drop("_n")


def match_share(matched: DataFrame) -> DataFrame:
    """Addresses with and without a prefix, and the share that has one; 0 of none."""
    hit = F.col("asn").isNotNull()
    return matched.agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"), aggregate.share(F.count_if(hit), F.count("*")).cast("double").alias("pct"))


def asn_distribution(matched: DataFrame) -> DataFrame:
    """Addresses by name of their AS: name, n, pct of all addresses, those without a prefix too."""
    total = matched.agg(F.count("*").alias("total"))
    n = matched.where("asn IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("name", "n", aggregate.share(F.col("n"), F.col("total")).cast("double").alias("pct"))  # one row
