"""Queries for the operators, each with the SQL that DuckDB answers the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import http, latency, net, tls
from ..operators import aggregate, enrich, mixture, models, pairing
from ..sources import tables
from .views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register a function of its views (or of spark and the folder where it names none) as a query."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views]) if views else f(spark, sf_dir)
        if sql:
            ORACLE_SQL[name] = duck(sql, *views)
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# Filters: rows and the sum of their frames.
_n = lambda c: net.ip_number(F.col(c))
_IP = "regexp_full_match({0}, '(0|[1-9]\\d?\\d?)(\\.(0|[1-9]\\d?\\d?)){{3}}')"
_NUM = "(CASE WHEN regexp_full_match({0}, '(0|[1-9]\\d?\\d?)(\\.(0|[1-9]\\d?\\d?)){{3}}') AND greatest(split_part({0}, '.', 1)::INT, split_part({0}, '.', 2)::INT, split_part({0}, '.', 3)::INT, split_part({0}, '.', 4)::INT) <= 255 THEN ((split_part({0}, '.', 1)::BIGINT * 256 + split_part({0}, '.', 2)::BIGINT) * 256 + split_part({0}, '.', 3)::BIGINT) * 256 + split_part({0}, '.', 4)::BIGINT END)"
_LOOSE = "(((split_part({0}, '.', 1)::BIGINT * 256 + split_part({0}, '.', 2)::BIGINT) * 256 + split_part({0}, '.', 3)::BIGINT) * 256 + split_part({0}, '.', 4)::BIGINT)"


def _duck_in(number: str, nets: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"({number} >= {net.cidr(x)[0]} AND {number} < {net.cidr(x)[0] + (1 << (32 - net.cidr(x)[1]))})" for x in nets) + ", false)"


_DST = _NUM.format("dst")
FILTERS: dict[str, tuple[str, Callable[[], Column], str]] = {
    "F1_ipv4_tcp_udp": ("packet", lambda: (F.col("ethertype") == 2048) & F.col("ip_proto").isin(6, 17), "ethertype = 2048 AND ip_proto IN (6, 17)"),
    "F2_payload": ("packet", lambda: F.octet_length(F.col("payload")) > 0, "octet_length(payload) > 0"),
    "F3_tls_or_443": ("packet", lambda: tls.is_application_data(F.col("payload")) | (F.col("sport") == 443) | (F.col("dport") == 443), "(octet_length(payload) > 5 AND substr(hex(payload), 1, 2) = '17') OR sport = 443 OR dport = 443"),
    "F4_http_or_80": ("packet", lambda: http.is_request(F.decode(F.col("payload"), "ISO-8859-1")) | http.is_response(F.decode(F.col("payload"), "ISO-8859-1")) | (F.col("sport") == 80) | (F.col("dport") == 80), "regexp_matches(hex(payload), '^(474554|504F5354|505554|48454144|4F5054494F4E53|44454C455445|5041544348)20') OR hex(payload) LIKE '485454502F%' OR sport = 80 OR dport = 80"),
    "F5_response_time": ("pkt", lambda: (F.col("dir") == "S2C") & F.col("latency_s").isNotNull() & (F.col("latency_s") < 0.05), "dir = 'S2C' AND latency_s IS NOT NULL AND latency_s < 0.05"),
    "F6_request_or_timed": ("pkt", lambda: (F.col("dir") == "C2S") | (F.col("latency_s") < 0.02), "dir = 'C2S' OR latency_s < 0.02"),
    "F7_tls_in_nets": ("packet", lambda: tls.is_application_data(F.col("payload")) & (net.in_networks(_n("src"), ["10.79.0.0/25"]) | net.in_networks(_n("dst"), ["172.18.3.0/24", "8.8.4.0/24"])), f"(octet_length(payload) > 5 AND substr(hex(payload), 1, 2) = '17') AND ({_duck_in(_NUM.format('src'), ['10.79.0.0/25'])} OR {_duck_in(_DST, ['172.18.3.0/24', '8.8.4.0/24'])})"),
    "F8_server_hello": ("packet", lambda: tls.is_server_hello(F.col("payload")), "regexp_matches(hex(payload), '^1603(00|01|02|03|04)....02')"),
    "F9_unicast": ("packet", lambda: net.is_unicast(F.col("eth_dst")), "(('0x' || substr(eth_dst, 1, 2))::INT & 1) = 0"),
    "F11_http_ports": ("packet", lambda: F.col("sport").isin(http.HTTP_PORTS) | F.col("dport").isin(http.HTTP_PORTS), "sport IN (80, 8080, 8000, 8888) OR dport IN (80, 8080, 8000, 8888)"),
    "F12_request_prefix": ("packet", lambda: http.is_request(F.decode(F.col("payload"), "ISO-8859-1")), "regexp_matches(hex(payload), '^(474554|504F5354|505554|48454144|4F5054494F4E53|44454C455445|5041544348)20')"),
    "F13_response_prefix": ("packet", lambda: http.is_response(F.decode(F.col("payload"), "ISO-8859-1")), "hex(payload) LIKE '485454502F%'"),
    "F14_tls_heuristic": ("packet", lambda: tls.is_application_data(F.col("payload")), "octet_length(payload) > 5 AND substr(hex(payload), 1, 2) = '17'"),
    "F15_tls_header": ("packet", lambda: tls.is_record(F.col("payload")), "octet_length(payload) >= 5 AND substr(hex(payload), 1, 2) IN ('14', '15', '16', '17') AND substr(hex(payload), 3, 2) = '03' AND substr(hex(payload), 5, 2) IN ('00', '01', '02', '03', '04')"),
    "F16_record_length": ("packet", lambda: tls.is_record(F.col("payload")) & (tls.record_length(F.col("payload")) >= 600), "octet_length(payload) >= 5 AND substr(hex(payload), 1, 2) IN ('14', '15', '16', '17') AND substr(hex(payload), 3, 2) = '03' AND ('0x' || substr(hex(payload), 7, 4))::INT >= 600"),
    "F17_plausible": ("pkt", lambda: latency.plausible(F.col("latency_s"), (0.0005, 0.1)), "latency_s > 0.0005 AND latency_s < 0.1"),
    "F19_display_cap": ("pkt", lambda: F.col("latency_s") * 1000 <= 40, "latency_s * 1000 <= 40"),
    "F20_in_subnets": ("packet", lambda: net.in_networks(_n("dst"), ["172.18.3.0/24", "8.8.0.0/13"]), _duck_in(_DST, ["172.18.3.0/24", "8.8.0.0/13"])),
    "F21_in_subnets_loose": ("packet", lambda: net.in_networks(net.ip_number(F.col("dst"), False), ["172.18.3.0/24", "203.0.2.0/24"]), _duck_in(_LOOSE.format("dst"), ["172.18.3.0/24", "203.0.2.0/24"])),
    "F22_public": ("packet", lambda: net.is_public(F.col("dst")), f"{_DST} IS NOT NULL AND (NOT {_duck_in(_DST, net.PRIVATE)} OR dst IN ('192.0.0.9', '192.0.0.10'))"),
    "F23_method": ("packet", lambda: F.upper("method") == "GET", "upper(method) = 'GET'"),
    "F24_known_protocol": ("packet", lambda: net.protocol(F.col("dport")).isNotNull(), "dport IN (" + ", ".join(map(str, net.PORTS)) + ")"),
    "F32_port_present": ("packet", lambda: F.col("sport").isNotNull() & (F.col("sport") != 0), "sport IS NOT NULL AND sport <> 0"),
}


def _filter(name: str, v: str, condition: Callable[[], Column], sql: str) -> None:
    @query(name, f"SELECT count(*) AS n, coalesce(sum(frame), 0)::BIGINT AS frames FROM {v} WHERE {sql}", v)
    def run(df: DataFrame) -> DataFrame:
        return df.where(condition()).agg(F.count("*").alias("n"), F.coalesce(F.sum("frame"), F.lit(0)).alias("frames"))


for _name, (_v, _c, _s) in FILTERS.items():
    _filter(_name, _v, _c, _s)


@query("F25_all_tokens", "SELECT f.pattern_id::BIGINT AS pattern_id, count(*) AS n FROM url u JOIN filter f ON len(list_filter(string_split(f.tokens, ' '), lambda t: NOT contains(u.url, t))) = 0 GROUP BY 1", "url", "filter")
def f25(url, flt):
    return enrich.match_patterns(url, flt.withColumn("t", F.split("tokens", " ")), enrich.all_tokens_in(F.col("url"), F.col("t")), "url", enrich.longest(F.col("t"))).groupBy(long("pattern_id").alias("pattern_id")).agg(F.count("*").alias("n"))


@query("F26_host_set", "SELECT page_id FROM url WHERE lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) IN (SELECT host FROM hosts)", "url", "hosts")
def f26(url, hosts):
    return url.withColumn("host", http.host_of(F.col("url"))).join(hosts, "host", "left_semi").select("page_id")


@query("F27_one_token", "SELECT count(*) AS n FROM line WHERE len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '')) = 1", "line")
def f27(line):
    return line.where(F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")) == 1).agg(F.count("*").alias("n"))


@query("F28_min_matches", "SELECT flow, count(*) AS n FROM pkt GROUP BY flow HAVING count(*) >= 60", "pkt")
def f28(pkt):
    return pkt.groupBy("flow").agg(F.count("*").alias("n")).where("n >= 60")


@query("F29_min_samples", "SELECT endpoint, flow FROM pkt GROUP BY ALL HAVING count(*) >= 2", "pkt")
def f29(pkt):
    return pkt.groupBy("endpoint", "flow").count().where("count >= 2").select("endpoint", "flow")


@query("F30_prune", "SELECT model_id, comp::BIGINT AS comp, round(weight / sum(weight) OVER (PARTITION BY model_id), 6) AS weight FROM model WHERE weight >= 0.05", "model")
def f30(model):
    return mixture.prune(model).select("model_id", long("comp").alias("comp"), r6(F.col("weight")).alias("weight"))


@query("F33_numeric_parse", "SELECT count(*) AS n, sum(try_cast(split_part(line, ' ', 1) AS BIGINT))::BIGINT AS total FROM line WHERE try_cast(split_part(line, ' ', 1) AS BIGINT) IS NOT NULL AND regexp_full_match(split_part(line, ' ', 1), '\\d{1,15}')", "line")
def f33(line):
    first = F.split_part("line", F.lit(" "), F.lit(1))
    return line.where(first.rlike(r"^\d{1,15}$")).select(first.try_cast("bigint").alias("v")).where("v IS NOT NULL").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("F34_first_of_many", "SELECT frame, split_part(concat(latency_s::DECIMAL(18, 6)::VARCHAR, ',', frame), ',', 1) AS head FROM pkt", "pkt")
def f34(pkt):
    return pkt.select("frame", F.split_part(F.concat_ws(",", F.col("latency_s").cast("decimal(18,6)").cast("string"), F.col("frame").cast("string")), F.lit(","), F.lit(1)).alias("head"))


@query("F35_percentile_cut", "SELECT round(least(2.0, quantile_cont(latency_s, 0.995) * 1.5), 6) AS cap, (SELECT count(*) FROM pkt WHERE latency_s <= (SELECT least(2.0, quantile_cont(latency_s, 0.99)) FROM pkt)) AS n FROM pkt", "pkt")
def f35(pkt):
    p = aggregate.percentiles(pkt, F.col("latency_s"), [], {"p995": 0.995, "p99": 0.99})
    caps = p.select(F.least(F.lit(2.0), F.col("p995") * 1.5).alias("cap"), F.least(F.lit(2.0), F.col("p99")).alias("c99"))
    return pkt.crossJoin(F.broadcast(caps)).agg(r6(F.first("cap")).alias("cap"), F.count_if(F.col("latency_s") <= F.col("c99")).alias("n"))


# Scalar functions.
@query("X1_first_socket", "SELECT doc_id, pos::BIGINT AS pos, regexp_extract(line, '(\\d{1,3}(?:\\.\\d{1,3}){3}):(\\d+)', 1) AS ip, try_cast(regexp_extract(line, '(\\d{1,3}(?:\\.\\d{1,3}){3}):(\\d+)', 2) AS BIGINT) AS port FROM line WHERE regexp_matches(line, '\\d{1,3}(?:\\.\\d{1,3}){3}:\\d+')", "line")
def x1(line):
    ip, port = net.first_socket(F.col("line"))
    return line.select("doc_id", long("pos").alias("pos"), ip.alias("ip"), port.alias("port")).where("ip IS NOT NULL")


@query("X2_all_sockets", "SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, '\\d{1,3}(?:\\.\\d{1,3}){3}(?::\\d+)?')) AS item FROM line", "line")
def x2(line):
    return line.select("doc_id", F.explode(net.all_sockets(F.col("line"))).alias("item")).distinct()


@query("X3_first_ip", "SELECT doc_id, pos::BIGINT AS pos, regexp_extract(line, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b', 0) AS ip FROM line WHERE regexp_matches(line, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b')", "line")
def x3(line):
    return line.select("doc_id", long("pos").alias("pos"), net.first_ip(F.col("line")).alias("ip")).where("ip IS NOT NULL")


@query("X4_ip_number", f"SELECT DISTINCT dst, {_NUM.format('dst')} AS strict, {_LOOSE.format('dst')} AS loose FROM packet", "packet")
def x4(packet):
    return packet.select("dst", _n("dst").alias("strict"), net.ip_number(F.col("dst"), False).alias("loose")).distinct()


@query("X5_cidr", f"SELECT cidr, ({_LOOSE.format('split_part(cidr, chr(47), 1)')} // (1 << (32 - split_part(cidr, '/', 2)::INT))) * (1 << (32 - split_part(cidr, '/', 2)::INT)) AS net, split_part(cidr, '/', 2)::BIGINT AS plen FROM subnet", "subnet")
def x5(subnet):
    plen = F.split_part("cidr", F.lit("/"), F.lit(2)).cast("int")
    return subnet.select("cidr", net.network(net.ip_number(F.split_part("cidr", F.lit("/"), F.lit(1))), plen).alias("net"), long(plen).alias("plen"))


@query("X6_socket", "SELECT frame, coalesce(CASE WHEN sport <> 0 THEN concat(src, ':', sport) END, src) AS entry FROM packet", "packet")
def x6(packet):
    return packet.select("frame", F.coalesce(net.socket(F.col("src"), F.col("sport")), F.col("src")).alias("entry"))


@query("X7_biflow", "SELECT DISTINCT concat(least(src, dst), ' <-> ', greatest(src, dst)) AS flow FROM packet", "packet")
def x7(packet):
    return packet.select(net.biflow(F.col("src"), F.col("dst")).alias("flow")).distinct()


@query("X8_protocol", "SELECT dport::BIGINT AS port, CASE dport " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in net.PORTS.items()) + " ELSE 'unknown' END AS protocol, count(*) AS n FROM packet GROUP BY ALL", "packet")
def x8(packet):
    return packet.groupBy(long("dport").alias("port"), net.protocol(F.col("dport"), "unknown").alias("protocol")).agg(F.count("*").alias("n"))


_CIPHER_VALUES = "(VALUES " + ", ".join(f"('{c}', '{n}', '{v}')" for c, n, v in tls.CIPHERS) + ") AS c(code, name, version)"


def _ciphers(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(tls.CIPHERS, "cipher string, name string, version string")


@query("X9_cipher_name", f"SELECT DISTINCT cipher, coalesce(name, concat('Unknown Cipher (', cipher, ')')) AS name, coalesce(version, 'Unknown') AS version FROM packet LEFT JOIN {_CIPHER_VALUES} ON cipher = code", "packet")
def x9(packet):
    out = packet.select("cipher").distinct().join(_ciphers(packet), "cipher", "left")
    return out.select("cipher", F.coalesce("name", F.format_string("Unknown Cipher (%s)", "cipher")).alias("name"), F.coalesce("version", F.lit("Unknown")).alias("version"))


@query("X10_api", "SELECT id::BIGINT AS id, CASE WHEN len(p) < 3 THEN uri WHEN len(list_filter(p, lambda x: lower(x) IN ('avlfarenquiry', 'avlfareenquiry', 'fareenquiry', 'fareenq', 'avlfrq'))) > 0 THEN '/eticketing/avlFarenquiry' ELSE '/' || array_to_string(p[1:3], '/') END AS api FROM (SELECT *, list_filter(string_split(uri, '/'), lambda x: x <> '') AS p FROM raw_uri)", "raw_uri")
def x10(raw):
    return raw.select(long("id").alias("id"), http.api_of(F.col("uri")).alias("api"))


@query("X11_mask_ids", "SELECT page_id, regexp_replace(regexp_replace(concat(url, '/', page_id * 123457, '/deadbeef', page_id), '\\b[0-9a-fA-F]{8,}\\b', '<HEXID>', 'g'), '\\d{5,}', '<ID>', 'g') AS masked FROM url", "url")
def x11(url):
    return url.select("page_id", http.mask_ids(F.concat("url", F.lit("/"), (F.col("page_id") * 123457).cast("string"), F.lit("/deadbeef"), F.col("page_id").cast("string"))).alias("masked"))


_T = "list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '')"


@query("X12_request_line", f"SELECT id::BIGINT AS id, CASE WHEN len(t) < 2 THEN lower(trim(line)) ELSE upper(t[1]) END AS method, CASE WHEN len(t) < 2 THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(t[2], '\\?.*$', ''), '\\b[0-9a-fA-F]{{8,}}\\b', '<HEXID>', 'g'), '\\d{{5,}}', '<ID>', 'g') END AS path, CASE WHEN len(t) < 2 THEN '' ELSE coalesce(t[3], '') END AS proto FROM (SELECT *, {_T} AS t FROM start_line)", "start_line")
def x12(lines):
    m, p, v = http.request_line(F.col("line"))
    return lines.select(long("id").alias("id"), m.alias("method"), p.alias("path"), v.alias("proto"))


@query("X13_response_line", f"SELECT id::BIGINT AS id, CASE WHEN len(t) < 2 THEN '' ELSE t[2] END AS status, CASE WHEN len(t) < 2 THEN '' ELSE t[1] END AS proto FROM (SELECT *, {_T} AS t FROM start_line)", "start_line")
def x13(lines):
    s, v = http.response_line(F.col("line"))
    return lines.select(long("id").alias("id"), s.alias("status"), v.alias("proto"))


@query("X14_decode_url", "SELECT page_id, replace(replace(url_decode(concat(url, '%2Fa%20b')), 'http://', ''), 'https://', '') AS plain FROM url", "url")
def x14(url):
    return url.select("page_id", http.decode_url(F.concat("url", F.lit("%2Fa%20b"))).alias("plain"))


_MESSAGE = "concat(CASE WHEN page_id % 3 = 0 THEN 'HTTP/1.1 200 OK' ELSE concat('GET ', replace(url, ' ', ''), ' HTTP/1.1') END, '{nl}Host: Shop{nl}X-Trace: ', CAST(page_id AS {s}), '{nl}host: again{nl}{nl}body ', CAST(page_id * 1000003 AS {s}), '  end')"


def _messages(url: DataFrame) -> DataFrame:
    return url.select("page_id", F.expr(_MESSAGE.format(nl="\\r\\n", s="STRING")).alias("m"))


_DM = "SELECT page_id, " + _MESSAGE.replace("'{nl}", "chr(13) || chr(10) || '").replace("{nl}", "' || chr(13) || chr(10) || '").format(s="VARCHAR") + " AS m FROM url"
_CR = "chr(13) || chr(10)"
_SIG = f"array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(block, {_CR}), lambda x: trim(x) <> ''), lambda x: lower(trim(string_split(x, ':')[1]))))), '|')"
_BLOCK = f"SELECT page_id, m, substr(m, 1, strpos(m, {_CR} || {_CR}) - 1) AS block, substr(m, strpos(m, {_CR} || {_CR}) + 4) AS rest FROM ({_DM})"


def _duck_mask(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\b[0-9a-fA-F]{{8,}}\\b', '<HEXID>', 'g'), '\\d{{5,}}', '<ID>', 'g')"


@query("X15_header_signature", f"SELECT page_id, {_SIG} AS signature FROM ({_BLOCK})", "url")
def x15(url):
    return _messages(url).select("page_id", http.header_signature(http.split_message(F.col("m"))[1]).alias("signature"))


@query("X16_split_message", f"SELECT page_id, string_split(block, {_CR})[1] AS start, length(block) AS headers, rest FROM ({_BLOCK})", "url")
def x16(url):
    s, b, r = http.split_message(F.col("m"))
    return _messages(url).select("page_id", s.alias("start"), long(F.length(b)).alias("headers"), r.alias("rest"))


_START = f"string_split(block, {_CR})[1]"
_HEAD = f"CASE WHEN page_id % 3 = 0 THEN concat(string_split({_START}, ' ')[2], ' ', string_split({_START}, ' ')[1]) ELSE concat('GET ', {_duck_mask(f'regexp_replace(string_split({_START}, chr(32))[2], chr(92) || chr(63) || chr(46) || chr(42) || chr(36), chr(32))')}, ' HTTP/1.1') END"
_HEAD = _HEAD.replace("chr(92) || chr(63) || chr(46) || chr(42) || chr(36), chr(32)", "'\\?.*$', ''")


@query("X17_fingerprint", f"SELECT page_id, sha256({_duck_mask(f'concat({_HEAD}, chr(10), {_SIG}, chr(10), lower(' + _duck_mask('regexp_replace(substr(rest, 1, 512), chr(92) || chr(115) || chr(43), chr(32), chr(103))') + '))')}) AS sha FROM ({_BLOCK})", "url")
def x17(url):
    return _messages(url).select("page_id", http.fingerprint(F.col("m")).alias("sha"))


@query("X18_content_length", "SELECT page_id, coalesce(try_cast(nullif(regexp_replace(url, '\\D', '', 'g'), '') AS BIGINT), 0) AS n FROM url", "url")
def x18(url):
    return url.select("page_id", http.content_length(F.col("url")).alias("n"))


@query("X19_method_uri", "SELECT id::BIGINT AS id, string_split(trim(line), ' ')[1] AS method, string_split(trim(line), ' ')[2] AS uri FROM start_line", "start_line")
def x19(lines):
    t = F.split(F.trim("line"), " ")
    return lines.select(long("id").alias("id"), F.get(t, F.lit(0)).alias("method"), F.get(t, F.lit(1)).alias("uri"))


@query("X20_host", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM url", "url")
def x20(url):
    return url.select("page_id", http.host_of(F.col("url")).alias("host"))


_STATIC = "lambda s: s <> '' AND NOT regexp_full_match(s, '\\d+') AND NOT (length(s) <= 4 AND upper(s) = s AND lower(s) <> s) AND NOT (length(s) >= 7 AND regexp_matches(s, '\\d') AND regexp_matches(s, '[A-Za-z]')) AND NOT regexp_full_match(s, '[0-9a-fA-F]{6,}')"


@query("X21_static_segments", f"SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), {_STATIC}), '/') AS kept FROM url", "url")
def x21(url):
    return url.select("page_id", F.array_join(F.filter(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), http.is_static_segment), "/").alias("kept"))


_BASE = f"SELECT id, u, root, clean || CASE WHEN path LIKE '%/' AND clean <> '' THEN '/' ELSE '' END AS clean FROM (SELECT *, array_to_string(list_filter(string_split(path, '/'), {_STATIC}), '/') AS clean FROM (SELECT *, substr(bare, length(root) + 1) AS path FROM (SELECT *, regexp_extract(bare, '^([^:/]+://[^/]*)', 1) AS root FROM (SELECT *, regexp_replace(trim(CASE WHEN u LIKE 'http%' THEN u ELSE 'http://' || u END), '[?#].*$', '') AS bare FROM {{0}}))))"


@query("X22_base_url", f"SELECT id::BIGINT AS id, root || CASE WHEN clean <> '' THEN '/' || clean ELSE '' END AS base FROM ({_BASE.replace('{0}', 'raw_url')})", "raw_url")
def x22(raw):
    return raw.select(long("id").alias("id"), http.base_url(F.col("u")).alias("base"))


@query("X23_relative_time", "SELECT frame, round((ts_us - min(ts_us) OVER ()) / 1e6, 6) AS rel FROM pkt", "pkt")
def x23(pkt):
    first = pkt.agg(F.min("ts_us").alias("t0"))
    return pkt.crossJoin(F.broadcast(first)).select("frame", r6((F.col("ts_us") - F.col("t0")) / 1e6).alias("rel"))


@query("X24_milliseconds", "SELECT frame, round(latency_s * 1000, 6) AS ms FROM pkt", "pkt")
def x24(pkt):
    return pkt.select("frame", r6(F.col("latency_s") * 1000).alias("ms"))


@query("X26_clip", "SELECT frame, round(greatest(latency_s - 0.03, 0.0001), 6) AS v FROM pkt", "pkt")
def x26(pkt):
    return pkt.select("frame", r6(F.greatest(F.col("latency_s") - 0.03, F.lit(0.0001))).alias("v"))


@query("X27_safe_name", "SELECT page_id, right(regexp_replace(url, '[^A-Za-z0-9]', '_', 'g'), 100) AS name FROM url", "url")
def x27(url):
    return url.select("page_id", http.safe_name(F.col("url")).alias("name"))


@query("X28_netem_scale", "SELECT frame, round(45.18 + (CASE WHEN (SELECT max(abs(latency_s * 1000)) FROM pkt) > 2 THEN latency_s * 1000 / 32768 ELSE latency_s * 1000 END) * 53.41, 6) AS ms FROM pkt", "pkt")
def x28(pkt):
    top = pkt.agg(F.max(F.abs(F.col("latency_s") * 1000)).alias("top"))
    v = F.col("latency_s") * 1000
    return pkt.crossJoin(F.broadcast(top)).select("frame", r6(45.18 + F.when(F.col("top") > 2, v / 32768).otherwise(v) * 53.41).alias("ms"))


@query("X29_baseline", "SELECT frame, round(greatest(latency_s * 1000 - 0.022, 0.0), 6) AS ms FROM pkt", "pkt")
def x29(pkt):
    return pkt.select("frame", r6(F.greatest(F.col("latency_s") * 1000 - 0.022, F.lit(0.0))).alias("ms"))


_PDF = "weight * exp(-((x - mean) * (x - mean)) / (2 * var)) / sqrt(2 * pi() * var)"


def _grid(df: DataFrame, n: int, step: float) -> DataFrame:
    return df.sparkSession.range(n).select("id", (F.col("id") * step).alias("x"))


@query("X30_density", f"SELECT i AS id, model_id, round(sum({_PDF}), 6) AS pdf FROM (SELECT range AS i, range * 0.005::DOUBLE AS x FROM range(200)), model GROUP BY ALL", "model")
def x30(model):
    return _grid(model, 200, 0.005).crossJoin(F.broadcast(mixture.packed(model))).select("id", "model_id", r6(mixture.density(F.col("x"), F.col("comps"))).alias("pdf"))


_CDF = "weight * 0.5 * (1 + sign(z) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z)))"


@query("X31_cdf", f"SELECT i AS id, model_id, round(sum({_CDF}), 6) AS cdf FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS t FROM (SELECT *, (x - mean) / sqrt(2 * var) AS z FROM (SELECT range AS i, range * 0.005::DOUBLE AS x FROM range(200)), model)) GROUP BY ALL", "model")
def x31(model):
    return _grid(model, 200, 0.005).crossJoin(F.broadcast(mixture.packed(model))).select("id", "model_id", r6(mixture.distribution(F.col("x"), F.col("comps"))).alias("cdf"))


@query("X32_labels", f"SELECT i AS id, model_id, arg_max(comp, w)::BIGINT AS label, round(max(w) / sum(w), 6) AS share FROM (SELECT i, model_id, comp, {_PDF} AS w FROM (SELECT range AS i, range * 0.005::DOUBLE AS x FROM range(60)), model) GROUP BY ALL", "model")
def x32(model):
    return mixture.responsibilities(_grid(model, 60, 0.005), "x", model).select("id", "model_id", long("label").alias("label"), r6(F.col("share")).alias("share"))


@query("X33_verdict", "SELECT frame, CASE WHEN latency_s * 10 < 0.1 THEN 'excellent' WHEN latency_s * 10 < 0.5 THEN 'good' WHEN latency_s * 10 < 1.0 THEN 'fair' ELSE 'poor' END AS verdict FROM pkt", "pkt")
def x33(pkt):
    return pkt.select("frame", latency.verdict(F.col("latency_s") * 10).alias("verdict"))


@query("X34_compensated", "SELECT frame, round(greatest(0.0, 0.05 - latency_s), 6) AS wait FROM pkt", "pkt")
def x34(pkt):
    return pkt.select("frame", r6(F.greatest(F.lit(0.0), 0.05 - F.col("latency_s"))).alias("wait"))


# Look-ups.
_PFX = f"SELECT {_LOOSE.format('net')} AS lo, {_LOOSE.format('net')} + (1::BIGINT << (32 - plen)) AS hi, plen, asn, name FROM prefix"


_MATCHED = f"SELECT dst AS ip, arg_max(asn, plen) AS asn FROM (SELECT DISTINCT dst, {_DST} AS n FROM packet WHERE frame % 3 = 0) JOIN ({_PFX}) ON n >= lo AND n < hi GROUP BY dst"


@query("J1_ip_asn", f"SELECT frame, coalesce(asn, 'Unknown') AS asn FROM packet LEFT JOIN ({_MATCHED}) a ON dst = ip", "packet", "prefix")
def j1(packet, prefix):
    """Packets with their destination's system, from a table of addresses that were matched earlier, in a part of the traffic."""
    p = prefix.select(net.ip_number(F.col("net")).alias("net"), "plen", "asn")
    seen = packet.where("frame % 3 = 0").select("dst").distinct().withColumn("n", _n("dst"))
    matched = enrich.longest_prefix(seen, p, "n", ["asn"]).where("asn IS NOT NULL").select("dst", "asn")
    return enrich.look_up(packet.select("frame", "dst"), matched, "dst", {"asn": "Unknown"}).select("frame", "asn")


@query("J2_longest_prefix", f"SELECT dst, arg_max(asn, plen) AS asn, max(plen)::BIGINT AS plen FROM (SELECT DISTINCT dst, {_DST} AS n FROM packet) LEFT JOIN ({_PFX}) ON n >= lo AND n < hi GROUP BY dst", "packet", "prefix")
def j2(packet, prefix):
    p = prefix.select(net.ip_number(F.col("net")).alias("net"), "plen", "asn", "name")
    rows = packet.select("dst").distinct().withColumn("n", _n("dst"))
    return enrich.longest_prefix(rows, p, "n", ["asn", "name"]).select("dst", "asn", long("plen").alias("plen"))


_SUB = f"SELECT ({_LOOSE.format('split_part(cidr, chr(47), 1)')}) AS lo, ({_LOOSE.format('split_part(cidr, chr(47), 1)')}) + (1::BIGINT << (32 - split_part(cidr, '/', 2)::INT)) AS hi FROM subnet"


@query("J3_in_subnets", f"SELECT frame FROM packet WHERE EXISTS (SELECT 1 FROM ({_SUB}) WHERE {_DST} >= lo AND {_DST} < hi)", "packet", "subnet")
def j3(packet, subnet):
    plen = F.split_part("cidr", F.lit("/"), F.lit(2)).cast("int")
    nets = subnet.select(net.network(net.ip_number(F.split_part("cidr", F.lit("/"), F.lit(1))), plen).alias("net"), plen.alias("plen"))
    return enrich.in_subnets(packet.withColumn("num", _n("dst")), nets, "num").select("frame")


@query("J4_vendor", "SELECT frame, coalesce(vendor, 'Unknown') AS vendor FROM packet LEFT JOIN vendor ON lower(eth_dst) = mac", "packet", "vendor")
def j4(packet, vendor):
    return enrich.look_up(packet.select("frame", F.lower("eth_dst").alias("mac")), vendor, "mac", {"vendor": "Unknown"}).select("frame", "vendor")


@query("J5_cipher", f"SELECT frame, coalesce(name, 'Unknown') AS name FROM packet LEFT JOIN {_CIPHER_VALUES} ON cipher = code", "packet")
def j5(packet):
    return enrich.look_up(packet.select("frame", "cipher"), _ciphers(packet), "cipher", {"name": "Unknown"}).select("frame", "name")


@query("J6_filters_unmatched", "SELECT page_id FROM url u WHERE NOT EXISTS (SELECT 1 FROM filter f WHERE len(list_filter(string_split(f.tokens, ' '), lambda t: NOT contains(u.url, t))) = 0)", "url", "filter")
def j6(url, flt):
    hit = enrich.match_patterns(url, flt.withColumn("t", F.split("tokens", " ")), enrich.all_tokens_in(F.col("url"), F.col("t")), "url", enrich.longest(F.col("t")))
    return url.join(hit.select("page_id"), "page_id", "left_anti").select("page_id")


_MSG = "SELECT frame, ts_us, flow, CASE WHEN dir = 'C2S' THEN 'REQ' ELSE 'RESP' END AS kind FROM pkt"


@query("J8_fifo_ordinal", f"SELECT flow, q.frame AS req_frame, s.frame AS res_frame, round((s.ts_us - q.ts_us) / 1e6, 6) AS delay_s FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY frame) AS k FROM ({_MSG}) WHERE kind = 'REQ') q JOIN (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY frame) AS k FROM ({_MSG}) WHERE kind = 'RESP') s USING (flow, k)", "pkt")
def j8_ordinal(pkt):
    msgs = pkt.select("frame", "ts_us", "flow", F.when(F.col("dir") == "C2S", "REQ").otherwise("RESP").alias("kind"))
    return pairing.fifo_by_ordinal(msgs, ["flow"]).select("flow", "req_frame", "res_frame", r6(F.col("delay_s")).alias("delay_s"))


def _sides() -> tuple[Column, Column]:
    return F.col("dir") == "C2S", F.col("dir") == "S2C"


_ADJ = "SELECT * FROM (SELECT *, lag(dir) OVER w AS was, lag(frame) OVER w AS req_frame, lag(ts_us) OVER w AS req_ts FROM pkt WHERE payload_len > 0 WINDOW w AS (PARTITION BY flow ORDER BY frame)) WHERE dir = 'S2C' AND was = 'C2S'"


@query("J9_tls_adjacent_pairs", f"SELECT flow, req_frame, frame AS res_frame, round((ts_us - req_ts) / 1e6, 6) AS delay_s FROM ({_ADJ})", "pkt")
def j9(pkt):
    return pairing.adjacent_pairs(pkt.where("payload_len > 0"), ["flow"], ["frame"], *_sides()).select("flow", "req_frame", "res_frame", r6(F.col("delay_s")).alias("delay_s"))


@query("J10_tls_as_of_pairs", "SELECT flow, req_frame, frame AS res_frame, round((ts_us - req_ts) / 1e6, 6) AS delay_s FROM (SELECT *, last_value(CASE WHEN dir = 'C2S' THEN frame END IGNORE NULLS) OVER w AS req_frame, last_value(CASE WHEN dir = 'C2S' THEN ts_us END IGNORE NULLS) OVER w AS req_ts FROM pkt WINDOW w AS (PARTITION BY flow ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE dir = 'S2C' AND req_ts IS NOT NULL", "pkt")
def j10(pkt):
    return pairing.as_of_pairs(pkt, ["flow"], ["frame"], *_sides()).select("flow", "req_frame", "res_frame", r6(F.col("delay_s")).alias("delay_s"))


@query("J11_stream_pairs", "SELECT flow, req_frame, frame AS res_frame, round(latency_s, 6) AS rtt FROM (SELECT *, lag(dir) OVER w AS was, lag(frame) OVER w AS req_frame FROM pkt WHERE dir = 'C2S' OR latency_s < 0.06 WINDOW w AS (PARTITION BY flow ORDER BY frame)) WHERE dir = 'S2C' AND was = 'C2S'", "pkt")
def j11(pkt):
    kept = pkt.where("dir = 'C2S' OR latency_s < 0.06")
    return pairing.adjacent_pairs(kept, ["flow"], ["frame"], *_sides()).select("flow", "req_frame", "res_frame", r6(F.col("latency_s")).alias("rtt"))


_RANKED = "SELECT latency_s AS v, row_number() OVER (ORDER BY latency_s, frame) AS k FROM pkt WHERE endpoint = '{0}'"


@query("J14_rank_join", f"SELECT a.k AS k, round(a.v - b.v, 6) AS d FROM ({_RANKED.format('view')}) a JOIN ({_RANKED.format('click')}) b USING (k)", "pkt")
def j14(pkt):
    n = aggregate.running(pkt.where("endpoint IN ('view', 'click')"), ["endpoint"], "latency_s", ["frame"], name="k").select("endpoint", F.col("latency_s").alias("v"), "k")
    a, b = n.where("endpoint = 'view'").select("k", F.col("v").alias("a")), n.where("endpoint = 'click'").select("k", F.col("v").alias("b"))
    return a.join(b, "k").select("k", r6(F.col("a") - F.col("b")).alias("d"))


_Q = "SELECT unnest(range(101)) AS pos, unnest(quantile_cont(latency_s, list_transform(range(101), lambda i: i / 100.0))) AS q FROM pkt WHERE endpoint = '{0}'"


def _quantile_difference(pkt: DataFrame, points: int) -> DataFrame:
    q = aggregate.quantiles(pkt.where("endpoint IN ('view', 'click')"), F.col("latency_s"), ["endpoint"], points)
    return q.groupBy("pos").agg(F.max(F.when(F.col("endpoint") == "view", F.col("q"))).alias("a"), F.max(F.when(F.col("endpoint") == "click", F.col("q"))).alias("b")).select(long("pos").alias("pos"), (F.col("a") - F.col("b")).alias("d"))


@query("J15_quantile_join", f"SELECT a.pos AS pos, round(a.q - b.q, 9) AS d FROM ({_Q.format('view')}) a JOIN ({_Q.format('click')}) b USING (pos)", "pkt")
def j15(pkt):
    return _quantile_difference(pkt, 101).select("pos", F.round("d", 9).alias("d"))


def _du(i: str, s: str) -> str:
    return f"(('0x' || substr(md5(concat({i}, ':{s}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _dn(i: str, s: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_du(i, s + 'a')})) * cos(2 * pi() * {_du(i, s + 'b')}))"


_COMPS = "SELECT *, sum(weight) OVER (PARTITION BY model_id ORDER BY comp) AS upto, sum(weight) OVER (PARTITION BY model_id ORDER BY comp) - weight AS since, max(comp) OVER (PARTITION BY model_id) AS last FROM model"


def _draws(model: str, n: int, stream: str) -> str:
    u = _du("i", stream + "c")
    return f"SELECT i, mean + sqrt(var) * {_dn('i', stream)} AS x FROM (SELECT range AS i FROM range({n})) JOIN ({_COMPS}) ON model_id = '{model}' AND {u} >= since AND ({u} < upto OR comp = last)"


def _duck_em(samples: str, ks: str, rounds: int, then: str) -> str:
    """SQL of EM: ``samples`` gives model_id, x, c; after so many rounds ``then`` reads fit (model_id, k, comp from 0 by mean, weight, mean, var) and score (model_id, k, n, loglik, bic)."""
    steps = [
        f"cnt AS ({samples})",
        f"""r0 AS (SELECT model_id, k, n, comp, 1.0::DOUBLE / k AS weight, low + (comp + 0.5::DOUBLE) * step AS mean, greatest(step * step / 4, 0.000001::DOUBLE) AS var
            FROM (SELECT *, (high - low) / k AS step, unnest(range(k)) AS comp FROM (SELECT model_id, sum(c) AS n, min(x) AS low, max(x) AS high FROM cnt GROUP BY model_id HAVING sum(c) >= 2), (SELECT unnest({ks}) AS k)))""",
    ]
    pdf = "weight * exp(-0.5 * (x - mean) * (x - mean) / var) / sqrt(2 * pi() * var)"
    for i in range(rounds):
        steps += [
            f"e{i} AS (SELECT model_id, k, n, comp, x, p / sum(p) OVER (PARTITION BY model_id, k, x) * c AS r FROM (SELECT f.model_id AS model_id, k, n, comp, x, c, {pdf} AS p FROM r{i} f JOIN cnt ON cnt.model_id = f.model_id))",
            f"""r{i + 1} AS (SELECT e.model_id AS model_id, e.k AS k, any_value(e.n) AS n, e.comp AS comp, sum(r) / any_value(e.n) AS weight, any_value(m) AS mean, greatest(sum(r * (x - m) * (x - m)) / sum(r), 0.000001::DOUBLE) AS var
                FROM e{i} e JOIN (SELECT model_id, k, comp, sum(r * x) / sum(r) AS m FROM e{i} GROUP BY ALL) a ON e.model_id = a.model_id AND e.k = a.k AND e.comp = a.comp GROUP BY e.model_id, e.k, e.comp)""",
        ]
    steps += [
        f"fit AS (SELECT model_id, k, row_number() OVER (PARTITION BY model_id, k ORDER BY mean, var) - 1 AS comp, weight, mean, var FROM r{rounds})",
        f"score AS (SELECT model_id, k, n, loglik, -2 * loglik + (3 * k - 1) * ln(n) AS bic FROM (SELECT model_id, k, any_value(n) AS n, sum(c * ln(p)) AS loglik FROM (SELECT f.model_id AS model_id, k, any_value(n) AS n, x, any_value(c) AS c, sum({pdf}) AS p FROM r{rounds} f JOIN cnt ON cnt.model_id = f.model_id GROUP BY f.model_id, k, x) GROUP BY model_id, k))",
        "best AS (SELECT model_id, arg_min(k, row(bic, k)) AS k FROM score GROUP BY model_id)",
    ]
    return "SELECT * FROM (WITH " + ", ".join(steps) + f" {then})"


def _one(model: DataFrame, name: str) -> DataFrame:
    return mixture.packed(model).where(F.col("model_id") == name).select(F.col("comps").alias(name))


def _pair_draws(model: DataFrame, n: int, streams: tuple[str, str], names: tuple[str, str] = ("total", "rest")) -> DataFrame:
    rows = model.sparkSession.range(n)
    for name in names:
        rows = rows.crossJoin(F.broadcast(_one(model, name)))  # one row each
    return rows.select("id", *[mixture.draw(F.col("id"), s, F.col(m)).alias(m) for s, m in zip(streams, names, strict=True)])


@query("J16_random_pairs", f"SELECT t.i AS id, round(t.x - r.x, 6) AS d FROM ({_draws('total', 3000, 'p')}) t JOIN ({_draws('rest', 3000, 'q')}) r ON t.i = r.i", "model")
def j16(model):
    return _pair_draws(model, 3000, ("p", "q")).select("id", r6(F.col("total") - F.col("rest")).alias("d"))


_MOM = "SELECT model_id, sum(weight * mean) AS mu, sum(weight * (var + mean * mean)) - sum(weight * mean) * sum(weight * mean) AS variance FROM model GROUP BY model_id"


@query("J17_node_config", f"SELECT node, round(t.mu, 6) AS total_mu, round(r.mu, 6) AS rest_mu FROM node JOIN ({_MOM}) t ON total_capture = t.model_id JOIN ({_MOM}) r ON rest_capture = r.model_id", "node", "model")
def j17(node, model):
    m = mixture.moments(model)
    t, r = m.select(F.col("model_id").alias("total_capture"), r6(F.col("mu")).alias("total_mu")), m.select(F.col("model_id").alias("rest_capture"), r6(F.col("mu")).alias("rest_mu"))
    return node.join(t, "total_capture").join(r, "rest_capture").select("node", "total_mu", "rest_mu")
