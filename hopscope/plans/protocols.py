"""Queries for operators that work on whole exchanges: HTTP and TLS traffic, matched addresses, refitted models, the delay chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http, latency, net
from ..operators import aggregate, chain, enrich, models, pairing
from ..operators import http as web
from ..sources import reassembly
from . import queries as q
from .queries import _DST, _PFX, _SIG, _duck_in, _duck_mask, _dn, _draws, _du, _duck_em, _MOM, _PDF, _pair_draws, long, r6

_before = set(q.QUERIES)
query = q.query

_CRLF = "chr(13) || chr(10)"
_REQ, _RESP = r"'^([A-Z_]+)\s+(\S+)\s+HTTP\S*\s*?\r?\n'", r"'^HTTP\S*\s+(\d+)(?:[ \t]+([^\r\n]*?))?[ \t]*\r?\n'"
_PORTS = "(sport IN (80, 8080, 8000, 8888) OR dport IN (80, 8080, 8000, 8888))"
_TEXT = "SELECT *, decode(payload) AS m, payload_len AS size FROM exchange WHERE payload_len > 0"
_EVENTS = f"""SELECT e.capture, frame, (ts_us - t0) / 1e6 AS ts_rel, m, size, regexp_matches(m, {_RESP}) AS back, concat(src, ':', sport) AS a, concat(dst, ':', dport) AS b
FROM ({_TEXT}) e JOIN (SELECT capture, arg_min(ts_us, frame) AS t0 FROM exchange GROUP BY capture) f ON e.capture = f.capture WHERE {_PORTS} AND (regexp_matches(m, {_REQ}) OR regexp_matches(m, {_RESP}))"""
_EXTRACT = f"SELECT capture, frame, round(ts_rel, 6) AS ts_rel, CASE WHEN back THEN b ELSE a END AS client, CASE WHEN back THEN a ELSE b END AS server, size::BIGINT AS pkt_len, CASE WHEN NOT back THEN regexp_extract(m, {_REQ}, 1) END AS method, CASE WHEN back THEN regexp_extract(m, {_RESP}, 2) END AS reason, CASE WHEN back THEN 'response' ELSE 'request' END AS direction FROM ({_EVENTS})"


@query("H3_http_extract", _EXTRACT, "exchange")
def h3(frames):
    return web.http_extract(frames).select("capture", "frame", r6(F.col("ts_rel")).alias("ts_rel"), "client", "server", long("pkt_len").alias("pkt_len"), "method", "reason", "direction")


@query("A5_method_counts", f"SELECT direction, coalesce(method, reason) AS what, count(*) AS n FROM ({_EXTRACT}) GROUP BY ALL", "exchange")
def a5(frames):
    return web.outcome_counts(web.http_extract(frames))


_API = "CASE WHEN len(p) < 3 THEN uri WHEN len(list_filter(p, lambda x: lower(x) IN ('avlfarenquiry', 'avlfareenquiry', 'fareenquiry', 'fareenq', 'avlfrq'))) > 0 THEN '/eticketing/avlFarenquiry' ELSE '/' || array_to_string(p[1:3], '/') END"


@query("H4_get_post_groups", f"SELECT method, {_API} AS api, count(*) AS n, arg_min(uri, frame) AS example FROM (SELECT *, list_filter(string_split(uri, '/'), lambda x: x <> '') AS p FROM (SELECT frame, regexp_extract(m, {_REQ}, 1) AS method, regexp_extract(m, {_REQ}, 2) AS uri FROM ({_TEXT})) WHERE method IN ('GET', 'POST')) GROUP BY ALL", "exchange")
def h4(frames):
    return web.api_groups(frames, ["GET", "POST"])


# The queue of waiting requests is folded over each connection's messages; both ends of the fold have one type.
_METHODS = "'^(" + "|".join(http.METHODS) + ") '"
_MESSAGES = f"""SELECT capture, CASE WHEN rq THEN src ELSE dst END AS client_ip, CASE WHEN rq THEN sport ELSE dport END AS client_port, CASE WHEN rq THEN dst ELSE src END AS server_ip, CASE WHEN rq THEN dport ELSE sport END AS server_port,
  frame, ts_us, rq, seq + size AS seq_end, ack, string_split(string_split(m, {_CRLF})[1], ' ')[1] AS method, string_split(string_split(m, {_CRLF})[1], ' ')[2] AS uri, size
  FROM (SELECT *, regexp_matches(m, {_METHODS}) AS rq FROM ({_TEXT})) WHERE rq OR starts_with(m, 'HTTP/')"""
_Q, _O = "STRUCT(f BIGINT, t BIGINT, e BIGINT, m VARCHAR, u VARCHAR, s BIGINT)[]", "STRUCT(rf BIGINT, rt BIGINT, m VARCHAR, u VARCHAR, rs BIGINT, f BIGINT, t BIGINT, s BIGINT)[]"
_STATE = f"STRUCT(rq BOOLEAN, ack BIGINT, x STRUCT(f BIGINT, t BIGINT, e BIGINT, m VARCHAR, u VARCHAR, s BIGINT), w {_Q}, o {_O})"
_FOLD = f"""list_reduce(list(CAST({{'rq': rq, 'ack': ack, 'x': {{'f': frame, 't': ts_us, 'e': seq_end, 'm': method, 'u': uri, 's': size}}, 'w': [], 'o': []}} AS {_STATE}) ORDER BY frame),
  lambda a, b: CAST({{'rq': b.rq, 'ack': b.ack, 'x': b.x,
    'w': CASE WHEN b.rq THEN list_append(a.w, b.x) WHEN len(a.w) > 0 AND a.w[1].e <= b.ack THEN a.w[2:] ELSE a.w END,
    'o': CASE WHEN NOT b.rq AND len(a.w) > 0 AND a.w[1].e <= b.ack THEN list_append(a.o, {{'rf': a.w[1].f, 'rt': a.w[1].t, 'm': a.w[1].m, 'u': a.w[1].u, 'rs': a.w[1].s, 'f': b.x.f, 't': b.x.t, 's': b.x.s}}) ELSE a.o END}} AS {_STATE}),
  CAST({{'rq': false, 'ack': 0, 'x': NULL, 'w': [], 'o': []}} AS {_STATE}))"""
_PAIRS = f"SELECT capture, client_ip, client_port, server_ip, server_port, unnest(s.o) AS p FROM (SELECT capture, client_ip, client_port, server_ip, server_port, {_FOLD} AS s FROM ({_MESSAGES}) GROUP BY ALL)"


@query("J8_fifo", f"SELECT client_ip, client_port::BIGINT AS client_port, p.rf AS req_frame, p.f AS res_frame, round((p.t - p.rt) / 1e6, 6) AS delay_s FROM ({_PAIRS})", "exchange")
def j8(frames):
    return web.paired(frames).select("client_ip", long("client_port").alias("client_port"), "req_frame", "res_frame", r6(F.col("delay_s")).alias("delay_s"))


@query("J13_request_in", f"SELECT p.f AS res_frame, p.rf AS req_frame, round((p.t - p.rt) / 1e6, 6) AS delay FROM ({_PAIRS}) WHERE (p.t - p.rt) / 1e6 > -1 AND (p.t - p.rt) / 1e6 < 72000", "exchange")
def j13(frames):
    return web.paired(frames).where(latency.plausible(F.col("delay_s"), (-1.0, 72000.0))).select("res_frame", "req_frame", r6(F.col("delay_s")).alias("delay"))


@query("H5_http_rtt", f"SELECT p.m AS method, client_ip, client_port::BIGINT AS client_port, server_ip, server_port::BIGINT AS server_port, p.u AS uri, round((p.rt - t0) / 1e6, 6) AS request_time_rel, round((p.t - t0) / 1e6, 6) AS response_time_rel, round((p.t - p.rt) / 1e6, 6) AS rtt, p.rs AS request_size, p.s AS response_size FROM ({_PAIRS}) JOIN (SELECT capture, arg_min(ts_us, frame) AS t0 FROM exchange GROUP BY capture) USING (capture)", "exchange")
def h5(frames):
    t = web.http_rtt(frames)
    return t.select("method", "client_ip", long("client_port").alias("client_port"), "server_ip", long("server_port").alias("server_port"), "uri", *[r6(F.col(c)).alias(c) for c in ("request_time_rel", "response_time_rel", "rtt")], long("request_size").alias("request_size"), long("response_size").alias("response_size"))


@query("A32_run_summary", f"SELECT (SELECT count(*) FROM exchange) AS packets, (SELECT count(*) FROM exchange WHERE {_PORTS}) AS http_packets, count(*) AS matched FROM ({_PAIRS})", "exchange")
def a32(frames):
    return web.run_summary(frames)


_SIZES = f"SELECT unnest([p.rs, p.s]) AS size FROM ({_PAIRS})"


@query("A16_length_histogram", f"SELECT size // w AS bin, (size // w) * w AS low, count(*) AS n FROM (SELECT size, greatest(1, max(size) OVER () // 50) AS w FROM ({_SIZES})) GROUP BY ALL", "exchange")
def a16(frames):
    return web.length_bins(web.request_sizes(web.http_rtt(frames)), "size")


@query("A16_length_statistics", f"SELECT count(*) AS n, min(size) AS least, max(size) AS most, round(avg(size), 6) AS mean, sum(size)::BIGINT AS total, round(median(size), 6) AS median FROM ({_SIZES})", "exchange")
def a16b(frames):
    t = aggregate.length_statistics(web.request_sizes(web.http_rtt(frames)), "size")
    return t.select("n", long("least").alias("least"), long("most").alias("most"), r6(F.col("mean")).alias("mean"), "total", r6(F.col("median").cast("double")).alias("median"))


# J12: the flow's pending requests in order of their first asking; asking again renews the time.
_LS = "STRUCT(rq BOOLEAN, x STRUCT(m VARCHAR, u VARCHAR, f BIGINT, t BIGINT), w STRUCT(m VARCHAR, u VARCHAR, f BIGINT, t BIGINT)[], o STRUCT(m VARCHAR, u VARCHAR, rf BIGINT, f BIGINT, d DOUBLE)[])"
_LEGACY = f"""list_reduce(list(CAST({{'rq': dir = 'C2S', 'x': {{'m': endpoint, 'u': (payload_len % 5)::VARCHAR, 'f': frame, 't': ts_us}}, 'w': [], 'o': []}} AS {_LS}) ORDER BY frame),
  lambda a, b: CAST({{'rq': b.rq, 'x': b.x,
    'w': CASE WHEN NOT b.rq THEN a.w[2:] WHEN len(list_filter(a.w, lambda y: y.m = b.x.m AND y.u = b.x.u)) > 0 THEN list_transform(a.w, lambda y: CASE WHEN y.m = b.x.m AND y.u = b.x.u THEN b.x ELSE y END) ELSE list_append(a.w, b.x) END,
    'o': CASE WHEN NOT b.rq AND len(a.w) > 0 THEN list_append(a.o, {{'m': a.w[1].m, 'u': a.w[1].u, 'rf': a.w[1].f, 'f': b.x.f, 'd': (b.x.t - a.w[1].t) / 1e6}}) ELSE a.o END}} AS {_LS}),
  CAST({{'rq': false, 'x': NULL, 'w': [], 'o': []}} AS {_LS}))"""


@query("J12_legacy_pairs", f"SELECT flow, p.m AS method, p.u AS uri, p.rf AS req_frame, p.f AS res_frame, round(p.d, 6) AS delay_s FROM (SELECT flow, unnest(s.o) AS p FROM (SELECT flow, {_LEGACY} AS s FROM pkt GROUP BY flow))", "pkt")
def j12(pkt):
    msgs = pkt.select("flow", "frame", "ts_us", F.when(F.col("dir") == "C2S", "REQ").otherwise("RESP").alias("kind"), F.col("endpoint").alias("method"), (F.col("payload_len") % 5).cast("string").alias("uri"))
    return pairing.legacy_pairs(msgs, ["flow"]).select("flow", "method", "uri", "req_frame", "res_frame", r6(F.col("delay_s")).alias("delay_s"))


# Messages of a stream without gaps: a payload is one, unless foreign bytes came just before it and spoil its start line.
_FRAMED = f"""SELECT capture, src, sport, dst, dport, frame, CASE WHEN starts_with(m, 'HTTP/') THEN 'RESP' ELSE 'REQ' END AS kind, m
  FROM (SELECT *, lag(m) OVER (PARTITION BY capture, src, sport, dst, dport ORDER BY frame) AS was FROM ({_TEXT}))
  WHERE NOT starts_with(m, chr(23)) AND NOT coalesce(starts_with(was, chr(23)), false) AND (starts_with(m, 'HTTP/') OR regexp_matches(m, '^[A-Z]+ '))"""


@query("H1_reassembly", "SELECT capture, src, sport::BIGINT AS sport, dst, dport::BIGINT AS dport, sum(payload_len)::BIGINT AS bytes, count(*) AS segments, md5(string_agg(decode(payload), '' ORDER BY frame)) AS digest FROM exchange WHERE payload_len > 0 GROUP BY ALL", "exchange")
def h1(frames):
    """Segments are mixed and repeated before they are put together again."""
    doubled = frames.where("payload_len > 0").unionByName(frames.where("payload_len > 0 AND frame % 3 = 0").withColumn("frame", F.col("frame") + 5))
    return reassembly.reassembled(doubled).select("capture", "src", long("sport").alias("sport"), "dst", long("dport").alias("dport"), F.col("size").alias("bytes"), "segments", F.md5("data").alias("digest"))


@query("H2_http_messages", f"SELECT capture, src, sport::BIGINT AS sport, dst, dport::BIGINT AS dport, row_number() OVER (PARTITION BY capture, src, sport, dst, dport ORDER BY frame) - 1 AS n, frame, kind, m AS message FROM ({_FRAMED})", "exchange")
def h2(frames):
    return reassembly.http_messages(frames).select("capture", "src", long("sport").alias("sport"), "dst", long("dport").alias("dport"), long("n").alias("n"), "frame", "kind", "message")


@query("H2_flow_report", "SELECT capture, src, sport::BIGINT AS sport, dst, dport::BIGINT AS dport, count(*) AS segments, sum(payload_len)::BIGINT - coalesce(sum(payload_len) FILTER (frame % 41 = 0), 0)::BIGINT AS passed, 0::BIGINT AS waiting FROM exchange WHERE payload_len > 0 GROUP BY ALL HAVING count(*) FILTER (frame % 41 = 0) = 0", "exchange")
def h2b(frames):
    """What became of the bytes of flows of which no segment was cut short; a cut one's successors wait, which a bound of memory ends."""
    cut = frames.withColumn("payload", F.when(F.col("frame") % 41 == 0, F.expr("substring(payload, 1, octet_length(payload) - 1)")).otherwise(F.col("payload")))
    report = reassembly.flow_report(cut)
    whole = frames.where("payload_len > 0").groupBy(*reassembly.FLOW).agg(F.count_if(F.col("frame") % 41 == 0).alias("cut")).where("cut = 0")
    return report.join(whole, reassembly.FLOW, "left_semi").select("capture", "src", long("sport").alias("sport"), "dst", long("dport").alias("dport"), "segments", "passed", "waiting")


_LINE = f"string_split(block, {_CRLF})[1]"
_WORDS = f"string_split({_LINE}, ' ')"
_START = f"CASE WHEN kind = 'RESP' THEN concat({_WORDS}[2], ' ', {_WORDS}[1]) ELSE concat(upper({_WORDS}[1]), ' ', " + _duck_mask("regexp_replace(" + _WORDS + "[2], '\\?.*$', '')") + f", ' ', {_WORDS}[3]) END"
_SHA = "sha256(" + _duck_mask(f"concat({_START}, chr(10), {_SIG}, chr(10), lower(" + _duck_mask("regexp_replace(substr(rest, 1, 512), '\\s+', ' ', 'g')") + "))") + ")"
_PRINTS = f"SELECT kind, sha, count(*) AS n, arg_min(substr(m, 1, 512), frame) AS example FROM (SELECT *, {_SHA} AS sha FROM (SELECT *, substr(m, 1, strpos(m, {_CRLF} || {_CRLF}) - 1) AS block, substr(m, strpos(m, {_CRLF} || {_CRLF}) + 4) AS rest FROM ({_FRAMED}))) GROUP BY ALL"


@query("A3_fingerprint_counts", f"SELECT *, sum(n) OVER (PARTITION BY kind)::BIGINT AS total, count(*) OVER (PARTITION BY kind) AS kinds FROM ({_PRINTS})", "exchange")
def a3(frames):
    return web.fingerprint_counts(frames).select("kind", "sha", "n", "example", "total", "kinds")


@query("A3_fingerprint_top", f"SELECT kind, rank, n, sha FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, sha) AS rank FROM ({_PRINTS})) WHERE rank <= 20", "exchange")
def a3b(frames):
    return web.top_fingerprints(web.fingerprint_counts(frames)).select("kind", long("rank").alias("rank"), "n", "sha")


# Addresses.
_PUBLIC = f"{_DST} IS NOT NULL AND (NOT {_duck_in(_DST, net.PRIVATE)} OR dst IN ('192.0.0.9', '192.0.0.10'))"
_MATCHED = f"SELECT dst, arg_max(asn, plen) AS asn, arg_max(name, plen) AS name FROM (SELECT DISTINCT dst, {_DST} AS n FROM packet WHERE {_PUBLIC}) LEFT JOIN ({_PFX}) ON n >= lo AND n < hi GROUP BY dst"


def _matched(packet: DataFrame, prefix: DataFrame) -> DataFrame:
    return web.matched_addresses(packet, prefix.select(net.ip_number(F.col("net")).alias("net"), "plen", "asn", "name"), F.col("dst"))


@query("A13_matched_share", f"SELECT count(asn) AS matched, count(*) - count(asn) AS unmatched, round(coalesce(100.0 * count(asn) / nullif(count(*), 0), 0), 6)::DOUBLE AS pct FROM ({_MATCHED})", "packet", "prefix")
def a13(packet, prefix):
    return web.match_share(_matched(packet, prefix)).select("matched", "unmatched", F.round("pct", 6).alias("pct"))


@query("A14_asn_distribution", f"SELECT name, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ({_MATCHED})), 6)::DOUBLE AS pct FROM ({_MATCHED}) WHERE asn IS NOT NULL GROUP BY name", "packet", "prefix")
def a14(packet, prefix):
    return web.asn_distribution(_matched(packet, prefix)).select("name", "n", F.round("pct", 6).alias("pct"))


_PROTO = "CASE dport " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in net.PORTS.items()) + " END"


@query("A9_protocol_ips", f"SELECT DISTINCT file, protocol, unnest(['ip', 'socket']) AS kind, unnest([dst, concat(dst, ':', dport)]) AS entry FROM (SELECT eth_dst AS file, {_PROTO} AS protocol, dst, dport FROM packet) WHERE protocol IS NOT NULL", "packet")
def a9(packet):
    """Distinct addresses and sockets of each protocol in each file, in long form: no set is gathered in one row."""
    entries = F.explode(F.array(F.struct(F.lit("ip").alias("kind"), F.col("dst").alias("entry")), F.struct(F.lit("socket").alias("kind"), net.socket(F.col("dst"), F.col("dport")).alias("entry")))).alias("e")
    return packet.select(F.col("eth_dst").alias("file"), net.protocol(F.col("dport")).alias("protocol"), entries).where("protocol IS NOT NULL").select("file", "protocol", "e.*").distinct()


@query("A12_prefix_counts", "SELECT asn, name, len(string_split(prefixes, chr(10)))::BIGINT AS n, sum(len(string_split(prefixes, chr(10)))) OVER ()::BIGINT AS total, count(*) OVER () AS systems FROM cell ORDER BY n DESC, asn LIMIT 10", "cell")
def a12(cell):
    """The ten AS of most prefix lines, with the totals of all."""
    n = F.size(F.split(F.coalesce("prefixes", F.lit("")), "\n")).cast("bigint")
    total = cell.agg(F.sum(n).alias("total"), F.count("*").alias("systems"))
    return aggregate.top(cell.select("asn", "name", n.alias("n")), 10, "n", "asn").crossJoin(F.broadcast(total))  # one row


@query("F10_allow_list", "SELECT frame FROM packet WHERE src IN (SELECT DISTINCT src FROM packet WHERE frame % 500 = 0) OR dst IN (SELECT DISTINCT src FROM packet WHERE frame % 500 = 0)", "packet")
def f10(packet):
    """Packets whose source or destination is in an allow-list table: a semi-join on each side's addresses."""
    return enrich.on_allow_list(packet, packet.where("frame % 500 = 0").select(F.col("src").alias("ip")).distinct(), ["src", "dst"]).select("frame")


_METHOD = "CASE WHEN page_id % 3 = 0 THEN 'GET' ELSE 'POST' END"


@query("J7_patterns", f"SELECT page_id, method, pattern FROM (SELECT *, {_METHOD} AS method FROM url) u JOIN (SELECT pattern, CASE WHEN pattern_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS m FROM pattern) p ON method = m AND contains(url, pattern)", "url", "pattern")
def j7(url, pattern):
    """Requests with the patterns of their method that their URL holds."""
    p = pattern.withColumn("m", F.when(F.col("pattern_id") % 2 == 0, "GET").otherwise("POST"))
    return enrich.match_patterns(url.withColumn("method", F.expr(_METHOD)), p, (F.col("method") == F.col("m")) & F.contains("url", "pattern"), "url", F.col("pattern")).select("page_id", "method", "pattern")


# Windows of their own.
_FLOW = "WINDOW w AS (PARTITION BY flow ORDER BY frame)"


@query("W1_lag", f"SELECT frame, lag(dir) OVER w AS was, round((ts_us - lag(ts_us) OVER w) / 1e6, 6) AS gap FROM pkt {_FLOW}", "pkt")
def w1(pkt):
    w = Window.partitionBy("flow").orderBy("frame")
    return pkt.select("frame", F.lag("dir").over(w).alias("was"), r6((F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6).alias("gap"))


@query("W2_last_before", "SELECT frame, last_value(CASE WHEN dir = 'C2S' THEN frame END IGNORE NULLS) OVER (PARTITION BY flow ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS req_frame FROM pkt", "pkt")
def w2(pkt):
    w = Window.partitionBy("flow").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return pkt.select("frame", F.last(F.when(F.col("dir") == "C2S", F.col("frame")), ignorenulls=True).over(w).alias("req_frame"))


@query("W7_rank_fraction", "SELECT DISTINCT endpoint, round(latency_s, 6) AS v, round(cume_dist() OVER (PARTITION BY endpoint ORDER BY latency_s), 6) AS share FROM pkt", "pkt")
def w7(pkt):
    return aggregate.ecdf(pkt, "latency_s", ["endpoint"], 1e9).select("endpoint", r6(F.col("latency_s")).alias("v"), r6(F.col("share")).alias("share"))


@query("W8_rank_alignment", "SELECT frame, row_number() OVER (PARTITION BY endpoint ORDER BY latency_s, frame) AS k FROM pkt", "pkt")
def w8(pkt):
    return aggregate.running(pkt, ["endpoint"], "latency_s", ["frame"], name="k").select("frame", "k")


@query("X25_six_decimals", "SELECT frame, printf('%.6f', latency_s) AS text FROM pkt", "pkt")
def x25(pkt):
    return pkt.select("frame", latency.six_decimals(F.col("latency_s")).alias("text"))


# Histograms with bins of their own making.
_AUTO = "SELECT n, low, high, CASE WHEN d > 0 THEN least(s, d) ELSE s END AS step FROM (SELECT count(*) AS n, min(latency_s) AS low, max(latency_s) AS high, (max(latency_s) - min(latency_s)) / (log2(count(*)) + 1) AS s, 2 * (quantile_cont(latency_s, 0.75) - quantile_cont(latency_s, 0.25)) / pow(count(*), 1.0::DOUBLE / 3) AS d FROM pkt)"
_AUTO = f"SELECT n, low, high, ceil(round((high - low) / step, 9))::BIGINT AS bins FROM ({_AUTO})"


@query("A19_auto_histogram", f"SELECT bin, bins, n, round(n / (total * w), 6) AS density FROM (SELECT bin, bins, total, w, count(*) AS n FROM (SELECT bins, n AS total, (high - low) / bins AS w, least(bins - 1, floor((latency_s - low) / ((high - low) / bins)))::BIGINT AS bin FROM pkt, ({_AUTO})) GROUP BY ALL)", "pkt")
def a19(pkt):
    at = F.least(F.col("bins") - 1, F.floor((F.col("latency_s") - F.col("low")) / F.col("width"))).cast("bigint")
    rows = pkt.crossJoin(F.broadcast(aggregate.auto_bins(pkt, "latency_s"))).crossJoin(F.broadcast(pkt.agg(F.count("latency_s").alias("total"))))  # one row each
    out = rows.groupBy(at.alias("bin"), "bins", "width", "total").agg(F.count("*").alias("n"))
    return out.select("bin", "bins", "n", r6(F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


# Models.
@query("M2_bic", f"SELECT endpoint, model_id, k::BIGINT AS k, n, round(ll, 3) AS loglik, round(-2 * ll + (3 * k - 1) * ln(n), 3) AS bic FROM (SELECT endpoint, model_id, max(k) AS k, count(*) AS n, sum(ln(pdf + 1e-300)) AS ll FROM (SELECT endpoint, frame, model_id, count(*) AS k, sum(" + _PDF.replace("x - mean", "latency_s - mean") + ") AS pdf FROM pkt, model GROUP BY ALL) GROUP BY ALL)", "pkt", "model")
def m2(pkt, model):
    return models.scored(pkt, "latency_s", model, ["endpoint"]).select("endpoint", "model_id", long("k").alias("k"), "n", F.round("loglik", 3).alias("loglik"), F.round("bic", 3).alias("bic"))


_BW = f"(SELECT unnest([{', '.join(repr(h) for h in models.BANDWIDTHS)}]::DOUBLE[]) AS h)"
_FOLDED = "SELECT v, CASE WHEN p < (n % 3) * (n // 3 + 1) THEN p // (n // 3 + 1) ELSE n % 3 + (p - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM (SELECT round(latency_s / 0.001::DOUBLE) * 0.001::DOUBLE AS v, row_number() OVER (ORDER BY frame) - 1 AS p, count(*) OVER () AS n FROM pkt WHERE latency_s < 2)"
_COUNTED = f"SELECT v, fold, count(*) AS c FROM ({_FOLDED}) GROUP BY ALL"
_HELD = f"SELECT h, t.fold AS fold, t.v AS v, any_value(t.c) AS c, sum(r.c * exp(-0.5 * pow((t.v - r.v) / h, 2))) / (sum(r.c) * h * sqrt(2 * pi())) AS pdf FROM {_BW}, ({_COUNTED}) t, ({_COUNTED}) r WHERE t.fold <> r.fold GROUP BY h, t.fold, t.v"


@query("M3_select_bandwidth", f"SELECT round(h, 9) AS bandwidth, round(sum(c * ln(pdf + 1e-300)), 2) AS loglik FROM ({_HELD}) GROUP BY h", "pkt")
def m3(pkt):
    got = models.select_bandwidth(pkt.where("latency_s < 2"), "latency_s", "frame")
    return got.select(F.round("bandwidth", 9).alias("bandwidth"), F.round("loglik", 2).alias("loglik"))


def _components(fitted: DataFrame) -> DataFrame:
    return fitted.select("model_id", "n", long("k").alias("k"), long("comp").alias("comp"), *[r6(F.col(c)).alias(c) for c in ("weight", "mean")], r6(F.sqrt("var")).alias("sd"))


_REFIT = "SELECT f.model_id AS model_id, n::BIGINT AS n, f.k::BIGINT AS k, comp::BIGINT AS comp, round(weight, 6) AS weight, round(mean, 6) AS mean, round(sqrt(var), 6) AS sd FROM fit f JOIN best b ON f.model_id = b.model_id AND f.k = b.k JOIN score s ON f.model_id = s.model_id AND f.k = s.k"
_ON_GRID = "SELECT '{0}' AS model_id, round(d / 0.0001::DOUBLE) * 0.0001::DOUBLE AS x, count(*)::DOUBLE AS c FROM ({1}) GROUP BY ALL"


_SORTED = f"SELECT a.x - b.x AS d FROM (SELECT x, row_number() OVER (ORDER BY x, i) AS k FROM ({_draws('total', 4000, 'p')})) a JOIN (SELECT x, row_number() OVER (ORDER BY x, i) AS k FROM ({_draws('rest', 4000, 'q')})) b USING (k) WHERE a.x - b.x > 0.0001"


@query("M6_refit", _duck_em(_ON_GRID.format("node", _SORTED), "[2, 3, 4]", 4, _REFIT), "model")
def m6(model):
    """The components of the node's mixture, after four rounds on differences of equal ranks."""
    two = _pair_draws(model, 4000, ("p", "q")).select("id", F.expr("stack(2, 'total', total, 'rest', rest) AS (side, x)"))
    k = aggregate.running(two, ["side"], "x", ["id"], name="k")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("x")))
    d = k.groupBy("k").agg((side("total") - side("rest")).alias("d"))
    return _components(models.refit(d, "d", "node", [2, 3, 4], 0.0001, 4, -1.0))


@query("M9_refit", _duck_em(_ON_GRID.format("total", f"SELECT t.x + r.x AS d FROM ({_draws('rest', 4000, 'p')}) t JOIN ({_draws('edge', 4000, 'q')}) r ON t.i = r.i"), "[2, 3, 4]", 4, _REFIT), "model")
def m9(model):
    """The components of the total's mixture, after four rounds on sums of draws of the rest and of the node."""
    d = _pair_draws(model, 4000, ("p", "q"), ("rest", "edge")).select((F.col("rest") + F.col("edge")).alias("d"))
    return _components(models.refit(d, "d", "total", [2, 3, 4], rounds=4, gain=-1.0))


_CAPTURE = "CASE endpoint WHEN 'view' THEN 'total' WHEN 'click' THEN 'rest' ELSE 'edge' END"
_CAPTURES = f"SELECT {_CAPTURE} AS model_id, round(latency_s / 0.001::DOUBLE) * 0.001::DOUBLE AS x, count(*)::DOUBLE AS c FROM pkt WHERE latency_s > 0 AND latency_s < 5 AND endpoint IN ('view', 'click', 'purchase') GROUP BY ALL"
_FITTED = _duck_em(_CAPTURES, "[2, 3]", 3, "SELECT f.model_id AS model_id, comp, weight, mean, var FROM fit f JOIN best b ON f.model_id = b.model_id AND f.k = b.k")


def _node_draw(side: str, stream: str) -> str:
    u = _du("i", stream + "c")
    return f"SELECT node, i, mean + sqrt(var) * {_dn('i', stream)} AS x FROM (SELECT node, {side}_capture AS capture, concat(n.range, '-', node) AS i FROM node, range(1000) n) JOIN (SELECT *, sum(weight) OVER w AS upto, coalesce(sum(weight) OVER (PARTITION BY model_id ORDER BY comp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since, max(comp) OVER (PARTITION BY model_id) AS last FROM fitted WINDOW w AS (PARTITION BY model_id ORDER BY comp)) ON model_id = capture AND {u} >= since AND ({u} < upto OR comp = last)"


_DRAWN = f"SELECT t.node AS node, split_part(t.i, '-', 1)::BIGINT AS id, t.x - coalesce(r.x, 0) AS d FROM ({_node_draw('total', 't')}) t LEFT JOIN ({_node_draw('rest', 'r')}) r ON t.i = r.i AND t.node = r.node JOIN node o ON o.node = t.node WHERE o.rest_capture IS NULL OR r.x IS NOT NULL"


def _chain(pkt: DataFrame, node: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    kept = pkt.where("endpoint IN ('view', 'click', 'purchase')").where(latency.plausible(F.col("latency_s"), "fit")).withColumn("capture", F.expr(_CAPTURE))
    return chain.fitted_chain(kept, "capture", "latency_s", node, [2, 3], 500, grid=1e-3, rounds=3, gain=-1.0)


@query("M8_fitted_isolation", f"WITH fitted AS ({_FITTED}), m AS ({_MOM.replace('FROM model', 'FROM fitted')}) SELECT node, round(t.mu - coalesce(r.mu, 0), 6) AS mu, round(sqrt(greatest(t.variance - coalesce(r.variance, 0), 0)), 6) AS sd, t.mu - coalesce(r.mu, 0) < 0 AS negative_mean, t.variance - coalesce(r.variance, 0) < 0 AS negative_variance FROM node JOIN m t ON total_capture = t.model_id LEFT JOIN m r ON rest_capture = r.model_id WHERE rest_capture IS NULL OR r.mu IS NOT NULL", "pkt", "node")
def m8_fitted(pkt, node):
    """Nodes isolated from mixtures that are fitted to the captures."""
    return _chain(pkt, node)[1].select("node", r6(F.col("mu")).alias("mu"), r6(F.col("sd")).alias("sd"), "negative_mean", "negative_variance")


@query("M5_fitted_pools", f"WITH fitted AS ({_FITTED}) SELECT node, count(*) AS n, round(avg(d), 5) AS mean, round(max(d), 5) AS most FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY id) AS i FROM ({_DRAWN}) WHERE d > 0.001) WHERE i <= 500 GROUP BY node", "pkt", "node")
def m5_fitted(pkt, node):
    """Delay pools of the nodes, drawn from mixtures that are fitted to the captures."""
    return _chain(pkt, node)[2].groupBy("node").agg(F.count("*").alias("n"), F.round(F.avg("delay_s"), 5).alias("mean"), F.round(F.max("delay_s"), 5).alias("most"))


_NODES = {"view": "ips", "click": "adc", "signup": "waf", "error": "web", "purchase": "app"}
_NODE = "CASE endpoint " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in _NODES.items()) + " END"
_POOLS = f"SELECT {_NODE} AS node, row_number() OVER (PARTITION BY endpoint ORDER BY frame) - 1 AS idx, latency_s AS v, count(*) OVER (PARTITION BY endpoint) AS n FROM pkt WHERE latency_s < 0.2"
_HOPS = "(VALUES " + ", ".join(f"({i}, '{n}', {'NULL' if f is None else f}::DOUBLE, {c})" for i, (n, f, c) in enumerate(models.CHAIN)) + ") AS c(hop, node, fallback, once)"
_STEPS = f"SELECT id, hop, c.node AS node, fallback, ('0x' || substr(md5(concat(CASE WHEN once THEN id // 4 ELSE id END, ':', c.node)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT frame AS id FROM pkt WHERE dir = 'C2S'), {_HOPS}"
_CHAIN = f"SELECT id, hop, s.node AS node, CASE WHEN fallback IS NULL THEN 0 ELSE coalesce(v, fallback) END AS delay FROM ({_STEPS}) s LEFT JOIN (SELECT DISTINCT node, n FROM ({_POOLS})) z ON s.node = z.node LEFT JOIN ({_POOLS}) p ON s.node = p.node AND p.idx = floor(u * z.n)::BIGINT"


def _pools(pkt: DataFrame) -> DataFrame:
    kept = pkt.where("latency_s < 0.2").withColumn("node", F.expr(_NODE))
    return aggregate.running(kept, ["node"], "frame", name="k").select("node", (F.col("k") - 1).alias("idx"), F.col("latency_s").alias("v"))


@query("M15_chain_emulation", f"SELECT id, hop::BIGINT AS hop, node, round(delay, 6) AS delay, round(sum(delay) OVER (PARTITION BY id ORDER BY hop), 6) AS upto FROM ({_CHAIN})", "pkt")
def m15(pkt):
    """Requests through the chain: the second firewall has no pool and falls back, the balancer adds nothing, the first hop draws once for four requests of a connection."""
    requests = pkt.where("dir = 'C2S'").select(F.col("frame").alias("id"), F.expr("frame DIV 4").alias("conn"))
    return models.chain_delays(requests, _pools(pkt)).select("id", long("hop").alias("hop"), "node", r6(F.col("delay")).alias("delay"), r6(F.col("upto")).alias("upto"))


@query("M15_chain_without_delays", "SELECT count(*) AS steps, 0.0::DOUBLE AS total FROM (SELECT frame FROM pkt WHERE dir = 'C2S'), range(7)", "pkt")
def m15b(pkt):
    requests = pkt.where("dir = 'C2S'").select(F.col("frame").alias("id"), F.expr("frame DIV 4").alias("conn"))
    return models.chain_delays(requests, _pools(pkt), no_delay=True).agg(F.count("*").alias("steps"), F.sum("delay").alias("total"))


QUERIES = {k: v for k, v in q.QUERIES.items() if k not in _before}
ORACLE_SQL = {k: v for k, v in q.ORACLE_SQL.items() if k in QUERIES}
