"""Queries for aggregates, windows, sorts, set operations, models and protocol operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http, latency, net, tls
from ..operators import aggregate, mixture, models, pairing
from ..sources import tables
from . import queries as q
from .queries import _BASE, _CR, _DM, _DST, _PFX, _du, _draws, _duck_em, _MOM, _NUM, _PDF, _CIPHER_VALUES, _ciphers, _messages, _one, _pair_draws, _quantile_difference, long, r6

_before = set(q.QUERIES)
query = q.query


# Aggregates.
@query("A1_distinct_ips", "SELECT src AS ip FROM packet UNION SELECT dst FROM packet", "packet")
def a1(packet):
    return packet.select(F.explode(F.array("src", "dst")).alias("ip")).distinct()


@query("A2_api_counts", "SELECT '/' || array_to_string((list_filter(string_split(url, '/'), lambda x: x <> ''))[1:3], '/') AS api, count(*) AS n, arg_min(url, page_id) AS example FROM url GROUP BY 1", "url")
def a2(url):
    return aggregate.counted(url, http.api_of(F.col("url")), "api", "url", "page_id")


@query("A4_mac_accounts", "SELECT addr, count_if(s = 1) AS src_pkts, sum(CASE WHEN s = 1 THEN bytes ELSE 0 END)::BIGINT AS src_bytes, count_if(s = 0) AS dst_pkts, sum(CASE WHEN s = 0 THEN bytes ELSE 0 END)::BIGINT AS dst_bytes, count(*) AS total_pkts, sum(bytes)::BIGINT AS total_bytes FROM (SELECT src AS addr, 1 AS s, bytes FROM mac_acct UNION ALL SELECT dst, 0, bytes FROM mac_acct) GROUP BY addr", "mac_acct")
def a4(frames):
    return aggregate.accounts(frames, "src", "dst", F.col("bytes"))


@query("A6_cipher_counts", f"SELECT coalesce(version, 'Unknown') AS protocol, coalesce(name, concat('Unknown Cipher (', cipher, ')')) AS name, count(*) AS n FROM packet LEFT JOIN {_CIPHER_VALUES} ON cipher = code GROUP BY ALL", "packet")
def a6(packet):
    counts = packet.groupBy("cipher").agg(F.count("*").alias("n"))
    return counts.join(_ciphers(packet), "cipher", "left").select(F.coalesce("version", F.lit("Unknown")).alias("protocol"), F.coalesce("name", F.format_string("Unknown Cipher (%s)", "cipher")).alias("name"), "n")


_HIT = "len(list_filter(string_split(f.tokens, ' '), lambda t: NOT contains(u.url, t))) = 0"


@query("A7_filter_totals", f"SELECT (SELECT count(*) FROM url) AS total, count(DISTINCT page_id) AS matched, (SELECT count(*) FROM url) - count(DISTINCT page_id) AS unmatched FROM url u JOIN filter f ON {_HIT}", "url", "filter")
def a7(url, flt):
    from ..operators import enrich

    hit = enrich.match_patterns(url, flt.withColumn("t", F.split("tokens", " ")), enrich.all_tokens_in(F.col("url"), F.col("t")), "url", enrich.longest(F.col("t"))).agg(F.countDistinct("page_id").alias("matched"))
    return url.agg(F.count("*").alias("total")).crossJoin(hit).select("total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"))


@query("A8_host_counts", "SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM url) WHERE host IN (SELECT host FROM hosts) GROUP BY host", "url", "hosts")
def a8(url, hosts):
    return url.select(http.host_of(F.col("url")).alias("host")).join(hosts, "host", "left_semi").groupBy("host").agg(F.count("*").alias("n"))


_PROTO = "CASE dport " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in net.PORTS.items()) + " END"


@query("A10_file_stats", f"SELECT eth_dst AS file, count(*) AS total_lines, count(DISTINCT dport) AS unique_ports, array_to_string(list_sort(list(DISTINCT {_PROTO})), ',') AS protocols, count_if(sport = 0) AS ip_entries, count_if(sport <> 0) AS socket_entries FROM packet GROUP BY eth_dst", "packet")
def a10(packet):
    return packet.groupBy(F.col("eth_dst").alias("file")).agg(
        F.count("*").alias("total_lines"), F.countDistinct("dport").alias("unique_ports"), F.array_join(F.array_sort(F.collect_set(net.protocol(F.col("dport")))), ",").alias("protocols"),
        F.count_if(F.col("sport") == 0).alias("ip_entries"), F.count_if(F.col("sport") != 0).alias("socket_entries"),
    )


@query("A11_asn_prefixes", "SELECT asn, array_to_string(list_sort(list(DISTINCT concat(net, '/', plen))), ',') AS prefixes, arg_max(name, net) AS name FROM prefix GROUP BY asn", "prefix")
def a11(prefix):
    return prefix.groupBy("asn").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", F.col("net"), F.col("plen").cast("string")))), ",").alias("prefixes"), F.max_by("name", "net").alias("name"))


_PUBLIC = "dst LIKE '8.8.%' OR dst LIKE '100.64.%'"


_SUMMARY = "count(*) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median"
_ADJ2 = "SELECT endpoint, (ts_us - req_ts) / 1e6 AS v FROM (SELECT *, lag(dir) OVER w AS was, lag(ts_us) OVER w AS req_ts FROM pkt WHERE payload_len > 0 WINDOW w AS (PARTITION BY flow ORDER BY frame)) WHERE dir = 'S2C' AND was = 'C2S'"


@query("A15_rtt_summary", f"SELECT coalesce(endpoint, 'ALL') AS endpoint, {_SUMMARY} FROM ({_ADJ2}) GROUP BY ROLLUP (endpoint)", "pkt")
def a15(pkt):
    """Per-endpoint request/response latency: the flagship query."""
    pairs = pairing.adjacent_pairs(pkt.where("payload_len > 0"), ["flow"], ["frame"], F.col("dir") == "C2S", F.col("dir") == "S2C")
    out = aggregate.summary(pairs, F.col("delay_s"), "endpoint")
    return out.select("endpoint", "n", *[r6(F.col(c)).alias(c) for c in ("least", "most", "mean", "median")])


_US = "floor(round(latency_s * 1e6, 3))"
_BIN = "CASE WHEN " + _US + " = 2000000 THEN {last} ELSE floor(" + _US + " / {w}) END::BIGINT"


def _bins(w: int, keys: str = "endpoint") -> str:
    b = _BIN.format(w=w, last=2_000_000 // w - 1)
    return f"SELECT {keys}, {b} AS bin, count(*) AS n FROM pkt WHERE {b} BETWEEN 0 AND {2_000_000 // w - 1} GROUP BY ALL"


@query("A17_histogram_1ms", _bins(1000), "pkt")
def a17(pkt):
    return aggregate.histogram(pkt, F.col("latency_s"), 1000, 2_000_000, ["endpoint"])


@query("A17_histogram_5ms", _bins(5000), "pkt")
def a17b(pkt):
    return aggregate.histogram(pkt, F.col("latency_s"), 5000, 2_000_000, ["endpoint"])


@query("A18_empirical_pmf", f"SELECT endpoint, bin, round((bin + 0.5) * 0.001, 6)::DOUBLE AS center, n, round(n / total, 6) AS p FROM ({_bins(1000)}) JOIN (SELECT endpoint, count(*)::DOUBLE AS total FROM pkt GROUP BY 1) USING (endpoint)", "pkt")
def a18(pkt):
    return aggregate.pmf(pkt, F.col("latency_s"), 1000, 2_000_000, ["endpoint"]).select("endpoint", "bin", r6(F.col("center")).alias("center"), "n", r6(F.col("p")).alias("p"))


@query("A19_density_histogram", f"SELECT endpoint, bin, round(n / (sum(n) OVER (PARTITION BY endpoint) * 0.005::DOUBLE), 6) AS density FROM ({_bins(5000)})", "pkt")
def a19(pkt):
    p = aggregate.pmf(pkt, F.col("latency_s"), 5000, 2_000_000, ["endpoint"], inside=True)
    return p.select("endpoint", "bin", r6(F.col("p") / 0.005).alias("density"))


@query("A20_time_latency_grid", "SELECT ts_us // 3600000000 AS hour, " + _BIN.format(w=5000, last=399) + " AS bin, count(*) AS n FROM pkt WHERE latency_s <= 2 GROUP BY ALL", "pkt")
def a20(pkt):
    return aggregate.histogram(pkt.withColumn("hour", F.floor(F.col("ts_us") / 3600000000).cast("bigint")), F.col("latency_s"), 5000, 2_000_000, ["hour"])


@query("A21_ecdf", "SELECT DISTINCT endpoint, round(latency_s, 6) AS latency_s, round(cume_dist() OVER (PARTITION BY endpoint ORDER BY latency_s), 6) AS share FROM pkt WHERE latency_s <= 0.1", "pkt")
def a21(pkt):
    return aggregate.ecdf(pkt, "latency_s", ["endpoint"], 0.1).select("endpoint", r6(F.col("latency_s")).alias("latency_s"), r6(F.col("share")).alias("share"))


@query("A22_mean_p95", "SELECT endpoint, round(avg(latency_s), 6) AS mean, round(round(quantile_cont(latency_s, 0.95), 9), 6) AS p95 FROM pkt GROUP BY endpoint", "pkt")
def a22(pkt):
    mean, p95 = pkt.groupBy("endpoint").agg(r6(F.avg("latency_s")).alias("mean")), aggregate.percentiles(pkt, F.col("latency_s"), ["endpoint"], {"p95": 0.95})
    return mean.join(p95, "endpoint").select("endpoint", "mean", r6(F.round("p95", 9)).alias("p95"))


@query("A23_quantiles", "SELECT unnest(range(1001)) AS pos, round(unnest(quantile_cont(latency_s, list_transform(range(1001), lambda i: i / 1000.0))), 9) AS q FROM pkt", "pkt")
def a23(pkt):
    return aggregate.quantiles(pkt, F.col("latency_s"), [], 1001).select(long("pos").alias("pos"), F.round("q", 9).alias("q"))


@query("A24_mean_ms", "SELECT round(avg(latency_s * 1000), 6) AS mean_ms FROM pkt", "pkt")
def a24(pkt):
    return pkt.agg(r6(F.avg(F.col("latency_s") * 1000)).alias("mean_ms"))


@query("A25_jitter", "SELECT endpoint, round(stddev_samp(latency_s), 6) AS sample_sd, round(stddev_pop(latency_s), 6) AS population_sd FROM pkt GROUP BY endpoint", "pkt")
def a25(pkt):
    return pkt.groupBy("endpoint").agg(r6(F.stddev_samp("latency_s")).alias("sample_sd"), r6(F.stddev_pop("latency_s")).alias("population_sd"))


@query("A26_negative_share", "SELECT count_if(latency_s - 0.02 < 0) AS n, round(100.0 * count_if(latency_s - 0.02 < 0) / count(*), 6)::DOUBLE AS pct FROM pkt", "pkt")
def a26(pkt):
    bad = F.col("latency_s") - 0.02 < 0
    return pkt.agg(F.count_if(bad).alias("n"), F.round(aggregate.share(F.count_if(bad), F.count("*")), 6).cast("double").alias("pct"))


@query("A27_load_summary", "SELECT count_if(endpoint <> 'error') AS success, count_if(endpoint = 'error') AS failed, round((max(ts_us) - min(ts_us)) / 1e6, 6) AS elapsed_s, round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 9) AS per_s FROM pkt", "pkt")
def a27(pkt):
    elapsed = (F.max("ts_us") - F.min("ts_us")) / 1e6
    return pkt.agg(F.count_if(F.col("endpoint") != "error").alias("success"), F.count_if(F.col("endpoint") == "error").alias("failed"), r6(elapsed).alias("elapsed_s"), F.round(F.count("*") / elapsed, 9).alias("per_s"))


@query("A28_mixture_moments", f"SELECT model_id, round(mu, 6) AS mu, round(sqrt(variance), 6) AS sd FROM ({_MOM})", "model")
def a28(model):
    return mixture.moments(model).select("model_id", r6(F.col("mu")).alias("mu"), r6(F.sqrt("variance")).alias("sd"))


_FITTED = "SELECT endpoint AS model_id, round(latency_s / 0.001::DOUBLE) * 0.001::DOUBLE AS x, count(*)::DOUBLE AS c FROM pkt WHERE latency_s > 0 AND latency_s < 5 GROUP BY ALL"


def _fits(pkt: DataFrame, ks: list[int], rounds: int) -> DataFrame:
    """Mixtures of each endpoint's latencies after a number of rounds."""
    return models.fit_mixtures(pkt.where(latency.plausible(F.col("latency_s"), "fit")), "endpoint", "latency_s", ks, 1e-3, False, rounds, -1.0)


@query("A29_model_selection", _duck_em(_FITTED, "[2, 3, 4, 5, 6]", 2, "SELECT model_id AS endpoint, k::BIGINT AS k FROM best"), "pkt")
def a29(pkt):
    """Each endpoint's number of components, by the BIC of fits to its latencies."""
    return models.select_model(_fits(pkt, [2, 3, 4, 5, 6], 2)).select(F.col("model_id").alias("endpoint"), long("k").alias("k")).distinct()


@query("A30_rejected_share", f"SELECT round(100.0 * avg(CASE WHEN t.x - r.x <= 0.001 THEN 1 ELSE 0 END), 6) AS pct, avg(CASE WHEN t.x - r.x <= 0.001 THEN 1 ELSE 0 END) > 0.5 AS warn FROM ({_draws('total', 3000, 'p')}) t JOIN ({_draws('rest', 3000, 'q')}) r ON t.i = r.i", "model")
def a30(model):
    bad = F.avg((F.col("total") - F.col("rest") <= 0.001).cast("int"))
    return _pair_draws(model, 3000, ("p", "q")).agg(r6(100.0 * bad).alias("pct"), (bad > 0.5).alias("warn"))


@query("A31_packet_count", "SELECT count(*) AS n FROM packet", "packet")
def a31(packet):
    return packet.agg(F.count("*").alias("n"))


# Windows, sorts, samples.
@query("W3_ordinal", "SELECT frame, row_number() OVER (PARTITION BY flow, dir ORDER BY frame) AS k FROM pkt", "pkt")
def w3(pkt):
    return pkt.select("frame", long(F.row_number().over(Window.partitionBy("flow", "dir").orderBy("frame"))).alias("k"))


@query("W4_first_in_capture", "SELECT frame, round((ts_us - first_value(ts_us) OVER (PARTITION BY endpoint ORDER BY frame)) / 1e6, 6) AS rel FROM pkt", "pkt")
def w4(pkt):
    first = pkt.groupBy("endpoint").agg(F.min_by("ts_us", "frame").alias("t0"))
    return pkt.join(first, "endpoint").select("frame", r6((F.col("ts_us") - F.col("t0")) / 1e6).alias("rel"))


@query("W5_packet_index", "SELECT frame, row_number() OVER (PARTITION BY endpoint ORDER BY frame) AS i FROM pkt WHERE latency_s < 0.05", "pkt")
def w5(pkt):
    return aggregate.running(pkt.where("latency_s < 0.05"), ["endpoint"], "frame", name="i").select("frame", "i")


@query("W6_top_k", "SELECT flow, count(*) AS n FROM pkt GROUP BY flow ORDER BY n DESC, flow LIMIT 20", "pkt")
def w6(pkt):
    return aggregate.top(pkt.groupBy("flow").agg(F.count("*").alias("n")), 20, "n", "flow")


@query("W9_percent_of_total", "SELECT flow, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM pkt GROUP BY flow", "pkt")
def w9(pkt):
    n = pkt.groupBy("flow").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(pkt.agg(F.count("*").alias("total")))).select("flow", F.round(aggregate.share(F.col("n"), F.col("total")), 6).cast("double").alias("pct"))


@query("W10_contiguous_runs", "SELECT flow, sum(payload_len)::BIGINT AS bytes, count(*) AS n FROM (SELECT *, sum(gap) OVER (PARTITION BY flow ORDER BY frame) AS run FROM (SELECT *, CASE WHEN lag(dir) OVER (PARTITION BY flow ORDER BY frame) = dir THEN 0 ELSE 1 END AS gap FROM pkt)) GROUP BY flow, run", "pkt")
def w10(pkt):
    w = Window.partitionBy("flow").orderBy("frame")
    gap = F.when(F.lag("dir").over(w) == F.col("dir"), 0).otherwise(1)
    return pkt.withColumn("gap", gap).withColumn("run", F.sum("gap").over(w)).groupBy("flow", "run").agg(F.sum("payload_len").alias("bytes"), F.count("*").alias("n")).drop("run")


@query("O1_sorted_values", "SELECT DISTINCT dst FROM packet ORDER BY dst", "packet")
def o1(packet):
    return packet.select("dst").distinct().orderBy("dst")


@query("O2_sorted_counts", "SELECT dst, count(*) AS n FROM packet GROUP BY dst ORDER BY n DESC, dst", "packet")
def o2(packet):
    return packet.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst")


@query("O3_sorted_time", "SELECT ts_us, frame FROM pkt ORDER BY ts_us, frame", "pkt")
def o3(pkt):
    return pkt.select("ts_us", "frame").orderBy("ts_us", "frame")


@query("O4_numeric_sort", "SELECT DISTINCT dport::BIGINT AS port FROM packet ORDER BY port", "packet")
def o4(packet):
    return packet.select(long("dport").alias("port")).distinct().orderBy("port")


@query("O5_by_bytes", "SELECT addr, total FROM (SELECT src AS addr, sum(bytes)::BIGINT AS total FROM mac_acct GROUP BY src) ORDER BY total DESC, addr", "mac_acct")
def o5(frames):
    return frames.groupBy(F.col("src").alias("addr")).agg(F.sum("bytes").alias("total")).orderBy(F.desc("total"), "addr")


@query("O6_first_valid", f"SELECT t.i AS id FROM ({_draws('total', 3000, 'p')}) t JOIN ({_draws('rest', 3000, 'q')}) r ON t.i = r.i WHERE t.x - r.x > 0.001 ORDER BY t.i LIMIT 500", "model")
def o6(model):
    return _pair_draws(model, 3000, ("p", "q")).where("total - rest > 0.001").orderBy("id").limit(500).select("id")


_POOL = "SELECT latency_s AS v, row_number() OVER (ORDER BY frame) - 1 AS idx, count(*) OVER () AS n FROM pkt WHERE endpoint = '{0}'"


def _pool(pkt: DataFrame, endpoint: str) -> DataFrame:
    """(idx from 0, v) of an endpoint's samples in order of frame."""
    return aggregate.running(pkt.where(F.col("endpoint") == endpoint), ["endpoint"], "frame", name="k").select((F.col("k") - 1).alias("idx"), F.col("latency_s").alias("v"))


def _bootstrap(pkt: DataFrame, endpoint: str, n: int, stream: str) -> DataFrame:
    """(id, v): ``n`` uniform draws with replacement from an endpoint's samples."""
    pool = _pool(pkt, endpoint)
    size = pool.agg(F.count("*").alias("n"))
    ids = pkt.sparkSession.range(n).crossJoin(F.broadcast(size)).select("id", F.floor(latency.uniform(F.col("id"), stream) * F.col("n")).cast("bigint").alias("idx"))
    return ids.join(pool, "idx").select("id", "v")


def _duck_boot(endpoint: str, n: int, s: str) -> str:
    return f"SELECT i, v FROM (SELECT range AS i FROM range({n})) JOIN ({_POOL.format(endpoint)}) ON idx = floor({_du('i', s)} * n)::BIGINT"


@query("O7_bootstrap", f"SELECT i AS id, round(v, 6) AS v FROM ({_duck_boot('view', 2000, 'b')})", "pkt")
def o7(pkt):
    return _bootstrap(pkt, "view", 2000, "b").select("id", r6(F.col("v")).alias("v"))


_CUM = f"SELECT bin, (sum(n) OVER (ORDER BY bin) - n)::DOUBLE / sum(n) OVER () AS lo, (sum(n) OVER (ORDER BY bin))::DOUBLE / sum(n) OVER () AS hi FROM ({_bins(5000, chr(39) + 'all' + chr(39) + ' AS k')})"


def _cumulative(pkt: DataFrame) -> DataFrame:
    """Bins of the latency PMF with their range of cumulative weight: at most 400 rows."""
    n = aggregate.histogram(pkt, F.col("latency_s"), 5000, 2_000_000, []).withColumn("k", F.lit(0))
    upto, total = F.sum("n").over(Window.partitionBy("k").orderBy("bin")), F.sum("n").over(Window.partitionBy("k"))
    return n.select("bin", ((upto - F.col("n")) / total).alias("lo"), (upto / total).alias("hi"))


@query("O8_weighted_draw", f"SELECT bin, count(*) AS n FROM (SELECT range AS i FROM range(5000)) JOIN ({_CUM}) ON {_du('i', 'w')} >= lo AND {_du('i', 'w')} < hi GROUP BY bin", "pkt")
def o8(pkt):
    steps = _cumulative(pkt).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "bin"))).alias("s"))
    draws = pkt.sparkSession.range(5000).withColumn("u", latency.uniform(F.col("id"), "w")).crossJoin(F.broadcast(steps))
    got = draws.select(F.get(F.filter("s", lambda x: (F.col("u") >= x["lo"]) & (F.col("u") < x["hi"])), F.lit(0))["bin"].alias("bin")).where("bin IS NOT NULL")
    return got.groupBy("bin").agg(F.count("*").alias("n"))


@query("O9_mixture_draw", f"SELECT i AS id, round(x, 6) AS x FROM ({_draws('total', 2000, 'd')})", "model")
def o9(model):
    return model.sparkSession.range(2000).crossJoin(F.broadcast(_one(model, "total"))).select("id", r6(mixture.draw(F.col("id"), "d", F.col("total"))).alias("x"))


@query("O10_shuffled", f"SELECT row_number() OVER (ORDER BY {_du('frame', 'o')}, frame) AS place, frame FROM pkt", "pkt")
def o10(pkt):
    """Samples in an order of their own, by reproducible random keys: place from 1."""
    keyed = pkt.select("frame", latency.uniform(F.col("frame"), "o").alias("u"))
    return aggregate.running(keyed, [], "u", ["frame"], name="place").select("place", "frame")


# Set operations.
@query("U1_union_distinct", "SELECT src AS v FROM packet WHERE frame % 2 = 0 UNION SELECT src FROM packet WHERE frame % 2 = 1", "packet")
def u1(packet):
    return packet.where("frame % 2 = 0").select(F.col("src").alias("v")).union(packet.where("frame % 2 = 1").select("src")).distinct()


@query("U2_union_all", "SELECT frame, 'a' AS part FROM pkt WHERE dir = 'C2S' UNION ALL SELECT frame, 'b' FROM pkt", "pkt")
def u2(pkt):
    return pkt.where("dir = 'C2S'").select("frame", F.lit("a").alias("part")).unionByName(pkt.select("frame", F.lit("b").alias("part")))


@query("U3_stacked_sizes", "SELECT frame, 'len' AS side, payload_len AS size FROM pkt UNION ALL SELECT frame, 'flow', flow FROM pkt", "pkt")
def u3(pkt):
    return pkt.select("frame", F.expr("stack(2, 'len', payload_len, 'flow', flow) AS (side, size)"))


@query("U4_unmatched", "SELECT DISTINCT dst FROM packet WHERE dst NOT LIKE '8.8.%'", "packet")
def u4(packet):
    all_, hit = packet.select("dst").distinct(), packet.where("dst LIKE '8.8.%'").select("dst").distinct()
    return all_.join(hit, "dst", "left_anti")


@query("U5_common_ips", "SELECT src FROM packet WHERE frame % 3 = 0 INTERSECT SELECT src FROM packet WHERE frame % 3 = 1", "packet")
def u5(packet):
    return packet.where("frame % 3 = 0").select("src").intersect(packet.where("frame % 3 = 1").select("src"))


@query("U6_first_seen", "SELECT dst, min(frame) AS first FROM packet GROUP BY dst", "packet")
def u6(packet):
    return packet.groupBy("dst").agg(F.min("frame").alias("first"))


@query("U7_unpivoted", "SELECT DISTINCT a AS addr FROM (SELECT src AS a FROM packet UNION ALL SELECT dst FROM packet) WHERE a LIKE '10.%'", "packet")
def u7(packet):
    return packet.select(F.explode(F.array("src", "dst")).alias("addr")).where("addr LIKE '10.%'").distinct()


@query("U8_partitioned", "SELECT coalesce(m, 'ALL') AS part, count(*) AS n FROM (SELECT upper(method) AS m FROM packet WHERE upper(method) IN ('GET', 'POST')) GROUP BY ROLLUP (m)", "packet")
def u8(packet):
    m = packet.select(F.upper("method").alias("m")).where("m IN ('GET', 'POST')").rollup("m").agg(F.count("*").alias("n"))
    return m.select(F.coalesce("m", F.lit("ALL")).alias("part"), "n")


# Models.
@query("M1_em_rounds", _duck_em(_FITTED, "[2, 3, 4, 8]", 3, "SELECT f.model_id AS endpoint, f.k::BIGINT AS k, n::BIGINT AS n, comp::BIGINT AS comp, round(weight, 6) AS weight, round(mean, 6) AS mean, round(sqrt(var), 6) AS sd, round(bic, 2) AS bic FROM fit f JOIN score s ON f.model_id = s.model_id AND f.k = s.k"), "pkt")
def m1b(pkt):
    """Three rounds of EM for some numbers of components side by side."""
    fits = _fits(pkt, [2, 3, 4, 8], 3)
    return fits.select(F.col("model_id").alias("endpoint"), long("k").alias("k"), "n", long("comp").alias("comp"), r6(F.col("weight")).alias("weight"), r6(F.col("mean")).alias("mean"), r6(F.sqrt("var")).alias("sd"), F.round("bic", 2).alias("bic"))


@query("M1_fit_mixtures", None, "pkt")
def m1(pkt):
    return models.fit_mixtures(pkt.where(latency.plausible(F.col("latency_s"), "fit")), "endpoint", "latency_s", list(range(2, 30)), grid=1e-3)


@query("M3_kernel_density", "SELECT g.range AS i, round(sum(c * exp(-0.5 * ((g.range * 0.005::DOUBLE - v) / 0.02) * ((g.range * 0.005::DOUBLE - v) / 0.02))) / (sum(c) * 0.02 * sqrt(2 * pi())), 6) AS pdf FROM range(101) g, (SELECT round(latency_s / 0.001::DOUBLE) * 0.001::DOUBLE AS v, count(*) AS c FROM pkt GROUP BY 1) GROUP BY g.range", "pkt")
def m3(pkt):
    return models.kernel_density(pkt, "latency_s", 0.02, 101, 0.0, 0.5).select(long("i").alias("i"), r6(F.col("pdf")).alias("pdf"))


@query("M4_grid", "SELECT range AS i, round(0.0001::DOUBLE + range * ((top - 0.0001::DOUBLE) / 4999), 9) AS x FROM range(5000), (SELECT least(1.0::DOUBLE, max(latency_s)) AS top FROM pkt)", "pkt")
def m4(pkt):
    """5,000 points from 0.0001 to the greatest latency, or 1."""
    top = pkt.agg(F.least(F.lit(1.0), F.max("latency_s")).alias("top"))
    return pkt.sparkSession.range(5000).crossJoin(F.broadcast(top)).select(F.col("id").alias("i"), F.round(F.lit(1e-4) + F.col("id") * ((F.col("top") - 1e-4) / 4999), 9).alias("x"))  # one row


@query("M5_random_deconvolution", f"SELECT count(*) AS n, round(avg(d), 6) AS mean FROM (SELECT t.x - r.x AS d FROM ({_draws('total', 4000, 'p')}) t JOIN ({_draws('rest', 4000, 'q')}) r ON t.i = r.i WHERE t.x - r.x > 0.001 ORDER BY t.i LIMIT 2000)", "model")
def m5(model):
    kept = _pair_draws(model, 4000, ("p", "q")).where("total - rest > 0.001").orderBy("id").limit(2000)
    return kept.agg(F.count("*").alias("n"), r6(F.avg(F.col("total") - F.col("rest"))).alias("mean"))


@query("M6_sorted_deconvolution", f"SELECT count(*) AS n, round(avg(d), 6) AS mean FROM (SELECT a.x - b.x AS d FROM (SELECT x, row_number() OVER (ORDER BY x, i) AS k FROM ({_draws('total', 4000, 'p')})) a JOIN (SELECT x, row_number() OVER (ORDER BY x, i) AS k FROM ({_draws('rest', 4000, 'q')})) b USING (k)) WHERE d > 0.0001", "model")
def m6(model):
    two = _pair_draws(model, 4000, ("p", "q")).select("id", F.expr("stack(2, 'total', total, 'rest', rest) AS (side, x)"))
    k = aggregate.running(two, ["side"], "x", ["id"], name="k")
    d = k.groupBy("k").agg((F.max(F.when(F.col("side") == "total", F.col("x"))) - F.max(F.when(F.col("side") == "rest", F.col("x")))).alias("d"))
    return d.where("d > 0.0001").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean"))


@query("M7_quantile_deconvolution", q.ORACLE_SQL["J15_quantile_join"].replace("round(a.q - b.q, 9) AS d", "round(greatest(a.q - b.q, 0.0001), 9) AS d"))
def m7(spark, sf_dir):
    from .views import view

    return _quantile_difference(view(spark, sf_dir, "pkt"), 101).select("pos", F.round(F.greatest(F.col("d"), F.lit(1e-4)), 9).alias("d"))


@query("M8_analytic_isolation", f"SELECT node, round(t.mu - coalesce(r.mu, 0), 6) AS mu, round(sqrt(greatest(t.variance - coalesce(r.variance, 0), 0)), 6) AS sd, t.mu - coalesce(r.mu, 0) < 0 AS negative_mean, t.variance - coalesce(r.variance, 0) < 0 AS negative_variance FROM node JOIN ({_MOM}) t ON total_capture = t.model_id LEFT JOIN ({_MOM}) r ON rest_capture = r.model_id WHERE rest_capture IS NULL OR r.mu IS NOT NULL", "node", "model")
def m8(node, model):
    return mixture.isolate(model, node).select("node", r6(F.col("mu")).alias("mu"), r6(F.col("sd")).alias("sd"), "negative_mean", "negative_variance")


@query("M9_convolution", f"SELECT round(avg(t.x + r.x), 6) AS mean, round(stddev_pop(t.x + r.x), 6) AS sd FROM ({_draws('rest', 4000, 'p')}) t JOIN ({_draws('edge', 4000, 'q')}) r ON t.i = r.i", "model")
def m9(model):
    s = F.col("rest") + F.col("edge")
    return _pair_draws(model, 4000, ("p", "q"), ("rest", "edge")).agg(r6(F.avg(s)).alias("mean"), r6(F.stddev_pop(s)).alias("sd"))


@query("M10_bootstrap_convolution", f"SELECT bin, count(*) AS n FROM (SELECT floor(round((a.v + b.v) * 1e6, 3) / 5000)::BIGINT AS bin FROM ({_duck_boot('view', 3000, 'x')}) a JOIN ({_duck_boot('click', 3000, 'y')}) b ON a.i = b.i) GROUP BY bin", "pkt")
def m10(pkt):
    a, b = _bootstrap(pkt, "view", 3000, "x"), _bootstrap(pkt, "click", 3000, "y").withColumnRenamed("v", "w")
    return a.join(b, "id").groupBy(F.floor(F.round((F.col("v") + F.col("w")) * 1e6, 3) / 5000).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def _duck_kl(p: str, r: str, n: int, s: str) -> str:
    pdf = lambda m: f"(SELECT sum({_PDF}) FROM model WHERE model_id = '{m}')"
    return f"SELECT greatest(0.0, avg(ln({pdf(p)} + 1e-300) - ln({pdf(r)} + 1e-300))) AS kl FROM ({_draws(p, n, s)})"


@query("M11_monte_carlo_kl", f"SELECT round(kl, 6) AS kl FROM ({_duck_kl('total', 'rest', 2000, 'kl')})", "model")
def m11(model):
    return mixture.monte_carlo_kl(model, "total", "rest", 2000).select(r6(F.col("kl")).alias("kl"))


@query("M12_symmetric_kl", f"SELECT round((a.kl + b.kl) / 2, 6) AS kl, CASE WHEN (a.kl + b.kl) / 2 < 0.1 THEN 'excellent' WHEN (a.kl + b.kl) / 2 < 0.5 THEN 'good' WHEN (a.kl + b.kl) / 2 < 1.0 THEN 'fair' ELSE 'poor' END AS verdict FROM ({_duck_kl('total', 'rest', 2000, 'kl')}) a, ({_duck_kl('rest', 'total', 2000, 'kl')}) b", "model")
def m12(model):
    a, b = mixture.monte_carlo_kl(model, "total", "rest", 2000), mixture.monte_carlo_kl(model, "rest", "total", 2000).withColumnRenamed("kl", "back")
    s = (F.col("kl") + F.col("back")) / 2
    return a.crossJoin(b).select(r6(s).alias("kl"), latency.verdict(s).alias("verdict"))  # two single rows


_GRIDPQ = f"SELECT i, (SELECT sum({_PDF}) FROM model WHERE model_id = 'total') AS p, (SELECT sum({_PDF}) FROM model WHERE model_id = 'rest') AS q FROM (SELECT range AS i, 0.0001::DOUBLE + range * (0.9999::DOUBLE / 1999) AS x FROM range(2000))"
_NORMED = f"SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM (SELECT least(greatest(p / sum(p) OVER (), 1e-10), 1.0) AS p, least(greatest(q / sum(q) OVER (), 1e-10), 1.0) AS q FROM ({_GRIDPQ}))"


@query("M13_grid_divergence", f"SELECT round(sum(p * ln(p / q)), 6) AS kl, round(sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2), 6) AS js FROM ({_NORMED})", "model")
def m13(model):
    return mixture.grid_divergence(model, "total", "rest", 2000).select(r6(F.col("kl")).alias("kl"), r6(F.col("js")).alias("js"))


@query("M14_pool_pmf", f"SELECT endpoint, bin, round(n / sum(n) OVER (PARTITION BY endpoint), 6) AS p FROM ({_bins(1000)})", "pkt")
def m14(pkt):
    return aggregate.pmf(pkt, F.col("latency_s"), 1000, 2_000_000, ["endpoint"], inside=True).select("endpoint", "bin", r6(F.col("p")).alias("p"))


@query("M16_truncated_resample", "WITH model AS (SELECT model_id, comp, weight / sum(weight) OVER (PARTITION BY model_id) AS weight, mean, var FROM model0 WHERE weight >= 0.05) SELECT count(*) AS n, round(avg(x * 1000), 6) AS mean_ms, round(stddev_pop(x * 1000), 6) AS jitter_ms FROM (SELECT x FROM (" + _draws("total", 4000, "t") + ") WHERE x >= 0 ORDER BY i LIMIT 2000)", )
def m16(spark, sf_dir):
    from .views import view

    pruned = mixture.prune(view(spark, sf_dir, "model"))
    x = spark.range(4000).crossJoin(F.broadcast(_one(pruned, "total"))).select("id", mixture.draw(F.col("id"), "t", F.col("total")).alias("x"))
    kept = x.where("x >= 0").orderBy("id").limit(2000)
    return kept.agg(F.count("*").alias("n"), r6(F.avg(F.col("x") * 1000)).alias("mean_ms"), r6(F.stddev_pop(F.col("x") * 1000)).alias("jitter_ms"))


q.ORACLE_SQL["M16_truncated_resample"] = q.ORACLE_SQL["M16_truncated_resample"].replace("WITH model AS", q.duck("", "model").rstrip().replace("model AS", "model0 AS") + ", model AS")


@query("F18_subtraction_cut", f"SELECT count(*) AS n FROM ({_draws('total', 3000, 'p')}) t JOIN ({_draws('rest', 3000, 'q')}) r ON t.i = r.i WHERE t.x - r.x > 0.0001", "model")
def f18(model):
    return _pair_draws(model, 3000, ("p", "q")).where("total - rest > 0.0001").agg(F.count("*").alias("n"))


@query("F31_truncation", f"SELECT i AS id, round(x, 6) AS x FROM ({_draws('total', 2000, 't')}) WHERE x >= 0 ORDER BY i LIMIT 1000", "model")
def f31(model):
    x = model.sparkSession.range(2000).crossJoin(F.broadcast(_one(model, "total"))).select("id", mixture.draw(F.col("id"), "t", F.col("total")).alias("x"))
    return x.where("x >= 0").orderBy("id").limit(1000).select("id", r6(F.col("x")).alias("x"))


# Sources and sinks as tables.
@query("S11_prefix_cells", f"SELECT asn, name, (({q._LOOSE.format('ip')}) // (1::BIGINT << (32 - plen))) * (1::BIGINT << (32 - plen)) AS net, plen::BIGINT AS plen FROM (SELECT asn, name, split_part(trim(p), '/', 1) AS ip, CASE WHEN contains(p, '/') THEN split_part(trim(p), '/', 2)::INT ELSE 32 END AS plen FROM (SELECT asn, name, unnest(string_split(prefixes, chr(10))) AS p FROM cell) WHERE regexp_full_match(trim(p), '\\d+\\.\\d+\\.\\d+\\.\\d+(/\\d+)?'))", "cell")
def s11(cell):
    return tables.prefix_cells(cell).select("asn", "name", "net", long("plen").alias("plen"))


@query("S15_dist_values", "SELECT count(*) AS n, round(sum(v), 3) AS total FROM (SELECT unnest(list_transform(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda t: regexp_full_match(t, '[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?')), lambda t: t::DOUBLE)) AS v FROM line WHERE NOT starts_with(trim(line), '#')) WHERE abs(v) < 1e9", "line")
def s15(line):
    return line.select(F.explode(tables.numbers(F.col("line"))).alias("v")).where("abs(v) < 1e9").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"))


_KNOWN = f"SELECT dst, arg_max(asn, plen) AS asn, arg_max(name, plen) AS name FROM (SELECT DISTINCT dst, {_DST} AS n FROM packet) LEFT JOIN ({_PFX}) ON n >= lo AND n < hi GROUP BY dst"


@query("K7_report_lines", f"SELECT DISTINCT CASE WHEN asn IS NULL THEN concat('- ', p.dst, ' → ASN Unknown') ELSE concat('- ', p.dst, ' → ASN ', asn, ' (', name, ')') END AS line FROM packet p JOIN ({_KNOWN}) k ON p.dst = k.dst WHERE {_PROTO} IS NOT NULL UNION SELECT DISTINCT concat('### Protocol: ', {_PROTO}) FROM packet WHERE {_PROTO} IS NOT NULL", "packet", "prefix")
def k7(packet, prefix):
    """Addresses by protocol with the systems of their longest prefixes."""
    from ..operators import enrich

    rows = packet.select(net.protocol(F.col("dport")).alias("protocol"), F.col("dst").alias("ip")).where("protocol IS NOT NULL").distinct()
    table = prefix.select(net.ip_number(F.col("net")).alias("net"), "plen", "asn", "name")
    known = enrich.longest_prefix(rows.withColumn("n", net.ip_number(F.col("ip"))), table, "n", ["asn", "name"])
    return tables.report_lines(known.select("protocol", "ip", "asn", "name")).distinct()


@query("K13_event_lines", "SELECT printf('%.6f  %s -> %s  %d  %s', frame::DOUBLE, src, dst, octet_length(payload), method) AS value FROM packet", "packet")
def k13(packet):
    e = packet.select(F.col("frame").cast("double").alias("ts_rel"), F.col("src").alias("client"), F.col("dst").alias("server"), F.octet_length("payload").alias("pkt_len"), "method", F.lit(None).cast("string").alias("reason"))
    return tables.event_lines(e)


# Protocol operators.


@query("H6_tls_records", "SELECT frame, ('0x' || substr(hex(payload), 7, 4))::BIGINT AS length FROM packet WHERE octet_length(payload) >= 5 AND substr(hex(payload), 1, 2) IN ('14', '15', '16', '17') AND substr(hex(payload), 3, 2) = '03' AND substr(hex(payload), 5, 2) IN ('00', '01', '02', '03', '04')", "packet")
def h6(packet):
    return packet.where(tls.is_record(F.col("payload"))).select("frame", long(tls.record_length(F.col("payload"))).alias("length"))


@query("H7_unique_endpoints", f"SELECT DISTINCT root || CASE WHEN clean <> '' THEN '/' || clean ELSE '' END AS base FROM ({_BASE.replace('{0}', '(SELECT page_id AS id, url AS u FROM url)')})", "url")
def h7(url):
    return url.select(http.base_url(F.col("url")).alias("base")).distinct()


QUERIES = {k: v for k, v in q.QUERIES.items() if k not in _before}
ORACLE_SQL = {k: v for k, v in q.ORACLE_SQL.items() if k in QUERIES}
