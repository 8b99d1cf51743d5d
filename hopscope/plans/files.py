"""Queries that write the driver's tables in a format and read them back, for every source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net, tls
from ..operators import mixture
from ..scratch import folder
from ..sources import pcap, tables
from . import queries as q
from .queries import _DST, _LOOSE, _MOM, long, r6
from .views import view

_before = set(q.QUERIES)


def round_trip(name: str, sql: str, *views: str):
    """Register a query of its views and a path to write to."""

    def add(f):
        q.QUERIES[name] = lambda spark, sf_dir: f(folder(spark), *[view(spark, sf_dir, v) for v in views])
        q.ORACLE_SQL[name] = q.duck(sql, *views)
        return f

    return add


# Captures.
_COLUMNS = ["capture", "frame", "ts_us", "src", "sport", "dst", "dport", "seq", "ack", "payload_len"]
_CAPTURED = "SELECT capture, row_number() OVER (PARTITION BY capture ORDER BY frame) AS frame, ts_us, src, sport::BIGINT AS sport, dst, dport::BIGINT AS dport, seq, greatest(ack, 0) AS ack, payload_len::BIGINT AS payload_len, md5(payload) AS digest FROM exchange"


def _written(path: str, frames: DataFrame, link: int = pcap.ETHERNET) -> str:
    pcap.write_pcap(frames.withColumn("ack", F.greatest("ack", F.lit(0))), path, link)
    return path


def _read(rows: DataFrame) -> DataFrame:
    return rows.select(*[long(c).alias(c) if c in ("frame", "sport", "dport", "payload_len") else F.col(c) for c in _COLUMNS], F.md5("payload").alias("digest"))


@round_trip("S1_pcap_scan", _CAPTURED, "exchange")
def s1(path, frames):
    return _read(pcap.read_pcap_split(frames.sparkSession, _written(path, frames)))


@round_trip("S2_link_types", f"SELECT link::BIGINT AS link, x.* FROM (SELECT unnest([113, 276]) AS link), ({_CAPTURED}) x", "exchange")
def s2(path, frames):
    out = None
    for link in (pcap.SLL, pcap.SLL2):
        got = _read(pcap.read_pcap_split(frames.sparkSession, _written(f"{path}/{link}", frames, link))).select(F.lit(link).cast("bigint").alias("link"), "*")
        out = got if out is None else out.unionByName(got)
    return out


@round_trip("S3_nested_folders", "SELECT capture, count(*) * 2 AS n, sum(payload_len)::BIGINT * 2 AS bytes FROM exchange GROUP BY capture", "exchange")
def s3(path, frames):
    _written(f"{path}/a/b", frames)
    _written(f"{path}/c", frames)
    return pcap.read_pcap_split(frames.sparkSession, path).groupBy("capture").agg(F.count("*").alias("n"), F.sum("payload_len").alias("bytes"))


@round_trip("S4_split_captures", _CAPTURED, "exchange")
def s4(path, frames):
    """Captures read in ranges of 40,000 bytes: no frame is lost or read twice, and each has its number."""
    return _read(pcap.read_pcap_split(frames.sparkSession, _written(path, frames), 40_000))


@round_trip("S4_indexed_captures", _CAPTURED, "exchange")
def s4b(path, frames):
    """Captures in pieces of 30,000 bytes, indexed in ranges of 20,000 and read by the data source."""
    spark = frames.sparkSession
    pcap.write_pcap(frames.withColumn("ack", F.greatest("ack", F.lit(0))), path, roll_bytes=30_000)
    pcap.index_captures(spark, path, 20_000)
    return _read(spark.read.format("pcap").load(path))


@round_trip("S6_display_filter", f"SELECT capture, count(*) AS n FROM ({_CAPTURED}) WHERE payload_len = 8 AND (sport = 443 OR dport = 443) GROUP BY capture", "exchange")
def s6(path, frames):
    """A capture read and filtered as a display filter would: TLS application data on port 443."""
    rows = pcap.read_pcap_split(frames.sparkSession, _written(path, frames))
    return rows.where(tls.is_application_data(F.col("payload")) & ((F.col("sport") == 443) | (F.col("dport") == 443))).groupBy("capture").agg(F.count("*").alias("n"))


@round_trip("K10_filtered_capture", "SELECT capture, row_number() OVER (PARTITION BY capture ORDER BY frame) AS frame, ts_us, payload_len::BIGINT AS payload_len FROM exchange WHERE dport = 80", "exchange")
def k10(path, frames):
    return _read(pcap.read_pcap_split(frames.sparkSession, _written(path, frames.where("dport = 80")))).select("capture", "frame", "ts_us", "payload_len")


@round_trip("K10_rolled_pieces", "SELECT capture, count(*) AS n, max(frame) AS frames, sum(payload_len)::BIGINT AS bytes FROM (SELECT capture, row_number() OVER (PARTITION BY capture ORDER BY frame) AS frame, payload_len FROM exchange) GROUP BY capture", "exchange")
def k10b(path, frames):
    """Captures in pieces, numbered through; a second write of half of them takes their place."""
    pcap.write_pcap(frames.where("frame % 2 = 0"), path)
    pcap.write_pcap(frames.withColumn("ack", F.greatest("ack", F.lit(0))), path, roll_bytes=50_000)
    return _read(pcap.read_pcap_split(frames.sparkSession, path, 70_000)).groupBy("capture").agg(F.count("*").alias("n"), F.max("frame").alias("frames"), F.sum("payload_len").alias("bytes"))


# Tables of fields.
@round_trip("S5_tcp_fields", "SELECT frame AS frame_number, round(ts_us / 1e6, 6) AS time_epoch, flow::VARCHAR AS tcp_stream, (20000 + flow)::BIGINT AS srcport, 80::BIGINT AS dstport, payload_len AS tcp_len FROM pkt WHERE frame % 7 <> 0", "pkt")
def s5(path, pkt):
    """Field extracts without a header; rows with a blank field (every seventh) are left out."""
    rows = pkt.select("frame", F.round(F.col("ts_us") / 1e6, 6).alias("t"), F.when(F.col("frame") % 7 != 0, F.col("flow")).alias("flow"), (F.col("flow") + 20000).alias("sp"), F.lit(80).alias("dp"), "payload_len")
    tables.write_csv(rows, path, header=False)
    t = tables.read_tcp_fields(pkt.sparkSession, path)
    return t.select("frame_number", F.round("time_epoch", 6).alias("time_epoch"), "tcp_stream", long("srcport").alias("srcport"), long("dstport").alias("dstport"), long("tcp_len").alias("tcp_len"))


@round_trip("S7_csv_header", "SELECT frame, endpoint, round(latency_s, 6) AS latency_s FROM pkt", "pkt")
def s7(path, pkt):
    tables.write_csv(pkt.select("frame", "endpoint", "latency_s"), path)
    return tables.read_csv(pkt.sparkSession, path, "frame bigint, endpoint string, latency_s double").select("frame", "endpoint", r6(F.col("latency_s")).alias("latency_s"))


@round_trip("S8_latency_table", "SELECT frame AS res_frame, frame - 1 AS req_frame, round(latency_s, 6) AS delay FROM pkt", "pkt")
def s8(path, pkt):
    tables.write_csv(pkt.select("frame", F.col("frame") - 1, "latency_s"), path, header=False, gzip=True)
    return tables.read_latency(pkt.sparkSession, path).select("res_frame", "req_frame", r6(F.col("delay")).alias("delay"))


@round_trip("S9_text_lines", "SELECT count(*) AS n, count(DISTINCT dst) AS kinds, min(dst) AS first, max(dst) AS last, count(*) FILTER (dst LIKE '8.8.%') AS some FROM packet", "packet")
def s9(path, packet):
    """Lines of a folder of text files, each with its file."""
    packet.select(F.col("dst").alias("value")).repartition(3).write.text(path)
    got = tables.read_lines(packet.sparkSession, path).where(F.col("file").endswith(".txt"))
    return got.agg(F.count("*").alias("n"), F.countDistinct("line").alias("kinds"), F.min("line").alias("first"), F.max("line").alias("last"), F.count_if(F.col("line").startswith("8.8.")).alias("some"))


@round_trip("S10_delay_pools", "SELECT count(*) AS n, round(sum(latency_s), 6) AS total, round(max(latency_s), 6) AS most FROM pkt WHERE endpoint IN ('view', 'click')", "pkt")
def s10(path, pkt):
    tables.write_pool(pkt.where("endpoint IN ('view', 'click')"), "latency_s", "endpoint", path)
    return tables.read_pool(pkt.sparkSession, path).agg(F.count("*").alias("n"), r6(F.sum("delay_s")).alias("total"), r6(F.max("delay_s")).alias("most"))


_CELLS = f"SELECT asn, name, ({_LOOSE.format('net')} // (1::BIGINT << (32 - plen))) * (1::BIGINT << (32 - plen)) AS net, plen::BIGINT AS plen FROM prefix"


def _prefixes(prefix: DataFrame) -> DataFrame:
    return prefix.select("asn", "name", F.concat_ws("/", "net", F.col("plen").cast("string")).alias("prefix"))


@round_trip("S12_prefix_dimension", f"SELECT dst, arg_max(asn, plen) AS asn, max(plen)::BIGINT AS plen FROM (SELECT DISTINCT dst, {_DST} AS n FROM packet) JOIN (SELECT *, net + (1::BIGINT << (32 - plen)) AS hi FROM ({_CELLS})) ON n >= net AND n < hi GROUP BY dst", "packet", "prefix")
def s12(path, packet, prefix):
    """Addresses looked up, with the prefix length, in a prefix table that is read from a file."""
    from ..operators import enrich

    tables.write_prefixes(_prefixes(prefix), path)
    ips = packet.select("dst", net.ip_number(F.col("dst")).alias("n")).distinct()
    found = enrich.longest_prefix(ips, tables.read_prefixes(packet.sparkSession, path), "n", ["asn", "name"])
    return found.where("asn IS NOT NULL").select("dst", "asn", long("plen").alias("plen"))


@round_trip("K6_prefix_sheet", "SELECT asn AS as_number, min(name) AS as_name, array_to_string(list_sort(list(DISTINCT concat(net, '/', plen))), chr(10)) AS prefixes FROM prefix GROUP BY asn", "prefix")
def k6(path, prefix):
    tables.write_prefixes(_prefixes(prefix), path)
    got = prefix.sparkSession.read.csv(path, header=True, multiLine=True, escape='"')
    return got.select(F.col("AS #").alias("as_number"), F.col("AS Name").alias("as_name"), F.col("AS Prefixes").alias("prefixes"))


@round_trip("S11_prefix_sheets", f"SELECT asn, min(name) OVER (PARTITION BY asn) AS name, net, plen, 3::BIGINT AS sheets FROM ({_CELLS})", "prefix")
def s11(path, prefix):
    """Sheets of three layouts: the plain one, one with a title above and other names, one with its columns turned round."""
    sheet = tables.prefix_sheet(_prefixes(prefix))
    number, name, cells = (F.col(f"`{c}`") for c in sheet.columns)
    spark = prefix.sparkSession

    def titled(to: str, head: list[tuple], *columns) -> None:
        body = sheet.select(F.lit(len(head)).alias("o"), *[c.alias(n) for c, n in zip(columns, "abc", strict=True)])
        above = spark.createDataFrame([(i, *cells) for i, cells in enumerate(head)], "o int, a string, b string, c string")
        above.unionByName(body).repartition(1).sortWithinPartitions("o", "a").drop("o").write.csv(f"{path}/{to}", header=False, escape='"')

    tables.write_prefixes(_prefixes(prefix), f"{path}/plain")
    titled("titled", [("Prefixes by system", "", ""), ("", "", ""), ("ASN", "Organisation", "Networks")], number, name, cells)
    titled("turned", [("prefix", "as number", "name")], cells, number, name)
    got = tables.read_prefix_sheets(spark, path)
    return got.groupBy("asn", "name", "net", long("plen").alias("plen")).agg(F.count("*").alias("sheets"))


@round_trip("S13_vendor_lines", "SELECT lower(mac) AS mac, vendor FROM vendor", "vendor")
def s13(path, vendor):
    vendor.select(F.concat_ws(",", F.upper("mac"), "vendor").alias("value")).write.text(path)
    return tables.read_vendors(vendor.sparkSession, path)


@round_trip("S14_model_tables", f"SELECT model_id, round(mu, 6) AS mu, round(variance, 6) AS variance FROM ({_MOM})", "model")
def s14(path, model):
    tables.write_models(model, path)
    m = mixture.moments(tables.read_models(model.sparkSession, path))
    return m.select("model_id", r6(F.col("mu")).alias("mu"), r6(F.col("variance")).alias("variance"))


@round_trip("K11_model_tables", "SELECT model_id, comp::BIGINT AS comp, weight::DOUBLE AS weight, mean::DOUBLE AS mean, var::DOUBLE AS var, CAST(NULL AS DOUBLE) AS bic FROM model", "model")
def k11(path, model):
    tables.write_models(model, path)
    return model.sparkSession.read.parquet(path).select("model_id", long("comp").alias("comp"), "weight", "mean", "var", "bic")


@round_trip("S16_subnet_lines", f"SELECT DISTINCT ({_LOOSE.format('split_part(cidr, chr(47), 1)')}) AS net, split_part(cidr, '/', 2)::BIGINT AS plen FROM (SELECT cidr FROM subnet UNION ALL SELECT '10.9.8.0/24')", "subnet")
def s16(path, subnet):
    subnet.select(F.explode(F.array(F.concat(F.lit("  "), "cidr"), F.lit(""))).alias("value")).write.text(path)
    return tables.read_subnets(subnet.sparkSession, path, ["10.9.8.0/24"]).select("net", long("plen").alias("plen"))


@round_trip("S17_pattern_lines", "SELECT DISTINCT replace(replace(url, 'http://', ''), 'https://', '') AS pattern, count(*) OVER () AS kinds FROM (SELECT DISTINCT replace(replace(url, 'http://', ''), 'https://', '') AS url FROM url WHERE url NOT LIKE '%\\%%' ESCAPE '\\')", "url")
def s17(path, url):
    """Patterns in a file, with repeats and blank lines; each has a number of its own."""
    url.where("NOT contains(url, '%')").select(F.explode(F.array(F.col("url"), F.lit(" "), F.col("url"))).alias("value")).repartition(5).write.text(path)
    p = tables.read_patterns(url.sparkSession, path)
    return p.crossJoin(F.broadcast(p.agg(F.countDistinct("pattern_id").alias("kinds")))).select("pattern", "kinds")  # one row


@round_trip("S18_stage_table", "SELECT endpoint, count(*) AS n FROM pkt GROUP BY endpoint", "pkt")
def s18(path, pkt):
    """A stage's table: the second call finds the first one's result and keeps it."""
    counts = pkt.groupBy("endpoint").agg(F.count("*").alias("n"))
    tables.stage(counts, path)
    return tables.stage(counts.where("false"), path)


# Sinks.
@round_trip("K1_sorted_lines", "SELECT dst AS value, row_number() OVER (ORDER BY dst) AS at FROM (SELECT DISTINCT dst FROM packet)", "packet")
def k1(path, packet):
    """Sorted lines in several files, numbered through."""
    tables.write_lines(packet, "dst", path)
    return tables.numbered_lines(packet.sparkSession, path)


@round_trip("K2_csv", "SELECT endpoint, count(*) AS n, round(sum(latency_s), 6) AS total FROM pkt GROUP BY endpoint", "pkt")
def k2(path, pkt):
    tables.write_csv(pkt.groupBy("endpoint").agg(F.count("*").alias("n"), r6(F.sum("latency_s")).alias("total")), path)
    return tables.read_csv(pkt.sparkSession, path, "endpoint string, n bigint, total double")


@round_trip("K3_quoted_csv", "SELECT page_id, concat('a \"quoted\", part of ', url) AS text FROM url", "url")
def k3(path, url):
    """All fields quoted, quotes inside escaped by a backslash."""
    tables.write_csv(url.select("page_id", F.concat(F.lit('a "quoted", part of '), "url").alias("text")), path, quote_all=True)
    return url.sparkSession.read.csv(path, schema="page_id bigint, text string", header=True, escape="\\")


@round_trip("K4_tsv", "SELECT dst, count(*) AS n FROM packet GROUP BY dst", "packet")
def k4(path, packet):
    tables.write_csv(packet.groupBy("dst").agg(F.count("*").alias("n")), path, sep="\t")
    return tables.read_csv(packet.sparkSession, path, "dst string, n bigint", sep="\t")


@round_trip("K5_delay_pools", "SELECT endpoint, count(*) AS n, round(sum(latency_s), 6) AS total FROM pkt GROUP BY endpoint", "pkt")
def k5(path, pkt):
    """Pools in parts of at most about 700 delays."""
    tables.write_pool(pkt, "latency_s", "endpoint", path, 700)
    got = pkt.sparkSession.read.json(path, schema="delays_seconds array<double>, endpoint string")
    return got.select("endpoint", F.explode("delays_seconds").alias("v")).groupBy("endpoint").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))


_MS = "printf('%8.2f ms', {0} * 1000)"
_REPORT = f"""SELECT node, unnest(list_concat(['{'=' * 55}', concat(' ANALYTICAL NODE REPORT: ', CASE WHEN rest IS NULL THEN 'TERMINAL (Target Only)' ELSE 'INTERMEDIATE (T - R)' END), '{'=' * 55}', concat('Source Total: ', total)],
  CASE WHEN mr > 0 THEN [concat('Source Rest:  ', rest)] ELSE [] END, ['{'-' * 55}', '[1] TOTAL OBSERVED (T)', concat('    Mean:     ', {_MS.format('mt')}), concat('    Std Dev:  ', {_MS.format('sqrt(vt)')}), ''],
  CASE WHEN mr > 0 THEN ['[2] REST OF NETWORK (R)', concat('    Mean:     ', {_MS.format('mr')}), concat('    Std Dev:  ', {_MS.format('sqrt(vr)')}), ''] ELSE [] END,
  ['{'-' * 55}', '[3] ISOLATED NODE RESULT (N)', CASE WHEN mt - mr < 0 THEN printf('    [!] WARNING: Negative Mean (%.2fms).', (mt - mr) * 1000) ELSE concat('    Mean:     ', {_MS.format('(mt - mr)')}) END,
   CASE WHEN vt - vr < 0 THEN '    [!] WARNING: Negative Variance. Models incompatible.' ELSE concat('    Std Dev:  ', {_MS.format('sqrt(greatest(vt - vr, 0))')}) END, '{'=' * 55}'])) AS line
  FROM (SELECT node, total_capture AS total, rest_capture AS rest, t.mu AS mt, t.variance AS vt, coalesce(r.mu, 0) AS mr, coalesce(r.variance, 0) AS vr FROM node JOIN ({_MOM}) t ON total_capture = t.model_id LEFT JOIN ({_MOM}) r ON rest_capture = r.model_id WHERE rest_capture IS NULL OR r.mu IS NOT NULL)"""


@round_trip("K8_node_report", _REPORT, "node", "model")
def k8(path, node, model):
    """Reports of the nodes, written as text in a folder for each node."""
    m = mixture.moments(model)
    side = lambda key, mu, var: m.select(F.col("model_id").alias(key), F.col("mu").alias(mu), F.col("variance").alias(var))
    nodes = node.join(side("total_capture", "mu_t", "var_t"), "total_capture").join(side("rest_capture", "mu_r", "var_r"), "rest_capture", "left").where("rest_capture IS NULL OR mu_r IS NOT NULL")
    lines = tables.node_report(nodes.withColumnRenamed("total_capture", "total").withColumnRenamed("rest_capture", "rest"))
    lines.orderBy("node", "line_no").select("node", "line").write.partitionBy("node").text(path)
    return node.sparkSession.read.text(path).select(F.col("node").cast("string").alias("node"), F.col("value").alias("line"))


@round_trip("K9_folder_tree", "SELECT upper(method) AS method, count(*) AS n FROM packet WHERE upper(method) = 'GET' GROUP BY 1", "packet")
def k9(path, packet):
    """A folder for each method, of which one is read."""
    tables.write_tree(packet.select("frame", F.upper("method").alias("method")), path, "method")
    return packet.sparkSession.read.parquet(path).where("method = 'GET'").groupBy("method").agg(F.count("*").alias("n"))


@round_trip("K12_sample_lines", "SELECT printf('%.4f', latency_s * 1000) AS value, count(*) AS n FROM pkt GROUP BY 1", "pkt")
def k12(path, pkt):
    tables.sample_lines(pkt.select((F.col("latency_s") * 1000).alias("ms")), "ms").write.text(path)
    return pkt.sparkSession.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@round_trip("M17_sorted_samples", "SELECT count(*) AS n, printf('%.4f', min(latency_s * 1000)) AS first, printf('%.4f', max(latency_s * 1000)) AS last FROM pkt", "pkt")
def m17(path, pkt):
    """The sorted samples that a table of an inverse distribution is made from: the first and the last line of the files."""
    tables.sample_lines(pkt.select((F.col("latency_s") * 1000).alias("ms")), "ms").write.text(path)
    return tables.numbered_lines(pkt.sparkSession, path).agg(F.count("*").alias("n"), F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"))


QUERIES = {k: v for k, v in q.QUERIES.items() if k not in _before}
ORACLE_SQL = {k: v for k, v in q.ORACLE_SQL.items() if k in QUERIES}
