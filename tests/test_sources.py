"""Captures written by hand, files in all formats, streams, and the package without the training-data part."""

from __future__ import annotations

import os
import shutil
import struct
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from hopscope.functions import http
from hopscope.sources import boundaries, pcap, reassembly, tables
from hopscope.streaming import pairs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ip(text):
    return bytes(map(int, text.split(".")))


def tcp(src, sport, dst, dport, seq, ack, payload):
    body = struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 5 << 4, 0x18, 100, 0, 0) + payload
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 1, 0, 64, 6, 0) + ip(src) + ip(dst) + body


def capture(frames, link=1, order="<"):
    head = {1: b"\x02\0\0\0\0\1\x02\0\0\0\0\2\x08\0", 113: b"\0" * 14 + b"\x08\0", 276: b"\x08\0" + b"\0" * 18}.get(link, b"")
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        raw = (f if isinstance(f, bytes) else f[0]) if link not in (1, 113, 276) else head + f
        out += struct.pack(order + "IIII", 1700000000 + i, 5, len(raw), len(raw)) + raw
    return out


REQ = b"GET /item/123456?q=1 HTTP/1.1\r\nHost: a\r\nX: 1\r\n\r\n"
RESP = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"


@pytest.fixture()
def folder(tmp_path):
    c, s = ("10.0.0.1", 5000), ("10.0.0.2", 80)
    frames = [tcp(*c, *s, 100, 1, REQ[:20]), tcp(*c, *s, 120, 1, REQ[20:]), tcp(*c, *s, 120, 1, b"other"), tcp(*s, *c, 1, 100 + len(REQ), RESP[:30]), tcp(*s, *c, 31, 0, RESP[30:])]
    (tmp_path / "eth.pcap").write_bytes(capture(frames))
    (tmp_path / "sll.pcap").write_bytes(capture(frames[:2], 113, ">"))
    (tmp_path / "sll2.pcap").write_bytes(capture(frames[:1], 276))
    (tmp_path / "odd.pcap").write_bytes(capture(frames[:1], 147))
    return tmp_path


def test_pcap(spark, folder):
    rows = pcap.read_pcap(spark, str(folder))
    got = {r["capture"]: r["count"] for r in rows.groupBy("capture").count().collect()}
    assert got == {"eth": 5, "sll": 2, "sll2": 1}
    first = rows.where("capture = 'eth' AND frame = 1").first()
    assert (first["src"], first["sport"], first["dst"], first["dport"], first["seq"], first["payload_len"]) == ("10.0.0.1", 5000, "10.0.0.2", 80, 100, 20)
    assert first["ts_us"] == 1700000000_000005 and bytes(first["payload"]) == REQ[:20] and first["eth_src"] == "02:00:00:00:00:02"
    spark.dataSource.register(pcap.PcapSource)
    other = spark.read.format("pcap").load(str(folder))
    key = lambda df: sorted((r["capture"], r["frame"], bytes(r["payload"])) for r in df.select("capture", "frame", "payload").collect())
    assert key(other) == key(rows)


def test_pcapng_is_refused(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"\n\r\r\n" + b"\0" * 40)
    with pytest.raises(Exception, match="editcap"):
        pcap.read_pcap(spark, str(tmp_path)).count()


def test_messages_and_fingerprints(spark, folder):
    got = reassembly.http_messages(pcap.read_pcap(spark, f"{folder}/eth.pcap")).select("kind", "message", http.fingerprint(F.col("message")).alias("sha")).collect()
    assert {r["kind"]: r["message"] for r in got} == {"REQ": REQ.decode(), "RESP": RESP.decode()}
    import hashlib

    want = "GET /item/<ID> HTTP/1.1\nget /item/<ID>?q=1 http/1.1|host|x\n"
    assert next(r["sha"] for r in got if r["kind"] == "REQ") == hashlib.sha256(want.encode()).hexdigest()


def test_requests_of_any_method_and_whole_header_names(spark, tmp_path):
    c, s = ("10.0.0.1", 5000), ("10.0.0.2", 80)
    first = b"CONNECT a:1 HTTP/1.1\r\nContent-Length-Hint: 9\r\n\r\n"
    second = b"PUT /x HTTP/1.1\r\ncontent-length: 3\r\n\r\nabc"
    both = first + second  # pipelined in one segment: the first one's snippet runs into the second
    (tmp_path / "a.pcap").write_bytes(capture([tcp(*c, *s, 1, 1, both[:70]), tcp(*c, *s, 71, 1, both[70:])]))
    rows = pcap.read_pcap(spark, str(tmp_path))
    strict = [(r["n"], r["kind"], r["message"].encode()) for r in reassembly.http_messages(rows, strict=True).orderBy("n").collect()]
    assert strict == [(0, "REQ", first), (1, "REQ", second)]
    loose = [r["message"].encode() for r in reassembly.http_messages(rows).orderBy("n").collect()]
    assert loose == [both[:70], second]


def test_split_captures(spark, tmp_path):
    """Ranges of all sizes give the frames of a whole read, each once, with its number."""
    c, s = ("10.0.0.1", 5000), ("10.0.0.2", 80)
    frames = [tcp(*c, *s, i, 1, bytes([i % 251]) * (i % 90)) for i in range(400)]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    (tmp_path / "b.pcap").write_bytes(capture(frames[:30], order=">")[:-3])  # the last record is cut off
    key = lambda df: sorted(map(tuple, df.select("capture", "frame", "seq", "payload_len").collect()))
    want = key(pcap.read_pcap(spark, str(tmp_path)))
    assert len(want) == 429
    for size in (300, 5_000, 1 << 20):
        assert key(pcap.read_pcap_split(spark, str(tmp_path), size)) == want


def test_reassembly():
    assert reassembly.reassemble([(10, b"ab"), (14, b"ef"), (12, b"cd"), (12, b"XX"), (16, b"")]) == b"abcdef"


def test_prefix_sheets_of_any_layout(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text('AS #,AS Name,AS Prefixes\n1,One,"10.0.0.0/8\n192.0.2.0/24"\n,,\n2,"T, wo",bad\n')
    (tmp_path / "y.csv").write_text('made on Monday\n\nnumber of systems,3\nAS,Owner,Country,CIDR\n3,Three,XX,172.16.5.4/12\n')
    (tmp_path / "z.csv").write_text("name,prefix,as number\nFour,198.51.100.7,4\n")
    got = sorted(tuple(r) for r in tables.read_prefix_sheets(spark, str(tmp_path)).select("asn", "name", "net", "plen").collect())
    assert got == [("1", "One", 10 << 24, 8), ("1", "One", 0xC0000200, 24), ("3", "Three", 0xAC100000, 12), ("4", "Four", 0xC6336407, 32)]
    (tmp_path / "lost.csv").write_text("\n" * 3 + "a,b\n" * 12 + "AS,Owner,CIDR\n")
    with pytest.raises(ValueError, match="lost.csv"):
        tables.read_prefix_sheets(spark, str(tmp_path))


def test_files(spark, tmp_path):
    p = lambda n: f"{tmp_path}/{n}"
    open(p("pool.json"), "w").write('{"delays_seconds": [0.1, 0.25]}')
    assert sorted(r[0] for r in tables.read_pool(spark, p("pool.json")).collect()) == [0.1, 0.25]
    open(p("t.dist"), "w").write("# head 1 2\n 1 -2 x 3.5\n\n4\n")
    assert sorted(r[0] for r in tables.read_dist(spark, p("t.dist")).collect()) == [-2, 1, 3.5, 4]
    open(p("nets"), "w").write("10.1.2.3/8\n\n192.0.2.0/24\nbad\n")
    assert {tuple(r) for r in tables.read_subnets(spark, p("nets"), ["8.8.8.8"]).collect()} == {(10 << 24, 8), (0xC0000200, 24), (0x08080808, 32)}
    open(p("mac"), "w").write("02:AA:00:00:00:01,Acme, Inc.\nnothing\n")
    assert [tuple(r) for r in tables.read_vendors(spark, p("mac")).collect()] == [("02:aa:00:00:00:01", "Acme, Inc.")]
    open(p("lat.csv"), "w").write("5,3,0.25\n7,6,x\n")
    assert [r["delay"] for r in tables.read_latency(spark, p("lat.csv")).collect()] == [0.25, None]
    open(p("pats"), "w").write("http://a.b/x%2Fy\n\n a.b/x/y \n")
    assert [r["pattern"] for r in tables.read_patterns(spark, p("pats")).collect()] == ["a.b/x/y"]
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2)], "v string, n int")
    tables.write_lines(df, "v", p("lines"), one_file=True)
    assert [r[0] for r in spark.read.text(p("lines")).collect()] == ["a", "b"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.write_lines(spark.range(500).selectExpr("lpad(id, 4, '0') AS v"), "v", p("many"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([x for x in os.listdir(p("many")) if x.startswith("part")]) > 1
    assert sorted(map(tuple, tables.numbered_lines(spark, p("many")).collect())) == [(f"{i:04}", i + 1) for i in range(500)]
    tables.write_csv(df, p("q"), quote_all=True, gzip=True)
    assert sorted(map(tuple, tables.read_csv(spark, p("q"), "v string, n int").collect())) == [("a", 2), ("a", 2), ("b", 1)]
    tables.write_tree(df, p("tree"), "v")
    assert sorted(x for x in os.listdir(p("tree")) if "=" in x) == ["v=a", "v=b"]
    tables.write_pool(df.withColumn("n", F.col("n").cast("double")), "n", "v", p("pools"))
    assert spark.read.json(p("pools")).count() == 2
    assert tables.stage(df, p("stage")).count() == 3
    assert tables.stage(df.limit(0), p("stage")).count() == 3
    assert tables.stage(df.limit(1), p("stage"), overwrite=True).count() == 1
    assert tables.read_lines(spark, p("nets")).where("file = 'nets'").count() == 4


@pytest.mark.parametrize("how, want", [("adjacent", {(1, 2), (6, 7)}), ("as_of", {(1, 2), (1, 3), (6, 7)}), ("fifo", {(1, 2), (4, 9)})])
def test_stream_pairs(spark, tmp_path, how, want):
    rows = [("f", 1, "REQ", 10, 0), ("f", 2, "RESP", 0, 10), ("f", 3, "RESP", 0, 10), ("f", 4, "REQ", 20, 0), ("f", 6, "REQ", 30, 0), ("f", 7, "RESP", 0, 19), ("g", 8, "RESP", 0, 5), ("f", 9, "RESP", 0, 30)]
    rows = [r for r in rows if how == "fifo" or r[1] < 9]  # frame 7 doesn't acknowledge frame 4
    rows.append(("end", 10**6, "REQ", 0, 0))  # rows wait for the watermark to pass them
    df = spark.createDataFrame(rows, "flow string, frame long, kind string, seq_end long, ack long").withColumn("ts", (F.lit(1.7e9) + F.col("frame")).cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = pairs.stream_pairs(stream, how).writeStream.format("memory").queryName(f"pairs_{how}").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["req_frame"], r["res_frame"]) for r in spark.table(f"pairs_{how}").collect()} == want


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_package_without_training_data_part(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", *gone, "__pycache__", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_pools_of_several_objects_in_a_file(spark, tmp_path):
    """Parts of a node's pool that Spark writes into one file all come back, and so do objects over several lines beside them."""
    rows = spark.range(1000).select(F.col("id").cast("double").alias("n"), F.lit("a").alias("node"))
    tables.write_pool(rows, "n", "node", f"{tmp_path}/pools", 100)
    tables.write_pool(rows.where("n < 0"), "n", "node", f"{tmp_path}/none", 100)
    folder = tmp_path / "pools" / "node=a"
    (folder / "merged.json").write_text("\n".join('{"delays_seconds": [%d]}' % n for n in range(1000, 1010)))
    (folder / "pretty.json").write_text('{\n  "delays_seconds": [\n    1010,\n    1011\n  ],\n  "from": {"a": 1}\n}\n')
    (folder / "bare.json").write_text('{"delays_seconds": [1012, 1013]}')
    assert sorted(r[0] for r in tables.read_pool(spark, f"{tmp_path}/pools").collect()) == list(range(1014))
    assert tables.read_pool(spark, f"{tmp_path}/none").count() == 0
