"""Record boundaries, the sink's two phases and bounded reassembly, on captures made by hand."""

from __future__ import annotations

import json
import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F
from test_sources import REQ, RESP, capture, tcp

from hopscope.sources import boundaries, pcap, reassembly

C, S = ("10.0.0.1", 5000), ("10.0.0.2", 80)


def rows_of(df):
    return sorted(map(tuple, df.select("capture", "frame", "ts_us", "seq", "payload_len", "payload").collect()))


def raw(frames, sec=1_700_000_000, order="<", magic=0xA1B2C3D4, sub=5):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        whole = b"\x02\0\0\0\0\1\x02\0\0\0\0\2\x08\0" + f
        out += struct.pack(order + "IIII", sec + i, sub, len(whole), len(whole)) + whole
    return out


def test_a_capture_inside_a_payload_misleads_no_range(spark, tmp_path):
    """Ranges that begin inside an embedded capture find its records first; their neighbours tell."""
    inner = raw([tcp(*C, *S, i, 1, b"x" * 20) for i in range(400)])
    frames = [tcp(*C, *S, i, 1, inner[:60_000] if i % 3 == 1 else b"y" * i) for i in range(12)]
    data = raw(frames)
    (tmp_path / "nest.pcap").write_bytes(data)
    with open(tmp_path / "nest.pcap", "rb") as f:
        layout = boundaries.Layout(f.read(24), "nest")
        begun = [at for at in range(24, len(data), 7_001) if boundaries.Finder(f, layout, len(data)).first(at) not in boundaries_of(data)]
    assert begun  # by itself a range is misled
    want = rows_of(pcap.read_pcap(spark, str(tmp_path)))
    assert len(want) == 12
    for size in (7_001, 20_000, 61_000):
        assert rows_of(pcap.read_pcap_split(spark, str(tmp_path), size)) == want


def boundaries_of(data):
    out, at = set(), 24
    while at + 16 <= len(data):
        out.add(at)
        at += 16 + struct.unpack_from("<I", data, at + 8)[0]
    return out | {len(data)}


@pytest.mark.parametrize("order, magic, sub, cut", [("<", 0xA1B2C3D4, 999_999, 0), (">", 0xA1B2C3D4, 0, 5), ("<", 0xA1B23C4D, 999_999_999, 30), (">", 0xA1B23C4D, 7, 1)])
def test_ranges_of_any_byte_order_and_unit(spark, tmp_path, order, magic, sub, cut):
    rng = random.Random(3)
    data = raw([tcp(*C, *S, i, 1, rng.randbytes(rng.randrange(300))) for i in range(300)], order=order, magic=magic, sub=sub)
    (tmp_path / "a.pcap").write_bytes(data[: len(data) - cut])
    want = rows_of(pcap.read_pcap(spark, str(tmp_path)))
    assert len(want) == 300 - (cut > 0)
    for size in (301, 4_096, 1 << 20):
        assert rows_of(pcap.read_pcap_split(spark, str(tmp_path), size)) == want


def test_times_that_leap_are_found_by_the_neighbours(spark, tmp_path):
    frames = [tcp(*C, *S, i, 1, b"z" * 40) for i in range(60)]
    data = raw(frames[:20]) + raw(frames[20:], sec=900_000_000)[24:]  # decades earlier: no plausible header
    (tmp_path / "a.pcap").write_bytes(data)
    want = rows_of(pcap.read_pcap(spark, str(tmp_path)))
    assert len(want) == 60 and rows_of(pcap.read_pcap_split(spark, str(tmp_path), 900)) == want


def test_no_range_reads_much_more_than_itself(tmp_path, monkeypatch):
    """A range's search reads its own bytes and no file from its start."""
    data = raw([tcp(*C, *S, i, 1, bytes(1400)) for i in range(8_000)])
    path = str(tmp_path / "a.pcap")
    open(path, "wb").write(data)
    seen = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            out = self.f.read(n)
            seen.append(len(out))
            return out

    monkeypatch.setattr(boundaries, "open_file", lambda uri: Counting(open(uri, "rb")))
    step = 3 << 20
    stops = []
    for at in range(0, len(data), step):
        seen.clear()
        stops.append(boundaries.found(path, at, min(at + step, len(data)), len(data)))
        assert sum(seen) < step + 5 * boundaries.WINDOW
    assert all(a[1] == b[0] for a, b in zip(stops, stops[1:], strict=False)) and sum(n for *_, n in stops) == 8_000


# The sink.
def frames_of(spark, n=500):
    return spark.range(n).select(
        F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("capture"), F.col("id").alias("frame"), (F.col("id") * 1000).alias("ts_us"), F.lit(2048).alias("ethertype"), F.lit("10.0.0.1").alias("src"), F.lit("10.0.0.2").alias("dst"),
        F.lit(6).alias("ip_proto"), F.lit(1).alias("sport"), F.lit(80).alias("dport"), F.col("id").alias("seq"), F.lit(0).alias("ack"), F.encode(F.repeat(F.lit("p"), (F.col("id") % 60).cast("int")), "UTF-8").alias("payload"),
    )


def test_pieces_are_numbered_through(spark, tmp_path):
    frames, out = frames_of(spark), f"{tmp_path}/out"
    pcap.write_pcap(frames, out, roll_bytes=3_000)
    names = sorted(os.listdir(out))
    assert len([n for n in names if n.startswith("c0")]) > 3 and "c0.pcap" in names and "c0~00001.pcap" in names and all(n.endswith(".pcap") for n in names)
    got = pcap.read_pcap_split(spark, out, 1_000).select("capture", "frame", "seq").collect()
    assert sorted(map(tuple, got)) == sorted((f"c{i % 2}", i // 2 + 1, i) for i in range(500))
    pcap.write_pcap(frames.where("frame < 10"), out, mode="append")
    assert pcap.read_pcap_split(spark, out).where("capture = 'c0'").agg(F.max("frame"), F.count("*")).first() == (255, 255)
    pcap.write_pcap(frames.where("frame < 10"), out)
    assert sorted(os.listdir(out)) == ["c0.pcap", "c1.pcap"]
    pcap.index_captures(spark, out, 300)
    spark.dataSource.register(pcap.PcapSource)
    read = spark.read.format("pcap").load(out)
    assert read.rdd.getNumPartitions() > 2 and read.count() == 10


def test_a_failed_write_leaves_the_folder_as_it_was(spark, tmp_path):
    out = f"{tmp_path}/out"
    pcap.write_pcap(frames_of(spark, 20), out)
    before = {n: open(f"{out}/{n}", "rb").read() for n in os.listdir(out)}
    bad = frames_of(spark, 400).withColumn("src", F.when(F.col("frame") == 399, "not an address").otherwise(F.col("src")))
    with pytest.raises(Exception, match="invalid literal|Python|address"):
        pcap.write_pcap(bad, out)
    assert {n: open(f"{out}/{n}", "rb").read() for n in os.listdir(out)} == before


def test_repeated_tasks_and_interrupted_commits(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = frames_of(spark, 30).select(*[(F.col(c) if c in frames_of(spark, 1).columns else F.lit(None)).alias(c) for c in ("capture", "frame", *pcap.RECORD)]).where("capture = 'c0'").toArrow().to_batches()
    writer = pcap._Writer(out, pcap.ETHERNET, 1 << 20, False)
    writer.write(iter(batch))  # a task that was lost
    message = writer.write(iter(batch))
    real = pcap._carry_out
    try:
        pcap._carry_out = lambda *x: (_ for _ in ()).throw(KeyboardInterrupt)  # the driver dies after the journal
        with pytest.raises(KeyboardInterrupt):
            writer.commit([message, None])
    finally:
        pcap._carry_out = real
    assert not [n for n in os.listdir(out) if n.endswith(".pcap")]
    assert pcap.finish_writes(out) == 1 and sorted(os.listdir(out)) == ["c0.pcap"]
    assert pcap.finish_writes(out) == 0
    assert pcap.read_pcap_split(spark, out).count() == 15
    again = pcap._Writer(out, pcap.ETHERNET, 1 << 20, True)
    message = again.write(iter(batch))
    again.abort([message])
    assert sorted(os.listdir(out)) == ["c0.pcap"]
    half = {"job": "x", "remove": [], "moves": [["gone.pcap", "c0.pcap"]]}  # a journal that was carried out but not taken away
    (tmp_path / "out" / ".journal-x.json").write_text(json.dumps(half))
    assert pcap.finish_writes(out) == 1 and sorted(os.listdir(out)) == ["c0.pcap"]


# Reassembly.
def test_a_foreign_flow_takes_constant_memory_and_linear_time():
    """A quarter of a gigabyte without any header's end."""
    part, framer = bytes(range(32, 96)) * 22, reassembly.Framer(limit=1 << 20)
    flow, seconds = reassembly.Reassembly(1 << 20), []
    for quarter in range(4):
        t = time.process_time()
        for i in range(50_000):
            for _, data, gap in flow.push((quarter * 50_000 + i) * len(part), part):
                assert not gap and framer.feed(data) == []
            assert len(framer.data) <= 1 << 20
        seconds.append(time.process_time() - t)
    assert framer.dropped == flow.passed - len(framer.data) and max(seconds) < 4 * min(seconds) + 0.5
    assert framer.feed(b"\r\n\r\n" + REQ) == [("REQ", REQ.decode())]  # what comes after is found


def test_bodies_beyond_the_limit(spark):
    head = b"HTTP/1.1 200 OK\r\nContent-Length: 100000\r\n\r\n"
    for strict, size in ((False, reassembly.SNIPPET), (True, 4_096)):
        framer, out = reassembly.Framer(strict, limit=4_096), []
        stream = head + b"b" * 100_000 + RESP + REQ
        for at in range(0, len(stream), 700):
            out += framer.feed(stream[at : at + 700])
            assert len(framer.data) <= len(head) + 4_096 + 1_400
        assert [k for k, _ in out] == ["RESP", "RESP", "REQ"] and len(out[0][1]) == len(head) + size
        assert out[1][1].startswith(RESP.decode()) and out[2][1] == REQ.decode()


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_messages_do_not_depend_on_segments(size):
    stream = REQ + b"noise\r\n\r\n" + RESP + REQ + b"PUT /x HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc"
    framer = reassembly.Framer(strict=True)
    out = [m for at in range(0, len(stream), size) for m in framer.feed(stream[at : at + size])]
    assert out == [("REQ", REQ.decode()), ("RESP", RESP.decode()), ("REQ", REQ.decode()), ("REQ", "PUT /x HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc")]


def test_gaps_are_skipped_and_counted(spark):
    part = lambda i, seq, data, ts=None: ("a", *C, *S, i, 6, seq, i * 1_000_000 if ts is None else ts, data)
    schema = "capture string, src string, sport int, dst string, dport int, frame long, ip_proto int, seq long, ts_us long, payload binary"
    lost = [part(0, 100, REQ), part(1, 100 + len(REQ) + 9, REQ), part(2, 100 + 2 * len(REQ) + 9, REQ), part(3, 50, b"late")]
    rows = spark.createDataFrame(lost, schema)
    assert reassembly.http_messages(rows).count() == 1  # without a timeout what is missing is waited for
    got = reassembly.http_messages(rows, gap_s=1.5).orderBy("n").collect()
    assert [(r["n"], r["frame"]) for r in got] == [(0, 0), (1, 3), (2, 3)]
    report = reassembly.flow_report(rows, gap_s=1.5).first()
    assert (report["segments"], report["passed"], report["late"], report["gaps"], report["lost"], report["waiting"], report["messages"]) == (4, 3 * len(REQ), 4, 1, 9, 0, 3)
    tight = reassembly.flow_report(rows, limit=len(REQ) + 1).first()
    assert (tight["gaps"], tight["lost"], tight["messages"]) == (1, 9, 3)
    offsets = [(r["at"], bytes(r["data"])) for r in reassembly.streams(rows, gap_s=1.5).orderBy("at").collect()]
    assert offsets == [(0, REQ), (len(REQ) + 9, REQ * 2)]
    whole = reassembly.reassembled(rows).first()
    assert (whole["segments"], whole["size"], bytes(whole["data"])) == (1, len(REQ), REQ)
    assert reassembly.reassembled(rows, most=3).first()["data"] is None


@pytest.mark.parametrize("link", [pcap.ETHERNET, pcap.SLL, pcap.SLL2])
def test_addresses_and_ports_that_a_header_cannot_hold_come_back(spark, tmp_path, link):
    """Octets beyond 255 and ports beyond 65,535, as numbered test traffic has; others are written as ever."""
    rows = [("a", 1, "10.79.351.255", 109_999, "172.18.3.6", 80, 6, b"GET"), ("a", 2, "10.79.1.2", 65_535, "65535.0.0.256", 53, 17, b"x"), ("a", 3, "172.18.3.6", 80, "10.79.351.255", 1 << 30, 6, b""), ("a", 4, "10.0.0.1", 443, "10.0.0.255", 5000, 6, b"y")]
    frames = spark.createDataFrame(rows, "capture string, frame long, src string, sport int, dst string, dport int, ip_proto int, payload binary").withColumns({"ethertype": F.lit(2048), "ts_us": F.lit(1_700_000_000_000_000), "seq": F.lit(7), "ack": F.lit(9)})
    pcap.write_pcap(frames, str(tmp_path), link)
    got = pcap.read_pcap_split(spark, str(tmp_path), 60).select("capture", "frame", "src", "sport", "dst", "dport", "ip_proto", "payload").collect()
    assert sorted((*r[:7], bytes(r[7])) for r in got) == rows
    data = (tmp_path / "a.pcap").read_bytes()
    assert len(data) == 24 + 4 * (16 + {pcap.ETHERNET: 14, pcap.SLL: 16, pcap.SLL2: 20}[link] + 20) + 3 * (28 + 20) - 12 + 20 + 5  # only the first three have an option


def test_octets_beyond_16_bits_come_back(spark, tmp_path):
    rows = [("a", 1, "10.79.8388607.255", 2_147_483_647, "172.18.3.6", 80, b"GET"), ("a", 2, "172.18.3.6", 80, "10.79.65536.1", 70_000, b"")]
    frames = spark.createDataFrame(rows, "capture string, frame long, src string, sport int, dst string, dport int, payload binary").withColumns({"ethertype": F.lit(2048), "ip_proto": F.lit(6), "ts_us": F.lit(1_700_000_000_000_000), "seq": F.lit(7), "ack": F.lit(9)})
    pcap.write_pcap(frames, str(tmp_path))
    got = pcap.read_pcap_split(spark, str(tmp_path), 60).select("capture", "frame", "src", "sport", "dst", "dport", "payload").collect()
    assert sorted((*r[:6], bytes(r[6])) for r in got) == rows


def test_ranges_of_a_capture_of_many_years_are_found_at_once(spark, tmp_path):
    """Times far from the first record's don't leave the ranges to be walked one after another."""
    frames = [tcp(*C, *S, i, 1, b"a=b" * 20) for i in range(900)]
    data = raw(frames[:450]) + raw(frames[450:], sec=1_900_000_000)[24:]
    (tmp_path / "a.pcap").write_bytes(data)
    with open(tmp_path / "a.pcap", "rb") as f:
        finder = boundaries.Finder(f, boundaries.Layout(f.read(24), "a"), len(data))
        assert all(finder.first(at) in boundaries_of(data) for at in range(24, len(data), 1_001))
    assert rows_of(pcap.read_pcap_split(spark, str(tmp_path), 1_001)) == rows_of(pcap.read_pcap(spark, str(tmp_path)))


def test_many_short_ranges_share_tasks(spark, tmp_path):
    """As many tasks as bytes need, not one for each of a thousand ranges."""
    frames = spark.range(1, 2001).select(F.lit("a").alias("capture"), F.col("id").alias("frame"), F.lit(2048).alias("ethertype"), F.lit(6).alias("ip_proto"), F.lit("10.0.0.1").alias("src"), F.lit("10.0.0.2").alias("dst"), F.lit(1).alias("sport"), F.lit(2).alias("dport"), F.col("id").alias("seq"), F.lit(0).alias("ack"), F.lit(1_700_000_000_000_000).alias("ts_us"), F.lit(b"abc").alias("payload"))
    pcap.write_pcap(frames, str(tmp_path), roll_bytes=1000)
    rows = pcap.read_pcap_split(spark, str(tmp_path), 500)
    assert rows.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert [r[0] for r in rows.orderBy("frame").select("frame").collect()] == list(range(1, 2001))
    pcap.index_captures(spark, str(tmp_path), 500)
    rows = spark.read.format("pcap").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() < 100 and rows.agg(F.sum("frame")).first()[0] == 2001 * 1000
