"""Pairing on replayed, shuffled micro-batches against batch pairing; state that shrinks; captures as a stream."""

from __future__ import annotations

import ast
import json
import random
import time
from types import SimpleNamespace

import pytest
from conftest import SF
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from test_sources import capture, tcp

from hopscope import catalog
from hopscope.operators import pairing
from hopscope.plans import streams
from hopscope.sources import pcap
from hopscope.streaming import pairs

SCHEMA = "flow string, frame long, t double, kind string, seq_end long, ack long, value double, method string, uri string"
T0 = 1.7e9


def messages(seed, n=160):
    rng = random.Random(seed)
    rows, sent = [], {}
    for i in range(n):
        flow = f"f{rng.randrange(5)}"
        kind = rng.choice(["REQ", "RESP", "RESP", "NOTE"] if i % 5 else ["REQ"])
        if kind == "REQ":
            sent[flow] = sent.get(flow, 0) + rng.randrange(1, 50)
        end = None if rng.random() < 0.03 else sent.get(flow, 0)
        rows.append((flow, i, T0 + i / 2, kind, end, rng.choice([None, sent.get(flow, 0), sent.get(flow, 0), 3]), rng.choice([None, rng.random()]), rng.choice(["GET", "POST"]), f"/u{rng.randrange(3)}"))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("t").cast("timestamp")).withColumn("ts_us", F.unix_micros("ts"))


def batch(rows, how):
    sides = F.col("kind") == "REQ", F.col("kind") == "RESP"
    if how in ("adjacent", "as_of"):
        return getattr(pairing, f"{how}_pairs")(rows, ["flow"], ["frame"], *sides)
    if how == "consumed":
        kept = rows.where("kind = 'REQ' OR value IS NOT NULL")
        return pairing.adjacent_pairs(kept, ["flow"], ["frame"], *sides).withColumn("delay_s", F.col("value"))
    return {"fifo": pairing.fifo_pairs, "legacy": pairing.legacy_pairs}[how](rows.where("kind IN ('REQ', 'RESP')"), ["flow"])


def run(spark, folder, name, out, **options):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/c-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return q


def files(folder, parts):
    """One file for each part, in order of time."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k < len(parts) - 1:
            time.sleep(1.1)  # files are taken in order of their modification times


def key(rows):
    return sorted((str(r["flow"]), r["req_frame"], r["res_frame"], round(r["delay_s"], 6)) for r in rows.select("flow", "req_frame", "res_frame", "delay_s").collect())


@pytest.mark.parametrize("how", list(pairs.KINDS))
def test_streams_pair_like_batches(spark, tmp_path, how):
    rows = messages(7)
    want = key(batch(table(spark, rows), how))
    assert len(want) > 15
    rng = random.Random(1)
    rows_in = sorted(rows, key=lambda r: r[1] + rng.randrange(60))  # up to 30 seconds out of order
    parts = [rows_in[:60], rows_in[60:110] + rows_in[30:60], rows_in[110:], [("end", 10**6, T0 + 10**6, "REQ", 0, 0, 0.0, "", "")]]  # some come twice
    files(tmp_path, [table(spark, p) for p in parts])
    stream = spark.readStream.schema(table(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = run(spark, tmp_path, f"pairs_{how}", pairs.stream_pairs(stream, how, idle=100, late=40))
    assert key(spark.table(f"pairs_{how}")) == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) > 10 and held[-1] <= 2  # only the last flow, which is not idle yet, is left


def test_rows_beyond_the_lateness_are_left_out(spark, tmp_path):
    parts = [[("f", 1, T0, "REQ")], [("f", 9, T0 + 500, "REQ")], [("f", 10, T0 + 501, "RESP")], [("f", 2, T0 + 1, "RESP")], [("end", 99, T0 + 5000, "REQ")]]
    files(tmp_path, [table(spark, [(*r, 0, 0, 0.0, "", "") for r in p]) for p in parts])
    stream = spark.readStream.schema(table(spark, messages(1, 5)).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(spark, tmp_path, "late", pairs.stream_pairs(stream, "as_of", idle=10_000, late=50))
    assert key(spark.table("late")) == [("f", 9, 10, 1.0)]


def test_idle_flows_are_forgotten(spark, tmp_path):
    """A response that comes long after its request finds nothing."""
    parts = [[("f", 1, T0, "REQ"), ("g", 2, T0, "REQ")], [("g", 3, T0 + 5, "RESP"), ("x", 4, T0 + 400, "REQ")], [("x", 5, T0 + 600, "REQ")], [("f", 6, T0 + 700, "RESP")], [("end", 99, T0 + 5000, "REQ")]]
    files(tmp_path, [table(spark, [(*r, 0, 0, 0.0, "", "") for r in p]) for p in parts])
    stream = spark.readStream.schema(table(spark, messages(1, 5)).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(spark, tmp_path, "idle", pairs.stream_pairs(stream, "as_of", idle=100, late=20))
    assert key(spark.table("idle")) == [("g", 2, 3, 5.0)]


class Counted:
    """State of one flow that counts the calls to it."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def __getattr__(self, name):
        if not name.startswith("get"):  # registerTimer
            return lambda *_: self.called()
        return lambda of, *_: CountedState(self, of)

    def called(self):
        self.calls += 1


class CountedState:
    def __init__(self, handle, of):
        self.handle, self.of, self.kept = handle, of, handle.kept.setdefault(of, [])

    def __getattr__(self, name):
        self.handle.called()
        change = {"appendValue": self.kept.append, "put": lambda rows: self.kept.__setitem__(slice(None), rows), "update": lambda row: self.kept.__setitem__(slice(None), [row]), "clear": self.kept.clear}
        if name == "get":
            return lambda: list(self.kept) if self.of in ("held", "waiting") else (self.kept or [None])[0]
        return change[name]


@pytest.mark.parametrize("how", ["fifo", "as_of", "consumed"])
def test_what_is_forgotten_at_once_is_not_written_first(how):
    """A flow that is idle by the time that its rows are taken up costs six calls to the state in all."""
    flow, processor = Counted(), pairs.Pairing(how, 1000, 0)
    processor.init(flow)
    extra = {"fifo": ["9", "9"], "as_of": [], "consumed": ["0.5"]}[how]
    rows = [Row(us=us, row=json.dumps([str(us), str(i), kind, *extra])) for i, (us, kind) in enumerate([(5, "REQ"), (7, "RESP"), (9, "REQ")])]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9)
    assert list(processor.handleInputRows(("f",), iter(rows), now)) == []
    got = list(processor.handleExpiredTimer(("f",), now, None))
    assert got == [Row(flow="f", req_frame=0, res_frame=1, delay_s=0.5 if how == "consumed" else 2e-6)]
    assert flow.calls <= 6 and not any(flow.kept.values())


@pytest.mark.parametrize("ttl, want", [(600, [("f", 1, 2, 3.0), ("f", 3, 4, 1.0)]), (1, [])])
def test_state_with_a_time_to_live(spark, tmp_path, ttl, want):
    """In processing time rows pair across micro-batches, until what is remembered expires."""
    parts = [[("f", 1, T0, "REQ", 5)], [("f", 2, T0 + 3, "RESP", 0), ("f", 3, T0 + 4, "REQ", 9)], [("f", 4, T0 + 5, "RESP", 0)]]
    no_data = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(no_data, "false")  # else a query with timers of processing time never ends by itself
    for part in parts:
        rows = table(spark, [(*r, 99, 0.0, "", "") for r in part])
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        q = pairs.stream_pairs(stream, "fifo", ttl=ttl).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        ended = q.awaitTermination(40)
        q.stop()
        assert ended
        time.sleep(2.5 if ttl == 1 else 0)
    spark.conf.unset(no_data)
    assert key(spark.read.schema(pairs.PAIRS).parquet(f"{tmp_path}/out")) == want


def test_windows_leave_late_rows_out(spark, tmp_path):
    t0 = 1_699_999_980  # a whole minute
    parts = [[(1, 1), (2, 40)], [(3, 1000)], [(4, 1010)], [(5, 20), (6, 980)], [(7, 9000)]]  # frame 5 is too late
    frame = lambda p: spark.createDataFrame([(i, float(t0 + t), "REQ") for i, t in p], "frame long, t double, kind string").withColumn("ts", F.col("t").cast("timestamp"))
    files(tmp_path, [frame(p) for p in parts])
    stream = spark.readStream.schema(frame(parts[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(spark, tmp_path, "windows", pairs.windowed_counts(stream, "1 minute", "1 minute"))
    assert {int(r["start"].timestamp()) - t0: r["n"] for r in spark.table("windows").collect()} == {0: 2, 960: 3}


# Captures as a stream.
def test_captures_stream_and_go_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(pcap.PcapSource)
    c, s = ("10.0.0.1", 5000), ("10.0.0.2", 80)
    frames = [tcp(*c, *s, i, 1, bytes([i % 251]) * (i % 90)) for i in range(300)]
    folder = tmp_path / "in"
    folder.mkdir()
    whole = capture(frames)
    (folder / "a.pcap").write_bytes(whole[: len(whole) // 2])  # ends inside a record
    batches = []

    def start():
        rows = spark.readStream.format("pcap").option("maxBytesPerTrigger", 3000).load(str(folder))
        out = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="0 seconds").start()
        out.processAllAvailable()
        batches.extend(p["numInputRows"] for p in out.recentProgress)
        return out

    q = start()
    q.stop()
    (folder / "a.pcap").write_bytes(whole)  # it has grown
    (folder / "b.pcap").write_bytes(capture(frames[:50], order=">"))
    q = start()
    q.stop()
    q = start()  # nothing new
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").select("capture", "frame", "seq").collect()
    assert sorted(tuple(r) for r in got) == [("a", i + 1, i) for i in range(300)] + [("b", i + 1, i) for i in range(50)]
    assert len([n for n in batches if n]) > 8 and max(batches) < 120  # many small triggers


def test_pieces_of_a_capture_are_numbered_through_in_a_stream(spark, tmp_path):
    """Frames of a capture's later pieces go on behind the earlier ones' numbers, over restarts too; a piece that grows late goes on behind all."""
    spark.dataSource.register(pcap.PcapSource)
    frames = [tcp("10.0.0.1", 5000, "10.0.0.2", 80, i, 1, b"x" * 50) for i in range(100)]
    folder = tmp_path / "in"
    folder.mkdir()

    def read():
        out = spark.readStream.format("pcap").option("maxBytesPerTrigger", 1500).load(str(folder)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        out.processAllAvailable()
        out.stop()

    (folder / "a.pcap").write_bytes(capture(frames[:30]))
    (folder / "a~00001.pcap").write_bytes(capture(frames[30:60]))
    (folder / "b.pcap").write_bytes(capture(frames[:3]))
    read()
    (folder / "a~00002.pcap").write_bytes(capture(frames[60:90]))
    read()
    (folder / "a~00001.pcap").write_bytes(capture(frames[30:60] + frames[90:]))
    read()
    got = spark.read.parquet(f"{tmp_path}/out").select("capture", "frame", "seq").collect()
    assert sorted(tuple(r) for r in got) == [("a", i + 1, i) for i in range(100)] + [("b", i + 1, i) for i in range(3)]


def test_triggers_of_the_streamed_captures_stay_small_and_leave_the_session_as_it_was(spark, monkeypatch):
    """Each trigger takes 100,000 bytes and the record that begins in them; its checkpoints go by rename."""
    key, runs, start = "spark.sql.streaming.checkpointFileManagerClass", [], DataStreamWriter.start

    def started(self, *args, **options):
        runs.append((spark.conf.get(key, None), start(self, *args, **options)))
        return runs[-1][1]

    monkeypatch.setattr(DataStreamWriter, "start", started)
    assert catalog.QUERIES["S1_streamed_captures"](spark, SF).count() == 1000
    (manager, run), = runs
    assert manager and manager.endswith("FileSystemBasedCheckpointFileManager") and spark.conf.get(key, None) is None
    ends = [ast.literal_eval(p["sources"][0]["endOffset"]) for p in run.recentProgress if p["numInputRows"]]
    taken = [sum(f["byte"] for f in end.values()) - 24 * len(end) for end in ends]
    assert len(taken) > 1 and max(b - a for a, b in zip([0, *taken], taken, strict=False)) < 100_400


def test_a_manager_of_checkpoints_that_the_session_names_stays(spark):
    key, own = "spark.sql.streaming.checkpointFileManagerClass", "org.apache.spark.sql.execution.streaming.checkpointing.FileContextBasedCheckpointFileManager"
    spark.conf.set(key, own)
    try:
        with streams.short_triggers(spark):
            assert spark.conf.get(key) == own
        assert spark.conf.get(key) == own
    finally:
        spark.conf.unset(key)
    before = dict(spark.conf.getAll)
    with pytest.raises(ZeroDivisionError), streams.short_triggers(spark):
        assert dict(spark.conf.getAll) == before | streams.SHORT_TRIGGERS
        1 / 0  # noqa: B018
    assert dict(spark.conf.getAll) == before


def test_a_batch_over_several_runs_of_a_piece():
    """A piece's bytes that follow other pieces' in number are read as ranges of their own."""
    reader = pcap._StreamReader("/x", 100)
    end = {"/x/a.pcap": {"byte": 500, "frame": 12, "runs": [[24, 0], [300, 9]]}, "/x/a~00001.pcap": {"byte": 100, "frame": 9, "runs": [[24, 6]]}}
    parts = lambda start: [p.value[2:] for p in reader.partitions(start, end)]
    assert parts({}) == [(24, 300, 0), (300, 500, 9), (24, 100, 6)]
    assert parts({"/x/a.pcap": {"byte": 200, "frame": 4, "runs": [[24, 0]]}}) == [(200, 300, 4), (300, 500, 9), (24, 100, 6)]
    assert parts({"/x/a.pcap": {"byte": 400, "frame": 11, "runs": [[24, 0], [300, 9]]}, "/x/a~00001.pcap": end["/x/a~00001.pcap"]}) == [(400, 500, 11)]


def test_rows_that_wait_are_held_together(spark, tmp_path):
    """A micro-batch's rows of a flow are one entry of its state, whatever their number."""
    rows = [("f", i, T0 + i, "REQ" if i % 2 else "RESP", 0, 0, 0.5, None, "ü\"") for i in range(400)]
    files(tmp_path, [table(spark, rows), table(spark, [("end", 999, T0 + 10**5, "REQ", 0, 0, 0.0, "", "")])])
    stream = spark.readStream.schema(table(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = run(spark, tmp_path, "held", pairs.stream_pairs(stream, "legacy", idle=100, late=20))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 12
    assert key(spark.table("held")) == [("f", i, i + 1, 1.0) for i in sorted(range(1, 398, 2))]
