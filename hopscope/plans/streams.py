"""Queries whose rows go through a stream: the table is written in slices of time that overlap, and read in micro-batches."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pcap
from ..streaming import pairs
from . import queries as q
from .files import _CAPTURED, _read, round_trip
from .protocols import _LEGACY
from .queries import _ADJ, _MSG, r6

_before = set(q.QUERIES)
SLICES = 4


def _sliced(pkt: DataFrame, path: str) -> tuple[DataFrame, float]:
    """The rows as a stream, and the seconds that they span. Rows of neighbouring slices are mixed, some come twice, and a last row far ahead lets the watermark pass all others."""
    spark = pkt.sparkSession
    rows = pkt.select("flow", "frame", F.timestamp_micros("ts_us").alias("ts"), F.when(F.col("dir") == "C2S", "REQ").otherwise("RESP").alias("kind"), F.when(F.col("latency_s") < 0.06, F.col("latency_s")).alias("value"), F.col("endpoint").alias("method"), (F.col("payload_len") % 5).cast("string").alias("uri"), F.lit(0).cast("long").alias("seq_end"), F.lit(0).cast("long").alias("ack"), "ts_us")
    low, high = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    span = max(1, (high or 0) - (low or 0))
    at = F.floor((F.col("ts_us") - (low or 0)) / span * (SLICES - 1) + (F.col("frame") % 3) * 0.3)  # up to 0.6 of a slice late
    for k in range(SLICES):
        part = rows.where(F.least(at, F.lit(SLICES - 1)) == k)
        part.unionByName(part.where("frame % 7 = 0")).drop("ts_us").write.mode("append").parquet(f"{path}/in")
    last = spark.range(1).select(F.lit(-1).cast("long").alias("flow"), F.lit(1 << 60).alias("frame"), F.timestamp_micros(F.lit((high or 0) + 100 * span)).alias("ts"), F.lit("REQ").alias("kind"), F.lit(None).cast("double").alias("value"), F.lit("").alias("method"), F.lit("").alias("uri"), F.lit(0).cast("long").alias("seq_end"), F.lit(0).cast("long").alias("ack"))
    last.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(last.schema).parquet(f"{path}/in"), span / 1e6


def _streamed(pkt: DataFrame, path: str, how: str) -> DataFrame:
    stream, span = _sliced(pkt, path)
    out = pairs.stream_pairs(stream, how, idle=10 * span, late=span)
    run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    got = pkt.sparkSession.read.schema(pairs.PAIRS).parquet(f"{path}/out")
    return got.select(F.col("flow").cast("bigint").alias("flow"), "req_frame", "res_frame", r6(F.col("delay_s")).alias("delay_s"))


def streamed(name: str, how: str, sql: str) -> None:
    @round_trip(name, sql, "pkt")
    def run(path, pkt):
        return _streamed(pkt, path, how)




def _by_time(sql: str) -> str:
    """The batch query's SQL with its rows in order of (ts_us, frame)."""
    return sql.replace("ORDER BY frame", "ORDER BY ts_us, frame")


streamed("J8_stream_fifo", "fifo", _by_time(f"SELECT flow, rf AS req_frame, f AS res_frame, round((t - rt) / 1e6, 6) AS delay_s FROM (WITH m AS (SELECT flow, frame, ts_us, kind, sum(CASE WHEN kind = 'REQ' THEN 1 ELSE -1 END) OVER (PARTITION BY flow ORDER BY frame) AS s FROM ({_MSG})), d AS (SELECT *, least(0, min(s) OVER (PARTITION BY flow ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS low, coalesce(least(0, min(s) OVER (PARTITION BY flow ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS was FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY flow, kind ORDER BY frame) AS n FROM d WHERE kind = 'REQ' OR low = was) SELECT r.flow AS flow, r.frame AS rf, p.frame AS f, r.ts_us AS rt, p.ts_us AS t FROM k r JOIN k p ON r.flow = p.flow AND r.n = p.n AND r.kind = 'REQ' AND p.kind = 'RESP')"))
streamed("J9_stream_adjacent", "adjacent", _by_time(f"SELECT flow, req_frame, frame AS res_frame, round((ts_us - req_ts) / 1e6, 6) AS delay_s FROM ({_ADJ.replace(' WHERE payload_len > 0', '')})"))
streamed("J10_stream_as_of", "as_of", _by_time(q.ORACLE_SQL["J10_tls_as_of_pairs"].split("\n")[-1]))
streamed("J11_stream_consumed", "consumed", _by_time(q.ORACLE_SQL["J11_stream_pairs"].split("\n")[-1].replace("AS rtt", "AS delay_s")))
streamed("J12_stream_legacy", "legacy", _by_time(f"SELECT flow, p.rf AS req_frame, p.f AS res_frame, round(p.d, 6) AS delay_s FROM (SELECT flow, unnest(s.o) AS p FROM (SELECT flow, {_LEGACY} AS s FROM pkt GROUP BY flow))"))


#: Settings of streams of many short triggers that nothing reads while they run.
SHORT_TRIGGERS = {
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    "spark.sql.streaming.fileSink.log.cleanupDelay": "0",
}


@contextmanager
def short_triggers(spark: SparkSession):
    """Streams that run inside put their offsets, commits and lists of files in place by the file system's own rename, and drop lists that a later one holds.

    Spark's default manager starts processes on a local disk to ask for links and modes, which is a third of a short
    trigger's time, and lists stay for ten minutes, in which each trigger looks through all of them. What the session sets already stays.
    """
    own = spark.conf.getAll
    new = {k: v for k, v in SHORT_TRIGGERS.items() if k not in own}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in new:
            spark.conf.unset(k)


@round_trip("S1_streamed_captures", _CAPTURED, "exchange")
def s1(path, frames):
    """Captures read as a stream, at most 100,000 bytes at a time."""
    spark = frames.sparkSession
    pcap.write_pcap(frames.withColumn("ack", F.greatest("ack", F.lit(0))), f"{path}/in")
    spark.dataSource.register(pcap.PcapSource)
    stream = spark.readStream.format("pcap").option("maxBytesPerTrigger", 100_000).load(f"{path}/in")
    with short_triggers(spark):
        run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").start()
        run.processAllAvailable()
        run.stop()
    return _read(spark.read.parquet(f"{path}/out"))


QUERIES = {k: v for k, v in q.QUERIES.items() if k not in _before}
ORACLE_SQL = {k: v for k, v in q.ORACLE_SQL.items() if k in QUERIES}
