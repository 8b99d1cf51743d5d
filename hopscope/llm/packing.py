"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A bin is filled greedily: the longest waiting piece, then again and again the longest that fits.
Then its smallest piece is replaced by two unpacked ones whose lengths together fit the expanded gap
more tightly, where there are such. Lengths are at most the capacity, so bins are made from the counts
of waiting pieces by length: a bin's pattern is repeated as long as the counts allow, which ends at least
one length. The driver's work is bounded by the capacity, whatever the number of documents; pieces find
their bins by a join of their rank within their length. Ranks are counted within hash buckets of each
length, so a frequent length makes no large group.

Null text counts as empty (only the end id). Every row is packed, repeated and null ids too. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, worker

#: Pieces in a bucket of a length, about.
BUCKET_ROWS = 50_000
#: Characters of text that are tokenised at once; a task takes about 30 times as much beside the cache of pieces.
SLICE = 2 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document's ids: whole, or the remainder first and then full pieces."""

    @worker
    def cut(batches):
        from .tokens import encoder

        enc = encoder(vocabulary)
        for batch in batches:
            for rows in slices(batch, most=SLICE):
                tok, off = enc.encode(rows.column("text"), end_id)
                tok, n = tok.astype("<u4"), np.diff(off)
                pieces = -(-n // capacity)
                first = n - (pieces - 1) * capacity
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                at = off[doc] + start
                crc = [zlib.crc32(tok[a:b]) for a, b in zip(at, at + length, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (times, {length: pieces in each}) that together hold ``counts`` pieces of each length."""
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] = n
    out = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        bin_: dict[int, int] = {}
        gap, size = capacity, top
        while gap and size:
            size = min(size, gap)
            if n := min(left[size], gap // size):
                bin_[size] = n
                left[size] -= n
                gap -= n * size
            size -= 1
        if sum(bin_.values()) > 1:
            least = min(bin_)
            room, best, pair = gap + least, least, None
            low, high = 1, room - 1
            while low <= high:  # lengths low <= high of unpacked pieces with the largest sum within room
                if not left[low]:
                    low += 1
                elif not left[high] or (low == high and left[low] < 2) or low + high > room:
                    high -= 1
                else:
                    if low + high > best:
                        best, pair = low + high, (low, high)
                    low += 1
            if pair:
                bin_[least] -= 1
                left[least] += 1
                for size in pair:
                    bin_[size] = bin_.get(size, 0) + 1
                    left[size] -= 1
                bin_ = {s: n for s, n in bin_.items() if n}
        more = min(left[s] // n for s, n in bin_.items())
        for s, n in bin_.items():
            left[s] -= more * n
        out.append((1 + more, bin_))


def pack(pieces: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """Add sequence_id and offset to ``pieces``; ``counts`` has the pieces of each length."""
    spark = pieces.sparkSession
    entries, base, used = [], 0, {}
    for times, bin_ in patterns(counts, capacity):
        offset = 0
        for size, n in sorted(bin_.items(), reverse=True):
            begin = used.get(size, 0)
            entries.append((size, begin, begin + times * n, n, base, offset))
            used[size] = begin + times * n
            offset += n * size
        base += times
    # at most sqrt(2 * capacity) lengths in a bin and few patterns a length: bounded by the capacity
    slots = spark.createDataFrame(entries, "length long, begin long, until long, each long, base long, first long")
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = rows.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("within", within).join(before.drop("count"), ["length", "bucket"]).withColumn("rank", F.col("within") + F.col("before"))
    hit = (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["begin"]) & (ranked["rank"] < slots["until"])
    at = F.col("rank") - F.col("begin")
    return ranked.join(F.broadcast(slots), hit).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("base") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first") + at % F.col("each") * ranked["length"]).cast("long").alias("offset"),
    )


def best_two_fit(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = Scratch(docs.sparkSession, "packing").cut(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    return pack(pieces, counts, capacity)
