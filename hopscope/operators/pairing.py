"""Pairing of requests and responses: adjacent, as-of, FIFO and legacy semantics.

Windows are partitioned by flow and need each flow's rows in order; a flow's rows must fit a sort that may
spill, not memory. FIFO and legacy pairing walk over the sorted rows of a partition as a stream and hold
only what waits in the flow at hand.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .walk import walk


def adjacent_pairs(rows: DataFrame, flow: list[str], order: list[str], is_request: Column, is_response: Column, time: str = "ts_us", frame: str = "frame") -> DataFrame:
    """A response pairs with the row just before it in its flow if that is a request; other rows are left out first."""
    w = Window.partitionBy(*flow).orderBy(*order)
    kept = rows.where(is_request | is_response).withColumn("_req", is_request)
    kept = kept.withColumn("_was", F.lag("_req").over(w)).withColumn("req_frame", F.lag(frame).over(w)).withColumn("req_ts_us", F.lag(time).over(w))
    out = kept.where(~F.col("_req") & F.col("_was"))
    return out.withColumn("res_frame", F.col(frame)).withColumn("delay_s", (F.col(time) - F.col("req_ts_us")) / 1e6).drop("_req", "_was")


def as_of_pairs(rows: DataFrame, flow: list[str], order: list[str], is_request: Column, is_response: Column, time: str = "ts_us", frame: str = "frame") -> DataFrame:
    """Every response pairs with the latest request before it in its flow, which stays in place for the next one."""
    w = Window.partitionBy(*flow).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(is_request, F.col(c)), ignorenulls=True).over(w)
    out = rows.withColumn("req_ts_us", last(time)).withColumn("req_frame", last(frame))
    out = out.where(is_response & ~is_request & F.col("req_ts_us").isNotNull())
    return out.withColumn("res_frame", F.col(frame)).withColumn("delay_s", (F.col(time) - F.col("req_ts_us")) / 1e6)


def fifo_pairs(messages: DataFrame, flow: list[str], carry: list[str] | None = None) -> DataFrame:
    """Responses take the oldest waiting request of their flow if its bytes are acknowledged; else they are dropped.

    ``messages``: flow, frame, ts_us, kind ('REQ' or 'RESP'), seq_end, ack. A request that isn't
    acknowledged yet keeps its place at the head. Columns ``carry`` of both sides come as req_<name> and res_<name>.
    """
    carry = carry or []
    names = ["frame", "ts_us", *carry]
    fields = [StructField(f"{side}_{c}", messages.schema[c].dataType) for side in ("req", "res") for c in names]

    def begin():
        waiting: deque = deque()

        def step(kind, seq_end, ack, *own):
            if kind == "REQ":
                waiting.append((seq_end, own))
            elif waiting and None not in (ack, waiting[0][0]) and waiting[0][0] <= ack:
                return [(*waiting.popleft()[1], *own)]
            return []

        return step

    kept = messages.where(F.col("kind").isin("REQ", "RESP"))
    return walk(kept, flow, ["frame"], ["kind", "seq_end", "ack", *names], fields, begin).withColumn("delay_s", (F.col("res_ts_us") - F.col("req_ts_us")) / 1e6)


def fifo_by_ordinal(messages: DataFrame, flow: list[str]) -> DataFrame:
    """The k-th request of a flow with its k-th response: FIFO where each response follows its acknowledged request."""
    w = Window.partitionBy(*flow, "kind").orderBy("frame")
    n = messages.where(F.col("kind").isin("REQ", "RESP")).withColumn("k", F.row_number().over(w))
    req = n.where("kind = 'REQ'").select(*flow, "k", F.col("frame").alias("req_frame"), F.col("ts_us").alias("req_ts_us"))
    res = n.where("kind = 'RESP'").select(*flow, "k", F.col("frame").alias("res_frame"), F.col("ts_us").alias("res_ts_us"))
    return req.join(res, [*flow, "k"]).withColumn("delay_s", (F.col("res_ts_us") - F.col("req_ts_us")) / 1e6)


def legacy_pairs(messages: DataFrame, flow: list[str]) -> DataFrame:
    """A response takes the flow's first pending (method, uri); asking again for one renews its time but not its place.

    ``messages``: flow, frame, ts_us, kind, method, uri.
    """
    fields = StructType.fromDDL("method string, uri string, req_frame long, res_frame long, delay_s double").fields

    def begin():
        pending: dict[tuple, tuple] = {}

        def step(kind, frame, ts, method, uri):
            if kind == "REQ":
                pending[method, uri] = frame, ts
            elif pending:
                asked = next(iter(pending))
                first, since = pending.pop(asked)
                return [(*asked, first, frame, (ts - since) / 1e6)]
            return []

        return step

    return walk(messages, flow, ["frame"], ["kind", "frame", "ts_us", "method", "uri"], fields, begin)
