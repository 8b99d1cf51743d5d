"""TCP reassembly into streams and HTTP messages, in bounded memory for each flow.

A directed flow's bytes are contiguous from its first segment on; of segments that begin at the same byte the first
wins, and one that begins before what has been passed on is late and never counts. What waits for a missing
segment, and what waits for the end of a header, is at most ``LIMIT`` bytes a flow: beyond that the gap is
skipped, and the oldest bytes without a header's end are dropped. Both are counted (``flow_report``). A header
is searched for from where the last search ended, so work is linear in the flow's bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.http import SNIPPET
from ..operators.walk import walk

#: Fixed value: bytes of a flow that are kept at most.
LIMIT = 5_000_000
FLOW = ["capture", "src", "sport", "dst", "dport"]


class Reassembly:
    """Puts a flow's segments in order. ``gap_us``: how long a missing segment is waited for, by the segments' times; None: until ``limit`` bytes wait."""

    def __init__(self, limit: int = LIMIT, gap_us: int | None = None):
        self.limit, self.gap_us = limit, gap_us
        self.first = self.at = self.since = None
        self.held: dict[int, bytes] = {}
        self.waiting = self.gaps = self.lost = self.late = self.passed = 0

    def push(self, seq: int, payload: bytes, ts: int | None = None) -> list[tuple[int, bytes, bool]]:
        """What follows on now: (offset in the flow, bytes, whether bytes before it are lost)."""
        if self.at is None:
            self.first = self.at = seq
        out: list[tuple[int, bytes, bool]] = []
        if payload and seq < self.at:
            self.late += len(payload)
        elif payload and seq not in self.held:
            self.held[seq] = payload
            self.waiting += len(payload)
            if self.since is None:
                self.since = ts
        self._drain(out, False)
        while self.held and (self.waiting > self.limit or self._waited(ts)):
            after = min(self.held)
            if after < self.at:  # covered by longer segments since
                self.late += len(self.held[after])
                self.waiting -= len(self.held.pop(after))
                continue
            self.gaps, self.lost, self.at = self.gaps + 1, self.lost + after - self.at, after
            self._drain(out, True)
            self.since = ts
        if not self.held:
            self.since = None
        return out

    def _waited(self, ts: int | None) -> bool:
        return self.gap_us is not None and ts is not None and self.since is not None and ts - self.since > self.gap_us

    def _drain(self, out: list, gap: bool) -> None:
        while (part := self.held.pop(self.at, None)) is not None:
            out.append((self.at - self.first, part, gap))
            self.waiting -= len(part)
            self.passed += len(part)
            self.at += len(part)
            gap = False


class Framer:
    """Cuts a stream into HTTP messages: (kind, text).

    A message is complete when its headers and as many bytes as Content-Length says are there; any upper-case word and a
    blank begin a request. Its text is the headers and at most ``SNIPPET`` bytes of what has arrived after them by then, which may run into the
    next message; ``strict``: the body and no more. A body is only kept as far as the text and the limit need it.
    """

    def __init__(self, strict: bool = False, limit: int = LIMIT):
        self.strict, self.limit = strict, limit
        self.data, self.searched, self.dropped = bytearray(), 0, 0
        self.head: tuple[str | None, int, int] | None = None  # kind, end of the headers, body bytes that are still to come

    def lose(self) -> None:
        """Bytes are missing here: what has begun can't be completed."""
        self.dropped += len(self.data)
        self.data, self.searched, self.head = bytearray(), 0, None

    def feed(self, part: bytes) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        while True:
            if self.head is None:
                self.data += part
                part = b""
                if not self._header():
                    return out
            kind, end, left = self.head
            got = len(self.data) - end
            if left > got + len(part):  # not there yet; what is kept of a body counts as there
                keep = max(0, end + (self.limit if self.strict else SNIPPET) - len(self.data))
                self.data += part[:keep]
                self.head = kind, end, left - len(part[keep:])
                return out
            self.data += part
            part = b""
            if kind:
                out.append((kind, self.data[: end + (min(left, self.limit) if self.strict else SNIPPET)].decode("latin-1")))
            del self.data[: end + left]
            self.searched, self.head = 0, None

    def _header(self) -> bool:
        at = self.data.find(b"\r\n\r\n", self.searched)
        if at < 0:
            if (over := len(self.data) - self.limit) > 0:
                del self.data[:over]
                self.dropped += over
            self.searched = max(0, len(self.data) - 3)
            return False
        start, *lines = self.data[:at].decode("latin-1").split("\r\n")
        headers = {n.strip().lower(): v for n, colon, v in (x.partition(":") for x in lines) if colon}
        digits = "".join(c for c in headers.get("content-length", "") if c.isascii() and c.isdigit())
        line = start.strip()
        kind = "RESP" if line.startswith("HTTP/") else "REQ" if re.match("[A-Z]+ ", line) else None
        self.head = kind, at + 4, int(digits[:18] or 0)
        return True


def _segments(frames: DataFrame) -> DataFrame:
    return frames.where((F.col("ip_proto") == 6) & (F.octet_length("payload") > 0))


def _columns(gap_s: float | None) -> tuple[list[str], int | None]:
    return ["frame", "seq", "payload", *(["ts_us"] if gap_s is not None else [])], None if gap_s is None else round(gap_s * 1e6)


def reassemble(segments: list[tuple[int, bytes]]) -> bytes:
    """The contiguous bytes of segments in order of arrival."""
    flow = Reassembly()
    return b"".join(part for seq, payload in segments for _, part, _ in flow.push(seq, payload))


def streams(frames: DataFrame, limit: int = LIMIT, gap_s: float | None = None) -> DataFrame:
    """The bytes of directed flows as they become contiguous: capture, src, sport, dst, dport, frame, at (offset in the flow), data.

    Offsets count lost bytes too. ``gap_s``: seconds that a missing segment is waited for; it takes column ts_us.
    """
    columns, gap_us = _columns(gap_s)

    def begin():
        flow = Reassembly(limit, gap_us)

        def step(frame, seq, payload, ts=None):
            out: list[tuple[int, int, list[bytes]]] = []
            for at, part, _ in flow.push(seq, payload, ts):
                if out and out[-1][1] + sum(map(len, out[-1][2])) == at:
                    out[-1][2].append(part)
                else:
                    out.append((frame, at, [part]))
            return [(f, at, b"".join(parts)) for f, at, parts in out]

        return step

    return walk(_segments(frames), FLOW, ["frame"], columns, StructType.fromDDL("frame long, at long, data binary").fields, begin)


def reassembled(frames: DataFrame, most: int = 256 << 20) -> DataFrame:
    """Whole flows in a row each: capture, src, sport, dst, dport, segments (that added bytes), size, data; null data where there are more than ``most`` bytes (``streams`` has them)."""
    parts = F.array_sort(F.collect_list(F.when(F.col("at") < most, F.struct("at", "data"))))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    got = streams(frames).groupBy(*FLOW).agg(F.count("*").alias("segments"), F.sum(F.octet_length("data")).alias("size"), parts.alias("parts"))
    return got.select(*FLOW, "segments", "size", F.when(F.col("size") <= most, whole).alias("data"))


def http_messages(frames: DataFrame, strict: bool = False, limit: int = LIMIT, gap_s: float | None = None) -> DataFrame:
    """HTTP messages of reassembled directed flows (``Framer``): capture, src, sport, dst, dport, n, frame, kind, message (latin-1 text).

    Segments are taken in order of arrival. Chunked bodies are left to the next message's search for a start line. After a
    gap that is skipped, messages begin anew.
    """
    columns, gap_us = _columns(gap_s)

    def begin():
        flow, framer, n = Reassembly(limit, gap_us), Framer(strict, limit), 0

        def step(frame, seq, payload, ts=None):
            nonlocal n
            out = []
            for _, part, gap in flow.push(seq, payload, ts):
                if gap:
                    framer.lose()
                out += framer.feed(part)
            n += len(out)
            return [(n - len(out) + i, frame, *m) for i, m in enumerate(out)]

        return step

    return walk(_segments(frames), FLOW, ["frame"], columns, StructType.fromDDL("n int, frame long, kind string, message string").fields, begin)


def flow_report(frames: DataFrame, limit: int = LIMIT, gap_s: float | None = None) -> DataFrame:
    """What became of each flow's bytes: segments; bytes passed on, late, lost in how many gaps, still waiting; messages, and bytes dropped in search of a header."""
    columns, gap_us = _columns(gap_s)

    def begin():
        flow, framer, segments, messages = Reassembly(limit, gap_us), Framer(False, limit), 0, 0

        def step(frame, seq, payload, ts=None):
            nonlocal segments, messages
            segments += 1
            for _, part, gap in flow.push(seq, payload, ts):
                if gap:
                    framer.lose()
                messages += len(framer.feed(part))
            return []

        def end():
            return [(segments, flow.passed, flow.late, flow.gaps, flow.lost, flow.waiting, messages, framer.dropped)]

        return step, end

    fields = StructType.fromDDL("segments long, passed long, late long, gaps long, lost long, waiting long, messages long, dropped long").fields
    return walk(_segments(frames), FLOW, ["frame"], columns, fields, begin)
