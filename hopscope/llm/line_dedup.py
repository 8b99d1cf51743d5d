"""Removal of repeated line runs by a suffix array over line ids, built by distributed prefix doubling.

Each text is a sequence of 64-bit line ids; a suffix ends with its text. Lines that occur once are symbols
of their own and end every repeat, so only suffixes that begin with a repeated line are ranked. A round
of doubling orders the open suffixes by (rank, rank of the suffix h lines on): distinct pairs are counted,
their places inside a rank come from sums over buckets of the second rank, and rows take the new rank of
their pair by a join; no rank's rows meet in one task. Suffixes whose rank is theirs alone, or that are
equal to their end, close.

The suffix array is dealt into blocks of ``BLOCK`` neighbours. A block finds the longest common prefix of
each neighbouring pair; prefixes beyond ``SHIPPED`` lines are finished on the whole texts, once for each
irreducible pair. The common prefixes' intervals give, for each suffix, the longest run of lines that also
begins at an earlier place (documents by id, then rows). What lies beyond a block reaches it as a short
staircase of (common prefix, earliest place), summed over blocks on the driver.

A run of at least ``min_words`` words that occurs earlier, in the same text or another, is deleted with all
its lines; its first copy stays. By default any run with a word counts; lines without words go only within
such a run. Null text stays null with no lines; an empty text has one line without
words. Equal rows count as copies, the first in reading order stays whole; null ids come last. Kept lines
are joined by line feeds. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col, kept_names, passed_schema, slices, worker

MIN_WORDS, BLOCK, SHIPPED = 1, 65_536, 64
#: Ranks of lines that occur once: this and their position.
LONE = 1 << 62
_NO_ID = (1 << 63) - 1


def _line_table(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """Rows with their text, a number ``row``, ``base`` (position of the first line), line ids and word counts."""
    rows = docs.select(*[col(c).alias(f"_{i}") for i, c in enumerate(keep)], col(text_col).cast("string").alias("text"))
    passed = [f"_{i}" for i in range(len(keep))]
    schema = passed_schema(docs, keep, "text string, row long, base long, ids array<long>, words array<int>")

    @worker
    def split(batches):
        part = TaskContext.get().partitionId() << 40
        row, base = part, part
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column("text")
                lists = pc.split_pattern(texts, "\n")
                lines = lists.flatten()
                off = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))).astype(np.int64)
                coded = lines.dictionary_encode()
                names = np.asarray(coded.dictionary.to_pylist(), dtype=object)
                ids = pd.util.hash_array(names, categorize=False).view(np.int64) if len(names) else np.zeros(0, np.int64)
                parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(coded.dictionary))
                words = np.where(np.asarray(pc.binary_length(coded.dictionary)) > 0, np.asarray(pc.list_value_length(parts)), 0) if len(names) else np.zeros(0, np.int64)
                at = np.asarray(coded.indices)
                k = piece.num_rows
                o32 = pa.array(off, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *[piece.column(c) for c in passed], texts.cast(pa.string()), pa.array(row + np.arange(k), pa.int64()), pa.array(base + off[:-1], pa.int64()),
                    pa.ListArray.from_arrays(o32, pa.array(ids[at], pa.int64())), pa.ListArray.from_arrays(o32, pa.array(words[at], pa.int32())),
                ], names=[*passed, "text", "row", "base", "ids", "words"])
                row, base = row + k, base + int(off[-1])

    return rows.mapInArrow(split, schema)


def suffix_ranks(lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(row, i, rem, rank) of every suffix that begins with a repeated line, equal suffixes with equal ranks; and their number.

    ``lines``: row, base, ids. A rank is the number of such suffixes that are smaller.
    """
    every = lines.select("row", "base", F.size("ids").alias("len"), F.posexplode("ids").alias("i", "id"))
    often = every.groupBy("id").count().where("count > 1").withColumn("b", F.shiftright("id", 53))
    sums = often.groupBy("b").agg(F.sum("count").alias("c"))  # at most 2,048 buckets of the hashed ids
    base = sums.withColumn("before", F.sum("c").over(Window.orderBy("b")) - F.col("c")).select("b", "before")
    within = F.sum("count").over(Window.partitionBy("b").orderBy("id")) - F.col("count")
    rank0 = often.withColumn("within", within).join(F.broadcast(base), "b").select("id", (F.col("before") + F.col("within")).alias("r0"))
    state = every.join(rank0, "id", "left").select("row", "i", (F.col("len") - F.col("i")).alias("rem"), F.coalesce("r0", F.lit(LONE) + F.col("base") + F.col("i")).alias("r"), F.col("r0").isNotNull().alias("open"), F.lit(False).alias("fresh"))
    state = scratch.cut(state)
    total, last = state.agg(F.count_if("open"), F.max("row")).first()
    high = max(0, ((last or 0) >> 40).bit_length() - 7) + 40
    step = max(1, -(-(total or 0) // 128))
    done, h = [], 1
    while True:
        by_row = Window.partitionBy("row")
        now = state.withColumn("live", F.max("open").over(by_row)).withColumn("rh", F.coalesce(F.lead("r", h).over(by_row.orderBy("i")), F.lit(-1))).where("live").drop("live", "fresh")
        b = F.when(F.col("rh") < 0, -1).when(F.col("rh") < LONE, F.floor(F.col("rh") / step)).otherwise(128 + F.shiftright(F.col("rh") - LONE, high)).cast("int")
        pairs = now.where("open").groupBy("r", "rh").agg(F.count("*").alias("n")).withColumn("b", b)
        buckets = pairs.groupBy("r", "b").agg(F.sum("n").alias("bn"))
        buckets = buckets.withColumn("before", F.sum("bn").over(Window.partitionBy("r").orderBy("b")) - F.col("bn")).select("r", "b", "before")
        inner = F.sum("n").over(Window.partitionBy("r", "b").orderBy("rh")) - F.col("n")
        fresh = pairs.withColumn("inner", inner).join(buckets, ["r", "b"]).select("r", "rh", (F.col("r") + F.col("before") + F.col("inner")).alias("nr"), ((F.col("n") > 1) & (F.col("rh") >= 0)).alias("more"), F.lit(True).alias("hit"))
        met = now.join(fresh, ["r", "rh"], "left")
        was = F.coalesce("hit", F.lit(False)) & F.col("open")
        new = scratch.cut(met.select("row", "i", "rem", F.when(was, F.col("nr")).otherwise(F.col("r")).alias("r"), (was & F.coalesce("more", F.lit(False))).alias("open"), (was & ~F.coalesce("more", F.lit(False))).alias("fresh")))
        scratch.forget(state)
        state = new
        done.append(new.where("fresh").select("row", "i", "rem", "r"))
        if new.where("open").isEmpty():
            break
        h *= 2
        # closed suffixes of this round are kept apart, since later rounds drop texts without open ones
        done[-1] = scratch.cut(done[-1])
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, total or 0


def _compare(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[:n] != b[:n])
    return int(diff[0]) if len(diff) else n


def common_prefixes(ranked: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """The suffix array with longest common prefixes: (block, idx, doc, row, i, lcp), lcp with the suffix before.

    ``ranked``: row, i, rem, r. ``lines``: row, doc, ids.
    """
    # equal suffixes get places of their own, counted in hash buckets so that a frequent one makes no large group
    hashed = ranked.withColumn("hb", F.pmod(F.xxhash64("row", "i"), F.lit(64)))
    counts = hashed.groupBy("r", "hb").count().withColumn("before", F.sum("count").over(Window.partitionBy("r").orderBy("hb")) - F.col("count")).drop("count")
    order = Window.partitionBy("r", "hb").orderBy("row", "i")
    placed = hashed.withColumn("k", F.row_number().over(order) - 1).join(counts, ["r", "hb"]).select("row", "i", "rem", (F.col("r") + F.col("before") + F.col("k")).alias("idx"))
    sliced = placed.join(lines, "row").select("idx", "row", "doc", "i", "rem", F.slice("ids", F.col("i") + 1, F.lit(SHIPPED)).alias("head"), F.when(F.col("i") > 0, F.element_at("ids", F.greatest("i", F.lit(1)))).alias("prev"))
    block = F.floor(F.col("idx") / BLOCK)
    sliced = sliced.withColumn("block", F.explode(F.when((F.col("idx") + 1) % BLOCK == 0, F.array(block, block + 1)).otherwise(F.array(block))))
    sliced = sliced.repartition("block").sortWithinPartitions("block", "idx")

    @worker
    def compare(batches):
        last_block, before = None, None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("block", "idx", "row", "i", "rem", "prev")}
            heads = batch.column("head")
            flat, off = np.asarray(heads.flatten()), np.asarray(heads.offsets) - heads.offsets[0].as_py()
            out = []
            for k in range(batch.num_rows):
                head = flat[off[k] : off[k + 1]]
                me = (cols["row"][k], cols["i"][k], cols["rem"][k], head, cols["prev"][k])
                if cols["block"][k] != last_block:
                    last_block, before = cols["block"][k], None
                if cols["idx"][k] // BLOCK == last_block:  # else the last one of the block before
                    lcp, capped, reducible, other = 0, False, False, (None, None)
                    if before is not None:
                        lcp = _compare(before[3], head)
                        capped = lcp == SHIPPED and before[2] > SHIPPED and me[2] > SHIPPED
                        reducible = me[4] is not None and me[4] == before[4]
                        other = before[:2]
                    out.append((k, lcp, capped, reducible, *(other if capped else (None, None))))
                before = me
            if out:
                k, lcp, capped, reducible, row2, i2 = zip(*out, strict=True)
                rows = batch.select(["block", "idx", "doc", "row", "i"]).take(pa.array(k))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lcp, pa.int32()), pa.array(capped), pa.array(reducible), pa.array(row2, pa.int64()), pa.array(i2, pa.int32())], names=["block", "idx", "doc", "row", "i", "lcp", "capped", "reducible", "row2", "i2"])

    out = scratch.cut(sliced.select("block", "idx", "doc", "row", "i", "rem", "head", "prev").mapInArrow(compare, "block long, idx long, doc long, row long, i int, lcp int, capped boolean, reducible boolean, row2 long, i2 int"))
    capped = out.where("capped")
    if capped.isEmpty():
        return out.select("block", "idx", "doc", "row", "i", "lcp")
    # a pair is reducible if the lines before it are equal: then its prefix is one shorter than that of the pair before
    # it in the text, where those are neighbours too; the others are compared to their end on the texts
    last = F.lag(F.struct("row2", "i2", "i")).over(Window.partitionBy("row").orderBy("i"))
    chained = capped.withColumn("p", last).withColumn("chain", F.coalesce(F.col("reducible") & (F.col("p.row2") == F.col("row2")) & (F.col("p.i2") == F.col("i2") - 1) & (F.col("p.i") == F.col("i") - 1), F.lit(False)))
    own = lines.select("row", "ids")
    heads = chained.where("NOT chain").select("row", "i", "row2", "i2").join(own, "row").join(own.select(F.col("row").alias("row2"), F.col("ids").alias("ids2")), "row2")

    @worker
    def finish(batches):
        for batch in batches:
            found = [_compare(np.array(a[i:]), np.array(b[j:])) for a, b, i, j in zip(batch.column("ids").to_pylist(), batch.column("ids2").to_pylist(), batch.column("i").to_pylist(), batch.column("i2").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("i"), pa.array(found, pa.int32())], names=["row", "i", "full"])

    exact = heads.select("row", "i", "i2", "ids", "ids2").mapInArrow(finish, "row long, i int, full int")
    filled = chained.select("row", "i", "chain").join(exact, ["row", "i"], "left")
    before = F.last(F.when(F.col("full").isNotNull(), F.struct("i", "full")), True).over(Window.partitionBy("row").orderBy("i"))
    filled = filled.withColumn("h", before).select("row", "i", (F.col("h.full") - (F.col("i") - F.col("h.i"))).cast("int").alias("full"))
    return scratch.cut(out.join(filled, ["row", "i"], "left").select("block", "idx", "doc", "row", "i", F.coalesce("full", "lcp").alias("lcp")))


def _stairs(places: list[tuple], lcps: list[int], start: list[tuple[int, tuple]]) -> list[tuple[int, tuple]]:
    """Walk over suffixes away from a border: (common prefix with the border, earliest place), each earlier than those nearer.

    ``lcps[k]``: common prefix of suffix k with the one nearer to the border; ``start``: stairs so far beyond the last.
    """
    out, low = [], None
    for place, lcp in zip(places, lcps, strict=True):
        low = lcp if low is None else min(low, lcp)
        if low == 0:
            return out
        _step(out, low, place)
    for lcp, place in start:
        lcp = lcp if low is None else min(low, lcp)
        if lcp == 0:
            break
        _step(out, lcp, place)
    return out


def _step(stairs: list[tuple[int, tuple]], lcp: int, place: tuple) -> None:
    """Add a step further from the border if its place is earlier; it takes the place of a nearer one with the same prefix."""
    if not stairs or place < stairs[-1][1]:
        if stairs and stairs[-1][0] == lcp:
            stairs.pop()
        stairs.append((lcp, place))


def _earlier(places: list[tuple], lcps: list[int], beyond: list[tuple[int, tuple]]) -> list[int]:
    """For each suffix, its common prefix with the nearest one before it in order that has an earlier place.

    ``lcps[k]``: with the suffix before; ``beyond``: stairs of what comes before the first, nearest first, measured at the first.
    """
    stack: list[tuple[tuple, int]] = []
    far = 0
    for lcp, place in reversed(beyond):
        stack.append((place, far))
        far = lcp
    out = []
    for k, place in enumerate(places):
        lcp = far if k == 0 else lcps[k]
        while stack and stack[-1][0] > place:
            lcp = min(lcp, stack.pop()[1])
        out.append(lcp if stack else 0)
        stack.append((place, lcp))
    return out


def _blocks(batches):
    """Blocks of a sorted stream: (block, places, rows, i, lcp)."""
    block, places, lcps = None, [], []
    for batch in batches:
        for b, doc, row, i, lcp in zip(*(batch.column(c).to_pylist() for c in ("block", "doc", "row", "i", "lcp")), strict=True):
            if b != block:
                if places:
                    yield block, places, lcps
                block, places, lcps = b, [], []
            places.append((_NO_ID if doc is None else doc, row, i))
            lcps.append(lcp)
    if places:
        yield block, places, lcps


def earlier_runs(array: DataFrame) -> DataFrame:
    """(row, i, run): how many lines from line i of a row on also begin at an earlier place; only where there are any."""
    spark = array.sparkSession
    ordered = array.repartition("block").sortWithinPartitions("block", "idx").select("block", "doc", "row", "i", "lcp")

    @worker
    def summary(batches):
        for block, places, lcps in _blocks(batches):
            to_right = _stairs(places[::-1], [1 << 30, *lcps[:0:-1]], [])
            to_left = _stairs(places, [1 << 30, *lcps[1:]], [])
            rows = [(block, "right", min(lcps[1:], default=1 << 30), lcps[0], *p, v) for v, p in to_right] + [(block, "left", min(lcps[1:], default=1 << 30), lcps[0], *p, v) for v, p in to_left]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["block", "side", "least", "first", "doc", "row", "i", "lcp"])

    # a few steps for each block of BLOCK suffixes
    steps = ordered.mapInArrow(summary, "block long, side string, least int, first int, doc long, row long, i int, lcp int").collect()
    info: dict[int, dict] = {}
    for s in steps:
        d = info.setdefault(s["block"], {"right": [], "left": [], "least": s["least"], "first": s["first"]})
        d[s["side"]].append((s["lcp"], (s["doc"], s["row"], s["i"])))
    blocks = sorted(info)
    before: dict[int, list] = {}
    after: dict[int, list] = {}
    carry: list[tuple[int, tuple]] = []

    def over(stairs, least, rest):
        out = list(stairs)
        for lcp, place in rest:
            if lcp := min(lcp, least):
                _step(out, lcp, place)
        return out

    for b in blocks:  # stairs at a block's first suffix
        first = info[b]["first"]
        before[b] = [(min(v, first), p) for v, p in carry if min(v, first)]
        carry = over([s for s in info[b]["right"]], info[b]["least"], before[b])
    carry, first = [], 0
    for b in reversed(blocks):  # stairs at a block's last suffix
        after[b] = [(min(v, first), p) for v, p in carry if min(v, first)]
        carry = over([s for s in info[b]["left"]], info[b]["least"], after[b])
        first = info[b]["first"]
    sent = spark.sparkContext.broadcast((before, after))

    @worker
    def runs(batches):
        before, after = sent.value
        for block, places, lcps in _blocks(batches):
            left = _earlier(places, lcps, before[block])
            right = _earlier(places[::-1], [0, *lcps[:0:-1]], after[block])[::-1]
            run = np.maximum(left, right)
            at = np.flatnonzero(run)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([places[k][1] for k in at], pa.int64()), pa.array([places[k][2] for k in at], pa.int32()), pa.array(run[at], pa.int32())], names=["row", "i", "run"])

    return ordered.mapInArrow(runs, "row long, i int, run int")


OUTPUTS = ["text", "n_lines", "n_removed", "removed"]


def dedup_lines(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Columns ``keep`` (with ``id_col``) and text without repeated runs, n_lines, n_removed, removed (array of first line, lines)."""
    keep = [id_col, *[c for c in keep if c not in (id_col, text_col)]]
    out = _without_repeats(docs, keep, text_col, min_words)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept_names(keep, OUTPUTS))], *OUTPUTS)


def keep_first_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, n_chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with their texts shortened, and ``n_chars_col`` brought up to date where there is one; rows of which no word is left go."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    keep = [id_col, *others]
    out = _without_repeats(docs, keep, text_col, min_words).where("n_removed = 0 OR text RLIKE '[^ \\\\t-\\\\r]'")
    columns = {c: F.col(f"_{i}") for i, c in enumerate(keep)} | {text_col: F.col("text").cast(docs.schema[text_col].dataType)}
    if n_chars_col in columns:
        columns[n_chars_col] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(columns[n_chars_col]).cast(docs.schema[n_chars_col].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def _without_repeats(docs: DataFrame, keep: list[str], text_col: str, min_words: int) -> DataFrame:
    """Columns _0 (the id), _1, ... for those of ``keep``, and the outputs."""
    scratch = Scratch(docs.sparkSession, "lines")
    table = scratch.cut(_line_table(docs, keep, text_col))
    lines = table.select("row", F.col("_0").cast("long").alias("doc"), "base", "ids")
    ranked, _ = suffix_ranks(lines, scratch)
    array = common_prefixes(ranked, lines.drop("base"), scratch)
    found = earlier_runs(array).groupBy("row").agg(F.collect_list(F.struct("i", "run")).alias("runs"))  # at most a text's lines
    joined = table.drop("base", "ids").join(found, "row", "left")
    passed = [f"_{i}" for i in range(len(keep))]
    schema = passed_schema(docs, keep, "text string, n_lines int, n_removed int, removed array<struct<first:int,lines:int>>")

    @worker
    def delete(batches):
        for batch in batches:
            texts, n_lines, n_removed, removed = [], [], [], []
            for text, words, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "words", "runs")), strict=True):
                n = 0 if text is None else len(words)
                gone = np.zeros(n + 1, np.int64)
                if runs:
                    total = np.append(0, np.cumsum(words))
                    for r in runs:
                        if total[r["i"] + r["run"]] - total[r["i"]] >= min_words:
                            gone[r["i"]] += 1
                            gone[r["i"] + r["run"]] -= 1
                out = np.cumsum(gone)[:-1] > 0
                if out.any():
                    text = "\n".join(x for x, g in zip(text.split("\n"), out, strict=True) if not g)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out, [0]]).astype(int)))
                texts.append(text)
                n_lines.append(n)
                n_removed.append(int(out.sum()))
                removed.append([{"first": int(a), "lines": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], pa.array(texts, pa.string()), pa.array(n_lines, pa.int32()), pa.array(n_removed, pa.int32()), pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("lines", pa.int32())])))], names=[*passed, "text", "n_lines", "n_removed", "removed"])

    return joined.select(*passed, "text", "words", "runs").mapInArrow(delete, schema)
