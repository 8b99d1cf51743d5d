"""Near-duplicate components by an exact Jaccard join on five-word shingles, with count-vector R-trees.

Two texts link when 100 * |A and B| >= 80 * |A or B| for their sets of distinct shingles of lower-cased
words. Equal sets are one class. A pair that links shares at least k shingles among the first
n - ceil(0.8 n) + k of each set in any common order (prefix filter; k is 1 + n // 50, the lesser one's).
Here shingles go by how often their counter was met in all texts: each is hashed into one of ``COUNTERS``
counters, which tasks fill and add up. A passage whose copies grow with the corpus stands out from its
counter's other shingles, whose number varies by their square root only. The order keeps groups of texts
that share a shingle small, but decides nothing else. Within a
group, shingles are hashed into ``GROUPS`` counters; the counts are points in an R-tree, and the summed
coordinate minima of two boxes bound the overlap below them. Pairs that survive are verified on the sets.

Copies make large groups, so links are found in two rounds. First each class meets only the class that it
shares most prefix shingles with, if the bound allows; components follow. Then only pairs of different components that share a
prefix shingle are looked at, together for all shingles whose groups have the same least and greatest class, so that a pair of
copies is handed on a few times and not once for each shingle in common. Pairs inside a component can't change it, so the components are exact, and
no group emits all its pairs. Large groups are cut into blocks that meet block by block.

Null text or no words: an empty set that links with nothing. Fewer than five words: one shingle of all.
Repeated ids and rows each get a row; a null id stays a row, and a component of such rows alone has a
null component_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mix64, packed_array, slices, small, summed, words_of, worker
from .components import components

WORDS, PERCENT, GROUPS, FANOUT = 5, 80, 128, 24
#: Counters of shingles (an order for them, nothing more), how many of them travel together, and classes of a block (of a meeting's block in the second round).
COUNTERS, PIECE, BLOCK, MEETING = 1 << 22, 1 << 16, 1_024, 256
#: Bytes of text whose shingles a task holds at once.
SLICE = 2 << 20


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, ascending within each, and their offsets."""
    words, off = words_of(texts)
    coded = words.dictionary_encode()
    names = np.asarray(coded.dictionary.to_pylist(), dtype=object)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    h = np.append(hashes[np.asarray(coded.indices)], np.zeros(WORDS, np.uint64))
    n = np.diff(off)
    k = np.maximum(n - WORDS + 1, (n > 0).astype(np.int64))
    start = np.append(0, np.cumsum(k))
    at = np.arange(start[-1]) - np.repeat(start[:-1] - off[:-1], k)
    size = np.repeat(np.minimum(n, WORDS), k)
    out = size.astype(np.uint64)
    for i in range(WORDS):
        out = np.where(i < size, mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[at + i]), out)
    for a, b in zip(start, start[1:], strict=False):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[start[:-1][k > 0]] = True
    return out[keep], np.append(0, np.cumsum(keep))[start]


def least_shared(n):
    """How many prefix shingles a set shares at least with another of its size or more that it links with."""
    return 1 + n // 50


def prefixes(sets: np.ndarray, off: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(0.8 n) + least_shared(n) shingles of each set in the order of their counters ``often``, then of their hashes; and offsets."""
    n = np.diff(off)
    want = np.where(n > 0, np.minimum(n, n - (PERCENT * n + 99) // 100 + least_shared(n)), 0)
    if not len(sets):
        return sets, off
    times = often[(sets & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.int64)
    order = np.empty(len(sets), np.int64)
    for a, b in zip(off, off[1:], strict=False):
        order[a:b] = a + np.argsort(times[a:b], kind="stable")  # sets ascend, so equal counters stay in the order of hashes
    place = np.arange(len(sets)) - np.repeat(off[:-1], n)
    take = order[place < np.repeat(want, n)]
    return sets[take], np.append(0, np.cumsum(want))


def chosen(sets: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets for which ``keep`` holds; the others become empty."""
    n = np.diff(off)
    return sets[np.repeat(keep, n)], np.append(0, np.cumsum(np.where(keep, n, 0)))


def vectors(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Count vectors (texts, GROUPS)."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return np.bincount(doc * GROUPS + (sets % np.uint64(GROUPS)).astype(np.int64), minlength=(len(off) - 1) * GROUPS).reshape(-1, GROUPS)


def linked(common, a, b):
    """Whether sets of sizes a, b with (at most) ``common`` shared members are alike enough."""
    return 100 * common >= PERCENT * (a + b - common)


class RTree:
    """Sort-packed R-tree over count vectors; ``pairs`` joins two trees (or one with itself)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], sizes)) if len(points) else np.zeros(0, int)
        lo = hi = points[self.order]
        n_lo = n_hi = sizes[self.order]
        self.levels = [(lo, hi, n_lo, n_hi)]
        while len(lo) > FANOUT:
            cuts = np.arange(0, len(lo), FANOUT)
            lo, hi = np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)
            n_lo, n_hi = np.minimum.reduceat(n_lo, cuts), np.maximum.reduceat(n_hi, cuts)
            self.levels.append((lo, hi, n_lo, n_hi))

    def pairs(self, other: RTree | None = None):
        """Entries (i of self, j of other) below boxes whose bound allows a link, node pair by node pair; each pair once in a self-join."""
        same = other is None
        other = self if same else other
        top_a, top_b = len(self.levels) - 1, len(other.levels) - 1
        stack = [(top_a, np.arange(len(self.levels[-1][0])), top_b, np.arange(len(other.levels[-1][0])))]
        while stack:
            la, ia, lb, ib = stack.pop()
            a, b = self.levels[la], other.levels[lb]
            ok = np.zeros((len(ia), len(ib)), bool)
            for i, x in enumerate(ia):
                bound = np.minimum(a[1][x], b[1][ib]).sum(1)
                near = (100 * b[3][ib] >= PERCENT * a[2][x]) & (100 * a[3][x] >= PERCENT * b[2][ib])
                ok[i] = near & linked(np.minimum(bound, np.minimum(a[3][x], b[3][ib])), a[2][x], b[2][ib])
            if same and la == lb:
                ok &= ia[:, None] <= ib[None] if la else ia[:, None] < ib[None]
            if la == 0 and lb == 0:
                i, j = np.nonzero(ok)
                if len(i):
                    yield self.order[ia[i]], other.order[ib[j]]
                continue
            down = lambda tree, level, x: np.arange(x * FANOUT, min((x + 1) * FANOUT, len(tree.levels[level - 1][0])))
            for i, j in zip(*np.nonzero(ok), strict=True):
                go_a, go_b = la >= lb, lb >= la
                stack.append((la - go_a, down(self, la, ia[i]) if go_a else ia[i : i + 1], lb - go_b, down(other, lb, ib[j]) if go_b else ib[j : j + 1]))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Shared members of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _runs(batches, keys: list[str]):
    """Runs of rows with equal ``keys`` of a sorted stream, as tables."""
    carry: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if carry and key != last:
                yield pa.Table.from_batches(carry)
                carry = []
            last = key
            carry.append(batch.slice(a, b - a))
    if carry:
        yield pa.Table.from_batches(carry)


def _link_block(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between a block's sets that join its components, found through an R-tree."""
    off = np.append(0, np.cumsum([len(s) for s in sets]))
    tree = RTree(vectors(np.concatenate(sets), off), np.diff(off))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in tree.pairs():
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb and linked(common(sets[a], sets[b]), len(sets[a]), len(sets[b])):
                root[max(ra, rb)] = min(ra, rb)
                out.append((int(ids[a]), int(ids[b])))
    return out


def _class_of(sets: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """128-bit names of sets; None for empty ones."""
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return [None] * (len(off) - 1)
    one = np.add.reduceat(mix64(sets), off[:-1][full])
    two = np.add.reduceat(mix64(sets ^ np.uint64(0xD6E8FEB86659FD93)), off[:-1][full])
    names = np.stack([one, two + np.diff(off)[full].astype(np.uint64)], 1)
    out: list[bytes | None] = [None] * (len(off) - 1)
    for i, name in zip(full.tolist(), names, strict=True):
        out[i] = name.tobytes()
    return out


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * GROUPS else "<u4").astype(np.int64)


def _binary_list(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(flat).view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * flat.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def meetings(left: DataFrame) -> DataFrame:
    """Where classes of different components meet: lo, hi, cid, comp and the ascending shingles ``shared`` there, from prefix shingles (s, cid, comp).

    Shingles of one least and one greatest class are one meeting, so that copies with many shingles in common meet a few times and not once a shingle.
    """
    mixed = left.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("x <> y").select("s", "lo", "hi")
    return left.join(mixed, "s").groupBy("lo", "hi", "cid", "comp").agg(F.sort_array(F.collect_list("s")).alias("shared"))  # at most the class's own prefix


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row; text_hash (xxhash64), and first: the component's row of least id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))

    @worker
    def met(batches):
        often = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for piece in slices(batch, most=SLICE):
                sets, _ = shingle_sets(piece.column("text"))
                np.add.at(often, (sets & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
        task = TaskContext.get().partitionId()
        for at in range(COUNTERS // PIECE):
            part = often[at * PIECE : (at + 1) * PIECE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([task], pa.int64()), pa.array([PIECE], pa.int32()), pa.array([packed_array(part)], pa.binary())], names=["at", "task", "n", "part"])

    often = np.zeros(COUNTERS, np.uint32)  # one fixed size, whatever the corpus
    for at, part in summed(rows.select("text").mapInArrow(met, "at int, task long, n int, part binary"), "<u4", "<u4", 16).items():
        often[at * PIECE : (at + 1) * PIECE] = part
    often_b = spark.sparkContext.broadcast(often)

    @worker
    def described(batches):
        often = often_b.value
        row = TaskContext.get().partitionId() << 33
        seen: set[bytes | None] = {None}
        for batch in batches:
            for piece in slices(batch, most=SLICE):
                sets, off = shingle_sets(piece.column("text"))
                names = _class_of(sets, off)
                fresh = np.array([c not in seen and not seen.add(c) for c in names], bool)  # a class's first text in the task
                pre, pre_off = prefixes(*chosen(sets, off, fresh), often)
                v = vectors(sets, off)
                kind = "<u2" if not len(v) or v.max() < 1 << 16 else "<u4"
                k = piece.num_rows
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), piece.column("text_hash"), pa.array(row + np.arange(k), pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(names, pa.binary()),
                    _binary_list(v.astype(kind).ravel(), np.arange(k + 1) * GROUPS), pa.ListArray.from_arrays(pa.array(pre_off, pa.int32()), pa.array(pre.view(np.int64))),
                ], names=["doc_id", "text_hash", "row", "n", "cls", "vec", "prefix"])
                row += k

    described_rows = scratch.cut(hashed.mapInArrow(described, "doc_id long, text_hash long, row long, n long, cls binary, vec binary, prefix array<long>"))
    classes = described_rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("row").alias("cid"))
    member = scratch.cut(described_rows.select("doc_id", "text_hash", "row", "n", "cls").join(classes, "cls", "left").select("doc_id", "text_hash", "row", "n", "cls", "cid"))
    # prefix shingles that at least two classes share, with the least class of each. Postings go by a hash of the class's name;
    # where two names had one hash, both classes would take part, which only adds candidates
    posts = described_rows.select(F.xxhash64("cls").alias("c"), F.explode("prefix").alias("s")).repartition("s")
    groups = posts.groupBy("s").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("s")
    named = member.where("row = cid").select(F.xxhash64("cls").alias("c"), "cid")
    shared = posts.join(groups, "s").dropDuplicates(["s", "c"]).join(small(named), "c").select("s", "cid")
    postings = scratch.cut(shared)
    shared = postings.join(postings.groupBy("s").agg(F.min("cid").alias("hub")), "s")
    # count vectors only of classes that share a prefix shingle
    vecs = scratch.cut(described_rows.select(F.col("row").alias("cid"), "n", "vec").join(postings.select("cid").distinct(), "cid"))
    # first round: each class with the hub that it shares most with, of those of fitting size
    size = vecs.select("cid", "n")
    close = shared.where("cid <> hub").groupBy("cid", "hub").count().join(size, "cid").join(size.select(F.col("cid").alias("hub"), F.col("n").alias("hub_n")), "hub")
    close = close.where("100 * least(n, hub_n) >= 80 * greatest(n, hub_n) AND count >= 1 + least(n, hub_n) DIV 50")
    best = close.groupBy("cid").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
    pairs = best.join(vecs, "cid").join(vecs.select(F.col("cid").alias("hub"), F.col("n").alias("hub_n"), F.col("vec").alias("hub_vec")), "hub")

    @worker
    def bounded(batches):
        for batch in batches:
            ok = [bool(linked(np.minimum(_vector(x), _vector(y)).sum(), n, m)) for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("vec", "hub_vec", "n", "hub_n")), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["cid", "hub"])

    best = scratch.cut(pairs.select("cid", "hub", "n", "hub_n", "vec", "hub_vec").mapInArrow(bounded, "cid long, hub long"))
    blocks = best.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    placed = best.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int").alias("sub"), "cid")
    guests = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("sub"), F.col("hub").alias("cid"))
    in_block = placed.unionByName(guests)

    @worker
    def whole(batches):
        for batch in batches:
            for piece in slices(batch, most=SLICE):
                sets, off = shingle_sets(piece.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(_class_of(sets, off), pa.binary()), _binary_list(sets, off)], names=["cls", "members"])

    def sets_of(classes: DataFrame) -> DataFrame:
        """(cid, members) of a table of classes: their sets are made again, so that the others' never leave their tasks. Repeated rows repeat theirs."""
        few = small(scratch.cut(member.where("row = cid").select("doc_id", "cls", "cid").join(classes, "cid")))
        texts = rows.join(few.select(F.col("doc_id").alias("id")), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        return texts.mapInArrow(whole, "cls binary, members binary").join(few.select("cls", "cid"), "cls").select("cid", "members")

    sets = sets_of(in_block.select("cid").distinct())

    @worker
    def link(batches):
        for t in _runs(batches, ["hub", "sub"]):
            found = _link_block(np.asarray(t["cid"]), [np.frombuffer(x, np.uint64) for x in t["members"].to_pylist()])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    in_blocks = sets.join(small(in_block), "cid").select("hub", "sub", "cid", "members").repartition("hub", "sub").sortWithinPartitions("hub", "sub", "cid")
    first = components(in_blocks.mapInArrow(link, "a long, b long"), scratch)
    # second round: pairs of different components that share a prefix shingle
    left = postings.join(first.withColumnRenamed("node", "cid"), "cid", "left").select("s", "cid", F.coalesce("root", "cid").alias("comp"))
    met_at = scratch.cut(meetings(left))
    blocks = met_at.groupBy("lo", "hi").agg(F.ceil(F.count("*") / MEETING).cast("int").alias("k"))
    met_in = met_at.join(blocks, ["lo", "hi"]).withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    # in a large meeting, blocks meet pair by pair; a single block meets itself
    meets = met_in.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("lo", "hi", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "cid", "comp", "shared")
    meets = meets.join(vecs, "cid").repartition("lo", "hi", "i", "j").sortWithinPartitions("lo", "hi", "i", "j", "cid")

    @worker
    def candidates(batches):
        out: list[tuple[int, ...]] = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "ca", "cb", "need", "times"])

        for t in _runs(batches, ["lo", "hi", "i", "j"]):
            comp = np.asarray(t["comp"])
            if (comp == comp[0]).all():
                continue
            cid, n, sub = np.asarray(t["cid"]), np.asarray(t["n"]), np.asarray(t["sub"])
            lists = t["shared"].combine_chunks()
            flat, off = np.asarray(lists.flatten()), np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            points = np.stack([_vector(v) for v in t["vec"].to_pylist()])
            if t["i"][0].as_py() == t["j"][0].as_py():
                found, x, y = RTree(points, n).pairs(), np.arange(len(cid)), np.arange(len(cid))
            else:
                x, y = np.flatnonzero(sub == sub.min()), np.flatnonzero(sub == sub.max())
                if sub.min() == sub.max():
                    continue
                found = RTree(points[x], n[x]).pairs(RTree(points[y], n[y]))
            for i, j in found:
                i, j = x[i], y[j]
                other = comp[i] != comp[j]
                for p, q in zip(i[other].tolist(), j[other].tolist(), strict=True):
                    times = common(flat[off[p] : off[p + 1]], flat[off[q] : off[q + 1]])
                    if times:
                        p, q = (q, p) if cid[p] > cid[q] else (p, q)
                        out.append((cid[p], cid[q], comp[p], comp[q], least_shared(min(n[p], n[q])), times))
                if len(out) > 50_000:
                    yield flush()
                    out.clear()
        if out:
            yield flush()

    pairs = meets.mapInArrow(candidates, "a long, b long, ca long, cb long, need long, times long").groupBy("a", "b", "ca", "cb", "need").agg(F.sum("times").alias("times"))
    pairs = scratch.cut(pairs.where("times >= need").drop("need", "times"))
    wanted = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    sets = sets_of(wanted)

    # pairs that hang together meet in one place, so that each set travels once, or once for each block of a large place
    hang = components(pairs.select("a", "b"), scratch).withColumnRenamed("node", "cid")
    place = wanted.join(hang, "cid", "left").select("cid", F.coalesce("root", "cid").alias("g"))
    sizes = place.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    sub = lambda c: F.pmod(F.xxhash64(c), F.col("k")).cast("int")
    place = sets.join(small(scratch.cut(place.join(sizes, "g"))), "cid").withColumn("x", sub("cid")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    none = F.lit(None).cast("long")
    held = place.select("g", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.lit(0).alias("kind"), F.col("cid").alias("a"), none.alias("b"), none.alias("ca"), none.alias("cb"), "members")
    asked = pairs.join(hang.withColumnRenamed("cid", "a"), "a", "left").withColumn("g", F.coalesce("root", "a")).join(sizes, "g")
    asked = asked.select("g", F.least(sub("a"), sub("b")).alias("i"), F.greatest(sub("a"), sub("b")).alias("j"), F.lit(1).alias("kind"), "a", "b", "ca", "cb", F.lit(None).cast("binary").alias("members"))
    together = held.unionByName(asked).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "kind", "a", "b")

    @worker
    def verify(batches):
        for t in _runs(batches, ["g", "i", "j"]):
            n = int((np.asarray(t["kind"]) == 0).sum())
            own = {c: np.frombuffer(m, np.uint64) for c, m in zip(t["a"][:n].to_pylist(), t["members"][:n].to_pylist(), strict=True)}
            root: dict[int, int] = {}

            def find(x: int, root=root) -> int:
                while x in root:
                    x = root[x]
                return x

            out = []
            for a, b, ca, cb in zip(*(t[c][n:].to_pylist() for c in ("a", "b", "ca", "cb")), strict=True):
                ra, rb = find(ca), find(cb)
                if ra != rb and linked(common(own[a], own[b]), len(own[a]), len(own[b])):
                    root[max(ra, rb)] = min(ra, rb)
                    out.append((ca, cb))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    links = together.mapInArrow(verify, "a long, b long")
    second = components(links, scratch)
    # class, component of the first round, component, least id in it
    comp = member.join(first.select(F.col("node").alias("cid"), F.col("root").alias("one")), "cid", "left").withColumn("one", F.coalesce("one", "cid", "row"))
    comp = comp.join(second.select(F.col("node").alias("one"), F.col("root").alias("two")), "one", "left").select("doc_id", "text_hash", "row", "n", F.coalesce("two", "one").alias("comp"))
    comp = scratch.cut(comp)
    scratch.forget(described_rows, postings, vecs, best, met_at, pairs)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    name = comp.groupBy("comp").agg(least.alias("least"))
    return comp.join(name, "comp").select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "text_hash", (F.col("row") == F.col("least.row")).alias("first"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that another row of their component stands for. Rows without words stay."""
    found = near_duplicates(docs, id_col, text_col)
    lone = found["n_shingles"] == 0
    kept = found.where(F.col("first") | lone).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).agg(F.max(lone).alias("lone"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    out = rows.join(kept, rows["doc_id"].eqNullSafe(kept["id"]) & (rows["text_hash"] == kept["h"]))
    # of rows with equal id and text one stays
    turn = F.row_number().over(Window.partitionBy("id", "h").orderBy("h"))
    return out.withColumn("turn", turn).where("turn = 1 OR lone").select("row.*")
