"""Hard negatives by blocked dense products of anchors and candidates, exact in float64 below 2^53.

Components become whole numbers floor(``SCALE`` c), so scores are whole. Anchors are taken in blocks of at most
``ANCHORS``; a block is broadcast (its size is bounded by that) and every task goes over its candidates
in batches that are multiplied with it. A task keeps the best few of each anchor, merged from batch to batch; Spark merges
those of all tasks. The first pass finds each anchor's positives (same label), the second one the
negatives (other label) whose score lies in the window that a positive's score opens. Work grows with anchors
times candidates, as the question does; memory doesn't. A block's results are written before the next begins.

Rows with a null id, label or vector, with null or non-finite components, of another length than most, or so long that a
score might leave 64 bits, take no part. Products that might pass 2^53 are taken in whole numbers. Equal scores go by the
lesser id, then the lesser row number. Of repeated ids each row counts, also as an anchor; an anchor row isn't its own
positive. Empty tables, or those without anchors, give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col, worker

SCALE = 256
#: Anchors of a broadcast block; candidates and anchors of one product.
ANCHORS, ROWS, SIDE = 16_384, 4_096, 1_024
#: No score: whole numbers end above it.
_NONE = np.iinfo(np.int64).min
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, x (array of whole numbers) of the rows that take part. ``label`` may refer to column ``vec_id``."""
    rows = vectors.withColumn("_label", label).select(col(id_col).cast("long").alias("vec_id"), F.col("_label").cast("long").alias("label"), col(vector_col).cast("array<double>").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + (F.abs(c) * SCALE + 1) * (F.abs(c) * SCALE + 1))
    fine = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & (norm < float(1 << 62))  # bounds the products of any two
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    sizes = [tuple(r) for r in rows.groupBy(F.size("v").alias("d")).count().collect()]
    most = max(((n, d) for d, n in sizes if d), default=(0, 0))[1]
    return rows.where(F.size("v") == most).select("vec_id", "label", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products (anchors, candidates) as int64."""
    bound = float(np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0)) * np.sqrt((c.astype(np.float64) ** 2).sum(1).max(initial=0)))
    if bound < 1 << 52:
        return (a.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return a @ c.T  # whole numbers of 64 bits


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first of each line by (score falling, id, row); columns come in order of (id, row). Shorter lines end in ``_NONE``."""
    n = scores.shape[1]
    if n < k:
        scores = np.pad(scores, ((0, 0), (0, k - n)), constant_values=_NONE)
        ids, rows = np.pad(ids, (0, k - n)), np.pad(rows, (0, k - n), constant_values=-1)
        n = k
    if n > k:
        at = np.argpartition(scores, n - k, axis=1)[:, n - k :]
        least = np.take_along_axis(scores, at, axis=1).min(1)
        # where the least kept score is met by others too, the first columns with it are the ones to keep
        tied = np.flatnonzero(((scores >= least[:, None]).sum(1) > k) & (least > _NONE))
        for i in tied:
            above = np.flatnonzero(scores[i] > least[i])
            at[i] = np.append(above, np.flatnonzero(scores[i] == least[i])[: k - len(above)])
    else:
        at = np.broadcast_to(np.arange(n), scores.shape)
    return _sorted(np.take_along_axis(scores, at, axis=1), ids[at], rows[at], k)


def _sorted(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((rows, ids, ~scores), axis=1)[:, :k]  # ~s falls as s rises, without overflow
    return tuple(np.take_along_axis(x, order, axis=1) for x in (scores, ids, rows))


def _merged(old, new, k: int):
    return new if old is None else _sorted(*(np.concatenate(x, axis=1) for x in zip(old, new, strict=True)), k)


def _search(rows: DataFrame, block, windows, k: int) -> DataFrame:
    """Each task's ``k`` best of every (anchor, window): a, w, score, vec_id, u.

    ``block``: broadcast (u, label, x) of the anchors. ``windows``: None for positives, else broadcast (least, most) of shape (anchors, windows).
    """

    @worker
    def run(batches):
        u, label, x = block.value
        low, high = windows.value if windows is not None else (None, None)
        sides = [(a, min(a + SIDE, len(u))) for a in range(0, len(u), SIDE)]
        kept = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                ids, own = np.asarray(part.column("vec_id")), np.asarray(part.column("u"))
                order = np.lexsort((own, ids))
                ids, own, other = ids[order], own[order], np.asarray(part.column("label"))[order]
                c = np.asarray(part.column("x").flatten()).reshape(len(ids), -1)[order]
                for a, b in sides:
                    s = _scores(x[a:b], c)
                    same = label[a:b, None] == other[None, :]
                    if windows is None:
                        fits = [same & (u[a:b, None] != own[None, :])]
                    else:
                        fits = [~same & (s >= low[a:b, w, None]) & (s <= high[a:b, w, None]) for w in range(low.shape[1])]
                    for w, fit in enumerate(fits):
                        lines = np.flatnonzero(fit.any(1))
                        if len(lines):
                            new = _best(np.where(fit[lines], s[lines], _NONE), ids, own, k)
                            if (a, w) not in kept:
                                kept[a, w] = tuple(np.full((b - a, k), v, np.int64) for v in (_NONE, 0, -1))
                            for whole, more in zip(kept[a, w], _merged(tuple(z[lines] for z in kept[a, w]), new, k), strict=True):
                                whole[lines] = more
        for (a, w), (s, ids, own) in kept.items():
            line, place = np.nonzero(s > _NONE)
            columns = [pa.array(z, pa.int64()) for z in (u[a + line], s[line, place], ids[line, place], own[line, place])]
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(np.full(len(line), w), pa.int32()), *columns[1:]], names=["a", "w", "score", "vec_id", "u"])

    found = rows.select("u", "vec_id", "label", "x").mapInArrow(run, "a long, w int, score long, vec_id long, u long")
    first = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id", "u"))  # k rows of each task meet
    return found.withColumn("r", first).where(F.col("r") <= k)


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The first ``negatives`` rows of another label for each anchor and each of its ``positives`` first rows of its label.

    ``is_anchor``: a condition on vec_id. ``window``: the negatives' scores, in per cent of the positive's. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score; a positive without any negative gives no row.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    rows = whole_vectors(vectors, label, id_col, vector_col).withColumn("u", F.monotonically_increasing_id())
    # the table lies in even parts, so that each pass goes over it without a shuffle
    rows = scratch.cut(rows.withColumn("anchor", F.coalesce(is_anchor, F.lit(False))).repartition("u"))
    n, d = rows.where("anchor").count(), (rows.select(F.size("x")).first() or [0])[0]
    parts = max(1, -(-n // (ANCHORS * 3 // 4)))
    dealt = F.pmod(F.xxhash64("u"), F.lit(parts))
    low, high = window
    made = []
    for p in range(parts) if n else []:
        mine = sorted(tuple(r) for r in rows.where(F.col("anchor") & (dealt == p)).select("u", "vec_id", "label", "x").collect())
        for begin in range(0, len(mine), ANCHORS):  # one step, unless hashing deals unevenly
            some = mine[begin : begin + ANCHORS]
            u = np.array([r[0] for r in some], np.int64)
            block = spark.sparkContext.broadcast((u, np.array([r[2] for r in some], np.int64), np.array([r[3] for r in some], np.int64).reshape(len(some), d)))
            line = {a: i for i, a in enumerate(u.tolist())}
            chosen: list[list] = [[] for _ in some]
            for r in _search(rows, block, None, positives).select("a", "r", "score", "vec_id").orderBy("a", "r").collect():  # at most ANCHORS x positives
                chosen[line[r["a"]]].append((r["score"], r["vec_id"]))
            least, most = np.full((len(some), positives), 1, np.int64), np.zeros((len(some), positives), np.int64)  # empty windows
            for i, own in enumerate(chosen):
                for w, (score, _) in enumerate(own):
                    least[i, w], most[i, w] = -(-low * score // 100), high * score // 100
            windows = spark.sparkContext.broadcast((least, most))
            pairs = [(int(u[i]), some[i][1], w, score, pid) for i, own in enumerate(chosen) for w, (score, pid) in enumerate(own)]
            pairs = spark.createDataFrame(pairs, "a long, anchor_id long, w int, positive_score long, positive_id long")
            out = _search(rows, block, windows, negatives).join(F.broadcast(pairs), ["a", "w"])  # bounded like chosen
            made.append(scratch.cut(out.select("anchor_id", "positive_id", F.col("r").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
            block.unpersist()
            windows.unpersist()
    if not made:
        return spark.createDataFrame([], FOUND)
    return spark.read.schema(made[0].schema).parquet(*[m._scratch_path for m in made])
