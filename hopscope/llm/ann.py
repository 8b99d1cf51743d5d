"""Maximum inner product search by score-aware (anisotropic) product quantisation.

Pairs of dimensions are coded by 16 centroids each. Codebooks and codes weigh the part of a vector's
residual that is parallel to it ``ETA`` times as much as the rest, since that part moves its largest
inner products. The codebooks are fitted on a bounded sample; every distinct vector is indexed, with the
``k`` + 1 least ids that hold it. The scan ships 4-bit codes, and 8-bit components beside them: blocks of codes meet blocks of
queries in tasks of bounded size, which sum byte-wide look-up tables (two codes at once), keep the best few
of a block and estimate those again by their 8-bit components. The best of these finer estimates meet their original vectors
once, by joins, and are ranked by exact double products, summed in order of the components. How many of either are kept is
measured on the index at hand: for ``PROBES`` queries the exact neighbours are found by going over all vectors, and so many
estimates are taken that ``RECALL`` of those neighbours are among them (``RERANK`` at least, and ``MARGIN`` times what was
measured). So near copies, which 4-bit codes hardly tell apart, are told apart where the codes lie, not by joins. ``exact`` takes all.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do rows without an id. Repeated ids count once for each row; a query's own id is no
candidate, whatever its vectors; a query id with several vectors is asked with each. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Scratch, col, hashed_sample, one_thread, worker

#: The codebooks' sample, and weights: (d - 1) T^2 / (1 - T^2) at T = 0.2 of a vector's norm for d = 64.
SAMPLE, ROUNDS, ETA = 8_192, 6, 2.6
#: Codes and queries that meet in a task, and vectors that are reranked for a query at least.
BLOCK_ROWS, BLOCK_QUERIES, RERANK = 65_536, 1_024, 256
#: Queries whose neighbours are found exactly to measure that number, the share of neighbours that it has to reach, and what it is multiplied by.
PROBES, RECALL, MARGIN = 48, 0.98, 1.5


def _assign(x: np.ndarray, books: np.ndarray, codes: np.ndarray | None, passes: int) -> np.ndarray:
    """Codes of the rows of ``x`` (n, s, 2) by coordinate descent on the score-aware loss."""
    n, s, _ = x.shape
    norm2 = np.maximum((x**2).sum((1, 2)), 1e-30)
    if codes is None:
        codes = np.stack([((x[:, j, None, :] - books[j][None]) ** 2).sum(2).argmin(1) for j in range(s)], 1)
    dots = np.stack([((x[:, j] - books[j][codes[:, j]]) * x[:, j]).sum(1) for j in range(s)], 1)
    total = dots.sum(1)
    for _ in range(passes):
        for j in range(s):
            r = x[:, j, None, :] - books[j][None]
            d = (r * x[:, j, None, :]).sum(2)
            loss = (r**2).sum(2) + (ETA - 1) * ((total - dots[:, j])[:, None] + d) ** 2 / norm2[:, None]
            codes[:, j] = loss.argmin(1)
            new = d[np.arange(n), codes[:, j]]
            total += new - dots[:, j]
            dots[:, j] = new
    return codes


def fit(sample: np.ndarray) -> np.ndarray:
    """Codebooks (s, 16, 2) for vectors of length 2 s."""
    n, d = sample.shape
    s, rng = d // 2, np.random.default_rng(3)
    x = sample.reshape(n, s, 2)
    books = np.stack([x[rng.choice(n, 16, replace=n < 16), j] for j in range(s)]).astype(np.float64)
    codes, scale = None, 1 / np.sqrt(np.maximum((sample**2).sum(1), 1e-30))
    for _ in range(ROUNDS):
        codes = _assign(x, books, codes, 1)
        z = np.zeros((n, d * 16), np.float32)
        rows = np.arange(n)
        b, count = np.zeros((d, 16)), np.zeros((d, 16))
        for j in range(d):
            z[rows, j * 16 + codes[:, j // 2]] = sample[:, j] * scale
            b[j] = np.bincount(codes[:, j // 2], sample[:, j], 16)
            count[j] = np.bincount(codes[:, j // 2], minlength=16)
        a = (ETA - 1) * (z.T @ z).astype(np.float64)
        a[np.diag_indices(d * 16)] += count.ravel() + 1e-6
        theta = np.linalg.solve(a, ETA * b.ravel() + 1e-6 * np.repeat(0.0, d * 16)).reshape(d, 16)
        used = count[::2] > 0
        fresh = theta.reshape(s, 2, 16).transpose(0, 2, 1)
        books = np.where(used[:, :, None], fresh, books)
    return books


def encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Two 4-bit codes in a byte: (n, ceil(s / 2)) uint8."""
    codes = _assign(x.reshape(len(x), -1, 2), books, None, 2).astype(np.uint8)
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, ::2] | codes[:, 1::2] << 4


def bytes_of(x: np.ndarray) -> np.ndarray:
    """A row's largest component (float64) and its components in 127ths of that: (n, 8 + d) uint8."""
    most = np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
    return np.concatenate([most.astype("<f8").view(np.uint8), np.round(x / most * 127).astype(np.int8).view(np.uint8)], 1)


def _finer(q: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """Products of queries (m, d) with rows of ``bytes_of``: (m, n)."""
    scale = np.ascontiguousarray(fine[:, :8]).view("<f8")[:, 0] / 127
    return (q @ np.ascontiguousarray(fine[:, 8:]).view(np.int8).astype(np.float64).T) * scale


def _tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Look-up tables of queries (m, bytes, 256): the products with both codes of a byte."""
    one = np.einsum("msd,skd->msk", q.reshape(len(q), -1, 2), books).astype(np.float32)
    if one.shape[1] % 2:
        one = np.concatenate([one, np.zeros((len(one), 1, 16), np.float32)], 1)
    return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(q), -1, 256)


def scan_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, books: np.ndarray, fine: np.ndarray, most: int, few: int) -> pd.DataFrame:
    """Of the ``most`` codes of a block with the largest estimated products for each query, the ``few`` with the largest finer ones: q, u, estimate."""
    keep, few = min(most, len(ids)), min(most, few, len(ids))
    found, rough = [], []
    for a in range(0, len(q), 64):
        tables = _tables(q[a : a + 64], books)
        score = np.zeros((len(tables), len(ids)), np.float32)
        for p in range(codes.shape[1]):
            score += np.take(tables[:, p], codes[:, p], axis=1)
        best = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.broadcast_to(np.arange(len(ids)), score.shape)
        for i, at in enumerate(best):
            finer = _finer(q[a + i : a + i + 1, : fine.shape[1] - 8], fine[at])[0]
            first = np.argpartition(-finer, few - 1)[:few] if few < keep else np.arange(keep)
            found.append(at[first])
            rough.append(finer[first])
    return pd.DataFrame({"q": np.repeat(q_ids, few), "u": ids[np.concatenate(found).ravel()], "estimate": np.concatenate(rough).ravel().astype(np.float64)})


def _scores(batch: pa.RecordBatch, q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact, estimated and finer estimated products (queries, rows) of a batch with columns v, codes and fine."""
    x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    tables = _tables(np.pad(q, ((0, 0), (0, q.shape[1] % 2))), books)
    rough = np.zeros((len(q), batch.num_rows), np.float32)
    for p in range(codes.shape[1]):
        rough += np.take(tables[:, p], codes[:, p], axis=1)
    fine = np.frombuffer(b"".join(batch.column("fine").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return q @ x.T, rough, _finer(q, fine)


def measured_depth(index: DataFrame, probes: np.ndarray, books: np.ndarray, k: int, share: float = RECALL) -> list[int]:
    """How many of the best estimates, and of the best finer ones, hold ``share`` of the ``k`` exact neighbours of the probes.

    Two passes over the index (v, codes, fine), each with all probes at once: tasks send their best ``k`` a probe, then counts.
    """
    held = index.sparkSession.sparkContext.broadcast((probes, books))

    @worker
    def exact(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            if batch.num_rows:
                score, rough, finer = _scores(batch, *held.value)
                for i in range(len(score)):
                    s, e, f = (np.append(a, b) for a, b in zip(best.get(i, (np.zeros(0), np.zeros(0, np.float32), np.zeros(0))), (score[i], rough[i], finer[i]), strict=True))
                    at = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                    best[i] = s[at], e[at], f[at]
        for i, (s, e, f) in best.items():
            yield pa.RecordBatch.from_pydict({"q": pa.array([i] * len(s), pa.int32())} | {c: pa.array(x.astype(np.float64), pa.float64()) for c, x in (("score", s), ("estimate", e), ("finer", f))})

    of = index.select("v", "codes", "fine")
    found = of.mapInArrow(exact, "q int, score double, estimate double, finer double")
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("estimate")))
    near = _grouped(found.withColumn("r", first).where(F.col("r") <= k).collect(), len(probes))
    marks = [[np.array([r[c] for r in rows], kind) for rows in near] for c, kind in (("estimate", np.float32), ("finer", np.float64))]

    @worker
    def place(batches):
        counts = [[np.zeros(len(m), np.int64) for m in kind] for kind in marks]
        for batch in batches:
            if batch.num_rows:
                for kind, scores, count in zip(marks, _scores(batch, *held.value)[1:], counts, strict=True):
                    scores = np.sort(scores, axis=1)
                    for i, m in enumerate(kind):
                        # sums in another order may differ in their last bits
                        count[i] += batch.num_rows - np.searchsorted(scores[i], m - np.abs(m) * m.dtype.type(1e-6), side="left")
        for kind, count in enumerate(counts):
            for i, c in enumerate(count):
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(c), pa.int32()), "q": pa.array([i] * len(c), pa.int32()), "j": pa.array(range(len(c)), pa.int32()), "n": pa.array(c, pa.int64())})

    rows = of.mapInArrow(place, "kind int, q int, j int, n long").groupBy("kind", "q", "j").agg(F.sum("n").alias("n")).collect()
    held.unpersist()
    places = [sorted(r["n"] for r in rows if r["kind"] == kind) for kind in (0, 1)]
    return [int(p[min(len(p) - 1, int(np.ceil(share * len(p))) - 1)]) if p else 0 for p in places]


def _grouped(rows: list, n: int) -> list[list]:
    out: list[list] = [[] for _ in range(n)]
    for r in rows:
        out[r["q"]].append(r)
    return out


def foremost(exact: DataFrame, k: int) -> DataFrame:
    """The first ``k`` + 1 vectors (q, score, ids) of each query vector: a query that is left out of its own ids moves only that vector, so its first ``k`` are among them."""
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]["vec_id"]))
    return exact.withColumn("r", first).where(F.col("r") <= k + 1).drop("r")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """The ``k`` rows of largest inner product for each row with ``is_query``: query_id, rank, vec_id, score.

    ``is_query``: a condition on column vec_id. Ties go to the lesser id. ``exact``: all vectors are reranked.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "ann")
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = sorted(((r["count"], r["d"]) for r in rows.groupBy(F.size("v").alias("d")).count().collect()), reverse=True)
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes[0][1]
    rows = rows.where(F.size("v") == d)
    odd = d % 2
    sample = np.array([r["v"] for r in hashed_sample(rows, "vec_id", SAMPLE, ["vec_id"]).collect()])
    one_thread()
    books = fit(np.pad(sample, ((0, 0), (0, odd))))
    pad = lambda v: np.pad(np.stack(v.to_numpy()), ((0, 0), (0, odd)))

    @pandas_udf("binary")
    def codes_of(v: pd.Series) -> pd.Series:
        one_thread()
        return pd.Series([c.tobytes() for c in encode(pad(v) if len(v) else np.zeros((0, d + odd)), books)])

    @pandas_udf("binary")
    def fine_of(v: pd.Series) -> pd.Series:
        return pd.Series([c.tobytes() for c in bytes_of(np.stack(v.to_numpy()))] if len(v) else [], dtype=object)

    # distinct vectors, each with its least ids: tasks drop the others before they are shuffled
    each = rows.groupBy("v", "vec_id").agg(F.count("*").alias("times"))
    least = each.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    index = least.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "times"))).alias("ids"))
    index = scratch.cut(index.withColumn("u", F.monotonically_increasing_id()).withColumn("codes", codes_of("v")).withColumn("fine", fine_of("v")))
    asked = rows.where(is_query).select("vec_id", "v").distinct().join(index.select("v", F.col("u").alias("q")), "v")
    asked = scratch.cut(asked.select("q", F.col("vec_id").alias("query_id"), "v"))
    queries = asked.dropDuplicates(["q"]).select("q", "v")

    size = index.count()
    probes = hashed_sample(queries, "q", PROBES, ["q"]).collect()
    depth = few = size
    if not exact and size > RERANK and probes:
        depth, few = (min(size, max(RERANK, int(MARGIN * n) + 1)) for n in measured_depth(index, np.array([r["v"] for r in probes]), books, k + 1))
    blocks = -(-size // BLOCK_ROWS)
    q_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    share = lambda n: min(n, 16 + -(-3 * n // blocks)) if blocks > 1 and n < size else n
    most, most_few = share(depth), share(few)
    dealt = lambda df, key, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    held = dealt(index.select("u", "codes", "fine"), "u", "block", blocks, "q_block", q_blocks)
    sent = dealt(queries, "q", "q_block", q_blocks, "block", blocks)

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "u": pd.Series(dtype="int64"), "estimate": pd.Series(dtype="float64")})
        one_thread()
        codes = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1)
        fine = np.frombuffer(b"".join(left["fine"]), np.uint8).reshape(len(left), -1)
        return scan_block(right["q"].to_numpy(), pad(right["v"]), left["u"].to_numpy(), codes, books, fine, most, most_few)

    found = held.groupBy("block", "q_block").cogroup(sent.groupBy("block", "q_block")).applyInPandas(scan, "q long, u long, estimate double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("estimate"), "u"))).where(F.col("r") <= few).select("q", "u")
    # exact products of the candidates, then of each query's ids
    product = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = best.join(index.select("u", "v", "ids"), "u").join(queries.select("q", F.col("v").alias("w")), "q").select("q", product.alias("score"), "ids")
    exact = foremost(exact, k)
    mine = asked.select("q", "query_id").join(exact, "q").withColumn("ids", F.filter("ids", lambda x: x["vec_id"] != F.col("query_id"))).where(F.size("ids") > 0)
    first = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.col("ids")[0]["vec_id"]))
    mine = mine.withColumn("r", first).where(F.col("r") <= k).select("query_id", "q", "score", F.explode("ids").alias("x"))
    mine = mine.select("query_id", "q", "score", F.col("x.vec_id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.least(F.col("x.times"), F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
