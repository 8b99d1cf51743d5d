"""Whitening of embeddings by the eigenvectors of a covariance that is put together from tiles.

Entries become whole numbers x = floor(``SCALE`` c) + ``SHIFT``, so that sums over all vectors are exact. A pair of
``TILE``-wide ranges of dimensions is a tile. Tasks cut their vectors into row-blocks and ship each block's
centred column blocks, keyed by the row-block; where a row-block's column blocks meet, each pair is multiplied,
and products are summed per tile in a fixed order. The driver sees one array a tile, bounded by the vectors'
length, assembles the matrix and decomposes it. Vectors are then projected where they lie. The covariance of the
whitened vectors is measured by the same tiles.

Vectors that are null, of another length than most (the longer of equally many), or hold null or non-finite
entries, or such of ``MOST`` or more in magnitude, take no part. Repeated rows count each, null ids stay null, other
columns are ignored. Components without variance (a share of the trace below ``LEAST``, as of copies of one
vector) can't be whitened and give no rows; neither does an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, packed_array, summed, worker

#: What entries are multiplied by before they are cut to whole numbers, what is added, and where they end.
SCALE, SHIFT, MOST = 1024, 100_000, float(1 << 40)
#: Vectors of a row-block, dimensions of a tile's side, and the share of the trace under which a variance is rounding.
BLOCK_ROWS, TILE, LEAST = 4_096, 16, 1e-13
COMPONENTS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whole_entries(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and the vectors as whole numbers x."""
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < MOST)))  # false where it isn't finite
    sizes = [tuple(r) for r in rows.groupBy(F.size("v").alias("d")).count().collect()]
    most = max(((n, d) for d, n in sizes if d), default=(0, 0))[1]
    return rows.where(F.size("v") == most).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors x and the sum of each dimension: a row for each dimension comes to the driver."""

    @worker
    def add(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                d = x.shape[1]
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(d), pa.int32()), "n": pa.array([len(x)] * d, pa.int64()), "s": pa.array(x.sum(0), pa.int64())})

    each = rows.select("x").mapInArrow(add, "k int, n long, s long")
    got = sorted(tuple(r) for r in each.groupBy("k").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)"))).collect())
    return (got[0][1], [int(s) for _, _, s in got]) if got else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: whole numbers of 64 bits, or of any size where those don't hold them."""
    if n * int(np.abs(x).max(initial=0)) >= 1 << 61:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def squares(dev: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if int(np.abs(dev).max(initial=0)) ** 2 * max(dev.shape[1], 1) >= 1 << 63:
        dev = dev.astype(object)
    return [int(s) for s in (dev * dev).sum(1)]


def covariance(rows: DataFrame, column: str, d: int, n: int, centre, tile: int = TILE) -> np.ndarray:
    """Covariance (d, d), divisor ``n``, of the vectors in ``column``; ``centre`` turns a matrix of them into centred doubles."""

    @worker
    def cut(batches):
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            x = centre(_matrix(batch.column(column))) if batch.num_rows else np.zeros((0, d))
            for a in range(0, len(x), BLOCK_ROWS):
                part = x[a : a + BLOCK_ROWS]
                sides = [np.ascontiguousarray(part[:, j : j + tile]).tobytes() for j in range(0, d, tile)]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(sides), pa.int64()), "side": pa.array(range(len(sides)), pa.int32()), "data": pa.array(sides, pa.binary())})
                block += 1

    def multiply(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ordered = sorted(zip(table.column("side").to_pylist(), table.column("data").to_pylist(), strict=True))
        sides = {j: np.frombuffer(raw, np.float64).reshape(-1, min(tile, d - j * tile)) for j, raw in ordered}
        found = [(i, j, sides[i].T @ sides[j]) for i in sides for j in sides if i <= j]
        return pa.table({"at": pa.array([i * len(sides) + j for i, j, _ in found], pa.int32()), "task": pa.array([block] * len(found), pa.int64()), "n": pa.array([p.size for *_, p in found], pa.int32()), "part": pa.array([packed_array(p) for *_, p in found], pa.binary())})

    blocks = rows.select(column).mapInArrow(cut, "block long, side int, data binary")
    tiles = summed(blocks.groupBy("block").applyInArrow(multiply, "at int, task long, n int, part binary"), "f8", "f8")
    out, count = np.zeros((d, d)), -(-d // tile)
    for at, part in tiles.items():
        i, j = at // count * tile, at % count * tile
        part = part.reshape(min(tile, d - i), min(tile, d - j))
        out[i : i + tile, j : j + tile] = part
        out[j : j + tile, i : i + tile] = part.T
    return out / n


@dataclass
class Whitening:
    """What is fitted: number of vectors and their sums; eigenvalues that are more than rounding, falling; eigenvectors as columns; the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, dev: np.ndarray) -> np.ndarray:
        """Whitened vectors from their deviations n x - S."""
        return (dev / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values))


def fit(rows: DataFrame, components: int) -> Whitening:
    """Fit on all ``rows`` (x); at most ``components`` are kept."""
    n, sums = exact_sums(rows)
    d = len(sums)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    values, vectors = np.linalg.eigh(covariance(rows, "x", d, n, lambda x: (deviations(x, n, sums) / n).astype(np.float64)))
    values, vectors, trace = values[::-1], vectors[:, ::-1], float(values.sum())
    kept = int((values[:components] > LEAST * trace).sum()) if trace > 0 else 0
    return Whitening(n, sums, values[:kept], vectors[:, :kept], trace)


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component (from 1): vec_id, component, n, deviation, whitened, explained, identity_error.

    deviation: sum of (n x - S)^2 over the dimensions, exact (null past 38 digits); explained: the component's share of
    the variance; identity_error: the largest entry of the whitened vectors' covariance minus the identity.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = scratch.cut(whole_entries(vectors, id_col, vector_col))
    w = fit(rows, components)
    k = len(w.values)
    if not k:
        return vectors.sparkSession.createDataFrame([], COMPONENTS)

    @worker
    def project(batches):
        for batch in batches:
            if batch.num_rows:
                dev = deviations(_matrix(batch.column("x")), w.n, w.sums)
                flat = pa.array(w.project(dev).ravel(), pa.float64())
                whole = [Decimal(s) if s < 10**38 else None for s in squares(dev)]
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "deviation": pa.array(whole, pa.decimal128(38, 0)), "w": pa.ListArray.from_arrays(pa.array(np.arange(len(dev) + 1, dtype=np.int32) * k), flat)})

    done = scratch.cut(rows.mapInArrow(project, "vec_id long, deviation decimal(38,0), w array<double>"))
    mean = np.array(done.agg(*[F.avg(F.col("w")[i]) for i in range(k)]).first(), float)
    off = covariance(done, "w", k, w.n, lambda x: x - mean) - np.eye(k)
    shares = F.array(*[F.lit(float(v / w.trace)) for v in w.values])
    out = done.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(float(np.abs(off).max())).alias("identity_error"))
