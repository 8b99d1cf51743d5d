"""Shared helpers of the training-data operators: scratch tables, text slices, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import glob
import os
import tempfile
import threading
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Characters of text that a Python worker handles at once.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session in one JVM (tests) may name none: it gets a temporary folder. On a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN_DIR.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN_DIR[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="hopscope-")
    return found.rstrip("/")


#: Folders of sessions in one JVM (``local``) that name no shared one.
_OWN_DIR: dict[str, str] = {}


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes them.

    Unlike a local checkpoint they survive the loss of any executor.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        for made in _notes():
            made.append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def folder(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n}"

    def forget(self, *dfs: DataFrame) -> None:
        """Remove tables that no later step reads."""
        for df in dfs:
            remove(self.spark, df._scratch_path)

    def drop(self) -> None:
        remove(self.spark, self.root)


_NOTES = threading.local()


def _notes() -> list[list[Scratch]]:
    """The lists of this thread that scratch tables are noted in."""
    if not hasattr(_NOTES, "lists"):
        _NOTES.lists = []
    return _NOTES.lists


@contextlib.contextmanager
def noting(made: list[Scratch]):
    """Add the scratch tables that this thread makes inside to ``made``."""
    _notes().append(made)
    try:
        yield made
    finally:
        _notes().pop()


def drop_all(made: list[Scratch]) -> None:
    """Drop noted scratch tables; call only when no DataFrame over them is in use."""
    while made:
        made.pop().drop()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_path(uri: str) -> str | None:
    """The plain path of a ``file:`` URI or path; None for a remote store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


@contextlib.contextmanager
def new_file(uri: str):
    """A file to write to that appears whole or not at all: a retried or speculative task replaces it with equal bytes."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        try:
            with open(tmp, "wb") as f:
                yield f
            os.replace(tmp, path)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(tmp)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(inner), recursive=True)
    tmp = f"{inner}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(tmp) as f:
        yield f
    store.move(tmp, inner)


def put_file(uri: str, data: bytes) -> None:
    with new_file(uri) as f:
        f.write(data)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _TRIM = lambda n: 0


def give_back() -> None:
    """Return memory that this process has freed to the system; reused Python workers would keep it."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


@functools.cache
def one_thread() -> None:
    """Let this process multiply matrices in one thread: a task has one core, and threads that wait for each other burn more."""
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def worker(f):
    """A function of a stream of batches that uses one thread, and gives memory back when it ends."""

    @functools.wraps(f)
    def run(batches):
        one_thread()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def col(name: str):
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_names(keep: list[str], outputs: list[str]) -> list[str]:
    """Names of kept columns in a result: one that an output has too gets underscores at its end."""
    taken, out = {x.lower() for x in outputs}, []
    for name in keep:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def packed_array(x: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(np.ascontiguousarray(x).tobytes(), asbytes=True)


def _unpacked(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(raw, n * np.dtype(kind).itemsize, asbytes=True), kind)


def summed(parts: DataFrame, kind: str, total: str, spread: int = 256) -> dict[int, np.ndarray]:
    """Elementwise sums of the arrays that tasks sent: ``parts`` has at, task, n and part (``packed_array`` of ``n`` numbers of ``kind``).

    Sums are taken in two levels, so that no group holds the arrays of all tasks; whole numbers stop at the greatest of type ``total``.
    The driver gets one array for each ``at``.
    """

    def add(kind):
        def run(table):
            n = table.column("n")[0].as_py()
            out = np.zeros(n, np.int64 if np.dtype(total).kind in "iu" else np.float64)
            for raw in table.sort_by("task").column("part").to_pylist():  # in a fixed order
                out += _unpacked(raw, kind, n)
            if np.dtype(total).kind in "iu":
                out = np.minimum(out, np.iinfo(total).max)
            out = out.astype(total)
            return pa.table({"at": table.column("at")[:1].cast(pa.int32()), "task": pa.array([table.column("task")[0].as_py() % spread], pa.int64()), "n": pa.array([n], pa.int32()), "part": pa.array([packed_array(out)], pa.binary())})

        return run

    schema = "at int, task long, n int, part binary"
    some = parts.withColumn("g", F.pmod("task", F.lit(spread))).groupBy("at", "g").applyInArrow(add(kind), schema)
    rows = some.groupBy("at").applyInArrow(add(total), schema).collect()
    return {r["at"]: _unpacked(bytes(r["part"]), total, r["n"]) for r in rows}


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Cut a batch into runs of rows of about ``most`` bytes of ``column``, so that memory is bounded by it or one row.

    Each run is a copy: kernels such as pyarrow's ascii_lower misread arrays that begin inside a larger one.
    """
    n = batch.num_rows
    if n == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.take(pa.array(np.arange(a, b, dtype=np.int64)))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words ``[^ \\t-\\r]+`` of all texts in one array, and offsets of each text's words. Null: none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat, off = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    off = off - off[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        at = np.zeros(len(full) + 1, np.int64)
        np.cumsum(full, out=at[1:])
        flat, off = flat.filter(pa.array(full)), at[off]
    return flat, off


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of strings: two crc32 passes joined and mixed."""
    out = np.empty(len(words), np.uint64)
    crc = zlib.crc32
    for i, w in enumerate(words.to_pylist()):
        b = w.encode()
        out[i] = (crc(b) << 32) | crc(b, 0x9E3779B9)
    return mix64(out)


def passed_schema(df: DataFrame, keep: list[str], ddl: str) -> StructType:
    """Fields _0, _1, ... of the types of ``keep`` in ``df``, and those of ``ddl``."""
    return StructType([StructField(f"_{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + StructType.fromDDL(ddl).fields)


def held(column: str, mod: int, is_: int):
    """crc32 of the id as text, modulo ``mod``, equals ``is_``. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod == is_


def most_frequent(counts: DataFrame, key: str, count: str, most: int) -> DataFrame:
    """Rows of ``counts`` from the highest count down, at most ``most`` of them: all of a class of similar counts or none.

    A threshold is found from a few hundred totals first, so that no task sends candidates of its own to the driver.
    """
    step = F.floor(F.log2(count) * 16).cast("int")
    total, low = 0, None
    for r in sorted((tuple(r) for r in counts.groupBy(step.alias("b")).count().collect()), reverse=True):
        total += r[1]
        if total > most:
            break
        low = r[0]
    return counts.where(step >= low) if low is not None else counts.where("false")


def small(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of a few columns, to be broadcast if it has at most ``most`` rows; beyond that Spark joins it by shuffling."""
    return F.broadcast(table) if table.count() <= most else table


def hashed_sample(rows: DataFrame, key, most: int, order: list[str]) -> DataFrame:
    """About ``most`` rows, at most ``most``, chosen by a hash of ``key``: a share of all rows is cut first, then ordered."""
    n = rows.count()
    u = F.pmod(F.xxhash64(key, F.lit(97)), F.lit(1_000_000_007))
    if n > most:
        rows = rows.where(u < int(1_000_000_007 * 1.5 * most / n) + 1)
    return rows.orderBy(u, *order).limit(most)
