"""Token files: flat unsigned integers plus 64-bit document offsets, read back by memory map.

Layout of a folder, for each part p (parts in ascending id order):
``p.tok`` token ids, little-endian unsigned 16 bit where the vocabulary fits, else 32 bit;
``p.off`` little-endian int64 token offsets of the part's documents, one more than documents;
``p.ids`` an Arrow file with the documents' ids. ``manifest.json`` has the width and, for each part,
its documents, tokens and bases, which are prefix sums over the parts.

Null text counts as empty (only the end id); null ids come first; repeated ids each keep their
place, ordered by a hash of the text, so that they may fill many parts; an empty table gives a manifest
without parts. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import tempfile
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_path, new_file, put_file, slices, worker


#: Text of a part, about.
PART_BYTES = 64 << 20
#: Text that is tokenised at once.
SLICE = 16 << 20


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Tokenise whole texts in ascending id order into files below ``folder``; returns the manifest.

    One range shuffle orders the texts, in parts of about ``PART_BYTES`` of text (or as many as the session's
    shuffles have). A task streams its part's documents into the files and holds their ids and offsets. The
    driver sees one row for each part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // PART_BYTES)
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    @worker
    def write(batches):
        from .tokens import encoder

        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        kind = np.dtype("<u2" if max(enc.model.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        counts, ids = [], []
        name = f"{folder}/{part:08d}"
        first = next(batches, None)
        if first is None:
            return
        with new_file(f"{name}.tok") as file:
            for batch in chain([first], batches):
                for piece in slices(batch, most=SLICE):
                    tok, off = enc.encode(piece.column("text"), end_id)
                    file.write(tok.astype(kind).tobytes())
                    counts.append(np.diff(off))
                    ids.append(piece.column("doc_id"))
        enc.forget()
        offsets = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))).astype("<i8")
        put_file(f"{name}.off", offsets.tobytes())
        with new_file(f"{name}.ids") as file, pa.ipc.new_file(file, pa.schema([("doc_id", pa.int64())])) as w:
            w.write_table(pa.table({"doc_id": pa.chunked_array(ids, pa.int64())}))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "docs": pa.array([len(offsets) - 1], pa.int64()), "tokens": pa.array([offsets[-1]], pa.int64()), "width": pa.array([kind.itemsize], pa.int64())})

    parts = sorted(tuple(r) for r in rows.mapInArrow(write, "part long, docs long, tokens long, width long").collect())
    manifest, docs_before, tokens_before = {"width": parts[0][3] if parts else 2, "parts": []}, 0, 0
    for part, n_docs, n_tokens, _ in parts:
        manifest["parts"].append({"part": part, "docs": n_docs, "tokens": n_tokens, "doc_base": docs_before, "token_base": tokens_before})
        docs_before, tokens_before = docs_before + n_docs, tokens_before + n_tokens
    put_file(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return manifest


def open_part(folder: str, part: int, width: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A part's tokens and offsets (memory-mapped) and document ids. A remote file is mapped from a temporary copy that goes with the map."""
    name = f"{folder}/{part:08d}"

    def mapped(path: str, kind: str) -> np.ndarray:
        found, copy = local_path(path), None
        if found is None:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            with store.open_input_stream(inner) as f, tempfile.NamedTemporaryFile(delete=False) as copy:
                while block := f.read(1 << 22):
                    copy.write(block)
            found = copy.name
        try:
            return np.memmap(found, dtype=kind, mode="r") if os.path.getsize(found) else np.zeros(0, kind)
        finally:
            if copy is not None:
                os.remove(found)  # the map keeps the bytes

    ids = pa.ipc.open_file(pa.py_buffer(mapped(f"{name}.ids", "u1"))).read_all().column("doc_id").combine_chunks()
    return mapped(f"{name}.tok", f"<u{width}"), mapped(f"{name}.off", "<i8"), ids


def read_token_files(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    bases = {p["part"]: p["token_base"] for p in manifest["parts"]}
    if not bases:
        return spark.createDataFrame([], schema)
    width = manifest["width"]

    @worker
    def read(batches):
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                tok, off, ids = open_part(folder, part, width)
                crc = [zlib.crc32(tok[a:b].astype("<u4").tobytes()) for a, b in zip(off, off[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(base + off[:-1], pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = spark.createDataFrame(list(bases.items()), "part long, base long").repartition(len(bases), "part")
    return parts.mapInArrow(read, schema)
