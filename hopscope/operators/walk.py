"""Ordered walks over the rows of each key, as a stream: only what a step keeps is held in memory."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def walk(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], fields: list[StructField], begin: Callable) -> DataFrame:
    """Go over each key's rows in ``order``. ``begin()`` gives a function of a row's ``columns`` that returns result rows (``fields``),
    or it and a function that returns result rows after the key's last row.

    Rows are shuffled once by their keys and sorted with spilling; results have the keys before the fields.
    """
    schema = StructType([rows.schema[c] for c in keys] + fields)
    names = schema.fieldNames()
    kept = rows.select(*dict.fromkeys([*keys, *order, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order)
    empty = rows.sparkSession.createDataFrame([], schema)
    kinds = dict(zip(names, empty.toArrow().schema.types, strict=True))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

    def run(batches):
        key, step, end = None, None, None
        for batch in batches:
            every = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            own = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            out = []
            for k, row in zip(every, own, strict=True):
                if step is None or k != key:
                    if end is not None:
                        out += [(*key, *r) for r in end()]
                    key, step = k, begin()
                    step, end = step if isinstance(step, tuple) else (step, None)
                out += [(*k, *r) for r in step(*row)]
            if out:
                yield batch_of(out)
        if end is not None and (out := [(*key, *r) for r in end()]):
            yield batch_of(out)

    return kept.mapInArrow(run, schema)
