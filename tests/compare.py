"""Run queries against DuckDB on the same tables; ``python tests/compare.py [sf_dir] [name...]`` prints what differs."""

from __future__ import annotations

import glob
import math
import os
import sys


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return bytes(v) if isinstance(v, bytearray) else v


def duckdb_views(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def difference(spark, con, sf_dir: str, run, sql: str) -> str:
    """What differs, or an empty string."""
    got = run(spark, sf_dir)
    want = con.sql(sql)
    names = sorted(got.columns)
    if names != sorted(want.columns):
        return f"columns {names} and {sorted(want.columns)}"
    order = [want.columns.index(c) for c in names]
    a = sorted((tuple(_plain(v) for v in r) for r in got.select(*names).collect()), key=repr)
    b = sorted((tuple(_plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    if a == b:
        return ""
    pairs = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:3]
    return f"{len(a)} and {len(b)} rows; {pairs}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from conftest import session

    from hopscope import catalog

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), duckdb_views(folder)
    for name in sys.argv[2:] or catalog.QUERIES:
        try:
            if name in catalog.ORACLE_SQL:
                if text := difference(spark, con, folder, catalog.QUERIES[name], catalog.ORACLE_SQL[name]):
                    print(name, text[:600])
            else:
                print(name, "rows", catalog.QUERIES[name](spark, folder).count())
        except Exception as e:
            print(name, "failed:", str(e)[:700])
