"""Queries as SQL text that calls the registered functions."""

from __future__ import annotations

from ..functions import sql
from . import queries as q
from .queries import query

_before = set(q.QUERIES)


def by_sql(name: str, text: str, oracle: str, view: str) -> None:
    """Register a query that runs SQL ``text`` over its view {v}."""

    @query(name, oracle, view)
    def run(df):
        sql.register(df.sparkSession)
        return df.sparkSession.sql(text, v=df)


def _same_as(name: str) -> str:
    """The SQL of another query, without its views."""
    return q.ORACLE_SQL[name].rsplit("\n", 1)[-1]


by_sql("X4_sql_ip_number", "SELECT DISTINCT dst, ip_number(dst) AS strict, ip_number_loose(dst) AS loose FROM {v}", _same_as("X4_ip_number"), "packet")
by_sql("X10_sql_api_counts", "SELECT api_of(uri) AS api, count(*) AS n FROM {v} GROUP BY api_of(uri)", f"SELECT api, count(*) AS n FROM ({_same_as('X10_api')}) GROUP BY api", "raw_uri")
by_sql("X11_sql_mask_ids", "SELECT page_id, mask_ids(concat(url, '/', page_id * 123457, '/deadbeef', page_id)) AS masked FROM {v}", _same_as("X11_mask_ids"), "url")
by_sql("X21_sql_static_segments", "SELECT page_id, static_segments(regexp_replace(url, '^[a-z]+://', '')) AS kept FROM {v}", _same_as("X21_static_segments"), "url")
by_sql("F22_sql_public", "SELECT count(*) AS n, coalesce(sum(frame), 0) AS frames FROM {v} WHERE is_public_number(ip_number(dst))", _same_as("F22_public"), "packet")
by_sql("X8_sql_protocol", "SELECT protocol_of(dport) AS protocol, count(*) AS n FROM {v} WHERE protocol_of(dport) IS NOT NULL GROUP BY ALL", f"SELECT protocol, n FROM (SELECT protocol, sum(n)::BIGINT AS n FROM ({_same_as('X8_protocol')}) WHERE protocol <> 'unknown' GROUP BY protocol)", "packet")

QUERIES = {k: v for k, v in q.QUERIES.items() if k not in _before}
ORACLE_SQL = {k: v for k, v in q.ORACLE_SQL.items() if k in QUERIES}
