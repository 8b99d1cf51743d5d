"""All queries of the capture and latency analytics, by operator id, with SQL for comparison."""

from __future__ import annotations

from .plans import files, protocols, queries, sqltext, streams, totals

QUERIES = queries.QUERIES | totals.QUERIES | protocols.QUERIES | files.QUERIES | streams.QUERIES | sqltext.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | totals.ORACLE_SQL | protocols.ORACLE_SQL | files.ORACLE_SQL | streams.ORACLE_SQL | sqltext.ORACLE_SQL
FLAGSHIP = "A15_rtt_summary"
