"""Every registered query of the library, with equivalent SQL."""

from __future__ import annotations

from sluice.plans import queries_clean, queries_io, queries_logs, queries_shard, queries_sql, queries_stream, queries_text, queries_web

_MODULES = (queries_sql, queries_shard, queries_clean, queries_logs, queries_text, queries_web, queries_io, queries_stream)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
