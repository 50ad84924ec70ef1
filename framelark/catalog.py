"""Registry of the engine's queries: name -> (Spark callable), and the SQL that checks it."""

from __future__ import annotations

from framelark.plans import eval_queries, file_queries, media_queries, perf_queries, run_queries, setup_queries, stream_queries, text_queries, trim_queries, vector_queries

_PARTS = (trim_queries, eval_queries, perf_queries, vector_queries, text_queries, stream_queries, setup_queries, media_queries, file_queries, run_queries)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE: dict = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
