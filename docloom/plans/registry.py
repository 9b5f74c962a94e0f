"""All queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from docloom.plans import chunking_queries, document_queries, job_queries, quality_queries, refine_queries, review_queries, rollup_queries, store_queries, stream_queries, text_queries, tree_queries

FLAGSHIP = "c20_chunk_statistics"
_MODULES = [text_queries, document_queries, chunking_queries, job_queries, tree_queries, quality_queries, store_queries, stream_queries, rollup_queries, refine_queries, review_queries]
QUERIES: dict = {name: q for module in _MODULES for name, q in module.registry.queries.items()}
SQL: dict = {name: s for module in _MODULES for name, s in module.registry.sql.items()}
