"""All registered queries of the library and the SQL that states the same result."""

from __future__ import annotations

from fieldtrust.plans import chain_queries, dimension_queries, evaluate_queries, job_queries, merge_queries, ops_queries, text_queries

MODULES = (text_queries, merge_queries, evaluate_queries, ops_queries, job_queries, dimension_queries, chain_queries)
QUERIES = {k: v for m in MODULES for k, v in m.R.queries.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.R.sql.items()}
