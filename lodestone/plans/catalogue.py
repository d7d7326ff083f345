"""Registry of the document-analytics queries."""

from __future__ import annotations

from . import eval_queries, planning_queries, search_queries, sweep_queries, text_queries

QUERIES = {**text_queries.QUERIES, **search_queries.QUERIES, **eval_queries.QUERIES, **planning_queries.QUERIES, **sweep_queries.QUERIES}
ORACLE_SQL = {**text_queries.ORACLE_SQL, **search_queries.ORACLE_SQL, **eval_queries.ORACLE_SQL, **planning_queries.ORACLE_SQL, **sweep_queries.ORACLE_SQL}


def entry(spark, sf_dir):
    """The flagship query: every benchmark passage searched in all documents."""
    return search_queries.tfidf_search(spark, sf_dir)
