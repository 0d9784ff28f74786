"""All queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import index_queries, oracles, stream_queries
from textloom.plans import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**q.QUERY_FUNCTIONS, **index_queries.QUERY_FUNCTIONS, **stream_queries.QUERY_FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    both = {**oracles.SQL, **index_queries.SQL, **stream_queries.SQL}
    return both | {"hybrid_indexed": both["hybrid_topk"], "cosine_indexed": both["cosine_topk"], "grep_indexed": both["grep_lines"]}
