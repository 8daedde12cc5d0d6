"""All queries by name, with the SQL that an independent engine runs to the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: DuckDB's view of ``line_chunks``.
CHUNKS = """
    SELECT doc_id, (i - 1)::BIGINT AS ordinal, content FROM (
        SELECT doc_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents))
"""
#: DuckDB's list of a text's scoring terms.
TERMS = """list_filter(list_transform(regexp_extract_all({0}, '[0-9A-Za-z_]+|[\\x{{3400}}-\\x{{9fff}}]'), lambda t: lower(t)),
    lambda t: t NOT IN ('a', 'an', 'and', 'are', 'be', 'by', 'for', 'in', 'is', 'of', 'on', 'or', 'the', 'to'))"""
#: DuckDB's rounded cosine distance of two float lists.
DISTANCE = "round(1 - list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 9) + 0.0"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def load() -> None:
    """Imports the modules that hold queries."""
    from lectern.plans import analysis, core, documents, graphs, retrieval, streams  # noqa: F401
