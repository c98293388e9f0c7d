"""All queries outside the llm subpackage, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a function under its name, with the DuckDB SQL of the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


from tickplane.plans import cell_queries, codec_queries, corpus_queries, measure_queries, media_queries, scalar_queries, timeline_queries  # noqa: E402, F401
