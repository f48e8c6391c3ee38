"""All named queries of the library's core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from shelfmark.plans import general_queries, library_queries, record_queries

    return {**library_queries.QUERIES, **record_queries.QUERIES, **general_queries.QUERIES}
