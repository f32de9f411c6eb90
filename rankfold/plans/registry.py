"""Registry of named queries: a Spark builder plus, where SQL can express the
same result, an ANSI SQL oracle text that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    bench: bool = False


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, bench: bool = False):
    def deco(fn: Builder) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            from rankfold.session import ship_package
            ship_package(spark)
            return fn(spark, sf_dir)
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        QUERIES[name] = Query(name, build, sql, bench)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from rankfold.plans import (  # noqa: F401
        q_ingest, q_lookup, q_stats, q_changes, q_content, q_collab, q_blend, q_factors, q_requests,
        q_records, q_store, q_stream,
    )
    return QUERIES
