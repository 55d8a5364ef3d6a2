"""Registry of named queries: Spark builder + DuckDB oracle SQL (or None = rows-only)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules fills REGISTRY.
    from kwspread.plans import (  # noqa: F401
        candidate_queries,
        diffusion_queries,
        matching_queries,
        page_queries,
        presence_queries,
        source_queries,
        stream_queries,
        thread_queries,
    )

    return REGISTRY
