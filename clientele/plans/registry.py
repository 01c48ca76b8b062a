"""The runnable queries: a Spark callable each, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, oracle)
        return run
    return register


def all_queries() -> dict[str, Query]:
    # Importing the sections registers their queries.
    from clientele.plans import (  # noqa: F401
        ab_queries, aggregate_queries, customer_queries, feature_queries, lifetime_queries,
        model_queries, profile_queries,
        scalar_queries,
        source_queries)
    return QUERIES
