"""The queries of this package, kept apart from those of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clientele.llm.common import ready

Run = Callable[[SparkSession, str], DataFrame]
RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def keep(run: Run) -> Run:
        RUNS[name] = lambda spark, sf_dir: run(ready(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return run
    return keep
