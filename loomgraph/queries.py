"""Registry of the engine's own queries and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import bind_graph, bind_memory, bind_more, bind_sources, bind_text

_MODULES = (bind_graph, bind_text, bind_memory, bind_sources, bind_more)


def _shipped(run: Callable) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bind_sources.ship(spark)
        return run(spark, sf_dir)

    return query


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(run) for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def core_oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lookup with tracing both ways, as places in files."""
    return bind_graph.diagnose(spark, sf_dir)
