"""Registry of named queries (driver contract) and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
# queries compared on rows only (no exact SQL twin); value: reason
ROWS_ONLY: dict[str, str] = {}


def register(name: str, sql: str | None = None, rows_only: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB twin; when it is omitted ``rows_only`` must say why.
    """
    if sql is None and rows_only is None:
        raise ValueError(f"{name}: give an oracle SQL or a rows-only reason")

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        else:
            ROWS_ONLY[name] = rows_only
        return fn

    return deco


def with_ctes(*ctes: str, body: str, recursive: bool = False) -> str:
    """``WITH cte1, cte2 ... body`` from CTE snippets."""
    parts = [c.strip().rstrip(",") for c in ctes if c.strip()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body.strip()


def load_all() -> None:
    """Import every query module so that they register themselves."""
    from pressline.plans import (  # noqa: F401
        q_eval,
        q_packing,
        q_posttrain,
        q_runlog,
        q_schedule,
        q_sources,
        q_streaming,
        q_tensors,
        q_text,
        q_trained,
        q_vectors,
    )
