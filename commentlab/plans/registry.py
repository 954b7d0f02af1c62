
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn`` as query ``name``; ``sql`` is its oracle (omitted for non-SQL operators)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def r6(c: Column | str) -> Column:
    """Round to 6 places: float sums depend on order, so both engines compare rounded values."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    """Import every query module so that its queries register."""
    from commentlab.plans import (  # noqa: F401
        flagship,
        q_features,
        q_learn,
        q_metrics,
        q_order,
        q_sources,
        q_sql,
        q_stream,
        q_text,
        q_vocab,
    )
