"""Registered queries: each Spark plan and its independent DuckDB oracle.

Every query reads the lake's tables (through the fixtures, which derive
snapshot-shaped inputs from them) so its work grows with the data. Oracles
are written in the reference's own shape where one exists (triangular join,
recursive CTE, correlated subqueries), so they check the Spark rewrite.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from dbpulse.plans import queries_core, queries_keyed  # noqa: F401
