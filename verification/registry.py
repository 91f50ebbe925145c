"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assentlake.session import configure
from verification.relations import Relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of Relations as a query of (spark, folder)."""
    def register(function: Callable[[Relations], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark, "UTC")
            return function(Relations(spark, folder))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register
