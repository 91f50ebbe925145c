"""A name for a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once although the body uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, however many filters look at it.

    A filter on a plain computed column is pushed below the projection, with the whole
    expression copied into it: a JSON text would be parsed again for every test. Filters on
    the output of a generator stay above it. The outer form keeps rows with a NULL.
    """
    others = [F.col(c) for c in df.columns if c != name]
    return df.select(*others, F.explode_outer(F.array(value)).alias(name))
