"""Steps over ordered arrays that stay inside one expression and do not grow with the square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _halvings(values: Column) -> Column:
    """0, 1, ... as often as the length can be halved, and once at least."""
    return F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each place the combination of all values up to it, such as sums or greatest values.

    By doubling: each step combines a place with the one 1, 2, 4, ... before it. ``combine`` is
    associative and takes the earlier value first.
    """

    def step(done: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(
            done, lambda x, i: F.when(i >= back, combine(F.get(done, i - back), x)).otherwise(x)
        )

    return F.aggregate(_halvings(values), values, step)


def leading(values: Column, holds: Callable[[Column], Column]) -> Column:
    """How many values at the front satisfy ``holds``, which no value behind them does."""

    def halve(span: Column, _: Column) -> Column:
        low, high = span["low"], span["high"]
        middle = F.shiftright(low + high, 1)
        return F.when(low >= high, span).when(
            holds(F.get(values, middle)), F.struct((middle + 1).alias("low"), high.alias("high"))
        ).otherwise(F.struct(low.alias("low"), middle.alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    return F.aggregate(_halvings(values), start, halve, lambda span: span["low"])
