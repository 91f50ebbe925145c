"""Rates, levels and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assentlake import fixed


def _rate(hits: Column, messages: Column, factor: int) -> Column:
    # Half-up to two digits in integers: ties never depend on the binary error of a double.
    cents = F.call_function(
        "div", hits * F.lit(200 * factor) + messages, F.nullif(messages, F.lit(0)) * F.lit(2)
    )
    return F.when(messages > 0, cents / F.lit(100.0)).otherwise(F.lit(0.0))


def per_hundred(hits: Column, messages: Column) -> Column:
    return _rate(hits, messages, 100)


def per_thousand(hits: Column, messages: Column) -> Column:
    """Hits per thousand messages, rounded to two digits; 0 without messages."""
    return _rate(hits, messages, 1000)


def classify_level(mdi: Column) -> Column:
    """Level 0 to 4 of a per-thousand rate."""
    out = F.lit(fixed.LEVELS[-1][1])
    for bound, level, *_ in reversed(fixed.LEVELS[:-1]):
        out = F.when(mdi <= bound, level).otherwise(out)
    return out


def level_struct(mdi: Column) -> Column:
    """Level with its name, badge, tagline and colour."""
    def describe(level: int, badge: str, tagline: str, colour: str) -> Column:
        return F.struct(
            F.lit(level).alias("level"),
            F.lit(f"{badge} (Level {level})").alias("name"),
            F.lit(badge).alias("badge"),
            F.lit(tagline).alias("tagline"),
            F.lit(colour).alias("color"),
        )

    out = describe(*fixed.LEVELS[-1][1:])
    for bound, *rest in reversed(fixed.LEVELS[:-1]):
        out = F.when(mdi <= bound, describe(*rest)).otherwise(out)
    return out


def shrunk_score(
    hits: Column, messages: Column, prior_rate: Column, mass: int = fixed.PRIOR_MASS
) -> Column:
    """Per-thousand rate pulled towards the prior by ``mass`` pseudo-messages."""
    return (hits + F.lit(mass) * prior_rate) / (messages + F.lit(mass)) * F.lit(1000.0)


def reconcile_mdi(reported: Column, hits: Column, messages: Column) -> Column:
    """Keep a reported rate only if it agrees with the counts, else recompute it.

    ``reported`` is NULL when it is missing, negative or not finite.
    """
    exact = hits.cast("double") / F.nullif(messages, F.lit(0)).cast("double") * F.lit(1000.0)
    tolerance = F.greatest(exact * F.lit(0.01), F.lit(0.001))
    value = F.when(F.abs(reported - exact) <= tolerance, reported).otherwise(exact)
    # floor(x + 0.5) is the half-up rule of the stored values.
    rounded = F.floor(value * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(1000.0)
    return F.when(messages > 0, rounded).otherwise(F.lit(0.0))
