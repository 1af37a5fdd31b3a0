"""Sums and rounding that give the same bits whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_BITS = 20


def rounded(value: Column, places: int = 0) -> Column:
    """Half-to-even at the given number of places, computed on doubles."""
    if places == 0:
        return F.rint(value)
    scale = float(10**places)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def exact_sum(value: Column, scale: int = 4) -> Column:
    """Sum to ``scale`` places, the same whatever the row order.

    Each value becomes a whole number of the last place, kept as two machine words (the low 20
    bits and the rest) so that neither sum can overflow; only the two totals meet as decimals.
    Per row this costs about as much as a sum of doubles, and a fraction of a sum of decimals.
    """
    whole = F.rint(value * F.lit(float(10**scale))).cast("long")
    high = F.sum(F.shiftright(whole, LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(whole.bitwiseAND(F.lit((1 << LOW_BITS) - 1))).cast("decimal(20,0)")
    return (high * F.lit(1 << LOW_BITS) + low).cast("double") / F.lit(float(10**scale))


def exact_avg(value: Column, scale: int = 4) -> Column:
    return exact_sum(value, scale) / F.count(value)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL on a zero divisor."""
    return F.try_divide(top, bottom)


def clip(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)
