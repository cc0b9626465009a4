"""Null-safe numeric column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them.

    NaN is larger than any number in Spark, so one comparison covers both.
    """
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    """Limit to [low, high]; NULL stays NULL (``least``/``greatest`` alone skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, _column(low)), _column(high)))


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def half_even(c: Column) -> Column:
    """Round to a whole number, halves to the even neighbour."""
    return F.rint(c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL on a zero denominator, also in ANSI mode."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def count_true(predicate: Column) -> Column:
    return F.count_if(predicate)


def steps_reached(c: Column, edges: Sequence[float], inclusive: bool = True) -> Column:
    """How many of the ascending ``edges`` the value has reached.

    ``inclusive`` counts an edge equal to the value. The comparisons form a
    balanced tree of CASE expressions: log2(n) tests for a row, inside code
    generation, where ``filter`` over an array would test every edge.
    """
    edges = sorted(edges)

    def branch(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        edge = F.lit(float(edges[middle]))
        reached = (c >= edge) if inclusive else (c > edge)
        return F.when(reached, branch(middle + 1, high)).otherwise(branch(low, middle))

    return F.when(c.isNull(), None).otherwise(branch(0, len(edges)))


def equal_width_bin(c: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """Bin 0 … bins-1 of a value in [low, high]; the top edge is in the last bin."""
    low, high = _column(low), _column(high)
    place = F.floor(ratio(c - low, high - low) * bins)
    return F.when(c.isNull(), None).otherwise(
        F.greatest(F.lit(0), F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))).cast("int")
    )
