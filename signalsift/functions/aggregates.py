"""Named aggregates, so that a configuration can ask for ``{"sinr_db": ("mean",)}``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


AGGREGATES: dict[str, Callable[[str], Column]] = {
    "mean": lambda c: _or_zero(F.avg(c)),
    "std": lambda c: _or_zero(F.stddev_pop(c)),
    "min": lambda c: _or_zero(F.min(F.col(c).cast("double"))),
    "max": lambda c: _or_zero(F.max(F.col(c).cast("double"))),
    "mode": lambda c: F.coalesce(F.mode(F.col(c).cast("int"), True), F.lit(0)),
    "sum": lambda c: _or_zero(F.sum(F.col(c).cast("double"))),
    "sample_std": lambda c: F.stddev_samp(c),
    "count": lambda c: F.count(c),
    "nulls": lambda c: F.count_if(F.col(c).isNull()),
}


def register_aggregate(name: str, build: Callable[[str], Column]) -> None:
    """Add an aggregate under a name; it must return an aggregate Column."""
    AGGREGATES[name] = build


def aggregate(name: str, column: str) -> Column:
    return AGGREGATES[name](column)


def stripped(column: str, suffixes: tuple[str, ...]) -> str:
    """Column name without its unit."""
    for suffix in suffixes:
        column = column.replace(suffix, "")
    return column
