"""Joining, stacking, sorting and picking rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_KEY = ("scenario_id", "ts_start_ns")


def join_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Features, labels and scores of the same window, by key instead of by row position."""
    return left.join(right, list(keys), "inner")


def repeated_keys(df: DataFrame, keys: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Keys that occur more than once; empty for a table that may be joined."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables below each other, columns matched by name, absent ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def sort_in_files(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order inside each partition: what a sink needs, without a full sort."""
    return df.sortWithinPartitions(*keys)


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of an order; each task keeps only ``k``."""
    return df.orderBy(*order).limit(k)


def best_row(df: DataFrame, groups: Sequence[str], score: str, tie: str) -> DataFrame:
    """Per group the row with the highest score, the lowest ``tie`` on equal scores.

    An aggregate (largest struct), so a large group is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in groups]
    rank = F.struct(F.col(score), -F.col(tie))
    chosen = F.max_by(F.struct(*rest), rank)
    picked = df.groupBy(*groups).agg(chosen.alias("__best")) if groups else df.agg(chosen.alias("__best"))
    return picked.select(*groups, "__best.*")
