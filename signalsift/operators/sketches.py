"""Profiles that are kept per part of a table (a file, a day) and merged.

A part is read once. What is stored of it is one row per column: counts and
extremes, which merge exactly, a HyperLogLog sketch of the different values and a
KLL sketch of the quantiles, which merge within a stated error. The profile
of all parts, or of any choice of them, is an aggregate over these few rows, so a
table that grows by a part costs one pass over that part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct sketch, as a power of two: a relative standard error of 0.8 per cent.
DISTINCT_BITS = 14
#: Relative error of a distinct count that three standard errors allow.
DISTINCT_ERROR = 0.025
#: Size of a quantile sketch; its rank error is below half a per cent with 99 per cent confidence.
QUANTILE_SIZE = 1000
#: Error of a quantile's rank that is promised, twice the above.
RANK_ERROR = 0.01

_KEPT = ("n", "nulls", "low", "high", "different", "ranks")


def _values(column: str) -> Column:
    """A column as doubles; NaN is no value, as everywhere in this package."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def sketched(df: DataFrame, part: str | Column, columns: Sequence[str]) -> DataFrame:
    """Per part and numeric column: ``part, column, n, nulls, low, high, different, ranks``.

    One aggregate with partial sketches before the shuffle, so what is shuffled is
    a few kilobytes for each part and task, whatever the number of rows and however
    large a part is. NULL and NaN count as nulls; a part without values has empty sketches; a null part
    is a part of its own; an empty table gives no rows. Rows of a part
    may also come in several calls: their rows merge like those of different parts.
    """
    part = F.col(part) if isinstance(part, str) else part
    rows = df.select(part.alias("part"), *[_values(c).alias(f"v{i}") for i, c in enumerate(columns)])
    cells = []
    for i in range(len(columns)):
        v = F.col(f"v{i}")
        cells += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.isNull()).alias(f"nulls{i}"),
            F.min(v).alias(f"low{i}"),
            F.max(v).alias(f"high{i}"),
            # 0.0 is added to make -0.0 and 0.0 one value.
            F.hll_sketch_agg((v + F.lit(0.0)).cast("string"), F.lit(DISTINCT_BITS)).alias(f"different{i}"),
            F.kll_sketch_agg_double(v, F.lit(QUANTILE_SIZE)).alias(f"ranks{i}"),
        ]
    wide = rows.groupBy("part").agg(*cells)
    made = [F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in _KEPT]) for i, c in enumerate(columns)]
    return wide.select("part", F.inline(F.array(*made)))


def new_parts(df: DataFrame, part: str, stored: DataFrame) -> DataFrame:
    """Rows of the parts that ``stored`` does not hold yet; a null part is compared like any other."""
    known = stored.select(F.col("part").alias("known")).distinct()
    return df.join(known, F.col(part).eqNullSafe(F.col("known")), "left_anti")


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of several parts as one per column (and per ``by``); merging again changes nothing but the order."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"),
        F.sum("nulls").alias("nulls"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("different").alias("different"),
        F.kll_merge_agg_double("ranks", F.lit(QUANTILE_SIZE)).alias("ranks"),
    )


def quantile(probability: float) -> Column:
    """The quantile that a sketch tells: a value of the column whose rank is off by ``RANK_ERROR`` at most; NULL without values."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(float(probability))))


def merged_profile(sketches: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = ()) -> DataFrame:
    """The profile of all parts: ``column, n, nulls, low, high, distinct_values, quantiles``.

    ``n``, ``nulls``, ``low`` and ``high`` are exact. ``distinct_values`` is off by ``DISTINCT_ERROR`` at most in all but about
    three of a thousand cases, and exact for few values. ``quantiles`` has one
    value per probability.
    """
    return merged(sketches, by).select(
        *by,
        "column",
        "n",
        "nulls",
        "low",
        "high",
        F.hll_sketch_estimate("different").alias("distinct_values"),
        F.array(*[quantile(p) for p in probabilities]).alias("quantiles"),
    )


def sketched_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.5,)
) -> dict[str, list[float | None]]:
    """Quantiles of each column from one pass with sketches: the fast sibling of ``exact_quantiles``.

    A told value stands in the column, and its rank is off by ``RANK_ERROR`` at most. None for a column without values.
    """
    found = merged_profile(sketched(df, F.lit(0), columns), probabilities).select("column", "quantiles").collect()
    return {c: [None] * len(probabilities) for c in columns} | {r["column"]: r["quantiles"] for r in found}
