"""Exact quantiles and modes of whole tables.

The built-in ``median`` and ``percentile`` keep every distinct value of a
group in the memory of one task. Here values are counted first, all columns in
one pass, and running totals of the counts (cut into slices where they are
many) say which values stand at the wanted places. The number of jobs is the same for any number of
columns, probabilities and rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.operators.ordering import ROWS_PER_SLICE, running_sums
from signalsift.session import staged


def _counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``c, v, n``: how often each column has each value; NULL and NaN are no values."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    cells = df.select(F.inline(cells)).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return cells.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.5,),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column over all rows; None for a column without values."""
    counts = staged(_counted(df, columns), "values")
    totals = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    places = {c: [p * (n - 1) for p in probabilities] for c, n in totals.items()}
    ranks = sorted({(c, r) for c, at in places.items() for x in at for r in (math.floor(x), math.ceil(x))})
    found: dict[tuple[str, int], float] = {}
    if ranks:
        summed = running_sums(counts, ["c"], ["v"], {"n": "upto"}, rows_per_slice)
        wanted = df.sparkSession.createDataFrame(ranks, "c string, rank long")
        inside = (F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto"))
        hits = summed.join(F.broadcast(wanted), "c").filter(inside)  # two rows per column and probability
        found = {(r["c"], r["rank"]): r["v"] for r in hits.select("c", "rank", "v").collect()}

    def at(column: str, place: float) -> float:
        low, high = found[column, math.floor(place)], found[column, math.ceil(place)]
        return low if low == high else low + (high - low) * (place - math.floor(place))

    return {c: [at(c, x) for x in places[c]] if c in places else [None] * len(probabilities) for c in columns}


def exact_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Most frequent value of each numeric column, the smallest on ties.

    Values are counted before the shuffle; NULL is no value. One job.
    """
    best = _counted(df, columns).groupBy("c").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v")).collect()
    return {**dict.fromkeys(columns), **{r["c"]: r["v"] for r in best}}
