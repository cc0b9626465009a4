"""Drift of features between a reference and a current table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions.numeric import equal_width_bin


def population_stability(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    bins: int = 10,
    limit: float = cfg.DRIFT_LIMIT,
    floor: float = 1e-4,
) -> DataFrame:
    """Population stability index per column: Σ (c - r)·ln(c / r) over bins of
    the reference range. Values outside the range fall into the end bins, an
    empty bin counts as ``floor``. One job for all columns; rows are counted
    per bin before the shuffle."""

    def long(df: DataFrame, side: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
        return df.select(F.inline(cells)).filter("v is not null").withColumn("side", F.lit(side))

    base = long(reference, "reference")
    ends = base.groupBy("column").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    place = equal_width_bin(F.col("v"), F.col("low"), F.col("high"), bins)
    counts = (
        base.unionByName(long(current, "current"))
        .join(F.broadcast(ends), "column")  # one row per column
        .groupBy("column", place.alias("bin"))
        .agg(
            F.count_if(F.col("side") == "reference").alias("r"),
            F.count_if(F.col("side") == "current").alias("c"),
        )
    )
    whole = Window.partitionBy("column")  # over at most ``bins`` rows
    shares = counts.select(
        "column",
        F.greatest(F.try_divide(F.col("r"), F.sum("r").over(whole)), F.lit(floor)).alias("r"),
        F.greatest(F.try_divide(F.col("c"), F.sum("c").over(whole)), F.lit(floor)).alias("c"),
    )
    index = F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r")))
    return shares.groupBy("column").agg(index.alias("psi"), (index > limit).alias("drifted"))
