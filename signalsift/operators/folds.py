"""Group k-fold: whole scenarios go to one fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.session import staged

Run = tuple[int, int, int, list[int]]


def balanced_runs(sizes: list[tuple[int, int]], folds: int) -> list[Run]:
    """Largest group first, each to the fold with the fewest rows so far.

    ``sizes`` are pairs (rows of a group, groups of that size) in falling order.
    A run ``(size, first, last, folds)`` says that the groups of that size with the ranks
    ``first`` to ``last`` (exclusive) take these folds in turn. The number of runs
    follows the number of different sizes, not of groups.
    """
    load = [0] * folds
    out: list[Run] = []
    for size, count in sizes:
        at = 0
        while at < count:
            order = sorted(range(folds), key=lambda f: (load[f], f))
            near = next((m for m in range(1, folds) if load[order[m]] - load[order[0]] >= size), folds)
            left = count - at
            if near < folds:
                # These folds take turns until the next one is as light.
                turns = (load[order[near]] - load[order[near - 1]] - 1) // size if size else 0
                left = min(left, turns * near) if turns > 0 else 1
            turn = [f + 1 for f in order[:near]]
            out.append((size, at, at + left, turn))
            for k, fold in enumerate(order[:near]):
                load[fold] += size * (left // near + (k < left % near))
            at += left
    return out


def fold_table(df: DataFrame, group: str = "scenario_id", folds: int = cfg.FOLDS) -> DataFrame:
    """(group, fold): the largest group first, each to the fold with the
    fewest rows so far; groups of one size in the order of their names.

    The driver sees how many groups there are of each size: fewer than
    ``sqrt(2 rows)`` lines. The rank of a group among those of its size
    comes from a sorted table.
    """
    sizes = df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    ordered = sizes.orderBy(F.col("n").desc(), F.col("g").asc()).withColumn("at", F.monotonically_increasing_id())
    ordered = staged(ordered, "groups")
    counts = [(r["n"], r["k"]) for r in ordered.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.col("n").desc()).collect()]
    if sum(k for _, k in counts) < folds:
        raise ValueError(f"{folds} folds need at least as many groups, found {sum(k for _, k in counts)}")
    runs = df.sparkSession.createDataFrame(balanced_runs(counts, folds), "n long, first long, last long, turn array<int>")
    parts = ordered.groupBy("n", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("n", "part", (F.coalesce(F.sum("k").over(earlier), F.lit(0)) - F.col("low")).alias("shift"))
    ranked = ordered.withColumn("part", F.shiftright("at", 33)).join(parts, ["n", "part"])
    ranked = ranked.withColumn("rank", F.col("at") + F.col("shift"))
    met = ranked.join(runs, (ranked["n"] == runs["n"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    turn = F.col("rank") - F.col("first")
    return met.select(F.col("g").alias(group), F.element_at("turn", (turn % F.size("turn") + 1).cast("int")).alias("fold"))


def assign_folds(df: DataFrame, group: str = "scenario_id", folds: int = cfg.FOLDS) -> DataFrame:
    """Add ``fold`` (1 … k)."""
    return df.join(fold_table(df, group, folds), group)


def training_part(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") != fold)


def test_part(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") == fold)
