"""Count-based and event-time windows over telemetry samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions.aggregates import aggregate, stripped
from signalsift.functions.numeric import ratio, ratio_or_zero
from signalsift.operators.ordering import CHUNK, ROWS_PER_SLICE, number_rows, over_frame

#: Number of a window inside its scenario, 0, 1, 2, …; kept next to the
#: declared columns because deltas and rolling features need a dense position.
POSITION = "window_no"


def stat_columns(
    columns: Sequence[str], stats: Mapping[str, Sequence[str]] = cfg.WINDOW_STATS
) -> dict[str, Column]:
    """Aggregates of the configured statistics, skipping absent columns."""
    return {
        f"{stripped(c, cfg.UNIT_SUFFIXES)}_{how}": aggregate(how, c)
        for c, hows in stats.items()
        if c in columns
        for how in hows
    }


def weak_label(columns: Sequence[str], labels: Sequence[str] = cfg.LABELS) -> Column:
    """1 if any label of any row is set; constant 0 if a label column is absent."""
    if any(c not in columns for c in labels):
        return F.lit(0)
    any_set = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) != 0 for c in labels])
    return F.coalesce(F.bool_or(any_set), F.lit(False)).cast("int")


def _window_rows(columns: Sequence[str], stats, labels, size: int) -> list[Column]:
    """Everything one window row holds besides its key."""
    samples = F.count(F.lit(1))
    return [
        F.min("ts_ns").alias("ts_start_ns"),
        samples.alias("window_samples"),
        (F.lit(1.0) - samples / F.lit(float(size))).alias("gap_ratio"),
        *[c.alias(n) for n, c in stat_columns(columns, stats).items()],
        weak_label(columns, labels).alias(cfg.TARGET),
    ]


def number_windows(
    df: DataFrame,
    order: Sequence[str],
    scenario: str = "scenario_id",
    size: int = cfg.WINDOW_SAMPLES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add the window number of each row: every ``size`` rows in order."""
    return (
        number_rows(df, [scenario], order, "__rn", rows_per_slice)
        .withColumn(POSITION, F.floor((F.col("__rn") - 1) / F.lit(size)).cast("long"))
        .drop("__rn")
    )


def count_windows(
    df: DataFrame,
    order: Sequence[str],
    stats: Mapping[str, Sequence[str]] = cfg.WINDOW_STATS,
    labels: Sequence[str] = cfg.LABELS,
    scenario: str = "scenario_id",
    size: int = cfg.WINDOW_SAMPLES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per ``size`` consecutive rows of a scenario, the incomplete tail dropped.

    The numbering is dense, so only the last window of a scenario can be
    short: the tail rule is a filter on the row count of the window.
    """
    used = [c for c in [*stats, *labels] if c in df.columns]
    needed = list(dict.fromkeys([scenario, "ts_ns", *order, *used]))
    numbered = number_windows(df.select(*needed), order, scenario, size, rows_per_slice)
    return (
        numbered.groupBy(scenario, POSITION)
        .agg(*_window_rows(df.columns, stats, labels, size))
        .filter(F.col("window_samples") == size)
    )


def event_windows(
    df: DataFrame,
    every: str = f"{cfg.WINDOW_SECONDS} seconds",
    ts: str = "ts",
    stats: Mapping[str, Sequence[str]] = cfg.WINDOW_STATS,
    labels: Sequence[str] = cfg.LABELS,
    scenario: str = "scenario_id",
    size: int = cfg.WINDOW_SAMPLES,
    min_samples: int = cfg.MIN_WINDOW_SAMPLES,
) -> DataFrame:
    """Tumbling windows in event time with their true gap ratio.

    Also the streaming form: the same code runs behind a watermark.
    """
    return (
        df.groupBy(F.col(scenario), F.window(F.col(ts), every).alias("__w"))
        .agg(*_window_rows(df.columns, stats, labels, size))
        .filter(F.col("window_samples") >= min_samples)
        .withColumn("window_start", F.col("__w.start"))
        .drop("__w")
    )


def with_position(
    windows: DataFrame, scenario: str = "scenario_id", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Dense window number for a windows table that was stored without it."""
    if POSITION in windows.columns:
        return windows
    numbered = number_rows(windows, [scenario], ["ts_start_ns"], POSITION, rows_per_slice)
    return numbered.withColumn(POSITION, F.col(POSITION) - 1)


def add_deltas(
    windows: DataFrame,
    columns: Sequence[str] = cfg.DELTAS,
    scenario: str = "scenario_id",
    chunk: int = CHUNK,
) -> DataFrame:
    """Change since the previous window; 0 for the first window of a scenario."""
    present = [c for c in columns if c in windows.columns]

    def build(w):
        return {f"d_{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in present}

    return over_frame(with_position(windows, scenario), [scenario], POSITION, 1, build, chunk)


def add_second_deltas(
    windows: DataFrame, columns: Sequence[str] = ("sinr_mean",), scenario: str = "scenario_id", chunk: int = CHUNK
) -> DataFrame:
    """Change of the change: of ``d_c`` against the previous window, 0 at the start."""

    def build(w):
        out = {}
        for c in columns:
            # d_c is 0 in the first window, so the second window keeps its delta
            before = F.lag(c).over(w)
            older = F.coalesce(F.lag(c, 2).over(w), before)
            out[f"dd_{c}"] = F.coalesce(F.col(c) - before - (before - older), F.lit(0.0))
        return out

    return over_frame(with_position(windows, scenario), [scenario], POSITION, 2, build, chunk)


def add_rolling(
    windows: DataFrame,
    columns: Sequence[str] = ("sinr_mean",),
    length: int = 5,
    scenario: str = "scenario_id",
    chunk: int = CHUNK,
) -> DataFrame:
    """Mean and population deviation over the last ``length`` windows."""

    def build(w):
        frame = w.rowsBetween(-(length - 1), 0)
        out = {}
        for c in columns:
            out[f"{c}_roll_mean"] = F.avg(c).over(frame)
            out[f"{c}_roll_std"] = F.stddev_pop(c).over(frame)
        return out

    return over_frame(with_position(windows, scenario), [scenario], POSITION, length - 1, build, chunk)


def add_ratios(windows: DataFrame, ratios: Mapping[str, tuple[str, str]] = cfg.RATIOS) -> DataFrame:
    """num / (|den| + 1e-6), and the range of SINR inside the window."""
    out = {
        name: ratio_or_zero(F.col(num), F.abs(F.col(den)) + F.lit(1e-6))
        for name, (num, den) in ratios.items()
        if num in windows.columns and den in windows.columns
    }
    if {"sinr_max", "sinr_min"} <= set(windows.columns):
        out["sinr_range"] = F.col("sinr_max") - F.col("sinr_min")
    return windows.withColumns(out) if out else windows


def window_counts(
    samples: DataFrame, scenario: str = "scenario_id", size: int = cfg.WINDOW_SAMPLES
) -> DataFrame:
    """Per scenario: rows, complete windows and creation rate; scenarios
    without any complete window stay in the result with 0."""
    rows = F.count(F.lit(1))
    made = F.floor(rows / F.lit(size)).cast("long")
    return samples.groupBy(scenario).agg(
        rows.alias("rows"), made.alias("windows"), ratio(made, rows / F.lit(size)).alias("creation_rate")
    )
