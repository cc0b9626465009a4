"""Clipping, missing values, duplicates and the figures of a curation run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions.numeric import clip, finite, half_even, ratio
from signalsift.operators.ordering import ROWS_PER_SLICE, attach, carry_forward
from signalsift.operators.quantiles import exact_modes, exact_quantiles
from signalsift.session import staged

# --- clipping ----------------------------------------------------------------


def clip_ranges(
    df: DataFrame, bounds: Mapping[str, tuple[float, float]] = cfg.CLIP_BOUNDS
) -> DataFrame:
    """Limit columns to their bounds. MCS indices are rounded first."""
    out = {}
    for name, (low, high) in bounds.items():
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType
        value = F.col(name)
        if "mcs" in name and kind.typeName() in ("double", "float"):
            value = half_even(value)
        out[name] = clip(value, F.lit(low).cast(kind), F.lit(high).cast(kind))
    return df.withColumns(out) if out else df


def clipping_stats(
    df: DataFrame, bounds: Mapping[str, tuple[float, float]] = cfg.CLIP_BOUNDS
) -> DataFrame:
    """Values outside the bounds, one row per column, from a single aggregate."""
    present = [c for c in bounds if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c) < bounds[c][0]).alias(f"b_{c}") for c in present],
        *[F.count_if(F.col(c) > bounds[c][1]).alias(f"a_{c}") for c in present],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"b_{c}").alias("below_min"),
            F.col(f"a_{c}").alias("above_max"),
            (F.col(f"b_{c}") + F.col(f"a_{c}")).alias("total_clipped"),
            (ratio(F.col(f"b_{c}") + F.col(f"a_{c}"), F.col("__rows")) * 100).alias("pct_clipped"),
            F.lit(float(bounds[c][0])).alias("clip_min"),
            F.lit(float(bounds[c][1])).alias("clip_max"),
        )
        for c in present
    ]
    return counts.select(F.inline(F.array(*rows)))


def clipped_share(stats: DataFrame, columns: int = len(cfg.CLIP_BOUNDS)) -> DataFrame:
    """Clipped share over all cells, with the warning flag."""
    share = F.sum("pct_clipped") / F.lit(columns)
    return stats.agg(
        F.sum("total_clipped").alias("values_clipped"),
        F.count_if(F.col("total_clipped") > 0).alias("columns_clipped"),
        share.alias("pct_clipped"),
        (share > cfg.CURATION_LIMITS["max_clipped_pct"]).alias("warning"),
    )


def replace_infinite(df: DataFrame, columns: Sequence[str] | None = None, value: float | None = None) -> DataFrame:
    """±inf and NaN of double columns → NULL, or a value for infinities and NaN."""
    names = columns or [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    fixed = {}
    for c in names:
        if c in df.columns:
            clean = finite(F.col(c))
            if value is not None:
                clean = F.when(F.col(c).isNotNull() & clean.isNull(), F.lit(value)).otherwise(F.col(c))
            fixed[c] = clean
    return df.withColumns(fixed) if fixed else df


# --- filters -----------------------------------------------------------------


def drop_incomplete(df: DataFrame, critical: Sequence[str] = cfg.CRITICAL) -> DataFrame:
    """Rows with all critical columns present."""
    return df.na.drop(subset=[c for c in critical if c in df.columns])


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent per column, one job."""
    names = [c for c in (columns or df.columns) if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(c).alias("nulls"),
            (ratio(F.col(c), F.col("__rows")) * 100).alias("null_pct"),
        )
        for c in names
    ]
    return counts.select(F.inline(F.array(*rows)))


def remaining_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return null_counts(df, columns).filter("nulls > 0")


def with_label(df: DataFrame, value: int, label: str = "lab_anom") -> DataFrame:
    """One cohort of a labelled table."""
    return df.filter(F.col(label) == value)


def scenario_contains(df: DataFrame, text: str, scenario: str = "scenario_id") -> DataFrame:
    """Rows whose scenario contains the text, ignoring case."""
    return df.filter(F.lower(F.col(scenario)).contains(text.lower()))


# --- imputation --------------------------------------------------------------

#: Why a column is filled the way it is.
REASONS = {
    "mode": "a setting that takes few values: the most frequent one",
    "median": "a skewed figure: the middle one, which outliers do not move",
    "ffill": "a reading that lasts until the next one: the last known one of the scenario",
}


def fill_values(df: DataFrame, strategy: Mapping[str, str] = cfg.IMPUTE) -> dict[str, float]:
    """Global mode and median of the columns that ask for one.

    These few numbers are the fitted state of the imputation; a stream uses
    the same dictionary.
    """
    values: dict[str, float] = {}
    medians = [c for c, how in strategy.items() if how == "median" and c in df.columns]
    if medians:
        for c, (v,) in exact_quantiles(df, medians).items():
            if v is not None:
                values[c] = v
    modes = [c for c, how in strategy.items() if how == "mode" and c in df.columns]
    if modes:
        values |= {c: 0 if v is None else v for c, v in exact_modes(df, modes).items()}
    return values


def fill_constants(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    present = {c: v for c, v in values.items() if c in df.columns}
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in present.items()}
    ) if present else df


def fill_forward(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    scenario: str = "scenario_id",
    rows_per_slice: int = ROWS_PER_SLICE,
    known: DataFrame | None = None,
) -> DataFrame:
    """Last known value of the scenario; ``known`` as in ``carry_forward``."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    return carry_forward(df, [scenario], order, present, rows_per_slice, known)


def next_known(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Each missing value of ``columns`` → the next known one in the order of ``key``, which is unique.

    A suffix scan in two passes over ranges of the key: a window inside each range, then the first
    known values of the later ranges, one row per range, for what is still missing. So any number of
    keys is many tasks, and what meets in one place is a row per range. The windows run from the largest
    key down: a frame that ends at its row grows by it, one that starts there is read again for every row.
    """
    ranges = staged(
        rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()), "ranges"
    )
    inside = Window.partitionBy("__part").orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = ranges.select(key, "__part", *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in columns])
    heads = ranges.groupBy("__part").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"__n_{i}") for i, c in enumerate(columns)]
    )
    # One row per range, of which there are as many as shuffle partitions.
    later = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(
        "__part", *[F.last(f"__n_{i}", ignorenulls=True).over(later).alias(f"__n_{i}") for i in range(len(columns))]
    )
    met = filled.join(F.broadcast(carried), "__part")
    return met.select(key, *[F.coalesce(c, f"__n_{i}").alias(c) for i, c in enumerate(columns)])


def fill_backward(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    scenario: str = "scenario_id",
    known: DataFrame | None = None,
) -> DataFrame:
    """Next known value, over the whole table in scenario order.

    Meant to follow :func:`fill_forward`: what is still missing then leads its
    scenario, so the fill is the first known value of the scenario, or of the
    next scenario that has one. Both come from one row per scenario. The first
    known value is the same before the forward fill, so ``known`` may be the
    table as it was then.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    place = F.struct(*order)
    firsts = (df if known is None else known).groupBy(scenario).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__f_{c}") for c in present]
    )
    fills = next_known(firsts, scenario, [f"__f_{c}" for c in present])
    names = [f"__f_{c}" for c in present]
    return (
        attach(df, fills, [scenario], names)
        .withColumns({c: F.coalesce(F.col(c), F.col(f"__f_{c}")) for c in present})
        .drop(*names)
    )


def impute(
    df: DataFrame,
    order: Sequence[str],
    strategy: Mapping[str, str] = cfg.IMPUTE,
    scenario: str = "scenario_id",
    values: Mapping[str, float] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    known: DataFrame | None = None,
) -> DataFrame:
    """All fills: constants first, then forward and backward in one pass each."""
    known = df if known is None else known
    values = fill_values(known, strategy) if values is None else values
    carried = [c for c, how in strategy.items() if how == "ffill" and c in df.columns]
    df = fill_constants(df, values)
    if carried:
        df = fill_forward(df, carried, order, scenario, rows_per_slice, known)
        df = fill_backward(df, carried, order, scenario, known)
    return df


def imputation_stats(
    before: DataFrame,
    after: DataFrame,
    values: Mapping[str, float],
    strategy: Mapping[str, str] = cfg.IMPUTE,
) -> DataFrame:
    """Per imputed column: nulls before, filled, method, fill value, and the reason of the method."""
    names = [c for c in strategy if c in before.columns]
    counted_before = null_counts(before, names).select("column", F.col("nulls").alias("nulls_before"))
    counted_after = null_counts(after, names).select("column", F.col("nulls").alias("nulls_after"))
    method = F.create_map(*[F.lit(x) for c in names for x in (c, strategy[c])])
    shown = F.create_map(
        *[x for c in names for x in (F.lit(c), F.lit(float(values[c]) if c in values else None).cast("double"))]
    )
    reason = F.create_map(*[F.lit(x) for c in names for x in (c, REASONS.get(strategy[c]))])
    return (
        counted_before.join(counted_after, "column")
        .filter("nulls_before > 0")
        .select(
            "column",
            "nulls_before",
            (F.col("nulls_before") - F.col("nulls_after")).alias("nulls_filled"),
            method[F.col("column")].alias("method"),
            shown[F.col("column")].alias("fill_value"),
            reason[F.col("column")].alias("reason"),
        )
    )


# --- duplicates --------------------------------------------------------------


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicates; copies are dropped before the shuffle already, so one
    row that is repeated very often does not fill a task."""
    return replace_infinite(df).distinct()


def duplicate_stats(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, duplicates and their percent."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("__n"))
        .agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
        .select(
            "rows",
            "distinct_rows",
            (F.col("rows") - F.col("distinct_rows")).alias("duplicates"),
            (ratio(F.col("rows") - F.col("distinct_rows"), F.col("rows")) * 100).alias("duplicate_pct"),
        )
    )
