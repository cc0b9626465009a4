"""Stage plans: raw telemetry → clean table → windows → feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.operators import clean, schema
from signalsift.operators.features import feature_table
from signalsift.operators.ordering import ROWS_PER_SLICE
from signalsift.operators.windows import add_deltas, add_ratios, count_windows
from signalsift.session import staged


def typed_samples(raw: DataFrame, dates: bool = True) -> DataFrame:
    """Names, types and absolute time of a raw table; row-wise but for the
    first record of each scenario."""
    named = schema.add_defaults(schema.standardize_names(raw))
    schema.require_columns(named, cfg.REQUIRED)
    return schema.add_timestamp(schema.coerce_types(named, dates=dates))


def row_order(df: DataFrame, tie_breakers: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Sort key of a sample table. Without a numbered column the hash of the
    whole row breaks ties: rows that still tie are equal."""
    if tie_breakers:
        return df, ["ts_ns", *tie_breakers]
    return df.withColumn("__row_hash", F.xxhash64(*df.columns)), ["ts_ns", "__row_hash"]


def curate(
    raw: DataFrame,
    tie_breakers: Sequence[str] | None = None,
    columns: Sequence[str] | None = cfg.CLEAN_COLUMNS,
    strategy: Mapping[str, str] = cfg.IMPUTE,
    fill: Mapping[str, float] | None = None,
    dates: bool = True,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Raw table → clean table.

    Order of steps: types, clip, drop rows without critical values, impute,
    drop duplicates, project. The complete rows are staged once, because the
    fill values and the sort order are looked up in them before they are used.
    Exact copies already go before the fill, which treats them alike: a row
    that is repeated very often is merged before any shuffle and never sorted.
    The result is not sorted; the sink sorts inside its files, which is all
    later steps profit from.
    """
    typed = clean.clip_ranges(typed_samples(raw, dates))
    keyed, order = row_order(clean.drop_incomplete(typed), tie_breakers)
    keyed = staged(keyed, "complete")
    filled = clean.impute(
        clean.drop_duplicates(keyed), order, strategy, values=fill, rows_per_slice=rows_per_slice, known=keyed
    )
    unique = clean.drop_duplicates(filled.drop("__row_hash"))
    return schema.in_order(unique, columns) if columns else unique


def windowed(samples: DataFrame, order: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Clean samples → windows with deltas and ratios."""
    return add_ratios(add_deltas(count_windows(samples, order, rows_per_slice=rows_per_slice)))


def featurize(samples: DataFrame, order: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Clean samples → feature table."""
    return feature_table(windowed(samples, order, rows_per_slice))
