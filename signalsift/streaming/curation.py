"""Row-wise curation of a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from signalsift.config import telemetry as cfg
from signalsift.operators import clean, schema


def curate_stream(
    raw: DataFrame, fill: Mapping[str, float], columns: Sequence[str] | None = None
) -> DataFrame:
    """Names, types, clipping, missing values of a stream of raw rows.

    The same functions as in batch. ``fill`` holds the values fitted on a
    batch (``clean.fill_values``), because a stream has no global median; time
    must be in seconds. Forward fill and duplicates need the past of a
    scenario and stay in the batch plan.
    """
    named = schema.add_defaults(schema.standardize_names(raw))
    schema.require_columns(named, cfg.REQUIRED)
    typed = schema.add_timestamp(schema.coerce_types(named, dates=False))
    kept = clean.drop_incomplete(clean.clip_ranges(typed))
    filled = clean.fill_constants(kept, fill)
    return schema.in_order(filled, columns) if columns else filled
