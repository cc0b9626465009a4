"""Reports over stages: figures of a curation run, run log, alarm report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions.numeric import ratio
from signalsift.operators import investigate


def curation_summary(raw: DataFrame, typed: DataFrame, filled: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: rows in and out, dropped for missing values and as duplicates,
    values clipped and imputed, and the percentages the limits are about.

    ``typed`` is the table before clipping, ``filled`` after imputation and
    before duplicates go.
    """
    bounds = {c: b for c, b in cfg.CLIP_BOUNDS.items() if c in typed.columns}
    outside = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)) for c, (lo, hi) in bounds.items()]
    complete: Column = F.lit(True)
    for c in cfg.CRITICAL:
        complete = complete & F.col(c).isNotNull()
    missing = [F.count_if(complete & F.col(c).isNull()) for c in cfg.IMPUTE if c in typed.columns]
    before = typed.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(complete).alias("complete_rows"),
        sum(outside[1:], outside[0]).alias("values_clipped"),
        sum(missing[1:], missing[0]).alias("values_missing"),
    )
    left = [F.count_if(F.col(c).isNull()) for c in cfg.IMPUTE if c in filled.columns]
    still = filled.agg(sum(left[1:], left[0])).scalar()
    nulls = [F.count_if(F.col(c).isNull()) for c in clean.columns]
    after = clean.agg(F.count(F.lit(1)).alias("n"), sum(nulls[1:], nulls[0]).alias("nulls"))
    counted = after.select(F.struct("n", "nulls")).scalar()  # one subquery for both figures
    out_rows, out_nulls = counted.getField("n"), counted.getField("nulls")
    return before.select(
        "input_rows",
        F.lit(len(raw.columns)).cast("long").alias("input_columns"),
        out_rows.alias("output_rows"),
        F.lit(len(clean.columns)).cast("long").alias("output_columns"),
        (F.col("input_rows") - F.col("complete_rows")).alias("rows_dropped_nulls"),
        (F.col("complete_rows") - out_rows).alias("rows_dropped_duplicates"),
        "values_clipped",
        (F.col("values_missing") - still).alias("values_imputed"),
        (ratio(out_nulls, out_rows * F.lit(len(clean.columns))) * 100).alias("null_pct"),
        (ratio(F.col("values_clipped"), F.col("input_rows") * F.lit(len(cfg.CLIP_BOUNDS))) * 100).alias("clipped_pct"),
        (ratio(F.col("complete_rows") - out_rows, F.col("complete_rows")) * 100).alias("duplicate_pct"),
    )


def run_log(stage: str, metrics: DataFrame, run_id: str) -> DataFrame:
    """A one-row metrics table as rows (run_id, stage, key, value) to append."""
    cells = [
        F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in metrics.columns
    ]
    return metrics.select(
        F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), F.inline(F.array(*cells))
    )


def alarm_report(
    scored: DataFrame, features: Sequence[str], thresholds: Sequence[float] = cfg.REPORT_THRESHOLDS
) -> DataFrame:
    """Feature contrast at each report threshold, with the cohort sizes."""
    return investigate.feature_contrasts(scored, features, thresholds)
