"""The feature table: derived features in a fixed column order."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.utils import AnalysisException

from signalsift.config import telemetry as cfg
from signalsift.functions.features import FEATURES, Feature
from signalsift.operators.clean import replace_infinite
from signalsift.operators.schema import in_order


def add_features(df: DataFrame, features: Mapping[str, Feature] | None = None) -> DataFrame:
    """Apply the registered features; one that cannot be resolved is skipped
    with a warning, the others are kept. All go into one projection."""
    features = FEATURES if features is None else features
    usable = {}
    for name, build in features.items():
        try:
            df.select(build().alias(name)).schema  # analysis only, no job
            usable[name] = build()
        except AnalysisException as problem:
            warnings.warn(f"feature {name} skipped: {problem.getCondition()}", stacklevel=2)
    return df.withColumns(usable) if usable else df


def feature_table(
    windows: DataFrame,
    columns: Sequence[str] = cfg.FEATURE_COLUMNS,
    features: Mapping[str, Feature] | None = None,
) -> DataFrame:
    """Windows with deltas and ratios → the table a model is trained on."""
    table = add_features(windows, features)
    return in_order(replace_infinite(table), columns)
