"""Registry of derived window features: name → function giving a Column.

The functions see the column names of a table and return an expression, so
Catalyst sees through them; no Python code touches a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalsift.functions.numeric import ratio

Feature = Callable[[], Column]
FEATURES: dict[str, Feature] = {}


def feature(name: str) -> Callable[[Feature], Feature]:
    """Decorator: register a feature under ``name``."""

    def keep(build: Feature) -> Feature:
        FEATURES[name] = build
        return build

    return keep


def hour_of(ts_ns: str = "ts_start_ns") -> Column:
    """UTC hour of a time in ns, from arithmetic: independent of the session time zone."""
    return F.pmod(F.floor(F.col(ts_ns) / F.lit(3_600_000_000_000)), F.lit(24))


@feature("prb_util_ratio")
def _() -> Column:
    used = F.col("prb_dl_mean") + F.col("prb_ul_mean") + F.lit(1e-3)
    return ratio(F.col("prb_dl_mean"), used)


@feature("hour_sin")
def _() -> Column:
    return F.sin(F.lit(2 * math.pi) * hour_of() / F.lit(24))


@feature("hour_cos")
def _() -> Column:
    return F.cos(F.lit(2 * math.pi) * hour_of() / F.lit(24))


@feature("sinr_cv")
def _() -> Column:
    return ratio(F.col("sinr_std"), F.abs("sinr_mean") + F.lit(1e-6))


@feature("throughput_efficiency")
def _() -> Column:
    return ratio(F.col("app_dl_mean"), F.col("sinr_mean") + F.lit(1e-6))


@feature("is_single_rru")
def _() -> Column:
    return F.coalesce(F.lower("scenario_id").contains("1rru"), F.lit(False)).cast("int")


@feature("scenario_level")
def _() -> Column:
    digits = F.regexp_extract("scenario_id", r"Lvl(\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("double"), F.lit(0.0))
