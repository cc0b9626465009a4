"""Names, types and column contracts (no rows are moved here)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalsift.config import telemetry as cfg
from signalsift.functions.numeric import finite, half_even, ratio


def standardize_names(
    df: DataFrame, aliases: Mapping[str, Sequence[str]] = cfg.ALIASES
) -> DataFrame:
    """Rename raw columns; several raw names of one column are coalesced.

    Columns are addressed by position first, so ``RSRP`` next to ``rsrp`` and
    names with blanks or hyphens are no problem.
    """
    raw = list(df.columns)
    numbered = df.toDF(*[f"__c{i}" for i in range(len(raw))])
    at = {}
    for i, name in enumerate(raw):
        at.setdefault(name, F.col(f"__c{i}"))
    out: dict[str, Column] = {}
    used: set[str] = set()
    for clean, names in aliases.items():
        found = [n for n in dict.fromkeys([*names, clean]) if n in at]
        if not found:
            continue
        used.update(found)
        out[clean] = at[found[0]] if len(found) == 1 else F.coalesce(*[at[n] for n in found])
    taken = {c.lower() for c in out}
    for name in raw:
        if name not in used and name.lower() not in taken:
            out[name] = at[name]
            taken.add(name.lower())
    return numbered.select(*[c.alias(n) for n, c in out.items()])


def renamed_columns(columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = cfg.ALIASES) -> int:
    """How many raw columns the alias map recognises."""
    known = {n for names in aliases.values() for n in names}
    return sum(c in known for c in columns)


def add_defaults(df: DataFrame, defaults: Mapping[str, object] = cfg.OPTIONAL_DEFAULTS) -> DataFrame:
    """Constant columns for the optional ones that are absent."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise unless all columns are present."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def is_clean_layout(columns: Sequence[str]) -> bool:
    """Clean names win only if there are more of them than raw ones."""
    clean = sum(c in columns for c in cfg.CLEAN_MARKERS)
    raw = sum(c in columns for c in cfg.RAW_MARKERS)
    return clean > raw


def _number(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        c = F.trim(c)
    return finite(c.try_cast("double"))


def to_numbers(df: DataFrame, columns: Sequence[str] = cfg.NUMERIC) -> DataFrame:
    """Read columns as double; what is not a number becomes NULL."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: _number(df, c) for c in present}) if present else df


def coercion_losses(df: DataFrame, columns: Sequence[str] = cfg.NUMERIC) -> DataFrame:
    """One row per column: values that ``to_numbers`` would turn into NULL."""
    present = [c for c in columns if c in df.columns]
    counts = df.agg(
        *[F.count_if(F.col(c).isNotNull() & _number(df, c).isNull()).alias(c) for c in present]
    )
    return counts.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls_introduced")) for c in present])
        )
    )


def to_integers(df: DataFrame, columns: Sequence[str] = cfg.INTEGER) -> DataFrame:
    """Round half to even and keep as nullable 64-bit integers."""
    present = [c for c in columns if c in df.columns]
    return (
        df.withColumns({c: half_even(F.col(c).try_cast("double")).cast("long") for c in present})
        if present
        else df
    )


def to_floats(df: DataFrame, columns: Sequence[str] = cfg.FLOAT) -> DataFrame:
    """Narrow to 32 bits, for storage."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.col(c).cast("float") for c in present}) if present else df


def relative_seconds(df: DataFrame, column: str = "time_s", scenario: str = "scenario_id") -> DataFrame:
    """Time text → seconds, value by value: a number is taken as it is, a date as
    the time since the scenario's first date, all else becomes NULL.

    Nothing is looked up to decide it, so the order of files does not matter. A
    column that is no text is left alone. The first date comes from an aggregate that is joined back
    (broadcast when small), not from a window that would gather a scenario in one task.
    """
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.StringType):
        return df
    number = _number(df, column)
    instant = F.when(number.isNull(), F.unix_micros(F.try_to_timestamp(F.col(column))))
    parsed = df.withColumns({"__s": number, "__us": instant})
    by = [scenario] if scenario in df.columns else []
    first = parsed.groupBy(*by).agg(F.min("__us").alias("__first"))
    if by:
        from signalsift.operators.ordering import attach

        parsed = attach(parsed, first, by, ["__first"])
    else:
        parsed = parsed.withColumn("__first", F.lit(first.first()[0]).cast("long"))
    seconds = F.coalesce("__s", (F.col("__us") - F.col("__first")) / F.lit(1e6))
    return parsed.withColumn(column, seconds).select(*df.columns)


def coerce_types(
    df: DataFrame,
    numeric: Sequence[str] = cfg.NUMERIC,
    integers: Sequence[str] = cfg.INTEGER,
    dates: bool = True,
) -> DataFrame:
    """Time, numbers and integers in one step; without ``dates`` only numbers are times."""
    if dates:
        df = relative_seconds(df)
    return df.transform(to_numbers, numeric).transform(to_integers, integers)


def add_timestamp(df: DataFrame, start_ns: int = cfg.START_EPOCH_NS) -> DataFrame:
    """Absolute time in ns; a row without time is put at the start of its scenario.

    Computed in double; storing ``time_s`` in 32 bits first would move the
    timestamps by up to some 0.1 ms.
    """
    if "time_s" not in df.columns:
        return df
    seconds = F.coalesce(F.col("time_s"), F.lit(0.0))
    return df.withColumns(
        {"time_s": seconds, "ts_ns": F.lit(start_ns).cast("long") + (seconds * F.lit(1e9)).cast("long")}
    )


def time_stats(df: DataFrame) -> DataFrame:
    """One row: time range, rows, sampling rate, first and last timestamp."""
    span = F.max("time_s") - F.min("time_s")
    return df.agg(
        span.alias("time_range_s"),
        F.count(F.lit(1)).alias("records"),
        ratio(F.count(F.lit(1)), span).alias("sampling_rate_hz"),
        F.min("ts_ns").alias("ts_min"),
        F.max("ts_ns").alias("ts_max"),
    )


def in_order(df: DataFrame, columns: Sequence[str] = cfg.CLEAN_COLUMNS, rest: bool = False) -> DataFrame:
    """Project to a fixed column order, skipping absent ones; ``rest`` appends the others."""
    chosen = [c for c in columns if c in df.columns]
    if rest:
        chosen += [c for c in df.columns if c not in chosen]
    return df.select(*chosen)
