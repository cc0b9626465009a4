"""Profiles, histograms, box statistics and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalsift.config import telemetry as cfg
from signalsift.functions.numeric import equal_width_bin, ratio
from signalsift.operators.quantiles import exact_quantiles

#: Columns profiled by one aggregate.
COLUMNS_PER_JOB = 30


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, nulls, mean, sample deviation, min, max, null percent.

    One wide aggregate whose single row is turned into rows, instead of
    multiplying every input row by the number of columns.
    """
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    numbers = set(numeric_columns(df))
    parts = []
    for start in range(0, len(names), COLUMNS_PER_JOB):
        batch = names[start : start + COLUMNS_PER_JOB]
        aggs = [F.count(F.lit(1)).alias("__rows")]
        for i, c in enumerate(batch):
            aggs.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"))
            if c in numbers:
                v = F.col(f"`{c}`").cast("double")
                aggs += [
                    F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                    F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"),
                ]
        wide = df.agg(*aggs)
        rows = []
        for i, c in enumerate(batch):

            def stat(letter: str, i=i, c=c) -> Column:
                return F.col(f"{letter}{i}") if c in numbers else F.lit(None).cast("double")

            rows.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(kinds[c]).alias("dtype"),
                    F.col(f"n{i}").alias("nulls"),
                    stat("a").alias("mean"),
                    stat("s").alias("std"),
                    stat("l").alias("min"),
                    stat("h").alias("max"),
                    (ratio(F.col(f"n{i}"), F.col("__rows")) * 100).alias("null_pct"),
                )
            )
        parts.append(wide.select(F.inline(F.array(*rows))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary_stats(
    df: DataFrame, features: Sequence[str] = cfg.CRITICAL_FEATURES, labels: Sequence[str] = cfg.LABELS
) -> DataFrame:
    """Long table (stat, value): size, five figures per feature, label counts and rates."""
    rows = F.count(F.lit(1))
    stats: dict[str, Column] = {
        "total_samples": rows,
        "total_columns": F.max(F.lit(len(df.columns))),
    }
    for c in features:
        if c in df.columns:
            v = F.col(c).cast("double")
            stats |= {
                f"{c}_mean": F.avg(v),
                f"{c}_std": F.stddev_samp(v),
                f"{c}_min": F.min(v),
                f"{c}_max": F.max(v),
                f"{c}_null_pct": ratio(F.count_if(v.isNull()), rows) * 100,
            }
    names = {"lab_anom": "anomaly", "lab_inf": "interference"}
    for c in labels:
        if c in df.columns:
            stats |= {f"{names.get(c, c)}_count": F.sum(c), f"{names.get(c, c)}_rate": ratio(F.sum(c), rows)}
    return long_stats(df, stats)


def long_stats(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """Named aggregates of one job as rows (stat, value)."""
    wide = df.agg(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(stats.values())])
    rows = [F.struct(F.lit(n).alias("stat"), F.col(f"v{i}").alias("value")) for i, n in enumerate(stats)]
    return wide.select(F.inline(F.array(*rows)))


def dataset_size(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows, columns and, where the column exists, number of source files."""
    files = F.count_distinct(source) if source in df.columns else F.lit(None).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("dataset_rows"),
        F.max(F.lit(len(df.columns))).cast("long").alias("dataset_cols"),
        files.alias("num_source_files"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value. The total needs no column of the table."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(column, "n", ratio(F.col("n"), total).alias("share"))


def scenario_count(df: DataFrame, column: str = "scenario_id", approximate: bool = False) -> DataFrame:
    """Number of different values."""
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(count.alias("distinct_values"))


def group_minimum(df: DataFrame, group: str, column: str, out: str) -> DataFrame:
    """Minimum of the group next to each row: an aggregate joined back, so a
    large group is never gathered."""
    from signalsift.operators.ordering import attach

    return attach(df, df.groupBy(group).agg(F.min(column).alias(out)), [group], [out])


def histogram(
    df: DataFrame,
    columns: Sequence[str],
    bins: int = 50,
    density: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Equal-width histograms of all columns in one job, empty bins included.

    Range per column (and group ``by``) is its own minimum to maximum; a
    constant column gets a width of 1 around its value. Rows are unpivoted,
    but counted per bin before the shuffle.
    """
    long = df.select(
        *by,
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
            )
        ),
    ).filter("v is not null")
    keys = [*by, "column"]
    ends = long.groupBy(*keys).agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.count("v").alias("total")
    )
    flat = F.col("low") == F.col("high")
    ends = ends.select(
        *keys,
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        "mean",
        "total",
    )
    # One row per column and group; Spark knows its size when it chooses the join.
    placed = long.join(ends.select(*keys, "low", "high"), keys).groupBy(
        *keys, equal_width_bin(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    frame = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("high") - F.col("low")) / bins
    counted = frame.join(placed, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("low") + width * F.col("bin")).alias("bin_low"),
        (F.col("low") + width * (F.col("bin") + 1)).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "mean",
        "total",
    )
    if not density:
        return counted.drop("total")
    height = ratio(F.col("n"), F.col("total") * (F.col("bin_high") - F.col("bin_low")))
    return counted.withColumn("density", height).drop("total")


def box_stats(df: DataFrame, columns: Sequence[str], label: str = "lab_anom", values: Sequence[object] = (0, 1)) -> DataFrame:
    """Box-plot figures per column and label value: quartiles, whiskers at the
    last values inside 1.5 interquartile ranges, number of rows."""
    quartiles = {}
    for value in values:
        cohort = df.filter(F.col(label) == value)
        for c, q in exact_quantiles(cohort, columns, (0.25, 0.5, 0.75)).items():
            quartiles[(value, c)] = q
    wide = []
    for (value, c), (q1, _q2, q3) in quartiles.items():
        if q1 is None:
            continue
        member = (F.col(label) == value) & F.col(c).between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        wide += [
            F.min(F.when(member, F.col(c).cast("double"))).alias(f"lo_{value}_{c}"),
            F.max(F.when(member, F.col(c).cast("double"))).alias(f"hi_{value}_{c}"),
            F.count(F.when(F.col(label) == value, F.col(c))).alias(f"n_{value}_{c}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(value).alias("label"),
            F.col(f"n_{value}_{c}").alias("n"),
            F.col(f"lo_{value}_{c}").alias("whisker_low"),
            *[F.lit(q).alias(n) for q, n in zip(qs, ("q1", "median", "q3"))],
            F.col(f"hi_{value}_{c}").alias("whisker_high"),
        )
        for (value, c), qs in quartiles.items()
        if qs[0] is not None
    ]
    return df.agg(*wide).select(F.inline(F.array(*rows)))


def correlations(df: DataFrame, columns: Sequence[str] = cfg.CRITICAL_FEATURES) -> DataFrame:
    """Pearson correlation of all pairs (long form), pairwise complete, one aggregate."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"r{i}").alias("r")))
    return wide.select(F.inline(F.array(*rows)))


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: count, sample deviation, min, quartiles, max."""
    found = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    wide = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        wide += [F.count(v).alias(f"n{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("n"),
            F.col(f"s{i}").alias("std"),
            F.col(f"l{i}").alias("min"),
            *[F.lit(q).cast("double").alias(n) for q, n in zip(found[c], ("q1", "median", "q3"))],
            F.col(f"h{i}").alias("max"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*wide).select(F.inline(F.array(*rows)))


def first_rows(df: DataFrame, order: Sequence[str], n: int = 1000) -> DataFrame:
    """The first rows in time, for a preview; a top-k, not a full sort."""
    return df.orderBy(*order).limit(n)


def window_series(windows: DataFrame, column: str = "sinr_mean", spread: str = "sinr_std") -> DataFrame:
    """Seconds from the first window, value and value ± deviation."""
    start = windows.agg(F.min("ts_start_ns")).scalar()
    return windows.select(
        "scenario_id",
        ((F.col("ts_start_ns") - start) / F.lit(1e9)).alias("seconds"),
        F.col(column).alias("value"),
        (F.col(column) - F.col(spread)).alias("low"),
        (F.col(column) + F.col(spread)).alias("high"),
    )
