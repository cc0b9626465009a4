"""Why does a score raise false alarms? Cohorts, scenarios and features.

Cohorts at a threshold: ``high`` are normals at or above it (the false
alarms), ``low`` the other normals, ``anomaly`` the true ones. Features are
contrasted by a cube of moments: one aggregate by label and number of thresholds
reached, whose few cells are merged for each threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions.numeric import ratio, ratio_or_zero
from signalsift.operators.metrics import LABEL, SCORE, reached
from signalsift.operators.profile import histogram


def _normal() -> Column:
    return F.col(LABEL) == 0


def _high(threshold: Column | float) -> Column:
    return _normal() & reached(threshold)


def _low(threshold: Column | float) -> Column:
    return _normal() & ~reached(threshold)


def false_alarms(df: DataFrame, threshold: float) -> DataFrame:
    """Normals at or above the threshold."""
    return df.filter(_high(threshold))


def quiet_normals(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(_low(threshold))


def cohort_sizes(df: DataFrame, thresholds: Sequence[float] = cfg.REPORT_THRESHOLDS) -> DataFrame:
    """Per threshold: normals, false alarms, quiet normals and their percent,
    with the mean score of false alarms and anomalies. One scan for all thresholds."""
    aggs = [F.count_if(_normal()).alias("n"), F.avg(F.when(F.col(LABEL) == 1, F.col(SCORE))).alias("ma")]
    for i, t in enumerate(thresholds):
        aggs += [
            F.count_if(_high(t)).alias(f"h{i}"),
            F.count_if(_low(t)).alias(f"l{i}"),
            F.avg(F.when(_high(t), F.col(SCORE))).alias(f"m{i}"),
        ]
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col("n").alias("n_normal"),
            F.col(f"h{i}").alias("n_high"),
            (ratio_or_zero(F.col(f"h{i}"), F.col("n")) * 100).alias("high_pct"),
            F.col(f"l{i}").alias("n_low"),
            (ratio_or_zero(F.col(f"l{i}"), F.col("n")) * 100).alias("low_pct"),
            F.col(f"m{i}").alias("high_mean_prob"),
            F.col("ma").alias("anomaly_mean_prob"),
        )
        for i, t in enumerate(thresholds)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def alarms_by_scenario(df: DataFrame, threshold: float = 0.5, scenario: str = "scenario_id") -> DataFrame:
    """False alarms, normals and percent per scenario; 0 without normals."""
    high, normal = F.count_if(_high(threshold)), F.count_if(_normal())
    return df.groupBy(scenario).agg(
        high.alias("n_high"), normal.alias("n_normal"), (ratio_or_zero(high, normal) * 100).alias("false_alarm_rate")
    )


def concentration(df: DataFrame, threshold: float = 0.5, scenario: str = "scenario_id") -> DataFrame:
    """Do few scenarios cause the false alarms? Is the overall rate too high?"""
    per = alarms_by_scenario(df, threshold, scenario)
    spread = F.max("false_alarm_rate") - F.min("false_alarm_rate")
    overall = ratio_or_zero(F.sum("n_high"), F.sum("n_normal"))
    return per.agg(
        F.max("false_alarm_rate").alias("max_rate"),
        F.min("false_alarm_rate").alias("min_rate"),
        (spread > 30).alias("concentrated"),
        (overall * 100).alias("overall_rate"),
        (overall > 0.3).alias("too_many"),
    )


def feature_contrast(df: DataFrame, features: Sequence[str], threshold: float) -> DataFrame:
    """Means of false alarms and quiet normals per feature, their difference
    and its size in pooled deviations. No rows if there is no false alarm."""
    return feature_contrasts(df, features, [threshold]).drop("threshold", "n_normal", "n_high", "high_pct")


def cohort_moments(df: DataFrame, features: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Count, mean and squared deviations of each feature by label and number of thresholds reached.

    Columns ``label``, ``level``, ``rows`` and a struct ``(n, mean, ss)`` per feature (``f0`` …). This is
    all that the contrasts at any of the thresholds need: one narrow aggregate, a few groups.
    """
    level = sum((F.coalesce(reached(t), F.lit(False)).cast("int") for t in sorted(thresholds)), F.lit(0))
    aggs = []
    for i, f in enumerate(features):
        v = F.col(f).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}")]
    cells = df.groupBy(F.col(LABEL).alias("label"), level.alias("level")).agg(F.count(F.lit(1)).alias("rows"), *aggs)
    # One row per feature from here on: a few groups, so nothing is large any more.
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"n{i}").alias("n"),
            F.col(f"m{i}").alias("mean"),
            (F.col(f"v{i}") * F.col(f"n{i}")).alias("ss"),
        )
        for i, f in enumerate(features)
    ]
    return cells.select("label", "level", "rows", F.inline(F.array(*rows)))


def _merged(member: Column, name: str) -> list[Column]:
    """Count and mean of the cells that are members."""
    n = F.when(member, F.col("n"))
    total = F.when(member, F.col("n") * F.col("mean"))
    return [F.sum(n).alias(f"n_{name}"), (F.sum(total) / F.sum(n)).alias(f"m_{name}")]


def _deviation(member: Column, mean: Column, name: str) -> Column:
    """Sample variance of the merged cells: their own deviations, and those of their means."""
    inner = F.when(member, F.col("ss") + F.col("n") * F.pow(F.col("mean") - mean, F.lit(2)))
    n = F.when(member, F.col("n"))
    return (F.sum(inner) / F.when(F.sum(n) > 1, F.sum(n) - 1)).alias(f"v_{name}")


def feature_contrasts(df: DataFrame, features: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """``feature_contrast`` at each threshold, with the cohort sizes: one scan for all of them.

    The rows are aggregated once, by label and number of thresholds reached; cohorts at a
    threshold are merged from those cells, by the rule for moments of parts.
    """
    order = sorted(thresholds)
    cells = cohort_moments(df, features, order).where("label = 0")
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(order)]))
    cells = cells.withColumn("at", at).select("*", "at.i", "at.threshold")
    high, low = F.col("level") > F.col("i"), F.col("level") <= F.col("i")
    by = ["threshold", "i", "feature"]
    # Means first: the deviations of the cells' means need them, and a sum of squares would lose digits.
    means = cells.groupBy(*by).agg(*_merged(high, "h"), *_merged(low, "l"), F.sum("rows").alias("n_normal"), F.sum(F.when(high, F.col("rows")).otherwise(0)).alias("n_high"))
    told = cells.join(F.broadcast(means), by).groupBy(*by, "m_h", "m_l", "n_normal", "n_high").agg(
        _deviation(high, F.col("m_h"), "h"), _deviation(low, F.col("m_l"), "l")
    )
    diff, pooled = F.col("m_h") - F.col("m_l"), F.sqrt((F.col("v_h") + F.col("v_l")) / 2)
    return told.where("n_high > 0").select(
        "feature",
        F.col("m_h").alias("high_prob_mean"),
        F.col("m_l").alias("low_prob_mean"),
        diff.alias("diff"),
        F.abs(F.when(pooled > 0, ratio(diff, pooled)).otherwise(0.0)).alias("effect_size"),
        "threshold",
        "n_normal",
        "n_high",
        (ratio_or_zero(F.col("n_high"), F.col("n_normal")) * 100).alias("high_pct"),
    )


def strongest(contrast: DataFrame, k: int = 10) -> DataFrame:
    return contrast.orderBy(F.col("effect_size").desc(), F.col("feature").asc()).limit(k)


def anomaly_likeness(df: DataFrame, features: Sequence[str], threshold: float) -> DataFrame:
    """Mean of false alarms against mean of anomalies per feature. No rows if there is no false alarm."""
    cells = cohort_moments(df, features, [threshold])
    high, anomaly = (F.col("label") == 0) & (F.col("level") > 0), F.col("label") == 1
    told = cells.groupBy("feature").agg(
        *_merged(high, "h"), *_merged(anomaly, "a"), F.sum(F.when(high, F.col("rows"))).alias("n_high")
    )
    return told.where("n_high > 0").select(
        "feature",
        F.col("m_h").alias("high_prob_normal_mean"),
        F.col("m_a").alias("anomaly_mean"),
        F.abs(F.col("m_h") - F.col("m_a")).alias("absolute_diff"),
    )


def likeness_extremes(likeness: DataFrame, similar: int = 10, different: int = 5) -> DataFrame:
    """The most similar and the most different features."""
    near = likeness.orderBy(F.col("absolute_diff").asc(), F.col("feature").asc()).limit(similar)
    far = likeness.orderBy(F.col("absolute_diff").desc(), F.col("feature").desc()).limit(different)
    return near.withColumn("side", F.lit("similar")).unionByName(far.withColumn("side", F.lit("different")))


def cohort_histograms(
    df: DataFrame, features: Sequence[str], threshold: float = 0.5, top: int = 6, bins: int = 30
) -> DataFrame:
    """Density histograms of the three cohorts for the features that differ most."""
    chosen = [r["feature"] for r in strongest(feature_contrast(df, features, threshold), top).collect()]
    cohort = F.when(F.col(LABEL) == 1, "anomaly").when(_high(threshold), "high").otherwise("low")
    return histogram(df.withColumn("cohort", cohort), chosen, bins, density=True, by=["cohort"])
