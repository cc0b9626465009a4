"""Choosing a decision threshold.

All thresholds are evaluated in one scan: each row is counted under the number
of thresholds its score reaches, which gives at most one row per threshold,
and running sums over those few rows give the counts at every threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions import rates
from signalsift.functions.grades import alarm_grade, stability_grade
from signalsift.functions.numeric import steps_reached
from signalsift.operators.combine import best_row
from signalsift.operators.metrics import LABEL, SCORE, decision_counts


def threshold_counts(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn at every threshold (and group): one scan."""
    thresholds = sorted(float(t) for t in thresholds)
    positive = F.col(LABEL) == 1
    place = F.coalesce(steps_reached(F.col(SCORE), thresholds), F.lit(0))  # no score reaches no threshold
    reached = df.groupBy(*by, place.alias("__k")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    # One row per threshold from here on. Each group of rows answers for all
    # thresholds it reaches, 1 … k; number 0 keeps the totals complete.
    steps = reached.select(
        *by, "__k", "pos", "neg", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds)))).alias("__i")
    )
    hit = F.col("__k") >= F.col("__i")
    sums = steps.groupBy(*by, "__i").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
    )
    values = F.array(*[F.lit(t) for t in thresholds])
    return sums.filter("__i > 0").select(
        *by, F.element_at(values, F.col("__i")).alias("threshold"), "tp", "fp", "tn", "fn"
    )


def threshold_metrics(
    df: DataFrame, thresholds: Sequence[float] = cfg.FAR_THRESHOLDS, by: Sequence[str] = ()
) -> DataFrame:
    """Recall, precision, false-positive rate, false alarms per hour, F2 and counts."""
    return _with_rates(threshold_counts(df, thresholds, by), by)


def _with_rates(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    return counts.select(
        *by,
        "threshold",
        rates.f_beta(tp, fp, fn, 2.0).alias("f2_score"),
        rates.f_beta(tp, fp, fn, 1.0).alias("f1_score"),
        rates.precision(tp, fp).alias("precision"),
        rates.recall(tp, fn).alias("recall"),
        rates.false_positive_rate(fp, tn).alias("fpr"),
        rates.false_alarms_per_hour(fp, tn, total).alias("far_per_hour"),
        rates.alerts_per_hour(tp, fp, total).alias("total_alerts_per_hour"),
        rates.accuracy(tp, fp, tn, fn).alias("accuracy"),
        "tp", "fp", "tn", "fn",
    )


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = cfg.SWEEP) -> DataFrame:
    """The curve of F2, F1, precision, recall and false-positive rate."""
    return threshold_metrics(df, thresholds).select(
        "threshold", "f2_score", "f1_score", "precision", "recall", F.col("fpr").alias("far")
    )


def best_f2(df: DataFrame, thresholds: Sequence[float] = cfg.SWEEP, fallback: float = 0.5) -> DataFrame:
    """The threshold with the highest F2, the lowest one on ties, with all its
    figures; ``fallback`` if every F2 is 0."""
    offered = sorted({*map(float, thresholds), float(fallback)})
    metrics = threshold_metrics(df, offered)
    swept = F.col("threshold").isin(*[float(t) for t in thresholds])
    # F2 of the fallback counts as 0 unless it is also swept, so it wins only
    # where all swept ones are 0.
    rank = F.when(swept, F.col("f2_score")).otherwise(0.0)
    preferred = (F.col("threshold") == float(fallback)).cast("int")
    tie = F.when(rank > 0, 0).otherwise(preferred)
    return (
        metrics.withColumn("__rank", rank)
        .orderBy(F.col("__rank").desc(), tie.desc(), F.col("threshold").asc())
        .limit(1)
        .drop("__rank")
        .withColumnRenamed("threshold", "optimal_threshold")
        .withColumn("minutes_between_false_alarms", rates.minutes_between(F.col("far_per_hour")))
        .withColumn("status", alarm_grade(F.col("far_per_hour")))
    )


def within_budget(metrics: DataFrame, budgets: Sequence[float] = cfg.FAR_BUDGETS) -> DataFrame:
    """Best recall whose false alarms per hour keep each budget, lowest
    threshold on ties; a budget nothing keeps is absent."""
    offers = metrics.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets]))).filter(
        F.col("far_per_hour") <= F.col("budget")
    )
    return best_row(offers, ["budget"], "recall", "threshold")


def recommend(metrics: DataFrame, budget: float = cfg.SUSTAINABLE_FAR) -> DataFrame:
    return within_budget(metrics, [budget])


def per_fold(df: DataFrame, threshold: float, fold: str = "fold") -> DataFrame:
    """F2, precision, recall and rows of each fold at one threshold."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return decision_counts([fold], df, threshold).select(
        fold,
        rates.f_beta(tp, fp, fn, 2.0).alias("f2_score"),
        rates.precision(tp, fp).alias("precision"),
        rates.recall(tp, fn).alias("recall"),
        (tp + fp + tn + fn).alias("n_samples"),
    )


def stability(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds, with a grade from F2."""
    aggs = []
    for m in ("f2_score", "precision", "recall"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return folds.agg(*aggs).withColumn("stability", stability_grade(F.col("f2_score_std")))


def at_threshold(df: DataFrame, threshold: float = cfg.BASE_THRESHOLD) -> DataFrame:
    """All figures at a configured threshold, for runs without tuning."""
    return threshold_metrics(df, [threshold]).withColumn("status", alarm_grade(F.col("far_per_hour")))


def running_best(trials: DataFrame, order: str = "trial", score: str = "score") -> DataFrame:
    """Best score so far after each trial. The table has one row per trial of a search."""
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trials.withColumn("best_so_far", F.max(score).over(so_far))


def improvement(trials: DataFrame, baseline: float = cfg.BASELINE_ROC_AUC, score: str = "score") -> DataFrame:
    """Best score against the score of the current model, in points."""
    best: Column = F.max(score)
    return trials.agg(
        best.alias("best_score"),
        F.lit(baseline).alias("baseline"),
        ((best - baseline) * 100).alias("improvement"),
    )
