"""Scores and alerts with a stored model, in batch or on a stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions.grades import alarm_grade
from signalsift.functions.numeric import ratio_or_zero
from signalsift.operators.metrics import SCORE
from signalsift.plans.train import score


def alerts(features: DataFrame, model: PipelineModel, threshold: float) -> DataFrame:
    """Scored windows with ``alert`` set where the score reaches the threshold."""
    scored = score(features, model)
    return scored.withColumn("alert", (F.col(SCORE) >= F.lit(float(threshold))).cast("int"))


def alert_rate(alerted: DataFrame, per_hour: float = cfg.WINDOWS_PER_HOUR) -> DataFrame:
    """Windows, alerts and alerts per hour per scenario, with a grade."""
    n, hits = F.count(F.lit(1)), F.sum("alert")
    rate = ratio_or_zero(hits, n) * per_hour
    return alerted.groupBy("scenario_id").agg(
        n.alias("windows"), hits.alias("alerts"), rate.alias("alerts_per_hour"), alarm_grade(rate).alias("status")
    )
