"""Rates from the four counts of a binary decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions.numeric import ratio, ratio_or_zero


def precision(tp: Column, fp: Column) -> Column:
    return ratio_or_zero(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio_or_zero(tp, tp + fn)


def false_positive_rate(fp: Column, tn: Column) -> Column:
    return ratio_or_zero(fp, fp + tn)


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    """(1+b²)·tp / ((1+b²)·tp + b²·fn + fp), 0 where undefined."""
    square = beta * beta
    top = tp * (1 + square)
    return ratio_or_zero(top, top + fn * square + fp)


def accuracy(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return ratio_or_zero(tp + tn, tp + fp + tn + fn)


def false_alarms_per_hour(
    fp: Column, tn: Column, total: Column, per_hour: float = cfg.WINDOWS_PER_HOUR
) -> Column:
    """Rate among normals times the normal windows of an hour."""
    return false_positive_rate(fp, tn) * ratio_or_zero(fp + tn, total) * per_hour


def alerts_per_hour(
    tp: Column, fp: Column, total: Column, per_hour: float = cfg.WINDOWS_PER_HOUR
) -> Column:
    return ratio_or_zero(tp + fp, total) * per_hour


def minutes_between(per_hour: Column) -> Column:
    """Minutes from one false alarm to the next; NULL without false alarms."""
    return ratio(F.lit(60.0), F.when(per_hour > 0, per_hour))
