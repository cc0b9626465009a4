"""Grades of a number as WHEN chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alarm_grade(per_hour: Column) -> Column:
    """Operational grade of a false-alarm rate per hour."""
    return (
        F.when(per_hour <= 10, "EXCELLENT")
        .when(per_hour <= 30, "GOOD")
        .when(per_hour <= 60, "MODERATE")
        .otherwise("HIGH")
    )


def stability_grade(deviation: Column) -> Column:
    """Grade of the spread of F2 over folds."""
    return (
        F.when(deviation < 0.02, "EXCELLENT")
        .when(deviation < 0.05, "GOOD")
        .when(deviation < 0.10, "MODERATE")
        .otherwise("LOW")
    )


def separation_grade(difference: Column) -> Column:
    """Grade of the distance between the class means of a score."""
    return (
        F.when(difference > 0.5, "EXCELLENT")
        .when(difference > 0.3, "GOOD")
        .when(difference > 0.15, "MODERATE")
        .otherwise("POOR")
    )
