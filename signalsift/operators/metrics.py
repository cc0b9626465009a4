"""Quality of a probability score, exact and without sorting raw rows.

Input is a long prediction table: a 0/1 column ``y_true``, a score ``y_prob``
and any group columns (``by``, for example the fold). A row without a score reaches no
threshold and ranks below all others; it is counted everywhere. Rank metrics first
collapse the rows to distinct scores with their positives and negatives; only
that table is ordered, in slices if it is still large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsift.functions import rates
from signalsift.functions.grades import separation_grade
from signalsift.functions.numeric import ratio, steps_reached
from signalsift.operators.ordering import ROWS_PER_SLICE, running_sums
from signalsift.session import staged

LABEL, SCORE = "y_true", "y_prob"


def _positive() -> Column:
    return F.col(LABEL) == 1


def predictions(df: DataFrame, label: str, score: str, keep: Sequence[str] = ()) -> DataFrame:
    """A prediction table from any table with a label and a score."""
    return df.select(*keep, F.col(label).cast("int").alias(LABEL), F.col(score).cast("double").alias(SCORE))


def reached(threshold: Column | float) -> Column:
    """Whether the score reaches the threshold; no score reaches none."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(F.col(SCORE) >= t, F.lit(False))


def decide(df: DataFrame, threshold: float) -> DataFrame:
    """1 where the score reaches the threshold."""
    return df.withColumn("y_pred", reached(threshold).cast("int"))


# --- class balance -----------------------------------------------------------


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Counts of both classes and the weight of a positive, negatives / positives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(neg.alias("n_negative"), pos.alias("n_positive"), ratio(neg, pos).alias("scale_pos_weight"))


# --- counts at one threshold -------------------------------------------------


def _decisions(threshold: float) -> list[Column]:
    hit, pos = reached(threshold), _positive()
    return [
        F.count_if(pos & hit).alias("tp"),
        F.count_if(~pos & hit).alias("fp"),
        F.count_if(~pos & ~hit).alias("tn"),
        F.count_if(pos & ~hit).alias("fn"),
    ]


def decision_counts(by: Sequence[str], df: DataFrame, threshold: float) -> DataFrame:
    """tp, fp, tn, fn per group."""
    return df.groupBy(*by).agg(*_decisions(threshold))


def confusion_matrix(df: DataFrame, threshold: float) -> DataFrame:
    """Four rows (y_true, y_pred, n), zeros included."""
    c = decision_counts([], df, threshold)
    cells = [
        F.struct(F.lit(y).alias("y_true"), F.lit(p).alias("y_pred"), F.col(name).alias("n"))
        for y, p, name in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ]
    return c.select(F.inline(F.array(*cells)))


def decision_metrics(df: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 per group; 0 where undefined."""
    return decision_counts(by, df, threshold).select(*by, *_decision_rates())


def _decision_rates() -> list[Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return [
        rates.accuracy(tp, fp, tn, fn).alias("accuracy"),
        rates.precision(tp, fp).alias("precision"),
        rates.recall(tp, fn).alias("recall"),
        rates.f_beta(tp, fp, fn).alias("f1"),
    ]


def classification_report(df: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1, support per class, their macro and weighted means, accuracy."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    sides = {
        "Normal": (rates.precision(tn, fn), rates.recall(tn, fp), rates.f_beta(tn, fn, fp), tn + fp),
        "Anomaly": (rates.precision(tp, fp), rates.recall(tp, fn), rates.f_beta(tp, fp, fn), tp + fn),
    }
    total = tp + fp + tn + fn
    (p0, r0, f0, s0), (p1, r1, f1, s1) = sides.values()

    def row(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("support")
        )

    def weighted(a: Column, b: Column) -> Column:
        return ratio(a * s0 + b * s1, total)

    right = rates.accuracy(tp, fp, tn, fn)
    rows = [
        *[row(name, *values) for name, values in sides.items()],
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), total),
        row("accuracy", right, right, right, total),
    ]
    return decision_counts([], df, threshold).select(F.inline(F.array(*rows)))


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared distance of score and label."""
    return df.groupBy(*by).agg(_brier())


def _brier() -> Column:
    return F.avg(F.pow(F.col(SCORE) - F.col(LABEL), F.lit(2))).alias("brier")


# --- rank metrics ------------------------------------------------------------


def score_counts(df: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Positives and negatives per distinct score; ``digits`` rounds the score
    first, to bound the table at the price of exactness."""
    score = F.col(SCORE) if digits is None else F.round(SCORE, digits)
    return df.groupBy(*by, score.alias(SCORE)).agg(
        F.count_if(_positive()).alias("pos"), F.count_if(~_positive()).alias("neg")
    )


def ranked_scores(
    df: DataFrame, by: Sequence[str] = (), digits: int | None = None, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Distinct scores from the highest down with running counts tp and fp.

    The scores are staged: planning and ranking read them, not the rows.
    """
    counts = staged(score_counts(df, by, digits), "scores").withColumn("__down", -F.col(SCORE))
    return running_sums(counts, by, ["__down"], {"pos": "tp", "neg": "fp"}, rows_per_slice).drop("__down")


def rank_metrics(
    df: DataFrame, by: Sequence[str] = (), digits: int | None = None, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; NULL if a class is missing."""
    r = ranked_scores(df, by, digits, rows_per_slice)
    above = F.col("tp") - F.col("pos")
    wins = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    gained = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    p, n = F.sum("pos"), F.sum("neg")
    both = (p > 0) & (n > 0)
    return r.groupBy(*by).agg(
        F.when(both, ratio(wins, p.cast("double") * n.cast("double"))).alias("roc_auc"),
        F.when(both, ratio(gained, p)).alias("pr_auc"),
        p.alias("n_positive"),
        n.alias("n_negative"),
    )


def _class_totals(ranked: DataFrame) -> tuple[Column, Column]:
    """Positives and negatives of the table, from its distinct scores."""
    row = ranked.agg(F.sum("pos"), F.sum("neg")).first()
    return F.lit(row[0]).cast("long"), F.lit(row[1]).cast("long")


def roc_points(df: DataFrame) -> DataFrame:
    """Curve points (threshold, fpr, tpr) from (0, 0) with an infinite threshold on."""
    r = ranked_scores(df)
    p, n = _class_totals(r)
    points = r.select(
        F.col(SCORE).alias("threshold"), ratio(F.col("fp"), n).alias("fpr"), ratio(F.col("tp"), p).alias("tpr")
    )
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def precision_recall_points(df: DataFrame) -> DataFrame:
    """Curve points (threshold, precision, recall) per distinct score."""
    r = ranked_scores(df)
    p, _ = _class_totals(r)
    return r.select(
        F.col(SCORE).alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), p).alias("recall"),
    )


def score_metrics(df: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """All metrics of a score per group: the ranks, and one aggregate for the rest."""
    counted = df.groupBy(*by).agg(_brier(), *_decisions(threshold)).select(*by, "brier", *_decision_rates())
    ranks = rank_metrics(df, by)
    if by:
        return ranks.join(counted, list(by))
    return ranks.withColumn("__one", F.lit(1)).join(counted.withColumn("__one", F.lit(1)), "__one").drop("__one")


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and deviation over folds: population for the two areas, sample for
    the others; folds without an area are left out of its mean."""
    names = ["roc_auc", "pr_auc", "brier", "accuracy", "precision", "recall", "f1"]
    aggs = []
    for m in names:
        spread = F.stddev_pop(m) if m in ("roc_auc", "pr_auc") else F.stddev_samp(m)
        aggs += [F.avg(m).alias(f"m_{m}"), spread.alias(f"s_{m}"), F.count(m).alias(f"n_{m}")]
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"m_{m}").alias("mean"),
            F.col(f"s_{m}").alias("std"),
            F.col(f"n_{m}").alias("valid_folds"),
        )
        for m in names
    ]
    return fold_metrics.agg(*aggs).select(F.inline(F.array(*rows)))


# --- distribution of the score -----------------------------------------------


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and share of positives per uniform bin; an edge value belongs
    to the lower bin, empty bins are absent."""
    edges = [i / bins for i in range(1, bins)]
    return (
        df.groupBy(steps_reached(F.col(SCORE), edges, inclusive=False).alias("bin"))
        .agg(
            F.avg(SCORE).alias("mean_predicted"),
            F.avg(_positive().cast("double")).alias("fraction_positive"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def score_distribution(df: DataFrame) -> DataFrame:
    """Per class: n, mean, median, population deviation, min, max of the score."""
    from signalsift.operators.quantiles import exact_quantiles

    medians = F.create_map(
        *[
            x
            for y in (0, 1)
            for x in (F.lit(y), F.lit(exact_quantiles(df.filter(F.col(LABEL) == y), [SCORE])[SCORE][0]).cast("double"))
        ]
    )
    return df.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(SCORE).alias("mean"),
        F.stddev_pop(SCORE).alias("std"),
        F.min(SCORE).alias("min"),
        F.max(SCORE).alias("max"),
    ).withColumn("median", medians[F.col(LABEL)])


def class_overlap(df: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """How far the classes overlap, with a grade of their distance."""
    pos, p = _positive(), F.col(SCORE)
    n_normal, n_anomaly = F.count_if(~pos), F.count_if(pos)
    overlap = F.count_if(~pos & (p > low) & (p < high))
    sure, missed = F.count_if(pos & (p > high)), F.count_if(pos & (p < low))
    distance = F.avg(F.when(pos, p)) - F.avg(F.when(~pos, p))
    return df.agg(
        overlap.alias("overlap_normal"),
        (ratio(overlap, n_normal) * 100).alias("overlap_normal_pct"),
        sure.alias("anomaly_high"),
        (ratio(sure, n_anomaly) * 100).alias("anomaly_high_pct"),
        missed.alias("anomaly_low"),
        (ratio(missed, n_anomaly) * 100).alias("anomaly_low_pct"),
        distance.alias("mean_difference"),
        separation_grade(distance).alias("separation"),
    )


def fold_validity(df: DataFrame, fold: str = "fold", least: int = 100) -> DataFrame:
    """Per fold: enough rows, both classes."""
    n, pos = F.count(F.lit(1)), F.count_if(_positive())
    return df.groupBy(fold).agg(
        n.alias("n"),
        pos.alias("n_positive"),
        (n >= least).alias("enough_rows"),
        ((pos > 0) & (pos < n)).alias("both_classes"),
    )
