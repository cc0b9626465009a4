"""Metrics, thresholds, alarms, preparation, folds: small literal cases."""

from __future__ import annotations

import math
import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from signalsift.config import telemetry as cfg
from signalsift.operators import drift, folds, investigate, metrics, prep, threshold

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
CASES = st.lists(st.tuples(st.integers(0, 1), st.sampled_from([i / 20 for i in range(21)])), min_size=1, max_size=40)


def table(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "y_true int, y_prob double")


def brute_auc(pairs):
    pos = [p for y, p in pairs if y]
    neg = [p for y, p in pairs if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def brute_precision(pairs):
    total = sum(y for y, _ in pairs)
    if not total or total == len(pairs):
        return None
    out, before = 0.0, 0
    for t in sorted({p for _, p in pairs}, reverse=True):
        hit = [y for y, p in pairs if p >= t]
        out += (sum(hit) - before) / total * sum(hit) / len(hit)
        before = sum(hit)
    return out


@SLOW
@given(CASES, st.sampled_from([2, 10**6]))
def test_areas(spark, pairs, rows_per_slice):
    got = metrics.rank_metrics(table(spark, pairs), rows_per_slice=rows_per_slice).first()
    for value, want in ((got["roc_auc"], brute_auc(pairs)), (got["pr_auc"], brute_precision(pairs))):
        assert value is None if want is None else math.isclose(value, want, abs_tol=1e-9)


@SLOW
@given(CASES)
def test_reversed_score_gives_the_complement(spark, pairs):
    area = metrics.rank_metrics(table(spark, pairs)).first()["roc_auc"]
    other = metrics.rank_metrics(table(spark, [(y, 1 - p) for y, p in pairs])).first()["roc_auc"]
    assert (area is None and other is None) or math.isclose(area, 1 - other, abs_tol=1e-9)


def test_tied_scores(spark):
    got = metrics.rank_metrics(table(spark, [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)])).first()
    assert (got["roc_auc"], got["pr_auc"]) == (0.5, 0.5)


def test_one_class_only(spark):
    df = table(spark, [(0, 0.2), (0, 0.9)])
    got = metrics.score_metrics(df, 0.5).first()
    assert (got["roc_auc"], got["pr_auc"]) == (None, None)
    assert (got["precision"], got["recall"], got["f1"], got["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    assert rows(metrics.confusion_matrix(df, 0.5)) == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0)]
    assert metrics.class_weights(df).first()["scale_pos_weight"] is None


def test_calibration_edge_is_in_the_lower_bin(spark):
    got = metrics.calibration(table(spark, [(1, 0.1), (0, 0.100001), (1, 1.0), (0, 0.0)]))
    assert rows(got.select("bin", "n")) == [(0, 2), (1, 1), (9, 1)]


def test_curves_start_at_the_origin(spark):
    got = rows(metrics.roc_points(table(spark, [(1, 0.9), (0, 0.4), (1, 0.4), (0, 0.1)])))
    assert sorted(got, reverse=True) == [(math.inf, 0.0, 0.0), (0.9, 0.0, 0.5), (0.4, 0.5, 1.0), (0.1, 1.0, 1.0)]


@SLOW
@given(CASES)
def test_sweep_equals_counting(spark, pairs):
    thresholds = [0.0, 0.25, 0.3, 0.5, 0.95, 1.0]
    got = {r["threshold"]: r for r in threshold.threshold_metrics(table(spark, pairs), thresholds).collect()}
    assert sorted(got) == thresholds
    for t in thresholds:
        tp = sum(y and p >= t for y, p in pairs)
        fp = sum(not y and p >= t for y, p in pairs)
        fn = sum(y and p < t for y, p in pairs)
        r = got[t]
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
        f2 = 5 * tp / (5 * tp + 4 * fn + fp) if tp else 0.0
        assert math.isclose(r["f2_score"], f2, abs_tol=1e-9)


def test_best_threshold_without_any_positive(spark):
    got = threshold.best_f2(table(spark, [(0, 0.3), (0, 0.8)])).first()
    assert (got["optimal_threshold"], got["f2_score"]) == (0.5, 0.0)
    # 0.5 is reported even if it is no sweep point
    got = threshold.best_f2(table(spark, [(0, 0.3), (0, 0.8)]), [0.2, 0.9]).first()
    assert got["optimal_threshold"] == 0.5


def test_best_threshold_takes_the_lowest_on_ties(spark):
    got = threshold.best_f2(table(spark, [(1, 0.8), (0, 0.05)]), [0.2, 0.4, 0.6, 0.85]).first()
    assert (got["optimal_threshold"], got["f2_score"], got["status"]) == (0.2, 1.0, "EXCELLENT")
    assert got["minutes_between_false_alarms"] is None


def test_budgets(spark):
    pairs = [(1, 0.9), (1, 0.6), (0, 0.5), *[(0, 0.01)] * 97]
    m = threshold.threshold_metrics(table(spark, pairs), [0.4, 0.55, 0.7, 0.0])
    got = {r["budget"]: r["threshold"] for r in threshold.within_budget(m, [1, 8, 10_000]).collect()}
    # one false alarm in 100 windows are 7.2 per hour
    assert got == {1.0: 0.55, 8.0: 0.4, 10_000.0: 0.0}
    assert threshold.within_budget(m.filter("threshold = 0"), [1]).count() == 0
    assert threshold.recommend(m).count() == 1


def test_running_best_and_improvement(spark):
    trials = spark.createDataFrame([(0, 0.5), (1, None), (2, 0.9), (3, 0.7)], "trial int, score double")
    assert [r[2] for r in threshold.running_best(trials).orderBy("trial").collect()] == [0.5, 0.5, 0.9, 0.9]
    assert threshold.improvement(trials).first()["improvement"] == pytest.approx((0.9 - 0.8090) * 100)


def test_no_false_alarm_gives_empty_tables(spark):
    df = spark.createDataFrame([("a", 0, 0.1, 1.0), ("a", 1, 0.9, 2.0)], "scenario_id string, y_true int, y_prob double, f double")
    assert investigate.feature_contrast(df, ["f"], 0.5).count() == 0
    assert investigate.anomaly_likeness(df, ["f"], 0.5).count() == 0
    assert investigate.alarms_by_scenario(df).first()["false_alarm_rate"] == 0.0
    assert rows(investigate.cohort_sizes(df, [0.5]).select("n_high", "high_pct", "high_mean_prob")) == [(0, 0.0, None)]


def test_effect_size(spark):
    data = [("a", 0, 0.9, v) for v in (1.0, 3.0)] + [("a", 0, 0.1, v) for v in (5.0, 7.0)] + [("b", 1, 0.5, 2.0)]
    df = spark.createDataFrame(data, "scenario_id string, y_true int, y_prob double, f double").selectExpr("*", "1.0D AS same")
    got = {r["feature"]: r for r in investigate.feature_contrast(df, ["f", "same"], 0.5).collect()}
    assert got["f"]["diff"] == -4.0
    assert got["f"]["effect_size"] == pytest.approx(4 / math.sqrt(2))
    assert got["same"]["effect_size"] == 0.0
    assert investigate.alarms_by_scenario(df).filter("scenario_id = 'b'").first()["false_alarm_rate"] == 0.0
    made = investigate.cohort_histograms(df, ["f", "same"], top=1, bins=4)
    assert {r["cohort"] for r in made.collect()} == {"high", "low", "anomaly"}
    assert made.count() == 12


def test_scaling(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, None), (5.0, 3.0)], "same double, v double")
    fitted = prep.fit_preparation(df, ["same", "v"], [])
    assert fitted.scale["same"] == (5.0, 1.0)
    assert fitted.scale["v"] == pytest.approx((2.0, math.sqrt(2 / 3)))
    got = prep.transform(df, fitted).select("same", "v").collect()
    assert [r["same"] for r in got] == [0.0] * 3
    assert [None if r["v"] is None else round(r["v"], 6) for r in got] == [-1.224745, None, 1.224745]
    assert prep.transform(df, fitted, impute=True).filter("v IS NULL").count() == 0


def test_unknown_category_is_all_zero(spark):
    fitted = prep.fit_preparation(spark.createDataFrame([("b",), ("a",), ("c'x",), (None,)], "c string"), [], ["c"])
    assert fitted.categories == {"c": ["a", "b", "c'x"]}
    new = spark.createDataFrame([("a",), ("c'x",), ("zz",), (None,)], "c string")
    assert rows(prep.transform(new, fitted)) == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)]
    stages = new
    for stage in prep.as_stages(fitted):
        stages = stage.transform(stages)
    assert [r["features"].toArray().tolist() for r in stages.collect()] == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0]]


def test_feature_order_contract():
    fitted = prep.Preparation({"a": (0.0, 1.0), "b": (0.0, 1.0)}, {"c": ["x", "y"]})
    assert fitted.feature_order == ["a", "b", "ohe_c_0", "ohe_c_1"]
    prep.same_contract(fitted, ["a", "b", "ohe_c_0", "ohe_c_1"])
    with pytest.raises(ValueError):
        prep.same_contract(fitted, ["b", "a", "ohe_c_0", "ohe_c_1"])


def test_many_categories(spark):
    df = spark.range(2500).selectExpr("concat('c', lpad(id, 5, '0')) AS c")
    stages = df
    for stage in prep.as_stages(prep.fit_preparation(df, [], ["c"])):
        stages = stage.transform(stages)
    got = {r["c"]: r["features"] for r in stages.select("c", "features").collect()}
    assert all((v.size, v.indices.tolist(), v.values.tolist()) == (2500, [int(c[1:])], [1.0]) for c, v in got.items())


def test_group_folds_balance_by_size(spark):
    sizes = {"a": 5, "b": 4, "c": 3, "d": 3, "e": 1}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "scenario_id string")
    got = dict(rows(folds.assign_folds(df, folds=2).distinct()))
    # a→1, b→2, c→2 (4 < 5), d→1 (5 < 7), e→2 (7 < 8)
    assert got == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 2}
    with pytest.raises(ValueError, match="at least"):
        folds.assign_folds(df, folds=6)


def greedy(sizes, k):
    """Each group, largest first, to the fold with the fewest rows so far."""
    load, out = [0] * k, []
    for size in sizes:
        fold = min(range(k), key=lambda f: (load[f], f))
        load[fold] += size
        out.append(fold + 1)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(1, 6))
def test_runs_are_the_greedy_folds(sizes, k):
    sizes = sorted(sizes, reverse=True)
    got = []
    for _, first, last, turn in folds.balanced_runs([(n, sizes.count(n)) for n in sorted(set(sizes), reverse=True)], k):
        got += [turn[i % len(turn)] for i in range(last - first)]
    assert got == greedy(sizes, k)


def test_many_groups_are_balanced(spark):
    df = spark.range(5000).selectExpr("concat('g', lpad(pmod(hash(id), 700), 4, '0')) AS scenario_id")
    sizes = sorted(((-n, g) for g, n in rows(df.groupBy("scenario_id").count())))
    want = dict(zip([g for _, g in sizes], greedy([-n for n, _ in sizes], 4)))
    assert dict(rows(folds.assign_folds(df, folds=4).distinct())) == want


def test_drift_of_the_same_table_is_zero(spark):
    source = random.Random(1)
    df = spark.createDataFrame([(source.gauss(0, 1),) for _ in range(500)], "v double")
    same = drift.population_stability(df, df, ["v"]).first()
    assert (round(same["psi"], 9), same["drifted"]) == (0.0, False)
    moved = drift.population_stability(df, df.selectExpr("v + 1 AS v"), ["v"]).first()
    assert moved["drifted"]


def test_sweep_points():
    assert len(cfg.SWEEP) == 81
    assert (cfg.SWEEP[0], round(cfg.SWEEP[-1], 12)) == (0.1, 0.9)
