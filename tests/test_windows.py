"""Numbering, windows, features, and the scale path behind them."""

from __future__ import annotations

import random
import warnings

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions.features import FEATURES
from signalsift.operators import features, ordering, windows
from signalsift.plans.curate import featurize, windowed
from signalsift.plans.surrogate import LINEITEM_ORDER, telemetry_lineitem

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def samples(spark, sizes: dict[str, int], **columns):
    data = [(s, i, *[f(s, i) for f in columns.values()]) for s, n in sizes.items() for i in range(n)]
    types = ", ".join(f"{c} double" if not c.startswith("lab") else f"{c} int" for c in columns)
    return spark.createDataFrame(data, f"scenario_id string, ts_ns long{', ' + types if types else ''}")


def skewed(spark, seed: int = 1, n: int = 3000):
    """A third of the rows in one scenario, half of those at one instant."""
    source = random.Random(seed)
    data = []
    for i in range(n):
        hot = source.random() < 0.34
        scenario = "hot" if hot else source.choice("abc")
        instant = 5 if hot and source.random() < 0.5 else source.choice([None, source.randint(0, 50), source.randint(0, 10**9)])
        data.append((scenario, instant, i, source.random()))
    return spark.createDataFrame(data, "g string, t long, tie long, v double")


@pytest.mark.parametrize("rows_per_slice", [7, 50, 400])
def test_sliced_numbering_equals_a_window(spark, rows_per_slice):
    df = skewed(spark)
    plan = ordering.plan_slices(df, ["g"], ["t", "tie"], rows_per_slice)
    assert plan.levels
    sizes = plan.apply(df).groupBy(*plan.keys).count().agg(F.max("count")).first()[0]
    assert sizes <= 2 * max(rows_per_slice, 1) + 1
    w = Window.partitionBy("g").orderBy("t", "tie")
    want = df.withColumn("rn", F.row_number().over(w).cast("long"))
    got = ordering.number_rows(df, ["g"], ["t", "tie"], rows_per_slice=rows_per_slice)
    assert rows(got.select("tie", "rn")) == rows(want.select("tie", "rn"))


def test_sliced_running_sums_and_carry(spark):
    df = skewed(spark, 2).withColumn("x", F.when(F.col("v") < 0.1, F.round("v", 3)))
    w = Window.partitionBy("g").orderBy("t", "tie").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("tie", F.sum("tie").over(w).alias("s"), F.last("x", ignorenulls=True).over(w).alias("x"))
    sums = ordering.running_sums(df.drop("x"), ["g"], ["t", "tie"], {"tie": "s"}, 20).select("tie", "s")
    carried = ordering.carry_forward(df, ["g"], ["t", "tie"], ["x"], 20).select("tie", "x")
    assert rows(sums.join(carried, "tie")) == rows(want)


def test_whole_table_as_one_group(spark):
    df = skewed(spark, 3, 500).withColumn("down", -F.col("v"))
    got = ordering.running_sums(df, [], ["down"], {"tie": "s"}, 20)
    w = Window.orderBy("down").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got.select("tie", "s")) == rows(df.select("tie", F.sum("tie").over(w).alias("s")))


def test_slices_depend_on_values_only(spark):
    df = skewed(spark, 4)
    plan = ordering.plan_slices(df, ["g"], ["t", "tie"], 30)
    a = plan.apply(df.repartition(7)).select("tie", *plan.slice_columns)
    b = plan.apply(df.coalesce(1)).select("tie", *plan.slice_columns)
    assert rows(a) == rows(b)


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [("a", i) for i in range(5)], "g string, t long")
    got = ordering.number_rows(df, ["g"], ["t"], rows_per_slice=4)
    assert got.count() == 35
    assert got.filter("rn = t + 1").count() == 35


def test_order_by_text_is_refused(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(9)], "g string, t string")
    with pytest.raises(TypeError, match="numeric"):
        ordering.number_rows(df, ["g"], ["t"], rows_per_slice=2)


@SLOW
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(1, 40), min_size=1), st.sampled_from([4, 10**6]))
def test_window_count(spark, sizes, rows_per_slice):
    df = samples(spark, sizes, sinr_db=lambda s, i: float(i))
    made = windows.count_windows(df, ["ts_ns"], rows_per_slice=rows_per_slice)
    got = {r["scenario_id"]: r["count"] for r in made.groupBy("scenario_id").count().collect()}
    assert got == {s: n // 10 for s, n in sizes.items() if n >= 10}
    counts = {r["scenario_id"]: r["windows"] for r in windows.window_counts(df).collect()}
    assert counts == {s: n // 10 for s, n in sizes.items()}


def test_tail_is_dropped_and_nothing_from_nine_rows(spark):
    df = samples(spark, {"a": 25, "b": 9}, sinr_db=lambda s, i: float(i))
    made = windows.count_windows(df, ["ts_ns"])
    assert rows(made.select("scenario_id", "window_no", "ts_start_ns", "sinr_mean", "gap_ratio")) == [
        ("a", 0, 0, 4.5, 0.0),
        ("a", 1, 10, 14.5, 0.0),
    ]


def test_defaults_of_empty_and_single_values(spark):
    df = samples(spark, {"a": 10}, sinr_db=lambda s, i: None, rsrp_dbm=lambda s, i: 7.0 if i == 3 else None)
    row = windows.count_windows(df, ["ts_ns"]).first()
    assert [row[c] for c in ("sinr_mean", "sinr_std", "sinr_min", "sinr_max")] == [0.0] * 4
    assert (row["rsrp_mean"], row["rsrp_std"]) == (7.0, 0.0)
    assert row["weak_label"] == 0  # no label column at all
    modes = spark.createDataFrame([("a", i, None) for i in range(10)], "scenario_id string, ts_ns long, mcs_dl long")
    assert windows.count_windows(modes, ["ts_ns"]).first()["mcs_dl_mode"] == 0


def test_weak_label_is_any_label(spark):
    df = samples(
        spark, {"a": 30}, lab_anom=lambda s, i: 1 if i == 4 else (None if i == 5 else 0), lab_inf=lambda s, i: 1 if i == 22 else 0
    )
    made = windows.count_windows(df, ["ts_ns"])
    assert rows(made.select("window_no", "weak_label")) == [(0, 1), (1, 0), (2, 1)]


@pytest.mark.parametrize("chunk", [2, 3, 7, 100])
def test_chunked_frames_equal_whole_ones(spark, chunk):
    source = random.Random(5)
    data = [(g, i, source.random()) for g, n in (("a", 23), ("b", 1), ("c", 8)) for i in range(n)]
    df = spark.createDataFrame(data, "scenario_id string, window_no long, sinr_mean double")
    w = Window.partitionBy("scenario_id").orderBy("window_no")
    d = F.coalesce(F.col("sinr_mean") - F.lag("sinr_mean").over(w), F.lit(0.0))
    want = df.withColumn("d", d).select(
        "scenario_id", "window_no",
        F.round("d", 9).alias("d"),
        F.round(F.coalesce(F.col("d") - F.lag("d").over(w), F.lit(0.0)), 9).alias("dd"),
        F.round(F.avg("sinr_mean").over(w.rowsBetween(-2, 0)), 9).alias("m"),
    )
    if chunk > 2:
        got = windows.add_rolling(
            windows.add_second_deltas(windows.add_deltas(df, ["sinr_mean"], chunk=chunk), chunk=chunk), length=3, chunk=chunk
        )
        got = got.select("scenario_id", "window_no", *[F.round(c, 9) for c in ("d_sinr_mean", "dd_sinr_mean", "sinr_mean_roll_mean")])
        assert rows(got) == rows(want)
    else:
        got = windows.add_deltas(df, ["sinr_mean"], chunk=chunk)
        assert rows(got.select("scenario_id", "window_no", F.round("d_sinr_mean", 9))) == rows(want.drop("dd", "m"))


def test_event_windows_have_a_gap(spark):
    data = [("a", float(t)) for t in [0, 0.5, 1, 1.5, 2, 2.5, 3, 5, 5.5]]
    df = spark.createDataFrame(data, "scenario_id string, sec double").selectExpr(
        "scenario_id", "timestamp_millis(bigint(sec * 1000)) AS ts", "bigint(sec * 1000000000) AS ts_ns", "sec AS sinr_db"
    )
    made = windows.event_windows(df)
    got = made.select("window_samples", F.round("gap_ratio", 6), "sinr_mean").collect()
    assert [tuple(r) for r in got] == [(7, 0.3, 1.5)]


def test_a_stored_windows_table_gets_positions_back(spark):
    df = samples(spark, {"a": 40, "b": 20}, sinr_db=lambda s, i: float(i * i))
    made = windows.count_windows(df, ["ts_ns"])
    direct = windows.add_deltas(made, ["sinr_mean"]).select("scenario_id", "ts_start_ns", "d_sinr_mean")
    stored = windows.add_deltas(made.drop("window_no"), ["sinr_mean"]).select("scenario_id", "ts_start_ns", "d_sinr_mean")
    assert rows(direct) == rows(stored)


def test_feature_contract(spark, folder):
    table = featurize(telemetry_lineitem(spark, folder), LINEITEM_ORDER)
    assert tuple(table.columns) == cfg.FEATURE_COLUMNS
    assert len(table.columns) == 33
    sliced = featurize(telemetry_lineitem(spark, folder), LINEITEM_ORDER, rows_per_slice=100)
    fixed = [F.round(c, 6) for c in cfg.NUMERIC_FEATURES]
    assert rows(sliced.select("scenario_id", "ts_start_ns", *fixed)) == rows(table.select("scenario_id", "ts_start_ns", *fixed))


def test_windows_contract(spark, folder):
    made = windowed(telemetry_lineitem(spark, folder), LINEITEM_ORDER)
    assert set(cfg.WINDOW_COLUMNS) <= set(made.columns)


def test_failing_feature_is_skipped(spark):
    df = spark.createDataFrame([("Lvl5_1rruX", 0), ("other", 0), (None, 0)], "scenario_id string, ts_start_ns long")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        out = features.add_features(df)
    assert {"is_single_rru", "scenario_level", "hour_sin"} <= set(out.columns)
    assert "sinr_cv" not in out.columns
    assert any("sinr_cv" in str(c.message) for c in caught)
    assert rows(out.select("is_single_rru", "scenario_level")) == [(0, 0.0), (0, 0.0), (1, 5.0)]
    assert len(FEATURES) == 7


def test_an_aggregate_can_be_registered(spark):
    from signalsift.functions.aggregates import AGGREGATES, register_aggregate

    register_aggregate("span", lambda c: F.max(c) - F.min(c))
    try:
        df = samples(spark, {"a": 10}, sinr_db=lambda s, i: float(i))
        made = windows.count_windows(df, ["ts_ns"], stats={"sinr_db": ("span",)})
        assert made.first()["sinr_span"] == 9.0
    finally:
        del AGGREGATES["span"]
