"""Types, clipping, missing values, duplicates."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from signalsift.operators import clean, schema
from signalsift.operators.quantiles import exact_modes, exact_quantiles
from signalsift.plans import curate as plan

NAN, INF = float("nan"), float("inf")
SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def test_half_even(spark):
    df = spark.createDataFrame([("0.5",), ("26.5",), ("27.5",), ("27.9",), (None,)], "mcs_dl string")
    assert rows(schema.to_integers(df, ["mcs_dl"])) == [(0,), (26,), (28,), (28,), (None,)]


def test_numbers_that_do_not_parse(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("abc",), ("inf",), ("nan",), (None,), ("",)], "v string")
    assert rows(schema.to_numbers(df, ["v"])) == [(1.5,)] + [(None,)] * 5
    lost = schema.coercion_losses(df, ["v"]).collect()
    assert [(r["column"], r["nulls_introduced"]) for r in lost] == [("v", 4)]


def test_names_are_case_sensitive_and_coalesced(spark):
    df = spark.createDataFrame([("1", None, "x"), (None, "2", "y")], "SS_RSRP_dBm string, RSRP string, Other string")
    out = schema.standardize_names(df)
    assert out.columns == ["rsrp_dbm", "Other"]
    assert rows(out) == [("1", "x"), ("2", "y")]
    both = spark.createDataFrame([("1", "2", "3")], ["a", "b", "c"]).toDF("RSRP", "rsrp", "Cell ID")
    assert sorted(schema.standardize_names(both).columns) == ["cell_id", "rsrp", "rsrp_dbm"]
    assert schema.renamed_columns(["RSRP", "rsrp", "Cell ID"]) == 2


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="'b'"):
        schema.require_columns(df, ["a", "b"])
    assert schema.add_defaults(df, {"a": 5, "z": 0}).first().asDict() == {"a": 1, "z": 0}


def test_layout_detection():
    assert schema.is_clean_layout(["rsrp_dbm", "sinr_db", "RSRP"])
    assert not schema.is_clean_layout(["rsrp_dbm", "RSRP"])


def test_negative_numbers_are_no_dates(spark):
    mixed = spark.createDataFrame([("-1.5",), ("2e-3",), (None,), ("bad-time",), ("2024-01-01 00:00:01",)], "time_s string")
    assert rows(schema.relative_seconds(mixed)) == [(-1.5,), (0.0,), (0.002,), (None,), (None,)]


def test_times_do_not_depend_on_the_order_of_rows(spark):
    plain = [("a", str(k / 2)) for k in range(1200)]
    dated = [("b", f"2024-01-01 00:00:{k:02d}") for k in range(10)]
    for given in (plain + dated, dated + plain):
        got = rows(schema.relative_seconds(spark.createDataFrame(given, "scenario_id string, time_s string").coalesce(1)))
        assert got == rows(spark.createDataFrame([("a", k / 2) for k in range(1200)] + [("b", float(k)) for k in range(10)], "s string, t double"))


def test_relative_seconds_per_scenario(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01 00:00:01"), ("a", "2024-01-01T00:00:02.5"), ("b", "2024-02-01"), ("b", "oops")],
        "scenario_id string, time_s string",
    )
    assert rows(schema.relative_seconds(df)) == [("a", 0.0), ("a", 1.5), ("b", 0.0), ("b", None)]


def test_absolute_time_of_missing_time(spark):
    df = spark.createDataFrame([(1234.567,), (None,)], "time_s double")
    got = rows(schema.add_timestamp(df).select("ts_ns"))
    assert got == [(1_700_000_000_000_000_000,), (1_700_001_234_567_000_000,)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-200.0,), (-80.0,), (0.0,)], "rsrp_dbm double")
    assert rows(clean.clip_ranges(df)) == [(-156.0,), (-31.0,), (-80.0,), (None,)]
    stats = clean.clipping_stats(df).first()
    assert (stats["below_min"], stats["above_max"], stats["pct_clipped"]) == (1, 1, 50.0)


@SLOW
@given(st.lists(st.one_of(st.none(), st.floats(-500, 500)), min_size=1, max_size=20))
def test_clip_is_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "sinr_db double")
    once = clean.clip_ranges(df)
    assert rows(clean.clip_ranges(once)) == rows(once)
    assert all(v is None or -10 <= v <= 30 for (v,) in rows(once))


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (2,), (None,)], "mcs_dl int")
    assert exact_modes(df, ["mcs_dl"]) == {"mcs_dl": 1.0}
    empty = spark.createDataFrame([(None,)], "mcs_dl int")
    assert clean.fill_values(empty, {"mcs_dl": "mode"}) == {"mcs_dl": 0}


@pytest.mark.parametrize("slice_rows", [1_000_000, 3])
def test_exact_quantiles(spark, slice_rows):
    source = random.Random(3)
    values = [source.choice([0.0, 7.25, source.gauss(0, 1), source.uniform(-1e6, 1e6)]) for _ in range(301)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    q1, q2, q3 = statistics.quantiles(values, n=4, method="inclusive")
    got = exact_quantiles(df, ["v"], (0.25, 0.5, 0.75, 0.0, 1.0), rows_per_slice=slice_rows)["v"]
    assert got == pytest.approx([q1, q2, q3, min(values), max(values)], abs=1e-9)


def test_quantile_of_one_heavy_value(spark):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, 5.0D, double(id)) AS v")
    values = sorted(5.0 if i % 3 == 0 else float(i) for i in range(2000))
    got = exact_quantiles(df, ["v"], (0.1, 0.5), rows_per_slice=10)["v"]
    place = 0.1 * 1999
    low = math.floor(place)
    want = values[low] + (values[low + 1] - values[low]) * (place - low)
    assert got == pytest.approx([want, statistics.median(values)])


def pandas_fill(data, column):
    """Forward fill per scenario, then backward over the whole table."""
    import pandas as pd

    frame = pd.DataFrame(data, columns=["s", "t", column])
    frame[column] = frame.groupby("s")[column].ffill()
    return frame[column].bfill().tolist()


@pytest.mark.parametrize("rows_per_slice", [10**6, 3])
@pytest.mark.parametrize("seed", range(3))
def test_fill_equals_a_sequential_fill(spark, rows_per_slice, seed):
    source = random.Random(seed)
    data = []
    for s in "abcd":
        for t in range(source.randint(1, 200)):
            known = s != "b" and source.random() < 0.2
            data.append((s, t, float(t) if known else None))
    df = spark.createDataFrame(data, "scenario_id string, ts_ns long, v double")
    order = ["ts_ns"]
    filled = clean.fill_backward(
        clean.fill_forward(df, ["v"], order, rows_per_slice=rows_per_slice), ["v"], order
    )
    got = [r["v"] for r in filled.orderBy("scenario_id", "ts_ns").collect()]
    want = [None if isinstance(v, float) and math.isnan(v) else v for v in pandas_fill(data, "v")]
    assert got == want


def test_nan_and_null_are_one_duplicate(spark):
    df = spark.createDataFrame([(NAN,), (NAN,), (None,), (None,), (INF,)], "v double")
    assert rows(clean.drop_duplicates(df)) == [(None,)]
    assert rows(clean.replace_infinite(df, ["v"], 0.0)) == [(0.0,)] * 3 + [(None,)] * 2


def test_raw_to_clean(spark):
    raw = spark.createDataFrame(
        [
            ("s1", "0", "100", "-80", "-5", "20", None, "0"),
            ("s1", "0.5", "100", "-999", "-5", "20", "3", "0"),
            ("s1", "0.5", "100", "-999", "-5", "20", "3", "0"),
            ("s1", "1", "100", "bad", "-5", "20", "3", "1"),
            ("s2", None, "101", "-90", "9", "99", "5", "1"),
        ],
        "scenario_id string, Time string, PCI string, RSRP string, RSRQ string, SINR string, throughput_DL string, lab_anom string",
    )
    out = plan.curate(raw)
    assert [c for c in out.columns if c in ("lab_bs", "lab_inf", "lab_1rr", "nr_arfcn")] == ["nr_arfcn", "lab_bs", "lab_inf", "lab_1rr"]
    got = rows(out.select("scenario_id", "time_s", "rsrp_dbm", "rsrq_db", "sinr_db", "app_dl_mbps"))
    assert got == [
        ("s1", 0.0, -80.0, -5.0, 20.0, 3.0),
        ("s1", 0.5, -156.0, -5.0, 20.0, 3.0),
        ("s2", 0.0, -90.0, 3.0, 30.0, 5.0),
    ]


def test_missing_required_column_stops_curation(spark):
    with pytest.raises(ValueError, match="sinr_db"):
        plan.curate(spark.createDataFrame([("0", "1", "1", "1", "0")], "Time string, PCI string, RSRP string, RSRQ string, lab_anom string"))


def test_a_row_repeated_for_a_third_of_the_table(spark):
    """Copies are merged before the fill; the result is that of filling all rows."""
    data = [("s", str(i / 2), "1", "-80", "-5", "20", None if i % 3 else str(i), "0") for i in range(60)]
    data += [data[7]] * 30
    raw = spark.createDataFrame(
        data, "scenario_id string, Time string, PCI string, RSRP string, RSRQ string, SINR string, throughput_DL string, lab_anom string"
    )
    for rows_per_slice in (10**6, 8):
        got = rows(plan.curate(raw, rows_per_slice=rows_per_slice).select("time_s", "app_dl_mbps"))
        assert got == sorted(((i / 2, float(i - i % 3)) for i in range(60)), key=lambda t: tuple((False, str(v)) for v in t))
