"""The rule engine and the profiles."""

from __future__ import annotations

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.operators import profile, rules


def telemetry(spark, n=40, anomalies=10, scenario="Lvl4_AllRRUOn"):
    data = [
        (scenario, float(i), -80.0, -5.0, 5.0 if i < anomalies else 25.0, 10, 10.0 if i < anomalies else 100.0, int(i < anomalies), 0)
        for i in range(n)
    ]
    return spark.createDataFrame(
        data,
        "scenario_id string, time_s double, rsrp_dbm double, rsrq_db double, sinr_db double, mcs_dl int, "
        "app_dl_mbps double, lab_anom int, lab_inf int",
    )


def outcome(df):
    return {r["check"]: r["success"] for r in df.collect()}


def test_all_checks_of_a_good_table(spark):
    got = outcome(rules.check_table(telemetry(spark)))
    failed = {c for c, ok in got.items() if not ok}
    assert failed == {"sufficient_samples", "scenario_Lvl4_AllRRUOn_samples", "scenario_Lvl4_AllRRUOn_anomaly_rate"}
    assert got["anomaly_sinr_separation"] and got["anomaly_sinr_low_rate"] and got["anomaly_throughput_drop"]
    assert not any("Lvl5" in c for c in got)  # absent scenarios are skipped


def test_missing_columns(spark):
    df = telemetry(spark).drop("app_dl_mbps", "lab_anom")
    got = outcome(rules.check_table(df, raw=False))
    assert not got["column_exists_app_dl_mbps"] and not got["column_exists_lab_anom"]
    assert got["column_exists_sinr_db"]
    assert "anomaly_sinr_separation" not in got
    assert rules.schema_failures(df)[0] == {"column": "app_dl_mbps", "available_columns": df.columns[:10]}


def test_signature_without_anomalies_is_skipped(spark):
    got = outcome(rules.evaluate(telemetry(spark, anomalies=0), rules.signatures(telemetry(spark).columns)))
    assert got == {}


def test_ranges_ignore_null_and_pass_on_nothing(spark):
    df = spark.createDataFrame([(None, 30), (None, 5), (None, None)], "sinr_db double, mcs_dl int")
    got = {r["check"]: (r["success"], r["observed"]) for r in rules.evaluate(df, rules.in_range(df.columns)).collect()}
    assert got == {"range_sinr_db": (True, None), "range_mcs_dl": (False, 0.5)}


def test_non_strict_range_tolerates_five_percent(spark):
    df = spark.range(100).selectExpr("if(id < 5, 99D, 1D) AS sinr_db", "if(id < 1, 99, 1) AS mcs_dl")
    assert outcome(rules.evaluate(df, rules.in_range(df.columns))) == {"range_sinr_db": True, "range_mcs_dl": False}


def test_null_limits(spark):
    df = spark.range(100).selectExpr("if(id < 5, null, 1) AS mcs_dl", "if(id < 6, null, 1) AS mcs_ul", "if(id < 1, null, 1) AS sinr_db")
    checks = rules.evaluate(df, [*rules.nullable(df.columns), *rules.not_null(df.columns)])
    assert outcome(checks) == {"nullable_mcs_dl": True, "nullable_mcs_ul": False, "not_null_sinr_db": False}


def test_raw_layout_uses_raw_names(spark):
    df = telemetry(spark).select(
        F.col("time_s").alias("Time"), F.col("rsrp_dbm").alias("RSRP"), F.col("rsrq_db").alias("RSRQ"), F.col("sinr_db").alias("SINR"),
        F.col("app_dl_mbps").alias("throughput_DL"), F.col("mcs_dl").alias("PDSCH_MCS"), F.lit(1.0).alias("PDSCH PRBs"), "lab_anom",
        F.col("scenario_id").alias("source_file"),
    )
    got = outcome(rules.check_table(df))
    assert got["column_exists_throughput_DL"] and got["range_PDSCH PRBs"] and got["not_null_Time"]
    assert "scenario_Lvl4_AllRRUOn_samples" in got


def test_verdict_and_failures(spark):
    checks = rules.check_table(telemetry(spark))
    got = {r["category"]: r for r in rules.verdict(checks).collect()}
    assert got["overall"]["failed"] == 3 and not got["overall"]["success"]
    assert got["schema"]["pass_rate"] == 1.0
    assert rules.failures(checks).count() == 3


def test_severity_of_stored_results(spark):
    checks = rules.check_table(telemetry(spark))
    again = rules.with_severity(checks.drop("severity"))
    assert rows(again.select("check", "severity")) == rows(checks.select("check", "severity"))


def test_many_rules_are_split_into_jobs(spark, monkeypatch):
    monkeypatch.setattr(rules, "RULES_PER_JOB", 4)
    df = telemetry(spark)
    assert rows(rules.evaluate(df, rules.standard_rules(df.columns)).select("check", "success")) == rows(
        rules.evaluate(df, rules.standard_rules(df.columns)[::-1]).select("check", "success")
    )


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None)] * 3 + [(2, None)], "a int, b int")
    row = rules.duplicate_rule(df).first()
    assert (row["observed"], row["success"]) == (0.5, False)


def test_window_and_feature_checks_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "gap_ratio double, weak_label int, sinr_mean double, sinr_std double, app_dl_mean double, sinr_range double")
    got = outcome(rules.evaluate(empty, rules.window_rules()))
    assert not got["min_windows"] and got["weak_label_rate"]
    assert not outcome(rules.evaluate(empty, rules.feature_rules(["sinr_mean"])))["min_windows"]


def test_matrix_checks(spark):
    df = spark.createDataFrame([(1.0, 2.0), (math.inf, None)], "a double, b double")
    got = {r["check"]: r["observed"] for r in rules.evaluate(df, rules.matrix_rules(["a", "b"])).collect()}
    assert got == {"min_samples": 2.0, "missing_ratio": 0.25, "infinite_values": 1.0}


def test_histogram_of_a_constant_and_of_edges(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0), (5.0, 5.0), (None, 5.0)], "v double, same double")
    got = {(r["column"], r["bin"]): r["n"] for r in profile.histogram(df, ["v", "same"], 2).collect()}
    assert got == {("v", 0): 1, ("v", 1): 2, ("same", 0): 0, ("same", 1): 4}
    heights = profile.histogram(df, ["v"], 2, density=True).collect()
    assert sum(r["density"] * (r["bin_high"] - r["bin_low"]) for r in heights) == pytest.approx(1.0)


def test_profile_of_mixed_types(spark):
    df = spark.createDataFrame([(1, "a", None), (3, None, None)], "n int, s string, e double")
    got = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert (got["n"]["mean"], got["n"]["min"], got["n"]["max"]) == (2.0, 1.0, 3.0)
    assert (got["s"]["nulls"], got["s"]["mean"], got["s"]["null_pct"]) == (1, None, 50.0)
    assert (got["e"]["nulls"], got["e"]["std"]) == (2, None)


def test_summary_and_sizes(spark):
    df = telemetry(spark)
    stats = {r["stat"]: r["value"] for r in profile.summary_stats(df).collect()}
    assert (stats["total_samples"], stats["anomaly_rate"], stats["mcs_dl_std"]) == (40.0, 0.25, 0.0)
    assert profile.dataset_size(df).first().asDict() == {"dataset_rows": 40, "dataset_cols": 9, "num_source_files": None}
    assert profile.scenario_count(df, approximate=True).first()[0] == 1


def test_box_of_a_group_without_values(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 100.0), (0, 3.0), (1, None)], "lab_anom int, v double")
    got = profile.box_stats(df, ["v"]).collect()
    assert [(r["label"], r["n"], r["median"], r["whisker_high"]) for r in got] == [(0, 4, 2.5, 3.0)]


def test_rule_sets_are_complete():
    assert set(cfg.CHECK_RANGES) == set(cfg.CLIP_BOUNDS)
