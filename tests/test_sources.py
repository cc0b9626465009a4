"""CSV and parquet sources, sinks, stored models."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from signalsift.catalog import QUERIES
from signalsift.config import telemetry as cfg
from signalsift.operators import prep
from signalsift.plans import report, train
from signalsift.plans.curate import featurize
from signalsift.plans.surrogate import EVENT_ORDER, telemetry_events
from signalsift.session import ensure_checkpoint_dir, staged
from signalsift.sources import sinks, tables

TREES = {"maxIter": 2, "maxDepth": 2}


@pytest.fixture(scope="module")
def features(spark, folder):
    # The whole table, staged once for the model tests.
    return staged(featurize(telemetry_events(spark, "/root/testdata/sf0.01"), EVENT_ORDER))


def write(path, text):
    path.write_text(text, encoding="utf-8")


def test_short_and_long_rows(spark, tmp_path):
    write(tmp_path / "Lvl4 one.csv", "Time,RSRP,lab_anom\n0,-80,0\n0.5,-81,0,EXTRA\n1.0,abc,1\n1.5,-90\n")
    got = tables.read_csv(spark, str(tmp_path))
    assert got.columns == ["Time", "RSRP", "lab_anom", "scenario_id"]
    assert rows(got) == [
        ("0", "-80", "0", "Lvl4 one"), ("1.0", "abc", "1", "Lvl4 one"), ("1.5", "-90", None, "Lvl4 one")
    ]


def test_headers_in_different_order(spark, tmp_path):
    write(tmp_path / "b.csv", "RSRP,Time\n-70,9\n")
    write(tmp_path / "a.csv", "Time,RSRP\n1,-80\n")
    write(tmp_path / "c.csv", 'Time,Cell ID\n2,"x, ""y"""\n')
    write(tmp_path / "empty.csv", "")
    with pytest.warns(UserWarning, match="empty"):
        got = tables.read_csv(spark, str(tmp_path))
    assert rows(got.select("scenario_id", "Time", "RSRP", "Cell ID")) == [
        ("a", "1", "-80", None), ("b", "9", "-70", None), ("c", "2", None, 'x, "y"')
    ]


def test_no_csv(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path))


def test_format_detection(spark, tmp_path):
    write(tmp_path / "a.csv", "Time,RSRP\n1,-80\n2,-81\n")
    assert tables.read_any(spark, str(tmp_path)).columns == ["Time", "RSRP", "source_file"]
    assert tables.read_any(spark, str(tmp_path / "a.csv")).columns == ["Time", "RSRP"]
    spark.range(3).toPandas().to_parquet(tmp_path / "b.parquet")
    assert rows(tables.read_any(spark, str(tmp_path)).select("source_file").distinct()) == [("b",)]
    assert tables.read_any(spark, str(tmp_path / "b.parquet")).count() == 3


def test_parquet_round_trip(spark, tmp_path, folder):
    df = telemetry_events(spark, folder)
    path = sinks.write_parquet(df, str(tmp_path / "t"), cfg.CLEAN_COLUMNS, sort_by=["ts_ns"])
    back = tables.read_samples(spark, path)
    wanted = [c for c in cfg.CLEAN_COLUMNS if c in df.columns]
    assert sorted(back.columns) == sorted(wanted)
    assert rows(back.select("scenario_id", "ts_ns", "sinr_db")) == rows(df.select("scenario_id", "ts_ns", "sinr_db"))
    plan = back.filter("scenario_id = 'Lvl6_1RRUOn'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario_id" in plan


def test_contract_of_a_feature_file(spark, tmp_path, features):
    path = sinks.write_parquet(features, str(tmp_path / "f"))
    assert tables.read_features(spark, path).count() == features.count()
    assert tables.window_table_stats(tables.read_windows(spark, path)).first()["n_columns"] == 33
    with pytest.raises(ValueError, match="nope"):
        tables.read_features(spark, path, numeric=["nope"])


def test_reports_and_run_log(spark, tmp_path):
    one = spark.createDataFrame([(3, 1.5)], "input_rows long, pct double")
    sinks.write_report(one, str(tmp_path / "r"), str(tmp_path / "latest"))
    assert rows(spark.read.json(str(tmp_path / "latest"))) == [(3, 1.5)]
    for run in ("a", "b"):
        sinks.append_run_log(report.run_log("curate", one, run), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert rows(log.select("run_id", "stage", "key", "value")) == [
        ("a", "curate", "input_rows", 3.0), ("a", "curate", "pct", 1.5),
        ("b", "curate", "input_rows", 3.0), ("b", "curate", "pct", 1.5),
    ]


def test_matrix_sinks(spark, tmp_path, features):
    fitted = prep.fit_preparation(features)
    matrix = prep.design_matrix(features, fitted)
    assert fitted.feature_order[-6:] == ["ohe_pci_mode_1", "ohe_pci_mode_2", *[f"ohe_scenario_id_{i}" for i in range(4)]]
    back = spark.read.parquet(sinks.write_matrix(matrix, str(tmp_path / "m")))
    assert back.first()["features"].size == len(fitted.feature_order) == 36
    path = sinks.write_csv(matrix, str(tmp_path / "csv"), "features", fitted.feature_order)
    read = spark.read.option("header", True).csv(path)
    assert read.columns == ["scenario_id", "ts_start_ns", "label", *fitted.feature_order]


def test_held_out_scores_cover_every_row_once(spark, features, tmp_path):
    made = staged(train.held_out_scores(features, overrides=TREES))
    assert made.count() == features.count()
    assert rows(made.groupBy("scenario_id").agg(F.count_distinct("fold"))) == rows(
        features.select("scenario_id", F.lit(1)).distinct()
    )
    assert made.filter("y_prob < 0 OR y_prob > 1").count() == 0
    assert set(cfg.NUMERIC_FEATURES) <= set(made.columns)
    stored = spark.read.parquet(sinks.write_predictions(made, str(tmp_path / "p")))
    assert stored.count() == made.count()


def test_stored_model_gives_the_same_scores(spark, features, tmp_path):
    model = train.train_all(features, overrides=TREES)
    loaded = sinks.load_model(sinks.save_model(model, str(tmp_path / "model")))
    a = train.score(features, model).select("scenario_id", "ts_start_ns", "y_prob")
    assert rows(a) == rows(train.score(features, loaded).select("scenario_id", "ts_start_ns", "y_prob"))
    named = train.feature_importance(model, prep.fit_preparation(features).feature_order, 5)
    assert len(named) == 5 and named[0].importance >= named[-1].importance


def test_search(spark, features):
    found = train.search(features, trials=2, overrides=TREES)
    assert found.filter("score BETWEEN 0 AND 1").count() == 2
    assert len(found.first()["params"]) == len(cfg.SEARCH_SPACE)
    assert train.refit_best(features, found, TREES).stages


def test_places_are_those_of_the_string_index(spark):
    table = spark.range(0, 500, 1, 7).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE id * 37 % 211 END AS c", "id", "'old' AS place")
    model = PipelineModel(prep.as_stages(prep.fit_preparation(table, (), ("c",))))
    expected = model.transform(table).select("id", F.col("x_code_c").cast("long"))
    assert rows(prep.with_places(table, "c").select("id", "place")) == rows(expected)
    assert prep.category_places(table.limit(0), "c").count() == 0


def test_order_categories_stay_off_the_driver(spark, folder, monkeypatch):
    def refused(*_):
        raise AssertionError("the categories of this query are its data")

    monkeypatch.setattr(prep, "category_values", refused)
    found = QUERIES["m5_one_hot_orders"](spark, folder)
    orders = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert found.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()[:] == (0, orders - 1, orders)


def test_model_queries_train_the_configured_trees(spark, folder, monkeypatch):
    """What the registered queries ask for; only the fit itself is made small."""
    asked, whole = [], train.classifier

    def small(params, overrides=None):
        asked.append(whole(params, overrides))
        return whole(params, TREES)

    monkeypatch.setattr(train, "classifier", small)
    for name in ("t4_held_out_scores", "t6_final_model", "t19_feature_importance", "x4_alerts"):
        asked.clear()
        assert QUERIES[name](spark, folder).count() > 0
        assert {(a.getMaxIter(), a.getMaxDepth()) for a in asked} == {(cfg.BOOSTING["n_estimators"], cfg.BOOSTING["max_depth"])}


@pytest.mark.parametrize("name", ["o1_parameter_search", "o5_refit_best"])
def test_search_queries_try_the_whole_space(spark, folder, monkeypatch, name):
    asked = []

    def refused(rows, params, overrides=None, folds=cfg.FOLDS):
        asked.append((train.classifier(params, overrides).getMaxIter(), train.classifier(params, overrides).getMaxDepth()))
        raise ValueError("not trained here")

    monkeypatch.setattr(train, "held_out_scores", refused)
    with pytest.raises(ValueError, match="no trial has a score"):
        QUERIES[name](spark, folder)
    assert sorted(asked) == sorted((p["n_estimators"], p["max_depth"]) for p in train.draw(cfg.SEARCH_SPACE, 20))


def _one_fails(monkeypatch, failing):
    """Trials of the given numbers have parameters that make no model."""
    whole, asked = train.held_out_scores, []

    def held_out(rows, params, overrides=None, folds=cfg.FOLDS):
        asked.append(params["n_estimators"])
        bad = len(asked) in failing
        return whole(rows, params, {**TREES, **({"maxDepth": 99} if bad else {})}, folds)

    monkeypatch.setattr(train, "held_out_scores", held_out)
    return asked


def test_failed_trials_are_kept(spark, features, monkeypatch):
    _one_fails(monkeypatch, {1})
    found = train.search(features, trials=2, parallel=1).orderBy("trial").collect()
    assert [(r["trial"], r["score"] is None, "99" in (r["problem"] or "")) for r in found] == [(0, True, True), (1, False, False)]
    assert [r["params"]["n_estimators"] for r in found] == [p["n_estimators"] for p in train.draw(cfg.SEARCH_SPACE, 2)]


def test_a_search_without_scores_is_an_error(spark, features):
    with pytest.raises(ValueError, match="no trial has a score.*99"):
        train.search(features, trials=1, overrides={"maxDepth": 99})


def test_a_search_goes_on_where_it_stopped(spark, features, monkeypatch, tmp_path):
    store = str(tmp_path / "trials")
    asked = _one_fails(monkeypatch, set())
    whole = train.trained_trial

    def lost(rows, number, *more):
        if number == 1:
            raise RuntimeError("the driver is lost")
        return whole(rows, number, *more)

    monkeypatch.setattr(train, "trained_trial", lost)
    with pytest.raises(RuntimeError):
        train.search(features, trials=3, store=store, parallel=1)
    assert rows(train.stored_trials(spark, store).select("trial")) == [(0,)] and len(asked) == 1
    monkeypatch.setattr(train, "trained_trial", whole)
    found = train.search(features, trials=3, store=store, parallel=2)
    assert rows(found.select("trial")) == [(0,), (1,), (2,)] and len(asked) == 3
    # Nothing is left to do, so nothing is trained.
    again = train.search(features, trials=3, store=store)
    assert rows(again.select("trial", "score")) == rows(found.select("trial", "score")) and len(asked) == 3


def test_scores_do_not_depend_on_the_parts(spark, features, monkeypatch):
    few = train.held_out_scores(features, overrides=TREES).select("scenario_id", "ts_start_ns", "y_prob")
    monkeypatch.setattr(train, "ROWS_PER_PART", 10)
    many = train.held_out_scores(features, overrides=TREES).select("scenario_id", "ts_start_ns", "y_prob")
    assert rows(few.select("scenario_id", "ts_start_ns")) == rows(many.select("scenario_id", "ts_start_ns"))


def test_drawn_parameters():
    drawn = train.draw(cfg.SEARCH_SPACE, 50)
    assert drawn == train.draw(cfg.SEARCH_SPACE, 50)
    for one in drawn:
        assert one["n_estimators"] % 50 == 0 and 50 <= one["n_estimators"] <= 500
        assert 0.01 <= one["learning_rate"] <= 0.3 and 3 <= one["max_depth"] <= 12


def test_model_parameters():
    mapped, ignored = train.model_parameters()
    assert mapped == {
        "maxIter": 350, "maxDepth": 7, "stepSize": 0.08, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.765",
        "minInfoGain": 0.2, "minInstancesPerNode": 2, "seed": 42,
    }
    assert ignored == {"reg_alpha": 0.3, "reg_lambda": 1.5}


def test_checkpoint_folder_comes_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_rejected_rows_are_told_by_file_and_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n3,4,5\n6\n"7,7",8\n9,9,9,9\n')
    (tmp_path / "b.csv").write_text("y,x,z\n1,2,3\n1,2,3,4\n")
    (tmp_path / "c.csv").write_text("")
    with pytest.warns(UserWarning, match="no header"):
        kept = tables.read_csv(spark, str(tmp_path), "file")
    assert rows(kept.select("file", "x", "y")) == rows(
        spark.createDataFrame([("a", "1", "2"), ("a", "6", None), ("a", "7,7", "8"), ("b", "2", "1")], "file string, x string, y string")
    )
    with pytest.warns(UserWarning, match="no header"):
        bad = tables.rejected_rows(spark, str(tmp_path)).collect()
    assert sorted((r["file"], r["record"] or "", r["reason"]) for r in bad) == [
        ("a.csv", "3,4,5", "too many fields"), ("a.csv", "9,9,9,9", "too many fields"),
        ("b.csv", "1,2,3,4", "too many fields"), ("c.csv", "", "no header line"),
    ]


def test_next_known_over_many_groups(spark):
    from signalsift.operators.clean import next_known

    made = [(i, float(i) if i % 97 == 0 else None, float(i) if i == 4_000 else None) for i in range(5_000)]
    found = next_known(spark.createDataFrame(made, "k long, a double, b double").repartition(7), "k", ["a", "b"]).collect()
    for r in found:
        onward = -(-r["k"] // 97) * 97
        assert r["a"] == (float(onward) if onward < 5_000 else None)
        assert r["b"] == (4_000.0 if r["k"] <= 4_000 else None)
    assert len(found) == 5_000


def test_next_known_reads_a_range_once(spark):
    """A frame that starts at its row and has no end is read again for every row."""
    from signalsift.operators.clean import next_known

    k = F.col("id")
    made = spark.range(300_000).select(
        F.when(k > 0, k).alias("k"), F.when(k % 70_000 == 1, k).alias("a"), F.when(k == 0, k).alias("b")
    )
    found = next_known(made, "k", ["a", "b"])
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    onward = F.ceil((F.coalesce("k", F.lit(0)) - 1) / 70_000) * 70_000 + 1
    wrong = found.where(~F.col("a").eqNullSafe(F.when(onward < 300_000, onward)) | ~F.col("b").eqNullSafe(F.when(F.col("k").isNull(), F.lit(0))))
    assert found.count() == 300_000 and wrong.isEmpty()


def test_moments_of_parts_give_the_whole(spark):
    from signalsift.operators import investigate

    random_rows = [(float((i * 37) % 101) if i % 9 else None, 1e9 + (i % 7), ((i * 13) % 100) / 100, int(i % 5 == 0)) for i in range(800)]
    df = spark.createDataFrame(random_rows, "f double, g double, y_prob double, y_true int")
    got = {(r["feature"], r["threshold"]): r for r in investigate.feature_contrasts(df, ["f", "g"], [0.3, 0.7, 2.0]).collect()}
    assert set(t for _, t in got) == {0.3, 0.7}
    import numpy as np

    for k, name in enumerate("fg"):
        for t in (0.3, 0.7):
            high = [r[k] for r in random_rows if r[3] == 0 and r[2] >= t and r[k] is not None]
            low = [r[k] for r in random_rows if r[3] == 0 and r[2] < t and r[k] is not None]
            pooled = np.sqrt((np.var(high, ddof=1) + np.var(low, ddof=1)) / 2)
            want = abs(np.mean(high) - np.mean(low)) / pooled
            assert got[name, t]["effect_size"] == pytest.approx(want, rel=1e-6)
            assert got[name, t]["n_high"] == sum(1 for r in random_rows if r[3] == 0 and r[2] >= t)
