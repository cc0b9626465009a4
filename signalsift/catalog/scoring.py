"""Queries about preparation, scores, thresholds, alarms, search (M, T, H, I, O, X4, X5, F4–F6)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsift.catalog import sql as q
from signalsift.catalog.registry import asked, query, rounded, scratch
from signalsift.catalog.windows import feature_rows
from signalsift.config import telemetry as cfg
from signalsift.operators import contract, drift, folds, investigate, metrics, prep, threshold
from signalsift.plans import report, train
from signalsift.plans.surrogate import load, telemetry_events
from signalsift.session import staged
from signalsift.sources import sinks
from signalsift.streaming import scoring

T = 0.3
FEATURES = ["sinr_db", "rsrp_dbm", "rsrq_db", "app_dl_mbps", "mcs_dl", "mcs_ul", "prb_dl", "prb_ul"]


def events(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry_events(spark, folder)


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction table of the events view: label and score."""
    return events(spark, folder).withColumn("y_true", F.col("lab_anom").cast("int"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the fold of the scenario."""
    return folds.assign_folds(predicted(spark, folder))


# --- preparation -------------------------------------------------------------


@query(
    "m1_mean_imputation",
    asked(
        q.TELE, "SELECT row_id, coalesce(sinr_db, (SELECT avg(sinr_db) FROM tele)) AS sinr_db, coalesce(CAST(mcs_dl AS DOUBLE), (SELECT avg(mcs_dl) FROM tele)) AS mcs_dl FROM tele",
        ["sinr_db", "mcs_dl"], ["row_id"],
    ),
)
def _(spark, folder):
    return rounded(prep.fill_means(events(spark, folder).select("row_id", "sinr_db", "mcs_dl"), ["sinr_db", "mcs_dl"]))


def _scaling_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(CAST({c} AS DOUBLE)) AS mean, "
        f"CASE WHEN coalesce(var_pop({c}), 0) > 0 THEN sqrt(var_pop({c}) * count({c}) / count(*)) ELSE 1 END AS scale FROM {source}"
        for c in columns
    )


@query("m2_scaler", asked(q.TELE, _scaling_sql("tele", FEATURES), ["mean", "scale"], ['"column"']))
def _(spark, folder):
    """Missing values count as the mean; some columns have them."""
    return rounded(prep.scaling_stats(events(spark, folder), FEATURES))


@query("m2_scaler_features", asked(q.WIN, _scaling_sql("feat", cfg.NUMERIC_FEATURES), ["mean", "scale"], ['"column"'], 5))
def _(spark, folder):
    return rounded(prep.scaling_stats(feature_rows(spark, folder), cfg.NUMERIC_FEATURES), 5)


@query(
    "m3_scaled",
    asked(
        f"{q.TELE}, s AS ({_scaling_sql('tele', FEATURES)})",
        "SELECT row_id, " + ", ".join(
            f"(CAST({c} AS DOUBLE) - (SELECT mean FROM s WHERE \"column\" = '{c}')) / (SELECT scale FROM s WHERE \"column\" = '{c}') AS {c}"
            for c in FEATURES
        ) + " FROM tele",
        FEATURES, ["row_id"],
    ),
)
def _(spark, folder):
    t = events(spark, folder)
    return rounded(prep.transform(t, prep.fit_preparation(t, FEATURES, ()), ["row_id"]))


@query("m4_categories", f"WITH {q.TELE} SELECT CAST(pci AS VARCHAR) AS category, CAST(row_number() OVER (ORDER BY CAST(pci AS VARCHAR)) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT pci FROM tele) d")
def _(spark, folder):
    t = events(spark, folder)
    values = prep.category_values(t, "pci")
    listed = F.array(*[F.lit(v) for v in values])
    return t.select(F.col("pci").cast("string").alias("category")).distinct().select(
        "category", (F.array_position(listed, F.col("category")) - 1).alias("place")
    )


_ORDERED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "m7_contract",
    """WITH given AS (SELECT * FROM (VALUES (0, 'l_quantity'), (1, 'l_extendedprice'), (2, 'l_discount'), (3, 'l_tax')) AS v(position, feature)),
    found AS (SELECT 'l_returnflag' AS source, CAST(l_returnflag AS VARCHAR) AS category FROM lineitem
      UNION SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem),
    placed AS (SELECT source, category, row_number() OVER (PARTITION BY source ORDER BY category) - 1 AS place,
      row_number() OVER (ORDER BY source, category) + 3 AS position FROM found WHERE category IS NOT NULL)
    SELECT CAST(position AS BIGINT) AS position, feature, feature AS source, CAST(NULL AS VARCHAR) AS category, 'moved' AS what FROM given
    UNION ALL SELECT CAST(position AS BIGINT), 'ohe_' || source || '_' || CAST(place AS VARCHAR), source, category, NULL FROM placed""",
)
def _(spark, folder):
    """The contract of a design matrix stored and loaded, and what is told of each feature if the numeric columns come in another order."""
    lines = load(spark, folder, "lineitem")
    coded = ["l_returnflag", "l_suppkey"]
    path = contract.save_contract(contract.fitted_contract(lines, _ORDERED, coded), scratch(spark, "contract"))
    stored = contract.load_contract(spark, path)
    turned = contract.fitted_contract(lines, _ORDERED[::-1], coded)
    told = contract.contract_differences(stored, turned)
    return stored.join(told, "feature", "left").select("position", "feature", "source", "category", "what")


@query(
    "m5_one_hot",
    f"""WITH {q.TELE}, names AS (SELECT scenario_id, row_number() OVER (ORDER BY scenario_id) - 1 AS i FROM (SELECT DISTINCT scenario_id FROM tele) d)
    SELECT t.row_id, {', '.join(f"CAST(CASE WHEN n.i = {i} THEN 1 ELSE 0 END AS DOUBLE) AS ohe_scenario_id_{i}" for i in range(4))}
    FROM tele t JOIN names n ON n.scenario_id = t.scenario_id""",
)
def _(spark, folder):
    t = events(spark, folder)
    return prep.transform(t, prep.fit_preparation(t, (), ("scenario_id",)), ["row_id"])


_X = cfg.NUMERIC_FEATURES


@query(
    "m5_one_hot_orders",
    """SELECT l_orderkey, l_linenumber, n.place FROM lineitem l JOIN (
      SELECT k, CAST(row_number() OVER (ORDER BY CAST(k AS VARCHAR)) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) d
    ) n ON n.k = l.l_orderkey""",
)
def _(spark, folder):
    """Which entry of the one-hot vector is 1, with a category for every order."""
    rows = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return prep.with_places(rows, "l_orderkey").select("l_orderkey", "l_linenumber", "place")


@query(
    "m6_design_matrix",
    asked(
        f"{q.WIN}, s AS ({_scaling_sql('feat', _X)})",
        "SELECT scenario_id, ts_start_ns, CAST(weak_label AS INTEGER) AS label, 2 + "
        + " + ".join(
            f"(CAST({c} AS DOUBLE) - (SELECT mean FROM s WHERE \"column\" = '{c}')) / (SELECT scale FROM s WHERE \"column\" = '{c}')" for c in _X
        )
        + " AS total FROM feat",
        ["total"], ["scenario_id", "ts_start_ns", "label"], 4,
    ),
)
def _(spark, folder):
    """Sum of each feature vector; two of its entries are the one-hot ones."""
    table = staged(feature_rows(spark, folder))
    matrix = prep.design_matrix(table, prep.fit_preparation(table, _X))
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return rounded(matrix.select("scenario_id", "ts_start_ns", "label", total.alias("total")), 4)


# --- folds and class balance -------------------------------------------------


@query("t1_class_distribution", asked(q.TELE, "SELECT lab_anom, count(*) AS n, count(*) / CAST((SELECT count(*) FROM tele) AS DOUBLE) AS share FROM tele GROUP BY 1", ["share"], ["lab_anom", "n"]))
def _(spark, folder):
    from signalsift.operators.profile import value_counts

    return rounded(value_counts(events(spark, folder), "lab_anom"))


@query(
    "t3_group_folds_orders",
    """WITH RECURSIVE sizes AS (
      SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS place FROM orders GROUP BY 1
    ), dealt AS (
      SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS o_custkey, CAST(0 AS INTEGER) AS fold, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d
      UNION ALL
      SELECT place, o_custkey, f, a + CASE WHEN f = 1 THEN n ELSE 0 END, b + CASE WHEN f = 2 THEN n ELSE 0 END,
        c + CASE WHEN f = 3 THEN n ELSE 0 END, d + CASE WHEN f = 4 THEN n ELSE 0 END
      FROM (SELECT s.place, CAST(s.o_custkey AS BIGINT) AS o_custkey, s.n, x.a, x.b, x.c, x.d,
        CASE WHEN a <= least(b, c, d) THEN 1 WHEN b <= least(c, d) THEN 2 WHEN c <= d THEN 3 ELSE 4 END AS f
        FROM dealt x JOIN sizes s ON s.place = x.place + 1) y
    ) SELECT o_custkey, fold FROM dealt WHERE place > 0""",
)
def _(spark, folder):
    """Balanced folds over all customers, largest first."""
    orders = load(spark, folder, "orders").select(F.col("o_custkey").cast("long").alias("o_custkey"))
    return folds.fold_table(orders, "o_custkey", 4).select("o_custkey", "fold")


@query(
    "t2_class_weight",
    asked(
        q.TELE,
        "SELECT count(*) FILTER (lab_anom = 0) AS n_negative, count(*) FILTER (lab_anom = 1) AS n_positive, "
        "count(*) FILTER (lab_anom = 0) / CAST(count(*) FILTER (lab_anom = 1) AS DOUBLE) AS scale_pos_weight FROM tele",
        ["scale_pos_weight"], ["n_negative", "n_positive"],
    ),
)
def _(spark, folder):
    return rounded(metrics.class_weights(events(spark, folder), "lab_anom"))


@query("t3_group_folds", f"WITH {q.PRED} SELECT scenario_id, fold, count(*) AS n FROM pred GROUP BY 1, 2")
def _(spark, folder):
    return scored(spark, folder).groupBy("scenario_id", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("f6_fold_parts", f"WITH {q.PRED} SELECT f.fold, count(*) FILTER (p.fold <> f.fold) AS train_rows, count(*) FILTER (p.fold = f.fold) AS test_rows FROM pred p CROSS JOIN (SELECT DISTINCT fold FROM folds) f GROUP BY 1")
def _(spark, folder):
    t = scored(spark, folder)
    parts = None
    for k in range(1, cfg.FOLDS + 1):
        train_n = folds.training_part(t, k).agg(F.count(F.lit(1))).scalar()
        one = folds.test_part(t, k).agg(F.count(F.lit(1)).alias("test_rows"))
        row = one.select(F.lit(k).cast("int").alias("fold"), train_n.alias("train_rows"), "test_rows")
        parts = row if parts is None else parts.unionByName(row)
    return parts


# --- metrics -----------------------------------------------------------------


@query("t7_decisions", f"WITH {q.PRED} SELECT row_id, CAST(CASE WHEN y_prob >= CAST({T} AS DOUBLE) THEN 1 ELSE 0 END AS INTEGER) AS y_pred FROM pred")
def _(spark, folder):
    return metrics.decide(predicted(spark, folder), T).select("row_id", "y_pred")


def areas_sql(source: str, by: str = "") -> str:
    """Both areas by their definitions, from ordered rows."""
    over = f"PARTITION BY {by} " if by else ""
    key = f"{by}, " if by else ""
    return f"""
SELECT {key}CASE WHEN p > 0 AND n > 0 THEN wins / (CAST(p AS DOUBLE) * n) END AS roc_auc,
  CASE WHEN p > 0 AND n > 0 THEN gained / p END AS pr_auc, CAST(p AS BIGINT) AS n_positive, CAST(n AS BIGINT) AS n_negative
FROM (
  SELECT {key}sum(neg * (tp - pos + pos / 2.0)) AS wins, sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) AS gained, sum(pos) AS p, sum(neg) AS n
  FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
        FROM (SELECT {key}y_prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM {source} GROUP BY {key}y_prob) c
        WINDOW w AS ({over}ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING)) r
  {'GROUP BY ' + by if by else ''}) a"""


@query("t8_roc_auc", asked(q.PRED, areas_sql("pred"), ["roc_auc"], ["n_positive", "n_negative"]))
def _(spark, folder):
    return rounded(metrics.rank_metrics(predicted(spark, folder)).select("roc_auc", "n_positive", "n_negative"))


@query("t9_average_precision", asked(q.PRED, areas_sql("pred"), ["pr_auc"]))
def _(spark, folder):
    return rounded(metrics.rank_metrics(predicted(spark, folder)).select("pr_auc"))


@query("t8_roc_auc_sliced", asked(q.PRED, areas_sql("pred", "fold"), ["roc_auc", "pr_auc"], ["fold", "n_positive", "n_negative"]))
def _(spark, folder):
    """Per fold, with distinct scores cut into ranges as for a very large table."""
    return rounded(metrics.rank_metrics(scored(spark, folder), ["fold"], rows_per_slice=100))


@query("t10_brier", asked(q.PRED, "SELECT fold, avg((y_prob - y_true) * (y_prob - y_true)) AS brier FROM pred GROUP BY fold", ["brier"], ["fold"]))
def _(spark, folder):
    return rounded(metrics.brier(scored(spark, folder), ["fold"]))


_FOUR = ["accuracy", "precision", "recall", "f1"]
_FOUR_SQL = f"SELECT fold, {q.RATES['accuracy']} AS accuracy, {q.RATES['precision']} AS precision, {q.RATES['recall']} AS recall, {q.RATES['f1_score']} AS f1 FROM ({q.counts_at('pred', [T], 'fold')}) c"


@query("t11_decision_metrics", asked(q.PRED, _FOUR_SQL, _FOUR, ["fold"]))
def _(spark, folder):
    return rounded(metrics.decision_metrics(scored(spark, folder), T, ["fold"]))


@query(
    "t12_single_class_guard",
    asked(q.TELE.rstrip() + ", pred AS (SELECT *, lab_inf AS y_true, event AS grp FROM (SELECT t.*, row_id % 97 AS event FROM tele t) x)", areas_sql("pred", "grp"), ["roc_auc", "pr_auc"], ["grp", "n_positive", "n_negative"]),
)
def _(spark, folder):
    """The label depends on the group only, so every group has one class: no areas."""
    t = events(spark, folder).withColumn("grp", F.col("row_id") % 97).withColumn("y_true", F.col("lab_inf"))
    return rounded(metrics.rank_metrics(t, ["grp"]))


_CV_SQL = f"""
SELECT metric, mean, std, valid_folds FROM (
  {' UNION ALL '.join(
      f"SELECT '{m}' AS metric, avg({m}) AS mean, {'stddev_pop' if m.endswith('auc') else 'stddev_samp'}({m}) AS std, count({m}) AS valid_folds FROM per"
      for m in ("roc_auc", "pr_auc", "brier", "accuracy", "precision", "recall", "f1"))}) x"""
_PER = f"""per AS (SELECT a.fold, a.roc_auc, a.pr_auc, b.brier, c.accuracy, c.precision, c.recall, c.f1
  FROM ({areas_sql('pred', 'fold')}) a JOIN (SELECT fold, avg((y_prob - y_true) * (y_prob - y_true)) AS brier FROM pred GROUP BY fold) b ON a.fold = b.fold
  JOIN ({_FOUR_SQL}) c ON a.fold = c.fold)"""


@query("t13_cv_summary", asked(f"{q.PRED}, {_PER}", _CV_SQL, ["mean", "std"], ["metric", "valid_folds"]))
def _(spark, folder):
    return rounded(metrics.cv_summary(metrics.score_metrics(scored(spark, folder), T, ["fold"])))


@query(
    "t14_confusion_matrix",
    f"WITH {q.PRED} " + " UNION ALL ".join(
        f"SELECT CAST({y} AS INTEGER) AS y_true, CAST({p} AS INTEGER) AS y_pred, count(*) FILTER (y_true = {y} AND (y_prob >= CAST({T} AS DOUBLE)) = {bool(p)}) AS n FROM pred"
        for y in (0, 1) for p in (0, 1)
    ),
)
def _(spark, folder):
    return metrics.confusion_matrix(predicted(spark, folder), T)


_SIDES = {
    "Normal": ("tn", "fn", "fp"),
    "Anomaly": ("tp", "fp", "fn"),
}


def _report_sql() -> str:
    rows = [
        f"SELECT '{name}' AS class, {q.safe(hit, f'{hit} + {false}')} AS precision, {q.safe(hit, f'{hit} + {miss}')} AS recall, "
        f"{q.safe(f'2 * {hit}', f'2 * {hit} + {false} + {miss}')} AS f1, {hit} + {miss} AS support FROM c"
        for name, (hit, false, miss) in _SIDES.items()
    ]
    both = " UNION ALL ".join(rows)
    return f"""
SELECT * FROM ({both}) s UNION ALL
SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM ({both}) s UNION ALL
SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM ({both}) s UNION ALL
SELECT 'accuracy', {q.RATES['accuracy']}, {q.RATES['accuracy']}, {q.RATES['accuracy']}, tp + fp + tn + fn FROM c"""


@query(
    "t15_classification_report",
    asked(f"{q.PRED}, c AS ({q.counts_at('pred', [T])})", _report_sql(), ["precision", "recall", "f1"], ["class", "CAST(support AS BIGINT) AS support"]),
)
def _(spark, folder):
    return rounded(metrics.classification_report(predicted(spark, folder), T))


@query("t16_pooled_predictions", asked(q.PRED, "SELECT fold, row_id, y_true, y_prob FROM pred", ["y_prob"], ["fold", "row_id", "CAST(y_true AS INTEGER) AS y_true"]))
def _(spark, folder):
    from signalsift.operators.combine import stack

    t = scored(spark, folder).select("fold", "row_id", "y_true", "y_prob")
    return rounded(stack([folds.test_part(t, k) for k in range(1, cfg.FOLDS + 1)]))


_RANKED = """ranked AS (SELECT y_prob, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM (SELECT y_prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM pred GROUP BY y_prob) c
  WINDOW w AS (ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "t17_roc_points",
    asked(
        f"{q.PRED}, {_RANKED}",
        "SELECT y_prob AS threshold, fp / CAST(n AS DOUBLE) AS fpr, tp / CAST(p AS DOUBLE) AS tpr FROM ranked",
        ["threshold", "fpr", "tpr"],
    )
    + " UNION ALL SELECT CAST('Infinity' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)",
)
def _(spark, folder):
    points = metrics.roc_points(predicted(spark, folder))
    cells = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("fpr", "tpr")]
    limit = F.when(F.col("threshold") < 2, F.round("threshold", 6)).otherwise(F.col("threshold"))
    return points.select(limit.alias("threshold"), *cells)


@query(
    "t18_precision_recall_points",
    asked(
        f"{q.PRED}, {_RANKED}",
        "SELECT y_prob AS threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(p AS DOUBLE) AS recall FROM ranked",
        ["threshold", "precision", "recall"],
    ),
)
def _(spark, folder):
    return rounded(metrics.precision_recall_points(predicted(spark, folder)))


@query(
    "t20_calibration",
    asked(
        q.PRED,
        "SELECT CAST((SELECT count(*) FROM (VALUES " + q.values(i / 10 for i in range(1, 10)) + ") e(edge) WHERE edge < y_prob) AS INTEGER) AS bin, "
        "avg(y_prob) AS mean_predicted, avg(y_true) AS fraction_positive, count(*) AS n FROM pred GROUP BY 1",
        ["mean_predicted", "fraction_positive"], ["bin", "n"],
    ),
)
def _(spark, folder):
    return rounded(metrics.calibration(predicted(spark, folder)))


@query(
    "t21_score_distribution",
    asked(
        q.PRED,
        "SELECT CAST(y_true AS INTEGER) AS y_true, count(*) AS n, avg(y_prob) AS mean, median(y_prob) AS median, stddev_pop(y_prob) AS std, min(y_prob) AS min, max(y_prob) AS max FROM pred GROUP BY 1",
        ["mean", "median", "std", "min", "max"], ["y_true", "n"],
    ),
)
def _(spark, folder):
    return rounded(metrics.score_distribution(predicted(spark, folder)))


@query(
    "t22_class_overlap",
    asked(
        q.PRED,
        "SELECT *, CASE WHEN mean_difference > 0.5 THEN 'EXCELLENT' WHEN mean_difference > 0.3 THEN 'GOOD' WHEN mean_difference > 0.15 THEN 'MODERATE' ELSE 'POOR' END AS separation FROM ("
        "SELECT count(*) FILTER (y_true = 0 AND y_prob > 0.3 AND y_prob < 0.7) AS overlap_normal, "
        "100.0 * count(*) FILTER (y_true = 0 AND y_prob > 0.3 AND y_prob < 0.7) / count(*) FILTER (y_true = 0) AS overlap_normal_pct, "
        "count(*) FILTER (y_true = 1 AND y_prob > 0.7) AS anomaly_high, 100.0 * count(*) FILTER (y_true = 1 AND y_prob > 0.7) / count(*) FILTER (y_true = 1) AS anomaly_high_pct, "
        "count(*) FILTER (y_true = 1 AND y_prob < 0.3) AS anomaly_low, 100.0 * count(*) FILTER (y_true = 1 AND y_prob < 0.3) / count(*) FILTER (y_true = 1) AS anomaly_low_pct, "
        "avg(y_prob) FILTER (y_true = 1) - avg(y_prob) FILTER (y_true = 0) AS mean_difference FROM pred) x",
        ["overlap_normal_pct", "anomaly_high_pct", "anomaly_low_pct", "mean_difference"],
        ["overlap_normal", "anomaly_high", "anomaly_low", "separation"],
    ),
)
def _(spark, folder):
    return rounded(metrics.class_overlap(predicted(spark, folder)))


@query(
    "t23_fold_validity",
    f"WITH {q.PRED} SELECT fold, count(*) AS n, count(*) FILTER (y_true = 1) AS n_positive, count(*) >= 100 AS enough_rows, "
    "count(*) FILTER (y_true = 1) > 0 AND count(*) FILTER (y_true = 0) > 0 AS both_classes FROM pred GROUP BY fold",
)
def _(spark, folder):
    return metrics.fold_validity(scored(spark, folder))


# --- thresholds --------------------------------------------------------------

_CURVE = ["threshold", "f2_score", "f1_score", "precision", "recall", "fpr"]
_ALL = ["threshold", *q.RATES]
_COUNTS = ["tp", "fp", "tn", "fn"]


@query(
    "h1_threshold_sweep",
    asked(q.PRED, f"SELECT threshold, f2_score, f1_score, precision, recall, fpr AS far FROM ({q.rates_of(q.counts_at('pred', cfg.SWEEP))}) x", [*_CURVE[:-1], "far"]),
)
def _(spark, folder):
    return rounded(threshold.threshold_sweep(predicted(spark, folder)))


@query("h2_f_beta", asked(q.PRED, f"SELECT fold, {q.RATES['f2_score']} AS f2, {q.RATES['f1_score']} AS f1 FROM ({q.counts_at('pred', [T], 'fold')}) c", ["f2", "f1"], ["fold"]))
def _(spark, folder):
    from signalsift.functions.rates import f_beta

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counts = metrics.decision_counts(["fold"], scored(spark, folder), T)
    return rounded(counts.select("fold", f_beta(tp, fp, fn, 2.0).alias("f2"), f_beta(tp, fp, fn).alias("f1")))


_GRADE = "CASE WHEN far_per_hour <= 10 THEN 'EXCELLENT' WHEN far_per_hour <= 30 THEN 'GOOD' WHEN far_per_hour <= 60 THEN 'MODERATE' ELSE 'HIGH' END AS status"
_SWEPT = f"swept AS ({q.rates_of(q.counts_at('pred', cfg.SWEEP))})"
_BEST = f"best AS (SELECT *, threshold AS optimal_threshold, 60 / nullif(far_per_hour, 0) AS minutes_between_false_alarms, {_GRADE} FROM swept ORDER BY f2_score DESC, threshold LIMIT 1)"


@query(
    "h3_best_f2",
    asked(f"{q.PRED}, {_SWEPT}, {_BEST}", "SELECT * FROM best", ["optimal_threshold", *q.RATES, "minutes_between_false_alarms"], [*_COUNTS, "status"]),
)
def _(spark, folder):
    return rounded(threshold.best_f2(predicted(spark, folder)))


_OPER = ["fpr", "far_per_hour", "total_alerts_per_hour", "minutes_between"]


@query(
    "h4_operational_rates",
    asked(
        q.PRED, f"SELECT fold, fpr, far_per_hour, total_alerts_per_hour, 60 / nullif(far_per_hour, 0) AS minutes_between FROM ({q.rates_of(q.counts_at('pred', [T], 'fold'), 'fold')}) x",
        _OPER, ["fold"],
    ),
)
def _(spark, folder):
    from signalsift.functions.rates import minutes_between

    m = threshold.threshold_metrics(scored(spark, folder), [T], ["fold"])
    return rounded(m.withColumn("minutes_between", minutes_between(F.col("far_per_hour"))).select("fold", *_OPER))


@query("h5_far_at_thresholds", asked(q.PRED, q.rates_of(q.counts_at("pred", cfg.FAR_THRESHOLDS)), _ALL, _COUNTS))
def _(spark, folder):
    return rounded(threshold.threshold_metrics(predicted(spark, folder)))


def _budget_sql(budgets) -> str:
    return f"""
SELECT * FROM (
  SELECT m.*, b.budget, row_number() OVER (PARTITION BY b.budget ORDER BY recall DESC, threshold) AS place
  FROM swept m CROSS JOIN (VALUES {q.values(budgets)}) b(budget) WHERE far_per_hour <= b.budget) x WHERE place = 1"""


@query("h6_budgets", asked(f"{q.PRED}, {_SWEPT}", _budget_sql(cfg.FAR_BUDGETS), ["budget", *_ALL], _COUNTS))
def _(spark, folder):
    return rounded(threshold.within_budget(threshold.threshold_metrics(predicted(spark, folder), cfg.SWEEP)))


@query("h7_recommendation", asked(f"{q.PRED}, {_SWEPT}", _budget_sql([cfg.SUSTAINABLE_FAR]), ["budget", *_ALL], _COUNTS))
def _(spark, folder):
    return rounded(threshold.recommend(threshold.threshold_metrics(scored(spark, folder), cfg.SWEEP)))


_FOLD_SQL = f"SELECT fold, f2_score, precision, recall, tp + fp + tn + fn AS n_samples FROM ({q.rates_of(q.counts_at('pred', [T], 'fold'), 'fold')}) x"


@query("h8_threshold_per_fold", asked(q.PRED, _FOLD_SQL, ["f2_score", "precision", "recall"], ["fold", "n_samples"]))
def _(spark, folder):
    return rounded(threshold.per_fold(scored(spark, folder), T))


_STABLE = [f"{m}_{s}" for m in ("f2_score", "precision", "recall") for s in ("mean", "std")]


@query(
    "h9_stability",
    asked(
        f"{q.PRED}, per AS ({_FOLD_SQL})",
        "SELECT *, CASE WHEN f2_score_std < 0.02 THEN 'EXCELLENT' WHEN f2_score_std < 0.05 THEN 'GOOD' WHEN f2_score_std < 0.10 THEN 'MODERATE' ELSE 'LOW' END AS stability FROM (SELECT "
        + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in ("f2_score", "precision", "recall"))
        + " FROM per) x",
        _STABLE, ["stability"],
    ),
)
def _(spark, folder):
    return rounded(threshold.stability(threshold.per_fold(scored(spark, folder), T)))


@query("h10_alarm_grade", asked(f"{q.PRED}, {_SWEPT}", f"SELECT threshold, {_GRADE} FROM swept", ["threshold"], ["status"]))
def _(spark, folder):
    from signalsift.functions.grades import alarm_grade

    m = threshold.threshold_metrics(predicted(spark, folder), cfg.SWEEP)
    return rounded(m.select("threshold", alarm_grade(F.col("far_per_hour")).alias("status")))


@query("h11_fixed_threshold", asked(f"{q.PRED}", f"SELECT *, {_GRADE} FROM ({q.rates_of(q.counts_at('pred', [cfg.BASE_THRESHOLD]))}) x", _ALL, [*_COUNTS, "status"]))
def _(spark, folder):
    return rounded(threshold.at_threshold(predicted(spark, folder)))


# --- false alarms ------------------------------------------------------------


@query(
    "f4_score_cohorts",
    f"WITH {q.PRED} SELECT row_id, 'high' AS cohort FROM pred WHERE y_true = 0 AND y_prob >= 0.5 UNION ALL SELECT row_id, 'low' FROM pred WHERE y_true = 0 AND y_prob < 0.5",
)
def _(spark, folder):
    t = predicted(spark, folder)
    high = investigate.false_alarms(t, 0.5).select("row_id", F.lit("high").alias("cohort"))
    return high.unionByName(investigate.quiet_normals(t, 0.5).select("row_id", F.lit("low").alias("cohort")))


_SIZES = f"""SELECT v.t AS threshold, count(*) FILTER (y_true = 0) AS n_normal, count(*) FILTER (y_true = 0 AND y_prob >= v.t) AS n_high,
  100.0 * count(*) FILTER (y_true = 0 AND y_prob >= v.t) / count(*) FILTER (y_true = 0) AS high_pct,
  count(*) FILTER (y_true = 0 AND y_prob < v.t) AS n_low, 100.0 * count(*) FILTER (y_true = 0 AND y_prob < v.t) / count(*) FILTER (y_true = 0) AS low_pct,
  avg(y_prob) FILTER (y_true = 0 AND y_prob >= v.t) AS high_mean_prob, avg(y_prob) FILTER (y_true = 1) AS anomaly_mean_prob
  FROM pred CROSS JOIN (VALUES {q.values(cfg.REPORT_THRESHOLDS)}) v(t) GROUP BY 1"""


@query("i1_cohort_sizes", asked(q.PRED, _SIZES, ["threshold", "high_pct", "low_pct", "high_mean_prob", "anomaly_mean_prob"], ["n_normal", "n_high", "n_low"]))
def _(spark, folder):
    return rounded(investigate.cohort_sizes(predicted(spark, folder)))


_BY_SCENARIO = """SELECT scenario_id, count(*) FILTER (y_true = 0 AND y_prob >= 0.5) AS n_high, count(*) FILTER (y_true = 0) AS n_normal,
  coalesce(100.0 * count(*) FILTER (y_true = 0 AND y_prob >= 0.5) / nullif(count(*) FILTER (y_true = 0), 0), 0) AS false_alarm_rate FROM pred GROUP BY 1"""


@query("i2_alarms_by_scenario", asked(q.PRED, _BY_SCENARIO, ["false_alarm_rate"], ["scenario_id", "n_high", "n_normal"]))
def _(spark, folder):
    return rounded(investigate.alarms_by_scenario(predicted(spark, folder)))


@query(
    "i3_concentration",
    asked(
        f"{q.PRED}, per AS ({_BY_SCENARIO})",
        "SELECT max(false_alarm_rate) AS max_rate, min(false_alarm_rate) AS min_rate, max(false_alarm_rate) - min(false_alarm_rate) > 30 AS concentrated, "
        "100.0 * sum(n_high) / sum(n_normal) AS overall_rate, sum(n_high) / CAST(sum(n_normal) AS DOUBLE) > 0.3 AS too_many FROM per",
        ["max_rate", "min_rate", "overall_rate"], ["concentrated", "too_many"],
    ),
)
def _(spark, folder):
    return rounded(investigate.concentration(predicted(spark, folder)))


# Windows with all their features, a label and a score made of their place and time.
FPRED = f"""{q.WIN},
fpred AS (SELECT *, weak_label AS y_true, CAST(0.25 AS DOUBLE) * weak_label
  + CAST(0.75 AS DOUBLE) * (CAST((window_no * 7919 + mcs_ul_mode * 104729) % 997 AS DOUBLE) / 997) AS y_prob FROM feat)"""


def scored_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All features of each window, with a label and a score."""
    t = staged(feature_rows(spark, folder, "window_no"))
    place = (F.col("window_no") * 7919 + F.col("mcs_ul_mode") * 104729) % 997
    score = F.lit(0.25) * F.col("weak_label") + F.lit(0.75) * (place.cast("double") / 997)
    return t.withColumn("y_true", F.col("weak_label").cast("int")).withColumn("y_prob", score)


def _contrast_sql(t: float) -> str:
    rows = [
        f"SELECT '{f}' AS feature, avg({f}) FILTER (y_prob >= {t}) AS hm, avg({f}) FILTER (y_prob < {t}) AS lm, "
        f"stddev_samp({f}) FILTER (y_prob >= {t}) AS hs, stddev_samp({f}) FILTER (y_prob < {t}) AS ls FROM fpred WHERE y_true = 0"
        for f in _X
    ]
    return (
        "SELECT feature, hm AS high_prob_mean, lm AS low_prob_mean, hm - lm AS diff, "
        "abs(CASE WHEN sqrt((hs * hs + ls * ls) / 2) > 0 THEN (hm - lm) / sqrt((hs * hs + ls * ls) / 2) ELSE 0 END) AS effect_size FROM ("
        + " UNION ALL ".join(rows) + ") x"
    )


_CONTRAST = ["high_prob_mean", "low_prob_mean", "diff", "effect_size"]


@query("i4_feature_contrast", asked(FPRED, _contrast_sql(0.5), _CONTRAST, ["feature"], 8))
def _(spark, folder):
    return rounded(investigate.feature_contrast(scored_windows(spark, folder), _X, 0.5), 8)


@query("i4_top_features", asked(FPRED, f"SELECT * FROM ({_contrast_sql(0.5)}) c ORDER BY effect_size DESC, feature LIMIT 10", _CONTRAST, ["feature"], 8))
def _(spark, folder):
    return rounded(investigate.strongest(investigate.feature_contrast(scored_windows(spark, folder), _X, 0.5)), 8)


_LIKE = "SELECT feature, h AS high_prob_normal_mean, a AS anomaly_mean, abs(h - a) AS absolute_diff FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg({f}) FILTER (y_true = 0 AND y_prob >= 0.5) AS h, avg({f}) FILTER (y_true = 1) AS a FROM fpred" for f in _X
) + ") x"
_LIKE_COLUMNS = ["high_prob_normal_mean", "anomaly_mean", "absolute_diff"]


@query(
    "i5_anomaly_likeness",
    asked(
        f"{FPRED}, l AS ({_LIKE})",
        "SELECT * FROM (SELECT *, 'similar' AS side FROM l ORDER BY absolute_diff, feature LIMIT 10) n UNION ALL "
        "SELECT * FROM (SELECT *, 'different' AS side FROM l ORDER BY absolute_diff DESC, feature DESC LIMIT 5) f",
        _LIKE_COLUMNS, ["feature", "side"], 8,
    ),
)
def _(spark, folder):
    like = investigate.anomaly_likeness(scored_windows(spark, folder), _X, 0.5)
    return rounded(investigate.likeness_extremes(like), 8)


@query(
    "i6_alarm_report",
    asked(
        f"{FPRED}, sizes_at AS ({_SIZES.replace('FROM pred', 'FROM fpred')})",
        "SELECT c.*, s.n_normal, s.n_high, s.high_pct FROM (" + " UNION ALL ".join(
            f"SELECT *, CAST({t} AS DOUBLE) AS threshold FROM ({_contrast_sql(t)}) c{i}" for i, t in enumerate(cfg.REPORT_THRESHOLDS)
        ) + ") c JOIN sizes_at s ON s.threshold = c.threshold",
        ["threshold", *_CONTRAST, "high_pct"], ["feature", "n_normal", "n_high"], 8,
    ),
)
def _(spark, folder):
    return rounded(report.alarm_report(scored_windows(spark, folder), _X), 8)


def _cohort_histogram_sql(bins: int, top: int) -> str:
    """All features are binned; the ones with the largest effect are kept."""
    parts = [
        f"""SELECT r.cohort, '{f}' AS "column", CAST(b.i AS INTEGER) AS bin, r.low + (r.high - r.low) / {bins} * b.i AS bin_low,
  r.low + (r.high - r.low) / {bins} * (b.i + 1) AS bin_high, r.mean, r.total,
  (SELECT count(*) FROM cohorts t WHERE t.cohort = r.cohort AND t.{f} IS NOT NULL
     AND least(CAST(floor((t.{f} - r.low) / (r.high - r.low) * {bins}) AS INTEGER), {bins - 1}) = b.i) AS n
FROM (SELECT cohort, CAST(min({f}) AS DOUBLE) AS low, CAST(max({f}) AS DOUBLE) AS high, avg({f}) AS mean, count({f}) AS total FROM cohorts GROUP BY cohort) r, range({bins}) b(i)"""
        for f in _X
    ]
    return (
        "SELECT h.*, n / (total * (bin_high - bin_low)) AS density FROM (" + " UNION ALL ".join(parts) + ") h "
        f"WHERE \"column\" IN (SELECT feature FROM ({_contrast_sql(0.5)}) c ORDER BY effect_size DESC, feature LIMIT {top})"
    )


@query(
    "i7_cohort_histograms",
    asked(
        f"{FPRED}, cohorts AS (SELECT *, CASE WHEN y_true = 1 THEN 'anomaly' WHEN y_prob >= 0.5 THEN 'high' ELSE 'low' END AS cohort FROM fpred)",
        _cohort_histogram_sql(30, 6), ["bin_low", "bin_high", "mean", "density"], ["cohort", '"column"', "bin", "n"], 8,
    ),
)
def _(spark, folder):
    return rounded(investigate.cohort_histograms(scored_windows(spark, folder), _X), 8)


@query("i8_prediction_sink", asked(q.PRED, "SELECT fold, count(*) AS n, sum(y_true) AS positives, avg(y_prob) AS mean_score FROM pred GROUP BY 1", ["mean_score"], ["fold", "n", "CAST(positives AS BIGINT) AS positives"]))
def _(spark, folder):
    path = sinks.write_predictions(scored(spark, folder), scratch(spark, "predictions"))
    stored = spark.read.parquet(path)
    return rounded(stored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("positives"), F.avg("y_prob").alias("mean_score")))


# --- models (checked by rows only) -------------------------------------------


@query("t4_held_out_scores")
def _(spark, folder):
    made = train.held_out_scores(feature_rows(spark, folder))
    return rounded(made.select("scenario_id", "ts_start_ns", "fold", "y_true", "y_prob"))


@query("t6_final_model")
def _(spark, folder):
    table = staged(feature_rows(spark, folder))
    model = train.train_all(table)
    return rounded(train.score(table, model).select("scenario_id", "ts_start_ns", "weak_label", "y_prob"))


@query("t19_feature_importance")
def _(spark, folder):
    table = staged(feature_rows(spark, folder))
    fitted = prep.fit_preparation(table)
    model = train.fit_model(table, fitted)
    named = train.feature_importance(model, fitted.feature_order)
    return spark.createDataFrame([(i.feature, i.importance) for i in named], "feature string, importance double")


@query("x4_alerts")
def _(spark, folder):
    table = staged(feature_rows(spark, folder))
    path = sinks.save_model(train.train_all(table), scratch(spark, "model"))
    return rounded(scoring.alert_rate(scoring.alerts(table, sinks.load_model(path), 0.5)))


@query("o1_parameter_search")
def _(spark, folder):
    found = train.search(feature_rows(spark, folder))
    return found.select("trial", "score", "fold_std")


# --- search results over a trial table ---------------------------------------

# One trial per user: the score of its events, folds by event number.
_TRIALS = f"""{q.TELE},
runs AS (SELECT t.*, e.user_id AS trial, e.event_id % 2 AS part, t.lab_inf + t.lab_anom > 0 AS hit FROM tele t JOIN events e ON e.event_id = t.row_id),
judged AS (SELECT trial, part, CASE WHEN hit THEN 1 ELSE 0 END AS y_true, y_prob FROM runs),
areas AS (SELECT trial, part, (SELECT 1) AS one, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS n FROM judged GROUP BY trial, part),
pairs AS (SELECT a.trial, a.part, avg(CASE WHEN a.y_prob > b.y_prob THEN 1.0 WHEN a.y_prob = b.y_prob THEN 0.5 ELSE 0 END) AS roc_auc
  FROM judged a JOIN judged b ON a.trial = b.trial AND a.part = b.part WHERE a.y_true = 1 AND b.y_true = 0 GROUP BY 1, 2),
trials AS (SELECT a.trial, avg(p.roc_auc) AS score, stddev_pop(p.roc_auc) AS fold_std, count(p.roc_auc) AS valid_folds
  FROM areas a LEFT JOIN pairs p ON p.trial = a.trial AND p.part = a.part GROUP BY 1)"""


def trial_table(spark: SparkSession, folder: str) -> DataFrame:
    users = load(spark, folder, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("trial"))
    t = events(spark, folder).join(users, "row_id")
    hit = (F.col("lab_inf") + F.col("lab_anom") > 0).cast("int")
    judged = t.select("trial", (F.col("row_id") % 2).alias("fold"), hit.alias("y_true"), "y_prob")
    return train.trial_scores(judged)


@query("o1_trial_scores", asked(_TRIALS, "SELECT * FROM trials", ["score", "fold_std"], ["trial", "valid_folds"]))
def _(spark, folder):
    return rounded(trial_table(spark, folder))


@query("o2_top_trials", asked(_TRIALS, "SELECT trial, score FROM trials ORDER BY score DESC NULLS LAST, trial LIMIT 10", ["score"], ["trial"]))
def _(spark, folder):
    return rounded(train.top_trials(trial_table(spark, folder).select("trial", "score")))


@query(
    "o3_improvement",
    asked(_TRIALS, f"SELECT max(score) AS best_score, {cfg.BASELINE_ROC_AUC} AS baseline, (max(score) - {cfg.BASELINE_ROC_AUC}) * 100 AS improvement FROM trials", ["best_score", "baseline", "improvement"]),
)
def _(spark, folder):
    return rounded(threshold.improvement(trial_table(spark, folder)))


@query("o4_running_best", asked(_TRIALS, "SELECT trial, max(score) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) AS best_so_far FROM trials", ["best_so_far"], ["trial"]))
def _(spark, folder):
    return rounded(threshold.running_best(trial_table(spark, folder)).select("trial", "best_so_far"))


# --- drift -------------------------------------------------------------------

_DRIFT = ["sinr_db", "rsrp_dbm", "app_dl_mbps", "prb_ul"]


def _drift_sql() -> str:
    parts = []
    for c in _DRIFT:
        parts.append(f"""
SELECT '{c}' AS "column", sum((cs - rs) * ln(cs / rs)) AS psi FROM (
  SELECT greatest(sum(CASE WHEN side = 'r' THEN 1 ELSE 0 END) / CAST(max(nr) AS DOUBLE), 0.0001) AS rs,
         greatest(sum(CASE WHEN side = 'c' THEN 1 ELSE 0 END) / CAST(max(nc) AS DOUBLE), 0.0001) AS cs
  FROM (SELECT CASE WHEN row_id % 2 = 0 THEN 'r' ELSE 'c' END AS side,
          greatest(0, least(9, CAST(floor(({c} - low) / (high - low) * 10) AS INTEGER))) AS bin, nr, nc
        FROM tele, (SELECT min({c}) AS low, max({c}) AS high FROM tele WHERE row_id % 2 = 0) b,
          (SELECT count({c}) FILTER (row_id % 2 = 0) AS nr, count({c}) FILTER (row_id % 2 = 1) AS nc FROM tele) n
        WHERE {c} IS NOT NULL) x GROUP BY bin) y""")
    return f"SELECT *, psi > {cfg.DRIFT_LIMIT} AS drifted FROM (" + " UNION ALL ".join(parts) + ") z"


@query("x5_feature_drift", asked(q.TELE, _drift_sql(), ["psi"], ['"column"', "drifted"]))
def _(spark, folder):
    """Even rows are the reference, odd rows the current table; together all rows."""
    t = events(spark, folder)
    return rounded(drift.population_stability(t.filter("row_id % 2 = 0"), t.filter("row_id % 2 = 1"), _DRIFT))
