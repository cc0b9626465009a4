"""Queries about windows and features (W, A1–A5, C, X6, X7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsift.catalog import sql as q
from signalsift.catalog.registry import asked, query, rounded
from signalsift.config import telemetry as cfg
from signalsift.functions.aggregates import aggregate
from signalsift.operators import features, rules, windows
from signalsift.operators.schema import in_order
from signalsift.plans.curate import windowed
from signalsift.plans.surrogate import (
    EVENT_ORDER,
    LINEITEM_ORDER,
    telemetry_events,
    telemetry_lineitem,
)

KEY = ["scenario_id", "ts_start_ns"]
INTEGER_COLUMNS = {
    "ts_start_ns", "scenario_id", "pci_mode", "mcs_dl_mode", "mcs_ul_mode", "window_samples", "weak_label", "is_single_rru"
}


def split(columns) -> tuple[list[str], list[str]]:
    """(doubles, others) of a list of window or feature columns."""
    return [c for c in columns if c not in INTEGER_COLUMNS], [c for c in columns if c in INTEGER_COLUMNS]


def event_table(spark: SparkSession, folder: str) -> DataFrame:
    return windowed(telemetry_events(spark, folder), EVENT_ORDER)


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return windows.count_windows(telemetry_events(spark, folder), EVENT_ORDER)


def feature_rows(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """The feature table of the events view, with ``more`` columns of its windows."""
    made = features.feature_table(event_table(spark, folder))
    if not more:
        return made
    return made.join(event_counts(spark, folder).select(*KEY, *more), KEY)


@query(
    "w1_count_windows",
    f"WITH {q.WIN} SELECT scenario_id, window_no, ts_start_ns, window_samples FROM win0",
)
def _(spark, folder):
    return event_counts(spark, folder).select("scenario_id", "window_no", "ts_start_ns", "window_samples")


@query(
    "w1_row_numbers_sliced",
    f"WITH {q.TELE} SELECT row_id, row_number() OVER (PARTITION BY scenario_id ORDER BY ts_ns, row_id) AS rn FROM tele",
)
def _(spark, folder):
    """The way of large scenarios: ranges of time instead of one task each."""
    from signalsift.operators.ordering import number_rows

    numbered = number_rows(telemetry_events(spark, folder), ["scenario_id"], EVENT_ORDER, rows_per_slice=500)
    return numbered.select("row_id", "rn")


_STATS = [c for c in cfg.WINDOW_COLUMNS if c.endswith(("_mean", "_std", "_min", "_max", "_mode")) and not c.startswith("d_")]


@query("w2_window_aggregates", asked(q.WIN, "SELECT * FROM win1", split(_STATS)[0], ["scenario_id", "window_no", *split(_STATS)[1]]))
def _(spark, folder):
    return rounded(event_counts(spark, folder).select("scenario_id", "window_no", *_STATS))


@query(
    "w2_window_aggregates_lineitem",
    asked(q.LINE_WIN, "SELECT * FROM win1", split(_STATS)[0], ["scenario_id", "window_no", *split(_STATS)[1]]),
)
def _(spark, folder):
    made = windows.count_windows(telemetry_lineitem(spark, folder), LINEITEM_ORDER)
    return rounded(made.select("scenario_id", "window_no", *_STATS))


@query(
    "w3_window_metadata",
    asked(q.WIN, "SELECT * FROM win0", ["gap_ratio"], ["scenario_id", "ts_start_ns", "window_samples"]),
)
def _(spark, folder):
    return rounded(event_counts(spark, folder).select("scenario_id", "ts_start_ns", "window_samples", "gap_ratio"))


@query("w4_weak_label", f"WITH {q.WIN} SELECT scenario_id, window_no, weak_label FROM win0")
def _(spark, folder):
    return event_counts(spark, folder).select("scenario_id", "window_no", "weak_label")


_DELTAS = [f"d_{c}" for c in cfg.DELTAS]


@query("w5_window_deltas", asked(q.WIN, "SELECT * FROM win", _DELTAS, KEY))
def _(spark, folder):
    return rounded(windows.add_deltas(event_counts(spark, folder)).select(*KEY, *_DELTAS))


@query("w5_window_deltas_chunked", asked(q.WIN, "SELECT * FROM win", _DELTAS, KEY))
def _(spark, folder):
    """The same with short chunks, so that chunk borders are crossed often."""
    return rounded(windows.add_deltas(event_counts(spark, folder), chunk=50).select(*KEY, *_DELTAS))


@query("w6_guarded_ratios", asked(q.WIN, "SELECT * FROM win", list(cfg.RATIOS), KEY))
def _(spark, folder):
    return rounded(windows.add_ratios(event_counts(spark, folder)).select(*KEY, *cfg.RATIOS))


@query("w7_sinr_range", asked(q.WIN, "SELECT * FROM win", ["sinr_range"], KEY))
def _(spark, folder):
    return rounded(windows.add_ratios(event_counts(spark, folder)).select(*KEY, "sinr_range"))


@query(
    "w8_windows_per_scenario",
    asked(
        q.TELE,
        "SELECT scenario_id, count(*) AS rows, count(*) // 10 AS windows, (count(*) // 10) / (count(*) / 10.0) AS creation_rate "
        "FROM tele GROUP BY scenario_id",
        ["creation_rate"], ["scenario_id", "rows", "windows"],
    ),
)
def _(spark, folder):
    return rounded(windows.window_counts(telemetry_events(spark, folder)))


def result_sql(category: str, checks: list[tuple], severity: str | None = None) -> str:
    """Rows of a check table: (check, column, observed SQL, low, high) each."""
    rows = []
    for check, column, observed, low, high in checks:
        kept = " AND ".join(
            [f"v >= {low}" for _ in [0] if low is not None] + [f"v <= {high}" for _ in [0] if high is not None]
        ) or "TRUE"
        rows.append(
            f"SELECT '{category}' AS category, '{check}' AS \"check\", '{column}' AS \"column\", coalesce({kept}, TRUE) AS success, "
            f"v AS observed, CAST({'NULL' if low is None else low} AS DOUBLE) AS expected_min, "
            f"CAST({'NULL' if high is None else high} AS DOUBLE) AS expected_max, "
            f"{'CAST(NULL AS VARCHAR)' if severity is None else repr(severity)} AS severity FROM (SELECT CAST({observed} AS DOUBLE) AS v) t"
        )
    return " UNION ALL ".join(rows)


RESULT_DOUBLES = ["observed", "expected_min", "expected_max"]
RESULT_OTHERS = ["category", '"check"', '"column"', "success", "severity"]

_L = cfg.WINDOW_LIMITS


@query(
    "w9_window_checks",
    asked(
        q.WIN,
        result_sql(
            "windows",
            [
                ("min_windows", "*", "(SELECT count(*) FROM win)", _L["min_windows"], None),
                ("gap_ratio_mean", "gap_ratio", "(SELECT avg(gap_ratio) FROM win)", None, _L["max_gap_ratio"]),
                ("gap_ratio_max", "gap_ratio", "(SELECT max(gap_ratio) FROM win)", None, None),
                (
                    "weak_label_rate", "weak_label", "(SELECT avg(weak_label) FROM win)",
                    _L["min_label_rate"], _L["max_label_rate"],
                ),
                ("label_0", "weak_label", "(SELECT count(*) FROM win WHERE weak_label = 0)", None, None),
                ("label_1", "weak_label", "(SELECT count(*) FROM win WHERE weak_label = 1)", None, None),
                ("sinr_mean_avg", "sinr_mean", "(SELECT avg(sinr_mean) FROM win)", None, None),
                ("sinr_std_avg", "sinr_std", "(SELECT avg(sinr_std) FROM win)", None, None),
                ("throughput_mean_avg", "app_dl_mean", "(SELECT avg(app_dl_mean) FROM win)", None, None),
            ],
        ),
        RESULT_DOUBLES, RESULT_OTHERS,
    ),
)
def _(spark, folder):
    return rounded(rules.evaluate(event_counts(spark, folder), rules.window_rules()))


@query(
    "w10_event_time_windows",
    asked(
        q.LINE,
        "SELECT scenario_id, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS window_samples, "
        "CAST(1 AS DOUBLE) - count(*) / CAST(10 AS DOUBLE) AS gap_ratio, avg(sinr_db) AS sinr_mean, "
        "stddev_pop(sinr_db) AS sinr_std, max(CASE WHEN lab_anom <> 0 OR lab_inf <> 0 THEN 1 ELSE 0 END) AS weak_label, "
        "min(ts_ns) AS ts_start_ns FROM line GROUP BY 1, 2 HAVING count(*) >= 7",
        ["gap_ratio", "sinr_mean", "sinr_std"], ["scenario_id", "window_samples", "weak_label", "ts_start_ns"],
    ),
)
def _(spark, folder):
    made = windows.event_windows(telemetry_lineitem(spark, folder), "7 days")
    return rounded(
        made.select("scenario_id", "window_samples", "gap_ratio", "sinr_mean", "sinr_std", "weak_label", "ts_start_ns")
    )


@query(
    "w10_five_minute_windows",
    asked(
        q.TELE,
        "SELECT scenario_id, CAST(epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT) AS window_us, count(*) AS window_samples, "
        "coalesce(avg(prb_ul), 0) AS prb_ul_mean FROM tele GROUP BY 1, 2",
        ["prb_ul_mean"], ["scenario_id", "window_us", "window_samples"],
    ),
)
def _(spark, folder):
    made = windows.event_windows(telemetry_events(spark, folder), "5 minutes", min_samples=1)
    return rounded(
        made.select("scenario_id", F.unix_micros("window_start").alias("window_us"), "window_samples", "prb_ul_mean")
    )


# --- aggregates --------------------------------------------------------------


def _stat_query(name: str, function: str, sql: str) -> None:
    """One named aggregate of uplink throughput per hour and scenario; a
    scenario without any value gives the default."""

    @query(
        name,
        asked(
            q.TELE, f"SELECT scenario_id, ts_ns // 3600000000000 AS hour, {sql} AS v FROM tele GROUP BY 1, 2",
            ["v"], ["scenario_id", "hour"],
        ),
    )
    def _(spark, folder):
        t = telemetry_events(spark, folder)
        hour = F.floor(F.col("ts_ns") / F.lit(3_600_000_000_000)).alias("hour")
        return rounded(t.groupBy("scenario_id", hour).agg(aggregate(function, "app_ul_mbps").cast("double").alias("v")))


_stat_query("a1_mean_or_zero", "mean", "coalesce(avg(app_ul_mbps), 0)")
_stat_query("a2_population_std", "std", "coalesce(stddev_pop(app_ul_mbps), 0)")
_stat_query("a3_min_or_zero", "min", "coalesce(min(app_ul_mbps), 0)")
_stat_query("a3_max_or_zero", "max", "coalesce(max(app_ul_mbps), 0)")
_stat_query("a5_sum_or_zero", "sum", "coalesce(sum(app_ul_mbps), 0)")


@query(
    "a4_mode_smallest",
    f"""WITH {q.TELE}, c AS (SELECT scenario_id, ts_ns // 3600000000000 AS hour, mcs_dl, count(*) AS n FROM tele GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, hour ORDER BY mcs_dl IS NULL, n DESC, mcs_dl) AS place FROM c)
    SELECT scenario_id, hour, CAST(coalesce(mcs_dl, 0) AS INTEGER) AS v FROM r WHERE place = 1""",
)
def _(spark, folder):
    t = telemetry_events(spark, folder)
    hour = F.floor(F.col("ts_ns") / F.lit(3_600_000_000_000)).alias("hour")
    return t.groupBy("scenario_id", hour).agg(aggregate("mode", "mcs_dl").alias("v"))


# --- features ----------------------------------------------------------------


def _feature_query(name: str, feature: str) -> None:
    doubles, others = split([feature])

    @query(name, asked(q.WIN, "SELECT * FROM feat", doubles, [*KEY, *others]))
    def _(spark, folder):
        from signalsift.functions.features import FEATURES

        base = event_table(spark, folder)
        return rounded(features.add_features(base, {feature: FEATURES[feature]}).select(*KEY, feature))


for _name, _feature in {
    "c1_prb_util_ratio": "prb_util_ratio",
    "c2_hour_sin": "hour_sin",
    "c3_hour_cos": "hour_cos",
    "c4_sinr_cv": "sinr_cv",
    "c5_throughput_efficiency": "throughput_efficiency",
    "c6_is_single_rru": "is_single_rru",
    "c7_scenario_level": "scenario_level",
}.items():
    _feature_query(_name, _feature)


@query("c8_feature_table", asked(q.WIN, "SELECT * FROM feat", *split(cfg.FEATURE_COLUMNS)))
def _(spark, folder):
    """The flagship: samples to the table a model is trained on."""
    return rounded(feature_rows(spark, folder))


@query("c8_feature_table_lineitem", asked(q.LINE_WIN, "SELECT * FROM feat", *split(cfg.FEATURE_COLUMNS)))
def _(spark, folder):
    return rounded(features.feature_table(windowed(telemetry_lineitem(spark, folder), LINEITEM_ORDER)))


@query("w_windows_table", asked(q.WIN, "SELECT * FROM win", *split(cfg.WINDOW_COLUMNS)))
def _(spark, folder):
    return rounded(in_order(event_table(spark, folder), cfg.WINDOW_COLUMNS))


_FL = cfg.FEATURE_LIMITS


@query(
    "c9_feature_checks",
    asked(
        q.WIN,
        result_sql(
            "features",
            [
                ("min_windows", "*", "(SELECT count(*) FROM feat)", _FL["min_windows"], None),
                *[
                    (f"missing_{c}", c, f"(SELECT avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM feat)", None, _FL["max_missing_ratio"])
                    for c in cfg.FEATURE_COLUMNS
                ],
                ("total_missing", "*", "(SELECT " + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cfg.FEATURE_COLUMNS) + " FROM feat)", None, None),
                ("sinr_mean_avg", "sinr_mean", "(SELECT avg(sinr_mean) FROM feat)", None, None),
                ("sinr_range_avg", "sinr_range", "(SELECT avg(sinr_range) FROM feat)", None, None),
                ("throughput_avg", "app_dl_mean", "(SELECT avg(app_dl_mean) FROM feat)", None, None),
                ("anomaly_rate", "weak_label", "(SELECT avg(weak_label) FROM feat)", None, None),
            ],
        ),
        RESULT_DOUBLES, RESULT_OTHERS,
    ),
)
def _(spark, folder):
    table = feature_rows(spark, folder)
    return rounded(rules.evaluate(table, rules.feature_rules(table.columns)))


_ROLL = ["sinr_mean_roll_mean", "sinr_mean_roll_std", "app_dl_mean_roll_mean", "app_dl_mean_roll_std"]


@query(
    "x6_rolling_features",
    asked(
        q.WIN,
        "SELECT scenario_id, ts_start_ns, "
        + ", ".join(
            f"avg({c}) OVER r AS {c}_roll_mean, stddev_pop({c}) OVER r AS {c}_roll_std" for c in ("sinr_mean", "app_dl_mean")
        )
        + " FROM win WINDOW r AS (PARTITION BY scenario_id ORDER BY window_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
        _ROLL, KEY,
    ),
)
def _(spark, folder):
    rolled = windows.add_rolling(event_counts(spark, folder), ("sinr_mean", "app_dl_mean"), chunk=64)
    return rounded(rolled.select(*KEY, *_ROLL))


@query(
    "x7_second_delta",
    asked(
        q.WIN,
        "SELECT scenario_id, ts_start_ns, coalesce(d_sinr_mean - lag(d_sinr_mean) OVER w, 0) AS dd_sinr_mean FROM win "
        "WINDOW w AS (PARTITION BY scenario_id ORDER BY window_no)",
        ["dd_sinr_mean"], KEY,
    ),
)
def _(spark, folder):
    return rounded(windows.add_second_deltas(event_counts(spark, folder), chunk=64).select(*KEY, "dd_sinr_mean"))
