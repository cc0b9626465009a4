"""Queries about rules and profiles (V, G, A6–A11, U, J, R)."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from signalsift.catalog import sql as q
from signalsift.catalog.curation import SUMMARY_SQL, summary
from signalsift.catalog.registry import asked, query, rounded, scratch
from signalsift.catalog.windows import RESULT_DOUBLES, RESULT_OTHERS, event_counts, event_table, feature_rows, result_sql
from signalsift.config import telemetry as cfg
from signalsift.operators import combine, profile, rules, sketches
from signalsift.plans.surrogate import load, telemetry_events, telemetry_lineitem
from signalsift.session import staged

CHECKED = ["row_id", "scenario_id", "ts_ns", "pci", "rsrp_dbm", "rsrq_db", "sinr_db", "mcs_dl", "mcs_ul", "prb_dl",
           "prb_ul", "app_dl_mbps", "app_ul_mbps", "lab_anom", "lab_inf"]
S = cfg.SEVERITY


def samples(spark, folder):
    return telemetry_events(spark, folder).select(*CHECKED)


def one(expression: str, where: str = "") -> str:
    return f"(SELECT {expression} FROM tele {where})"


def null_share(c: str) -> str:
    return one(f"avg(CASE WHEN {c} IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END)")


def inside(c: str, low: float, high: float, cohort: str = "TRUE") -> str:
    return one(f"avg(CASE WHEN {c} BETWEEN {low} AND {high} THEN CAST(1 AS DOUBLE) ELSE 0 END)", f"WHERE {c} IS NOT NULL AND {cohort}")


_PRESENT = set(CHECKED)
NOT_NULL = [c for c in cfg.CHECK_NOT_NULL if c in _PRESENT]


def _rows(category: str, checks: list[tuple], severity: str) -> str:
    return result_sql(category, checks, severity)


SCHEMA_SQL = _rows(
    "schema", [(f"column_exists_{c}", c, str(int(c in _PRESENT)), 1, None) for c in cfg.CHECK_REQUIRED], S["required_columns"]
)
NOT_NULL_SQL = _rows("null_values", [(f"not_null_{c}", c, null_share(c), None, 0.0) for c in NOT_NULL], S["non_null_columns"])
NULLABLE_SQL = _rows(
    "null_values", [(f"nullable_{c}", c, null_share(c), None, v) for c, v in cfg.CHECK_NULLABLE.items()], S["nullable_columns"]
)
RANGE_SQL = " UNION ALL ".join(
    _rows(
        "numeric_ranges", [(f"range_{c}", c, inside(c, lo, hi), 1.0 if strict else cfg.RANGE_TOLERANCE, None)],
        S["numeric_ranges_strict" if strict else "numeric_ranges_non_strict"],
    )
    for c, (lo, hi, strict) in cfg.CHECK_RANGES.items()
)
SET_SQL = _rows(
    "categorical",
    [
        (f"categorical_{c}", c, one(f"avg(CASE WHEN {c} IN (0, 1) THEN CAST(1 AS DOUBLE) ELSE 0 END)", f"WHERE {c} IS NOT NULL"), 1.0, None)
        for c in cfg.CHECK_SETS
        if c in _PRESENT
    ],
    S["categorical_values"],
)
_NORMAL, _ANOM = "WHERE lab_anom = 0", "WHERE lab_anom = 1"
SEPARATION = ("anomaly_sinr_separation", "sinr_db", f"{one('avg(sinr_db)', _NORMAL)} - {one('avg(sinr_db)', _ANOM)}", 10, None)
LOW_RATE = (
    "anomaly_sinr_low_rate", "sinr_db", one("avg(CASE WHEN sinr_db < 15 THEN CAST(1 AS DOUBLE) ELSE 0 END)", _ANOM), 0.6, None
)
DROP = (
    "anomaly_throughput_drop", "app_dl_mbps",
    f"({one('avg(app_dl_mbps)', _NORMAL)} - {one('avg(app_dl_mbps)', _ANOM)}) / {one('avg(app_dl_mbps)', _NORMAL)}", 0.3, None,
)
SIGNATURE_SQL = _rows("anomaly_signatures", [SEPARATION, LOW_RATE, DROP], S["anomaly_signatures"])
Q = cfg.QUALITY_LIMITS
SAMPLES = ("sufficient_samples", "*", one("count(*)"), Q["min_samples"], None)
RATE = (
    "anomaly_rate_reasonable", "lab_anom", one("sum(lab_anom) / CAST(count(*) AS DOUBLE)"),
    Q["min_anomaly_rate"], Q["max_anomaly_rate"],
)
NULLS = (
    "low_overall_nulls", "*",
    one("(" + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in CHECKED) + f") / (CAST(count(*) AS DOUBLE) * {len(CHECKED)})"),
    None, Q["max_null_share"],
)
_DISTINCT = f"SELECT DISTINCT {', '.join(CHECKED)} FROM tele"
DUPLICATES = (
    "low_duplicates", "*",
    f"(SELECT (t.n - d.n) / CAST(t.n AS DOUBLE) FROM (SELECT count(*) AS n FROM tele) t, (SELECT count(*) AS n FROM ({_DISTINCT}) x) d)",
    None, Q["max_duplicate_rows"],
)
QUALITY_SQL = _rows("data_quality", [SAMPLES, RATE, NULLS], S["quality_thresholds"])
DUPLICATE_SQL = _rows("data_quality", [DUPLICATES], S["quality_thresholds"])


def _member(name: str) -> str:
    return f"WHERE lower(scenario_id) LIKE '%{name.lower().replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}'"


SCENARIO_SAMPLES = [
    (f"scenario_{n}_samples", "scenario_id", one("count(*)", _member(n)), least, None) for n, (least, _, _) in cfg.SCENARIO_RULES.items()
]
SCENARIO_RATES = [
    (f"scenario_{n}_anomaly_rate", "lab_anom", one("sum(lab_anom) / CAST(count(*) AS DOUBLE)", _member(n)), lo, hi)
    for n, (_, lo, hi) in cfg.SCENARIO_RULES.items()
]
SCENARIO_SQL = _rows("scenario_specific", [*SCENARIO_SAMPLES, *SCENARIO_RATES], S["scenario_rules"])
ALL_SQL = " UNION ALL ".join(
    [SCHEMA_SQL, NOT_NULL_SQL, NULLABLE_SQL, RANGE_SQL, SET_SQL, SIGNATURE_SQL, QUALITY_SQL, SCENARIO_SQL, DUPLICATE_SQL]
)


def _rule_query(name: str, sql: str, pick) -> None:
    @query(name, asked(q.TELE, sql, RESULT_DOUBLES, RESULT_OTHERS))
    def _(spark, folder):
        table = samples(spark, folder)
        return rounded(rules.evaluate(table, pick(table.columns)))


def _named(builder, *names):
    return lambda columns: [r for r in builder(columns) if r.check in names]


_rule_query("v1_required_columns", SCHEMA_SQL, rules.required_columns)
_rule_query("v2_not_null", NOT_NULL_SQL, rules.not_null)
_rule_query("v3_nullable", NULLABLE_SQL, rules.nullable)
_rule_query("v4_ranges", RANGE_SQL, rules.in_range)
_rule_query("v5_value_sets", SET_SQL, rules.in_set)
_rule_query("v6_sinr_separation", _rows("anomaly_signatures", [SEPARATION], S["anomaly_signatures"]), _named(rules.signatures, SEPARATION[0]))
_rule_query("v7_sinr_low_rate", _rows("anomaly_signatures", [LOW_RATE], S["anomaly_signatures"]), _named(rules.signatures, LOW_RATE[0]))
_rule_query("v8_throughput_drop", _rows("anomaly_signatures", [DROP], S["anomaly_signatures"]), _named(rules.signatures, DROP[0]))
_rule_query("v9_sample_count", _rows("data_quality", [SAMPLES], S["quality_thresholds"]), _named(rules.quality, SAMPLES[0]))
_rule_query("v11_anomaly_rate", _rows("data_quality", [RATE], S["quality_thresholds"]), _named(rules.quality, RATE[0]))
_rule_query("v12_null_share", _rows("data_quality", [NULLS], S["quality_thresholds"]), _named(rules.quality, NULLS[0]))
_rule_query(
    "v13_scenario_samples", _rows("scenario_specific", SCENARIO_SAMPLES, S["scenario_rules"]),
    _named(rules.scenario_rules, *[c[0] for c in SCENARIO_SAMPLES]),
)
_rule_query(
    "v14_scenario_rates", _rows("scenario_specific", SCENARIO_RATES, S["scenario_rules"]),
    _named(rules.scenario_rules, *[c[0] for c in SCENARIO_RATES]),
)
_rule_query(
    "v18_signature_ranges",
    _rows(
        "signature_ranges",
        [(n, m, inside(m, lo, hi, f"lab_anom = {v}"), cfg.RANGE_TOLERANCE, None) for n, (m, v, lo, hi) in cfg.SIGNATURE_RANGES.items()],
        S["anomaly_signatures"],
    ),
    rules.signature_ranges,
)


@query("v10_duplicate_share", asked(q.TELE, DUPLICATE_SQL, RESULT_DOUBLES, RESULT_OTHERS))
def _(spark, folder):
    return rounded(rules.duplicate_rule(samples(spark, folder)))


@query(
    "v10_duplicate_share_lineitem",
    asked(
        "",
        result_sql(
            "data_quality",
            [(
                "low_duplicates", "*",
                "(SELECT (t.n - d.n) / CAST(t.n AS DOUBLE) FROM (SELECT count(*) AS n FROM lineitem) t, "
                "(SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) x) d)",
                None, Q["max_duplicate_rows"],
            )],
            S["quality_thresholds"],
        ),
        RESULT_DOUBLES, RESULT_OTHERS,
    ),
)
def _(spark, folder):
    return rounded(rules.duplicate_rule(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")))


@query("v21_all_checks", asked(q.TELE, ALL_SQL, RESULT_DOUBLES, RESULT_OTHERS))
def _(spark, folder):
    return rounded(rules.check_table(samples(spark, folder)))


@query(
    "v16_verdict",
    asked(
        f"{q.TELE}, checks AS ({ALL_SQL}), per AS (SELECT category, count(*) AS total, count(*) FILTER (success) AS passed FROM checks GROUP BY 1)",
        "SELECT category, total, passed, total - passed AS failed, CAST(passed AS DOUBLE) / total AS pass_rate, total = passed AS success "
        "FROM (SELECT * FROM per UNION ALL SELECT 'overall', CAST(sum(total) AS BIGINT), CAST(sum(passed) AS BIGINT) FROM per) x",
        ["pass_rate"], ["category", "total", "passed", "failed", "success"],
    ),
)
def _(spark, folder):
    return rounded(rules.verdict(rules.check_table(samples(spark, folder))))


@query(
    "v17_failures",
    asked(f"{q.TELE}, checks AS ({ALL_SQL})", "SELECT * FROM checks WHERE NOT success", RESULT_DOUBLES, RESULT_OTHERS),
)
def _(spark, folder):
    return rounded(rules.failures(rules.check_table(samples(spark, folder))))


@query(
    "v19_severity",
    f"WITH {q.TELE}, checks AS ({ALL_SQL}) SELECT severity, count(*) AS total, count(*) FILTER (success) AS passed FROM checks GROUP BY severity",
)
def _(spark, folder):
    graded = rules.with_severity(rules.check_table(samples(spark, folder)).drop("severity"))
    return graded.groupBy("severity").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("passed"))


_CL = cfg.CURATION_LIMITS


@query(
    "v20_curation_limits",
    asked(
        f"{q.CLEAN}, summary AS ({SUMMARY_SQL})",
        result_sql(
            "curation",
            [
                ("null_pct", "null_pct", "(SELECT null_pct FROM summary)", None, _CL["max_null_pct"]),
                ("clipped_pct", "clipped_pct", "(SELECT clipped_pct FROM summary)", None, _CL["max_clipped_pct"]),
                ("duplicate_pct", "duplicate_pct", "(SELECT duplicate_pct FROM summary)", None, _CL["max_duplicate_pct"]),
                ("output_rows", "output_rows", "(SELECT output_rows FROM summary)", _CL["min_output_rows"], None),
            ],
        ),
        RESULT_DOUBLES, RESULT_OTHERS,
    ),
)
def _(spark, folder):
    return rounded(rules.evaluate(summary(spark, folder), rules.curation_rules()))


_ML = cfg.MATRIX_LIMITS
_NF = cfg.NUMERIC_FEATURES


@query(
    "v22_matrix_checks",
    asked(
        q.WIN,
        result_sql(
            "matrix",
            [
                ("min_samples", "*", "(SELECT count(*) FROM feat)", _ML["min_samples"], None),
                (
                    "missing_ratio", "*",
                    "(SELECT (" + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _NF) + f") / (CAST(count(*) AS DOUBLE) * {len(_NF)}) FROM feat)",
                    None, _ML["max_missing_ratio"],
                ),
                (
                    "infinite_values", "*",
                    "(SELECT " + " + ".join(f"count(*) FILTER (isinf(CAST({c} AS DOUBLE)))" for c in _NF) + " FROM feat)", None, 0,
                ),
                ("dtype_sinr_mean", "sinr_mean", "1", 1, None),
                ("dtype_weak_label", "weak_label", "1", 1, None),
                ("dtype_ts_start_ns", "ts_start_ns", "1", 1, None),
            ],
        ),
        RESULT_DOUBLES, RESULT_OTHERS,
    ),
)
def _(spark, folder):
    table = feature_rows(spark, folder)
    declared = {"sinr_mean": "double", "weak_label": "int", "ts_start_ns": "bigint"}
    return rounded(rules.evaluate(table, [*rules.matrix_rules(_NF), *rules.dtype_rules(table, declared)]))


# --- profiles ----------------------------------------------------------------


def _stat(name: str, expression: str) -> str:
    return f"SELECT '{name}' AS stat, CAST({expression} AS DOUBLE) AS value FROM tele"


def _five(c: str) -> list[str]:
    return [
        _stat(f"{c}_mean", f"avg({c})"), _stat(f"{c}_std", f"stddev_samp({c})"), _stat(f"{c}_min", f"min({c})"),
        _stat(f"{c}_max", f"max({c})"), _stat(f"{c}_null_pct", f"100.0 * count(*) FILTER ({c} IS NULL) / count(*)"),
    ]


@query(
    "v15_summary_stats",
    asked(
        q.TELE,
        " UNION ALL ".join(
            [
                _stat("total_samples", "count(*)"), _stat("total_columns", f"max({len(CHECKED)})"),
                *[s for c in cfg.CRITICAL_FEATURES for s in _five(c)],
                _stat("anomaly_count", "sum(lab_anom)"), _stat("anomaly_rate", "avg(lab_anom)"),
                _stat("interference_count", "sum(lab_inf)"), _stat("interference_rate", "avg(lab_inf)"),
            ]
        ),
        ["value"], ["stat"],
    ),
)
def _(spark, folder):
    return rounded(profile.summary_stats(samples(spark, folder)))


@query("g1_dataset_size", "SELECT count(*) AS dataset_rows, CAST(12 AS BIGINT) AS dataset_cols, CAST(1 AS BIGINT) AS num_source_files FROM lineitem")
def _(spark, folder):
    from signalsift.sources.tables import read_files

    return profile.dataset_size(read_files(spark, [f"{folder}/lineitem.parquet"]))


_LINE_COLUMNS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    rows = []
    for c, kind in columns.items():
        numeric = kind in ("bigint", "int", "double")

        def stat(f: str, c=c, numeric=numeric) -> str:
            return f"CAST({f}({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"

        rows.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) FILTER ({c} IS NULL) AS nulls, {stat('avg')} AS mean, "
            f"{stat('stddev_samp')} AS std, {stat('min')} AS min, {stat('max')} AS max, "
            f"100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS null_pct FROM {table}"
        )
    return " UNION ALL ".join(rows)


_PROFILE = (["mean", "std", "min", "max", "null_pct"], ['"column"', "dtype", "nulls"])


@query("g2_profile_lineitem", asked("", _profile_sql("lineitem", _LINE_COLUMNS), *_PROFILE, 4))
def _(spark, folder):
    return rounded(profile.column_profile(load(spark, folder, "lineitem")), 4)


_ORDER_COLUMNS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


@query("g2_profile_orders", asked("", _profile_sql("orders", _ORDER_COLUMNS), *_PROFILE, 4))
def _(spark, folder):
    return rounded(profile.column_profile(load(spark, folder, "orders")), 4)


def _histogram_sql(source: str, columns: list[str], bins: int) -> str:
    parts = []
    for c in columns:
        parts.append(f"""
SELECT '{c}' AS "column", CAST(b.i AS INTEGER) AS bin, r.low + (r.high - r.low) / {bins} * b.i AS bin_low,
  r.low + (r.high - r.low) / {bins} * (b.i + 1) AS bin_high,
  (SELECT count(*) FROM {source} t WHERE t.{c} IS NOT NULL
     AND least(CAST(floor((t.{c} - r.low) / (r.high - r.low) * {bins}) AS INTEGER), {bins - 1}) = b.i) AS n, r.mean
FROM (SELECT CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, avg({c}) AS mean FROM {source}) r, range({bins}) b(i)""")
    return " UNION ALL ".join(parts)


_HIST = (["bin_low", "bin_high", "mean"], ['"column"', "bin", "n"])


@query("g3_histogram", asked(q.TELE, _histogram_sql("tele", list(cfg.CRITICAL_FEATURES), 50), *_HIST))
def _(spark, folder):
    return rounded(profile.histogram(telemetry_events(spark, folder), list(cfg.CRITICAL_FEATURES), 50))


@query("g3_histogram_windows", asked(q.WIN, _histogram_sql("win", ["sinr_mean", "sinr_std", "app_dl_mean", "gap_ratio_x"], 50).replace("gap_ratio_x", "d_sinr_mean"), *_HIST))
def _(spark, folder):
    return rounded(profile.histogram(staged(event_table(spark, folder)), ["sinr_mean", "sinr_std", "app_dl_mean", "d_sinr_mean"], 50))


_BOX = list(cfg.CRITICAL_FEATURES)


def _box_sql() -> str:
    rows = []
    for c in _BOX:
        for v in (0, 1):
            rows.append(f"""
SELECT '{c}' AS "column", CAST({v} AS INTEGER) AS label, (SELECT count({c}) FROM tele WHERE lab_anom = {v}) AS n,
  (SELECT min({c}) FROM tele WHERE lab_anom = {v} AND {c} >= q1 - 1.5 * (q3 - q1)) AS whisker_low, q1, median, q3,
  (SELECT max({c}) FROM tele WHERE lab_anom = {v} AND {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM tele WHERE lab_anom = {v}) x""")
    return " UNION ALL ".join(rows)


@query(
    "g4_box_stats",
    asked(q.TELE, _box_sql(), ["whisker_low", "q1", "median", "q3", "whisker_high"], ['"column"', "label", "n"]),
)
def _(spark, folder):
    return rounded(profile.box_stats(telemetry_events(spark, folder), _BOX))


_PAIRS = [(a, b) for a, b in combinations_with_replacement(cfg.CRITICAL_FEATURES, 2)]


@query(
    "g5_correlations",
    asked(
        q.TELE,
        " UNION ALL ".join(
            f"SELECT '{x}' AS a, '{y}' AS b, corr({a}, {b}) AS r FROM tele"
            for a, b in _PAIRS
            for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])
        ),
        ["r"], ["a", "b"],
    ),
)
def _(spark, folder):
    return rounded(profile.correlations(telemetry_events(spark, folder)))


_LINE_NUMBERS = [c for c, kind in _LINE_COLUMNS.items() if kind in ("bigint", "int", "double")]


@query(
    "a10_correlation_lineitem",
    asked("", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a in _LINE_NUMBERS for b in _LINE_NUMBERS), ["r"], ["a", "b"]),
)
def _(spark, folder):
    """The whole matrix of all numeric columns."""
    return rounded(profile.correlations(load(spark, folder, "lineitem"), _LINE_NUMBERS))


@query("g6_series_sample", asked(q.TELE, "SELECT row_id, ts_ns, sinr_db, rsrp_dbm FROM tele ORDER BY ts_ns, row_id LIMIT 1000", ["sinr_db", "rsrp_dbm"], ["row_id", "ts_ns"]))
def _(spark, folder):
    t = telemetry_events(spark, folder).select("row_id", "ts_ns", "sinr_db", "rsrp_dbm")
    return rounded(profile.first_rows(t, ["ts_ns", "row_id"]))


@query(
    "g7_window_series",
    asked(
        q.WIN,
        "SELECT scenario_id, (ts_start_ns - (SELECT min(ts_start_ns) FROM win0)) / 1e9 AS seconds, sinr_mean AS value, "
        "sinr_mean - sinr_std AS low, sinr_mean + sinr_std AS high FROM win0",
        ["seconds", "value", "low", "high"], ["scenario_id"],
    ),
)
def _(spark, folder):
    return rounded(profile.window_series(staged(event_counts(spark, folder))))


_QUART = ["prb_dl", "app_dl_mbps"]


@query(
    "a6_quartiles",
    asked(
        q.TELE,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS n, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, max({c}) AS max FROM tele"
            for c in _QUART
        ),
        ["std", "min", "q1", "median", "q3", "max"], ['"column"', "n"],
    ),
)
def _(spark, folder):
    return rounded(profile.quartiles(telemetry_events(spark, folder), _QUART))


@query(
    "a6_median_by_search",
    asked(
        "",
        "SELECT quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem",
        ["median", "p90"],
    ),
)
def _(spark, folder):
    """The way of very long columns: running totals of the values are cut into slices."""
    from signalsift.operators.quantiles import exact_quantiles

    lines = load(spark, folder, "lineitem")
    found = exact_quantiles(lines, ["l_extendedprice"], (0.5, 0.9), rows_per_slice=200)["l_extendedprice"]
    return rounded(lines.agg(*[F.max(F.lit(v)).alias(n) for v, n in zip(found, ("median", "p90"))]))


@query("a7_distinct_scenarios", f"WITH {q.TELE} SELECT count(DISTINCT scenario_id) AS distinct_values FROM tele")
def _(spark, folder):
    return profile.scenario_count(telemetry_events(spark, folder))


_KEPT_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
_PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.99)


def _monthly(spark, folder):
    """Line items with their month, and their sketches per month, stored in two steps as months arrive."""
    lines = load(spark, folder, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    path = scratch(spark, "sketches")
    sketches.sketched(lines.where("l_shipdate < '1995-07-01'"), "month", _KEPT_COLUMNS).write.parquet(path)
    arrived = sketches.new_parts(lines, "month", spark.read.parquet(path))
    sketches.sketched(arrived, "month", _KEPT_COLUMNS).write.mode("append").parquet(path)
    return lines, spark.read.parquet(path)


@query(
    "a7_merged_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT date_trunc('month', l_shipdate)) AS parts, count({c}) AS n,
  count(*) - count({c}) AS nulls, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, true AS distinct_near FROM lineitem"""
        for c in _KEPT_COLUMNS
    ),
)
def _(spark, folder):
    """The profile merged from monthly sketches; whether its distinct counts keep the promised error, by exact counts."""
    lines, stored = _monthly(spark, folder)
    parts = stored.groupBy("column").agg(F.count("*").alias("parts"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in _KEPT_COLUMNS])
    exact = lines.select(F.inline(cells)).groupBy("column").agg(F.count_distinct("v").alias("exact"))
    found = sketches.merged_profile(stored).join(parts, "column").join(exact, "column")
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= F.col("exact") * sketches.DISTINCT_ERROR
    return found.select("column", "parts", "n", "nulls", "low", "high", near.alias("distinct_near"))


@query(
    "n2_sketched_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS probability, count({c}) AS n, true AS rank_near FROM lineitem"
        for c in _KEPT_COLUMNS
        for p in _PROBABILITIES
    ),
)
def _(spark, folder):
    """Quantiles merged from monthly sketches; whether their exact ranks keep the promised error."""
    lines, stored = _monthly(spark, folder)
    told = sketches.merged_profile(stored, _PROBABILITIES).select(
        "column", F.posexplode(F.arrays_zip(F.array(*map(F.lit, _PROBABILITIES)).alias("probability"), F.col("quantiles").alias("q")))
    )
    told = told.select("column", F.col("col.probability").alias("probability"), F.col("col.q").alias("q"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in _KEPT_COLUMNS])
    # A column has a few quantiles, so this join is over a list of a row for each column and probability.
    met = lines.select(F.inline(cells)).where("v is not null").join(F.broadcast(told), "column").groupBy("column", "probability")
    ranks = met.agg(F.count("v").alias("n"), F.count_if(F.col("v") < F.col("q")).alias("below"), F.count_if(F.col("v") <= F.col("q")).alias("upto"))
    low, high = (F.col("probability") + F.lit(e * sketches.RANK_ERROR) for e in (-1, 1))
    near = (F.col("below") <= high * F.col("n")) & (F.col("upto") >= low * F.col("n"))
    return ranks.select("column", "probability", "n", near.alias("rank_near"))


@query(
    "a8_value_counts",
    asked(q.TELE, "SELECT scenario_id, count(*) AS n, count(*) / CAST((SELECT count(*) FROM tele) AS DOUBLE) AS share FROM tele GROUP BY 1", ["share"], ["scenario_id", "n"]),
)
def _(spark, folder):
    return rounded(profile.value_counts(telemetry_events(spark, folder), "scenario_id"))


@query(
    "a8_label_counts",
    asked("", "SELECT toxic, count(*) AS n, count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE) AS share FROM labels GROUP BY 1", ["share"], ["toxic", "n"]),
)
def _(spark, folder):
    return rounded(profile.value_counts(load(spark, folder, "labels"), "toxic"))


@query(
    "a9_conditional_rate",
    asked(q.TELE, "SELECT scenario_id, avg(CASE WHEN sinr_db < 15 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS low_sinr_rate FROM tele GROUP BY 1", ["low_sinr_rate"], ["scenario_id"]),
)
def _(spark, folder):
    rate = F.count_if(F.col("sinr_db") < 15) / F.count(F.lit(1))
    return rounded(telemetry_events(spark, folder).groupBy("scenario_id").agg(rate.alias("low_sinr_rate")))


@query("a11_group_minimum", f"WITH {q.TELE} SELECT row_id, ts_ns, min(ts_ns) OVER (PARTITION BY scenario_id) AS first_ns FROM tele")
def _(spark, folder):
    t = telemetry_events(spark, folder).select("row_id", "scenario_id", "ts_ns")
    return profile.group_minimum(t, "scenario_id", "ts_ns", "first_ns").drop("scenario_id")


# --- joins, stacking, order --------------------------------------------------


@query(
    "j1_key_join",
    asked(q.WIN, "SELECT scenario_id, ts_start_ns, sinr_mean, weak_label FROM win", ["sinr_mean"], ["scenario_id", "ts_start_ns", "weak_label"]),
)
def _(spark, folder):
    made = staged(event_counts(spark, folder))
    keys = list(combine.WINDOW_KEY)
    return rounded(combine.join_by_key(made.select(*keys, "sinr_mean"), made.select(*keys, "weak_label")))


@query("j1_customer_orders", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def _(spark, folder):
    orders = load(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = combine.join_by_key(load(spark, folder, "customer"), orders, ["c_custkey"])
    return joined.select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "j1_repeated_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, folder):
    return combine.repeated_keys(load(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "u1_stack_by_name",
    asked(
        f"{q.TELE}, {q.LINE}",
        "SELECT scenario_id, sinr_db, row_id, NULL AS l_orderkey FROM tele UNION ALL SELECT scenario_id, sinr_db, NULL, l_orderkey FROM line",
        ["sinr_db"], ["scenario_id", "row_id", "l_orderkey"],
    ),
)
def _(spark, folder):
    a = telemetry_events(spark, folder).select("row_id", "sinr_db", "scenario_id")
    b = telemetry_lineitem(spark, folder).select("scenario_id", "l_orderkey", "sinr_db")
    return rounded(combine.stack([a, b]))


@query("r1_sort", asked(q.WIN, "SELECT scenario_id, ts_start_ns, sinr_mean FROM win0", ["sinr_mean"], ["scenario_id", "ts_start_ns"]))
def _(spark, folder):
    made = event_counts(spark, folder).select("scenario_id", "ts_start_ns", "sinr_mean")
    return rounded(combine.sort_in_files(made, ["scenario_id", "ts_start_ns"]))


@query("r2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return combine.top(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 20)


@query(
    "r3_best_row",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) x WHERE place = 1",
)
def _(spark, folder):
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return combine.best_row(orders, ["o_custkey"], "o_totalprice", "o_orderkey")
