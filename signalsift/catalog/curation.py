"""Queries about sources, names, types, cleaning (S, P, F, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsift.catalog import sql as q
from signalsift.catalog.registry import asked, query, rounded, scratch
from signalsift.config import telemetry as cfg
from signalsift.operators import clean, schema
from signalsift.plans import curate as plan
from signalsift.plans import report
from signalsift.plans.surrogate import EVENT_ORDER, load, telemetry_events, telemetry_lineitem, telemetry_raw
from signalsift.session import staged
from signalsift.sources import sinks, tables

RADIO = ["rsrp_dbm", "rsrq_db", "sinr_db", "prb_dl", "prb_ul", "app_dl_mbps", "app_ul_mbps"]
INTS = ["pci", "mcs_dl", "mcs_ul"]


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw view with its row number as a number, the tie-breaker of the order."""
    return telemetry_raw(spark, folder).withColumn("row_id", F.col("row_id").cast("long"))


def typed(spark: SparkSession, folder: str) -> DataFrame:
    return plan.typed_samples(raw(spark, folder))


def complete(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_incomplete(clean.clip_ranges(typed(spark, folder)))


# --- sources and sinks -------------------------------------------------------


@query(
    "s1_csv_scan",
    asked(
        q.RAW,
        """SELECT count(*) AS rows, count("RSRP") AS rsrp_values, count("SINR") AS sinr_values,
             sum(TRY_CAST("PDSCH PRBs" AS DOUBLE)) AS prb_sum, min("Time") AS first_time FROM raw""",
        ["prb_sum"], ["rows", "rsrp_values", "sinr_values", "first_time"], 3,
    ),
)
def _(spark, folder):
    path = sinks.write_csv(telemetry_raw(spark, folder), scratch(spark, "csv"))
    read = tables.read_csv(spark, path, "source_file")
    return rounded(
        read.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("RSRP").alias("rsrp_values"),
            F.count("SINR").alias("sinr_values"),
            F.sum(F.col("`PDSCH PRBs`").try_cast("double")).alias("prb_sum"),
            F.min("Time").alias("first_time"),
        ),
        3,
    )


_BROKEN = "CASE WHEN o_orderkey % 5 = 0 THEN 'long' WHEN o_orderkey % 7 = 0 THEN 'short' ELSE 'whole' END"


@query(
    "s1_quarantine",
    f"""WITH made AS (SELECT o_orderkey, o_custkey, {_BROKEN} AS kind FROM orders)
    SELECT CASE kind WHEN 'long' THEN 'too many fields' ELSE 'kept' END AS reason, count(*) AS n,
      count(CASE WHEN kind = 'whole' THEN o_custkey END) AS with_customer, CAST(sum(o_orderkey) AS BIGINT) AS keys
    FROM made GROUP BY 1""",
)
def _(spark, folder):
    """A folder whose records have one field too many, one too few or all: kept and rejected ones are all of them."""
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("c"))
    key = F.col("k").cast("long")
    line = F.when(key % 5 == 0, F.concat_ws(",", "k", "c", F.lit("x"))).when(key % 7 == 0, F.col("k")).otherwise(F.concat_ws(",", "k", "c"))
    path = scratch(spark, "broken")
    # Every file starts with its header line.
    orders.select(line.alias("o_orderkey,o_custkey")).write.option("header", True).option("sep", "\u0001").csv(path)
    kept = tables.read_csv(spark, path, "source_file").select(F.lit("kept").alias("reason"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    bad = tables.rejected_rows(spark, path)
    bad = spark.read.schema(bad.schema).json(sinks.write_report(bad, scratch(spark, "rejected")))
    bad = bad.select("reason", F.split_part("record", F.lit(","), F.lit(1)).alias("k"), F.lit(None).cast("string").alias("c"))
    return kept.unionByName(bad).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.count("c").alias("with_customer"), F.sum(F.col("k").cast("long")).alias("keys")
    )


@query(
    "s2_format_scan",
    "SELECT 'customer' AS source_file, count(*) AS rows FROM customer UNION ALL "
    "SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier",
)
def _(spark, folder):
    files = [f"{folder}/{t}.parquet" for t in ("customer", "orders", "supplier")]
    return tables.read_files(spark, files).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s3_sample_stats",
    asked(
        q.TELE,
        "SELECT count(*) AS input_rows, count(DISTINCT scenario_id) AS input_scenarios, "
        "min(ts_ns) AS ts_min, max(ts_ns) AS ts_max FROM tele",
        [], ["input_rows", "input_scenarios", "ts_min", "ts_max"],
    ),
)
def _(spark, folder):
    samples = schema.require_columns(
        telemetry_events(spark, folder), ("ts_ns", "scenario_id", "sinr_db", "rsrp_dbm")
    )
    return tables.sample_stats(samples)


@query(
    "s4_window_table_stats",
    asked(
        q.WIN,
        f"SELECT count(*) AS n_windows, CAST({len(cfg.WINDOW_COLUMNS)} AS BIGINT) AS n_columns, "
        "count(DISTINCT scenario_id) AS n_scenarios FROM win",
        [], ["n_windows", "n_columns", "n_scenarios"],
    ),
)
def _(spark, folder):
    windows = plan.windowed(telemetry_events(spark, folder), EVENT_ORDER)
    return tables.window_table_stats(schema.in_order(windows, cfg.WINDOW_COLUMNS))


@query(
    "s6_parquet_sink",
    asked(
        q.TELE,
        "SELECT scenario_id, count(*) AS rows, sum(sinr_db) AS sinr_sum, min(ts_ns) AS ts_min FROM tele GROUP BY 1",
        ["sinr_sum"], ["scenario_id", "rows", "ts_min"], 3,
    ),
)
def _(spark, folder):
    samples = telemetry_events(spark, folder)
    path = sinks.write_parquet(samples, scratch(spark, "samples"), cfg.CLEAN_COLUMNS, sort_by=["ts_ns"])
    return rounded(
        spark.read.parquet(path)
        .groupBy("scenario_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("sinr_db").alias("sinr_sum"), F.min("ts_ns").alias("ts_min")),
        3,
    )


@query(
    "s8_json_report",
    asked(
        q.TELE,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < {lo}) AS below_min, "
            f"count(*) FILTER ({c} > {hi}) AS above_max FROM tele"
            for c, (lo, hi) in cfg.CLIP_BOUNDS.items()
        ),
        [], ['"column"', "below_min", "above_max"],
    ),
)
def _(spark, folder):
    stats = clean.clipping_stats(telemetry_events(spark, folder)).select("column", "below_min", "above_max")
    path = sinks.write_report(stats, scratch(spark, "report"))
    return spark.read.schema(stats.schema).json(path)


SUMMARY_INTS = [
    "input_rows", "input_columns", "output_rows", "output_columns", "rows_dropped_nulls",
    "rows_dropped_duplicates", "values_clipped", "values_imputed",
]
SUMMARY_PCTS = ["null_pct", "clipped_pct", "duplicate_pct"]


def summary(spark: SparkSession, folder: str) -> DataFrame:
    source = raw(spark, folder)
    before = staged(plan.typed_samples(source), "typed")
    kept = clean.drop_incomplete(clean.clip_ranges(before))
    filled = staged(clean.impute(kept, ["ts_ns", "row_id"]), "filled")
    done = schema.in_order(clean.drop_duplicates(filled))
    return report.curation_summary(source, before, filled, done)


_OUTSIDE = " + ".join(
    f"count(*) FILTER ({c} < {lo} OR {c} > {hi})" for c, (lo, hi) in cfg.CLIP_BOUNDS.items()
)
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in cfg.CRITICAL)
_MISSING = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cfg.IMPUTE)
_NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cfg.CLEAN_COLUMNS)
SUMMARY_SQL = f"""
SELECT b.n AS input_rows, CAST(15 AS BIGINT) AS input_columns, o.n AS output_rows,
  CAST({len(cfg.CLEAN_COLUMNS)} AS BIGINT) AS output_columns,
  b.n - c.n AS rows_dropped_nulls, c.n - o.n AS rows_dropped_duplicates,
  b.clipped AS values_clipped, c.missing - l.missing AS values_imputed,
  100.0 * o.nulls / (o.n * {len(cfg.CLEAN_COLUMNS)}) AS null_pct,
  100.0 * b.clipped / (b.n * {len(cfg.CLIP_BOUNDS)}) AS clipped_pct,
  100.0 * (c.n - o.n) / c.n AS duplicate_pct
FROM (SELECT count(*) AS n, {_OUTSIDE} AS clipped FROM typed) b,
  (SELECT count(*) AS n, {_MISSING} AS missing FROM complete) c,
  (SELECT {_MISSING} AS missing FROM filled) l,
  (SELECT count(*) AS n, {_NULLS} AS nulls FROM clean) o"""


@query("n8_curation_summary", asked(q.CLEAN, SUMMARY_SQL, SUMMARY_PCTS, SUMMARY_INTS))
def _(spark, folder):
    return rounded(summary(spark, folder))


@query(
    "s11_run_log",
    asked(
        f"{q.CLEAN}, summary AS ({SUMMARY_SQL})",
        " UNION ALL ".join(
            f"SELECT 'run' AS run_id, 'curate' AS stage, '{c}' AS key, CAST({c} AS DOUBLE) AS value FROM summary"
            for c in [*SUMMARY_INTS, *SUMMARY_PCTS]
        ),
        ["value"], ["run_id", "stage", "key"],
    ),
)
def _(spark, folder):
    return rounded(report.run_log("curate", summary(spark, folder), "run"))


# --- names and types ---------------------------------------------------------

_NAMED = {
    "Time": "time_s", "PCI": "pci", "RSRP": "rsrp_dbm", "SS_RSRQ_dB": "rsrq_db", "SINR": "sinr_db",
    "lab_anom": "lab_anom", "lab_inf": "lab_inf",
}


@query(
    "p1_standard_names",
    f"WITH {q.RAW} SELECT row_id, scenario_id, "
    + ", ".join(f'count("{a}") AS {b}' for a, b in _NAMED.items())
    + ' FROM raw GROUP BY row_id, scenario_id',
)
def _(spark, folder):
    named = schema.standardize_names(telemetry_raw(spark, folder))
    return named.groupBy("row_id", "scenario_id").agg(*[F.count(b).alias(b) for b in _NAMED.values()])


@query(
    "p1_aliases_coalesced",
    f"""WITH {q.TELE} SELECT row_id, round(coalesce(sinr_db, prb_dl), 6) AS sinr_db FROM tele""",
)
def _(spark, folder):
    t = telemetry_events(spark, folder)
    both = t.select("row_id", F.col("sinr_db").alias("SS_SINR_dB"), F.col("prb_dl").alias("SINR"))
    return rounded(schema.standardize_names(both))


@query(
    "p2_optional_defaults",
    f"WITH {q.TELE} SELECT scenario_id, count(*) AS rows, CAST(0 AS BIGINT) AS lab_bs, "
    "CAST(0 AS BIGINT) AS lab_1rr, CAST(0 AS BIGINT) AS nr_arfcn FROM tele GROUP BY scenario_id",
)
def _(spark, folder):
    full = schema.add_defaults(telemetry_events(spark, folder))
    sums = [F.sum(c).alias(c) for c in ("lab_bs", "lab_1rr", "nr_arfcn")]
    return full.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("rows"), *sums)


@query(
    "p4_numeric_coercion",
    f"WITH {q.RAW} SELECT row_id, round({q.number(chr(34) + 'RSRP' + chr(34))}, 6) AS rsrp_dbm, "
    f"round({q.number(chr(34) + 'SINR' + chr(34))}, 6) AS sinr_db, "
    f"round({q.number(chr(34) + 'PDSCH_MCS' + chr(34))}, 6) AS mcs_dl FROM raw",
)
def _(spark, folder):
    named = schema.standardize_names(telemetry_raw(spark, folder))
    numbers = schema.to_numbers(named, ["rsrp_dbm", "sinr_db", "mcs_dl"])
    return rounded(numbers.select("row_id", "rsrp_dbm", "sinr_db", "mcs_dl"))


_LOSS = {"rsrp_dbm": "RSRP", "rsrq_db": "SS_RSRQ_dB", "sinr_db": "SINR", "prb_dl": "PDSCH PRBs"}


@query(
    "p4_coercion_losses",
    f"WITH {q.RAW} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ("{r}" IS NOT NULL AND TRY_CAST("{r}" AS DOUBLE) IS NULL)
        AS nulls_introduced FROM raw"""
        for c, r in _LOSS.items()
    ),
)
def _(spark, folder):
    return schema.coercion_losses(schema.standardize_names(telemetry_raw(spark, folder)), list(_LOSS))


@query(
    "p5_integer_rounding",
    f"WITH {q.TYPED} SELECT mcs_dl, mcs_ul, count(*) AS n FROM typed GROUP BY mcs_dl, mcs_ul",
)
def _(spark, folder):
    named = schema.standardize_names(telemetry_raw(spark, folder))
    whole = schema.to_integers(schema.to_numbers(named), ["mcs_dl", "mcs_ul"])
    return whole.groupBy("mcs_dl", "mcs_ul").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p6_float_narrowing",
    asked(
        q.TELE, "SELECT row_id, CAST(CAST(rsrp_dbm AS FLOAT) AS DOUBLE) AS rsrp_dbm FROM tele", ["rsrp_dbm"], ["row_id"], 4
    ),
)
def _(spark, folder):
    narrow = schema.to_floats(telemetry_events(spark, folder), ["rsrp_dbm"])
    return rounded(narrow.select("row_id", F.col("rsrp_dbm").cast("double")), 4)


@query(
    "p7_relative_seconds",
    asked(f"{q.TYPED}", "SELECT row_id, scenario_id, time_s0 AS time_s FROM timed", ["time_s"], ["row_id", "scenario_id"]),
)
def _(spark, folder):
    named = schema.standardize_names(telemetry_raw(spark, folder))
    named = schema.relative_seconds(named)
    return rounded(named.select("row_id", "scenario_id", "time_s"))


@query("p8_absolute_time", f"WITH {q.TYPED} SELECT CAST(row_id AS BIGINT) AS row_id, ts_ns FROM typed")
def _(spark, folder):
    return typed(spark, folder).select("row_id", "ts_ns")


@query(
    "p8_time_stats",
    asked(
        q.TYPED,
        "SELECT max(time_s) - min(time_s) AS time_range_s, count(*) AS records, "
        "count(*) / (max(time_s) - min(time_s)) AS sampling_rate_hz, min(ts_ns) AS ts_min, max(ts_ns) AS ts_max FROM typed",
        ["time_range_s", "sampling_rate_hz"], ["records", "ts_min", "ts_max"],
    ),
)
def _(spark, folder):
    return rounded(schema.time_stats(typed(spark, folder)))


_FINAL = ["time_s", "nr_arfcn", "rsrp_dbm", "rsrq_db", "sinr_db", "prb_dl", "prb_ul", "app_dl_mbps"]
_FINAL_INT = [c for c in cfg.CLEAN_COLUMNS if c not in _FINAL]


@query("p9_fixed_order", asked(q.CLEAN, "SELECT * FROM clean", _FINAL, _FINAL_INT))
def _(spark, folder):
    """The whole curation stage: raw text to the clean table."""
    return rounded(plan.curate(raw(spark, folder), ["row_id"]))


_BOUNDED = list(cfg.CLIP_BOUNDS)
_BOUNDED_REAL = [c for c in _BOUNDED if not c.startswith("mcs")]


@query(
    "p11_clip_ranges",
    asked(
        q.TELE, q.clipped("tele", _BOUNDED, ["row_id"]), _BOUNDED_REAL,
        ["row_id", *[f"CAST({c} AS BIGINT) AS {c}" for c in _BOUNDED if c.startswith("mcs")]],
    ),
)
def _(spark, folder):
    return rounded(clean.clip_ranges(telemetry_events(spark, folder)).select("row_id", *_BOUNDED))


def _clip_stats_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < {lo}) AS below_min, count(*) FILTER ({c} > {hi}) AS above_max, "
        f"count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS total_clipped, "
        f"100.0 * count(*) FILTER ({c} < {lo} OR {c} > {hi}) / count(*) AS pct_clipped, "
        f"CAST({lo} AS DOUBLE) AS clip_min, CAST({hi} AS DOUBLE) AS clip_max FROM {table}"
        for c, (lo, hi) in cfg.CLIP_BOUNDS.items()
        if not (table == "line" and c == "app_ul_mbps")
    )


@query(
    "p11_clipping_stats",
    asked(
        q.TELE, _clip_stats_sql("tele"), ["pct_clipped", "clip_min", "clip_max"],
        ['"column"', "below_min", "above_max", "total_clipped"],
    ),
)
def _(spark, folder):
    return rounded(clean.clipping_stats(telemetry_events(spark, folder)))


@query(
    "p11_clipping_stats_lineitem",
    asked(
        q.LINE, _clip_stats_sql("line"), ["pct_clipped", "clip_min", "clip_max"],
        ['"column"', "below_min", "above_max", "total_clipped"],
    ),
)
def _(spark, folder):
    return rounded(clean.clipping_stats(telemetry_lineitem(spark, folder)))


@query(
    "p11_clipped_share",
    asked(
        f"{q.TELE}, stats AS ({_clip_stats_sql('tele')})",
        "SELECT CAST(sum(total_clipped) AS BIGINT) AS values_clipped, count(*) FILTER (total_clipped > 0) AS columns_clipped, "
        f"sum(pct_clipped) / {len(cfg.CLIP_BOUNDS)} AS pct_clipped, "
        f"sum(pct_clipped) / {len(cfg.CLIP_BOUNDS)} > {cfg.CURATION_LIMITS['max_clipped_pct']} AS warning FROM stats",
        ["pct_clipped"], ["values_clipped", "columns_clipped", "warning"],
    ),
)
def _(spark, folder):
    return rounded(clean.clipped_share(clean.clipping_stats(telemetry_events(spark, folder))))


@query(
    "p12_infinite_to_null",
    asked(
        q.TELE,
        "SELECT row_id, CASE WHEN prb_ul = 0 THEN NULL ELSE app_dl_mbps / prb_ul END AS efficiency, "
        "CASE WHEN app_dl_mbps IS NULL THEN NULL WHEN prb_ul = 0 THEN 0 ELSE app_dl_mbps / prb_ul END AS efficiency_zero FROM tele",
        ["efficiency", "efficiency_zero"], ["row_id"],
    ),
)
def _(spark, folder):
    """An unguarded ratio has ±inf and NaN where its denominator is 0."""
    t = telemetry_events(spark, folder)
    odd = F.when(
        F.col("prb_ul") == 0,
        F.when(F.col("app_dl_mbps").isNotNull(), F.when(F.col("app_dl_mbps") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))),
    ).otherwise(F.try_divide("app_dl_mbps", "prb_ul"))
    both = t.select("row_id", odd.alias("efficiency"), odd.alias("efficiency_zero"))
    return rounded(
        clean.replace_infinite(clean.replace_infinite(both, ["efficiency"]), ["efficiency_zero"], 0.0)
    )


# --- filters -----------------------------------------------------------------


@query(
    "f1_drop_incomplete",
    f"WITH {q.TYPED} SELECT CAST(row_id AS BIGINT) AS row_id FROM typed WHERE {_WHOLE}",
)
def _(spark, folder):
    return clean.drop_incomplete(typed(spark, folder)).select("row_id")


@query(
    "f1_null_counts",
    asked(
        q.TYPED,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, "
            f"100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS null_pct FROM typed"
            for c in cfg.CRITICAL
        ),
        ["null_pct"], ['"column"', "nulls"],
    ),
)
def _(spark, folder):
    return rounded(clean.null_counts(typed(spark, folder), cfg.CRITICAL))


@query(
    "f2_label_cohorts",
    asked(
        q.TELE, "SELECT lab_anom, count(*) AS n, avg(sinr_db) AS sinr_mean FROM tele GROUP BY lab_anom",
        ["sinr_mean"], ["lab_anom", "n"],
    ),
)
def _(spark, folder):
    t = telemetry_events(spark, folder)
    sides = [clean.with_label(t, v) for v in (0, 1)]
    return rounded(
        sides[0].unionByName(sides[1]).groupBy("lab_anom").agg(F.count(F.lit(1)).alias("n"), F.avg("sinr_db").alias("sinr_mean"))
    )


@query("f3_scenario_contains", f"WITH {q.TELE} SELECT row_id, scenario_id FROM tele WHERE lower(scenario_id) LIKE '%lvl6_1rru%'")
def _(spark, folder):
    return clean.scenario_contains(telemetry_events(spark, folder), "LVL6_1rru").select("row_id", "scenario_id")


# --- missing values and duplicates -------------------------------------------


@query(
    "n1_global_mode",
    f"WITH {q.TELE}, fill AS ({q.fills('tele')}) SELECT row_id, CAST(coalesce(t.mcs_dl, fill.mcs_dl) AS BIGINT) AS mcs_dl, "
    "CAST(coalesce(t.mcs_ul, fill.mcs_ul) AS BIGINT) AS mcs_ul FROM tele t, fill",
)
def _(spark, folder):
    t = telemetry_events(spark, folder)
    values = clean.fill_values(t, {"mcs_dl": "mode", "mcs_ul": "mode"})
    return clean.fill_constants(t, values).select("row_id", "mcs_dl", "mcs_ul")


@query(
    "n2_global_median",
    asked(
        f"{q.TELE}, fill AS ({q.fills('tele')})",
        "SELECT row_id, coalesce(t.prb_dl, fill.prb_dl) AS prb_dl, coalesce(t.prb_ul, fill.prb_ul) AS prb_ul FROM tele t, fill",
        ["prb_dl", "prb_ul"], ["row_id"],
    ),
)
def _(spark, folder):
    t = telemetry_events(spark, folder)
    values = clean.fill_values(t, {"prb_dl": "median", "prb_ul": "median"})
    return rounded(clean.fill_constants(t, values).select("row_id", "prb_dl", "prb_ul"))


_FORWARD = f"""SELECT row_id, scenario_id, ts_ns, {q.carried('tele', 'app_dl_mbps', 'ts_ns, row_id')} AS app_dl_mbps,
  {q.carried('tele', 'app_ul_mbps', 'ts_ns, row_id')} AS app_ul_mbps FROM tele"""


@query("n3_forward_fill", asked(q.TELE, _FORWARD, ["app_dl_mbps", "app_ul_mbps"], ["row_id", "scenario_id"]))
def _(spark, folder):
    filled = clean.fill_forward(telemetry_events(spark, folder), ["app_dl_mbps", "app_ul_mbps"], EVENT_ORDER)
    return rounded(filled.select("row_id", "scenario_id", "app_dl_mbps", "app_ul_mbps"))


_BACK = """SELECT row_id, coalesce(app_dl_mbps, first_value(app_dl_mbps IGNORE NULLS) OVER back) AS app_dl_mbps,
  coalesce(app_ul_mbps, first_value(app_ul_mbps IGNORE NULLS) OVER back) AS app_ul_mbps FROM fwd
  WINDOW back AS (ORDER BY scenario_id, ts_ns, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query("n4_backward_fill", asked(f"{q.TELE}, fwd AS ({_FORWARD})", _BACK, ["app_dl_mbps", "app_ul_mbps"], ["row_id"]))
def _(spark, folder):
    """Includes a scenario without any uplink value, which borrows the next one's first."""
    t = telemetry_events(spark, folder)
    names = ["app_dl_mbps", "app_ul_mbps"]
    filled = clean.fill_backward(clean.fill_forward(t, names, EVENT_ORDER), names, EVENT_ORDER)
    return rounded(filled.select("row_id", *names))


_NEXT = """SELECT o_custkey, first_value(low IGNORE NULLS) OVER onward AS low, first_value(high IGNORE NULLS) OVER onward AS high FROM (
  SELECT o_custkey, min(CASE WHEN o_custkey % 7 = 0 THEN o_orderkey END) AS low, max(CASE WHEN o_custkey % 101 = 0 THEN o_orderkey END) AS high
  FROM orders GROUP BY 1) c WINDOW onward AS (ORDER BY o_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query("n4_next_known_customers", _NEXT)
def _(spark, folder):
    """The fill between groups with very many groups, most of which have no value of their own."""
    orders = load(spark, folder, "orders")
    low = F.min(F.when(F.col("o_custkey") % 7 == 0, F.col("o_orderkey"))).alias("low")
    high = F.max(F.when(F.col("o_custkey") % 101 == 0, F.col("o_orderkey"))).alias("high")
    return clean.next_known(orders.groupBy("o_custkey").agg(low, high), "o_custkey", ["low", "high"])


@query(
    "n5_imputation_stats",
    asked(
        q.CLEAN,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", (SELECT count(*) FILTER ({c} IS NULL) FROM complete) AS nulls_before, "
            f"(SELECT count(*) FILTER ({c} IS NULL) FROM complete) - (SELECT count(*) FILTER ({c} IS NULL) FROM filled) AS nulls_filled, "
            f"'{how}' AS method, {'CAST(NULL AS DOUBLE)' if how == 'ffill' else f'(SELECT CAST({c} AS DOUBLE) FROM fill)'} AS fill_value, '{clean.REASONS[how]}' AS reason"
            for c, how in cfg.IMPUTE.items()
        ),
        ["fill_value"], ['"column"', "nulls_before", "nulls_filled", "method", "reason"],
    )
    + " WHERE nulls_before > 0",
)
def _(spark, folder):
    before = staged(complete(spark, folder), "complete")
    values = clean.fill_values(before)
    after = clean.impute(before, ["ts_ns", "row_id"], values=values)
    return rounded(clean.imputation_stats(before, after, values))


@query(
    "n6_remaining_nulls",
    asked(
        q.TELE,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, "
            f"100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS null_pct FROM tele"
            for c in [*RADIO, *INTS]
        ),
        ["null_pct"], ['"column"', "nulls"],
    )
    + " WHERE nulls > 0",
)
def _(spark, folder):
    return rounded(clean.remaining_nulls(telemetry_events(spark, folder), [*RADIO, *INTS]))


@query("n7_drop_duplicates", f"WITH {q.RAW} SELECT DISTINCT row_id, scenario_id, \"Time\", \"RSRP\" FROM raw")
def _(spark, folder):
    return clean.drop_duplicates(telemetry_raw(spark, folder)).select("row_id", "scenario_id", "Time", "RSRP")


@query(
    "n7_duplicate_stats",
    asked(
        f"{q.RAW}, d AS (SELECT DISTINCT * FROM raw)",
        "SELECT r.n AS rows, d.n AS distinct_rows, r.n - d.n AS duplicates, 100.0 * (r.n - d.n) / r.n AS duplicate_pct "
        "FROM (SELECT count(*) AS n FROM raw) r, (SELECT count(*) AS n FROM d) d",
        ["duplicate_pct"], ["rows", "distinct_rows", "duplicates"],
    ),
)
def _(spark, folder):
    return rounded(clean.duplicate_stats(telemetry_raw(spark, folder)))


@query(
    "n7_duplicate_keys_lineitem",
    asked(
        "",
        "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates, "
        "100.0 * (sum(n) - count(*)) / sum(n) AS duplicate_pct FROM "
        "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)",
        ["duplicate_pct"], ["rows", "distinct_rows", "duplicates"],
    ),
)
def _(spark, folder):
    return rounded(clean.duplicate_stats(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")))
