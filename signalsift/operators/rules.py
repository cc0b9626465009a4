"""Data-quality rules: many checks, one aggregate.

A rule is an aggregate expression with the bounds its value must keep. All
rules of a table are computed side by side in one scan and turned into rows
(category, check, column, success, observed, expected_min, expected_max,
severity) afterwards; a hundred checks cost one job.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.functions.numeric import ratio

#: Aggregates put into one job; more would outgrow compiled code.
RULES_PER_JOB = 150


@dataclass(frozen=True)
class Rule:
    """``observed`` is an aggregate; NULL means that there was nothing to check."""

    category: str
    check: str
    column: str
    observed: Column
    low: float | None = None
    high: float | None = None
    severity: str | None = None
    #: aggregate that is true where the rule does not apply at all
    skip_if: Column | None = None


def _as_double(value: float | None) -> Column:
    return F.lit(None if value is None else float(value)).cast("double")


def _result(rule: Rule, observed: Column) -> Column:
    kept = F.lit(True)
    if rule.low is not None:
        kept = kept & (observed >= float(rule.low))
    if rule.high is not None:
        kept = kept & (observed <= float(rule.high))
    return F.struct(
        F.lit(rule.category).alias("category"),
        F.lit(rule.check).alias("check"),
        F.lit(rule.column).alias("column"),
        F.coalesce(kept, F.lit(True)).alias("success"),
        observed.alias("observed"),
        _as_double(rule.low).alias("expected_min"),
        _as_double(rule.high).alias("expected_max"),
        F.lit(rule.severity).cast("string").alias("severity"),
    )


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Check results, one row per rule that applies."""
    parts = []
    for start in range(0, len(rules), RULES_PER_JOB):
        batch = rules[start : start + RULES_PER_JOB]
        values = [r.observed.cast("double").alias(f"v{i}") for i, r in enumerate(batch)]
        skips = [
            (F.lit(False) if r.skip_if is None else r.skip_if).alias(f"s{i}") for i, r in enumerate(batch)
        ]
        wide = df.agg(*values, *skips)
        rows = [
            F.struct(F.col(f"s{i}").alias("skip"), _result(r, F.col(f"v{i}")).alias("r"))
            for i, r in enumerate(batch)
        ]
        parts.append(
            wide.select(F.explode(F.array(*rows)).alias("x")).filter(~F.col("x.skip")).select("x.r.*")
        )
    return reduce(DataFrame.unionByName, parts)


# --- rule builders -----------------------------------------------------------


def _rows() -> Column:
    return F.count(F.lit(1))


def _share(predicate: Column, of: Column | None = None) -> Column:
    """Share of rows (or of ``of`` rows) with a true predicate."""
    return ratio(F.count_if(predicate), _rows() if of is None else of)


def required_columns(columns: Sequence[str], required: Iterable[str] = cfg.CHECK_REQUIRED) -> list[Rule]:
    """1 where the column exists; needs no data but the names."""
    return [
        Rule("schema", f"column_exists_{c}", c, F.max(F.lit(float(c in columns))), 1, None, cfg.SEVERITY["required_columns"])
        for c in required
    ]


def not_null(columns: Sequence[str], names: Iterable[str] = cfg.CHECK_NOT_NULL) -> list[Rule]:
    return [
        Rule("null_values", f"not_null_{c}", c, _share(F.col(f"`{c}`").isNull()), None, 0.0, cfg.SEVERITY["non_null_columns"])
        for c in names
        if c in columns
    ]


def nullable(columns: Sequence[str], limits: Mapping[str, float] = cfg.CHECK_NULLABLE) -> list[Rule]:
    """Null share up to a limit."""
    return [
        Rule("null_values", f"nullable_{c}", c, _share(F.col(f"`{c}`").isNull()), None, most, cfg.SEVERITY["nullable_columns"])
        for c, most in limits.items()
        if c in columns
    ]


def in_range(
    columns: Sequence[str], ranges: Mapping[str, tuple[float, float, bool]] = cfg.CHECK_RANGES
) -> list[Rule]:
    """Share of known values inside the range: all of them, or 95 % if not strict."""
    out = []
    for c, (low, high, strict) in ranges.items():
        if c in columns:
            inside = ratio(F.count_if(F.col(f"`{c}`").between(low, high)), F.count(f"`{c}`"))
            severity = cfg.SEVERITY["numeric_ranges_strict" if strict else "numeric_ranges_non_strict"]
            out.append(
                Rule("numeric_ranges", f"range_{c}", c, inside, 1.0 if strict else cfg.RANGE_TOLERANCE, None, severity)
            )
    return out


def in_set(columns: Sequence[str], sets: Mapping[str, Sequence[object]] = cfg.CHECK_SETS) -> list[Rule]:
    """Share of known values that are allowed ones must be 1."""
    return [
        Rule(
            "categorical",
            f"categorical_{c}",
            c,
            ratio(F.count_if(F.col(c).isin(*allowed)), F.count(c)),
            1.0,
            None,
            cfg.SEVERITY["categorical_values"],
        )
        for c, allowed in sets.items()
        if c in columns
    ]


def signatures(
    columns: Sequence[str], sinr: str = "sinr_db", throughput: str = "app_dl_mbps", label: str = "lab_anom"
) -> list[Rule]:
    """Anomalies must look like anomalies; cohorts are compared inside one aggregate."""
    if label not in columns:
        return []
    normal, anomaly = F.col(label) == 0, F.col(label) == 1
    empty = (F.count_if(normal) == 0) | (F.count_if(anomaly) == 0)
    severity = cfg.SEVERITY["anomaly_signatures"]

    def mean(predicate: Column, name: str) -> Column:
        return F.avg(F.when(predicate, F.col(name)))

    out = []
    if sinr in columns:
        out += [
            Rule(
                "anomaly_signatures", "anomaly_sinr_separation", sinr,
                mean(normal, sinr) - mean(anomaly, sinr),
                cfg.SIGNATURE_SEPARATION_DB, None, severity, empty,
            ),
            Rule(
                "anomaly_signatures", "anomaly_sinr_low_rate", sinr,
                _share(anomaly & (F.col(sinr) < cfg.SIGNATURE_LOW_SINR_DB), F.count_if(anomaly)),
                cfg.SIGNATURE_LOW_SHARE, None, severity, empty,
            ),
        ]
    if throughput in columns:
        usual = mean(normal, throughput)
        out.append(
            Rule(
                "anomaly_signatures", "anomaly_throughput_drop", throughput,
                ratio(usual - mean(anomaly, throughput), usual),
                cfg.SIGNATURE_THROUGHPUT_DROP, None, severity,
                empty | ~F.coalesce(usual > 0, F.lit(False)),
            )
        )
    return out


def signature_ranges(columns: Sequence[str], label: str = "lab_anom") -> list[Rule]:
    """Declared ranges of a metric under a label: share of known values inside."""
    out = []
    for name, (metric, value, low, high) in cfg.SIGNATURE_RANGES.items():
        if metric in columns and label in columns:
            cohort = (F.col(label) == value) & F.col(metric).isNotNull()
            inside = _share(cohort & F.col(metric).between(low, high), F.count_if(cohort))
            out.append(
                Rule("signature_ranges", name, metric, inside, cfg.RANGE_TOLERANCE, None, cfg.SEVERITY["anomaly_signatures"])
            )
    return out


def quality(columns: Sequence[str], label: str = "lab_anom", limits: Mapping[str, float] = cfg.QUALITY_LIMITS) -> list[Rule]:
    """Row count, label rate and null share over all cells."""
    severity = cfg.SEVERITY["quality_thresholds"]
    out = [Rule("data_quality", "sufficient_samples", "*", _rows(), limits["min_samples"], None, severity)]
    if label in columns:
        out.append(
            Rule(
                "data_quality", "anomaly_rate_reasonable", label, ratio(F.sum(label), _rows()),
                limits["min_anomaly_rate"], limits["max_anomaly_rate"], severity,
            )
        )
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in columns])
    out.append(
        Rule(
            "data_quality", "low_overall_nulls", "*", ratio(nulls, _rows() * F.lit(len(columns))),
            None, limits["max_null_share"], severity,
        )
    )
    return out


def duplicate_rule(df: DataFrame, most: float = cfg.QUALITY_LIMITS["max_duplicate_rows"]) -> DataFrame:
    """Share of duplicate rows. Needs a shuffle of its own, with copies merged before it."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    share = ratio(F.sum("__n") - F.count(F.lit(1)), F.sum("__n"))
    return evaluate(
        counted,
        [Rule("data_quality", "low_duplicates", "*", share, None, most, cfg.SEVERITY["quality_thresholds"])],
    )


def scenario_rules(
    columns: Sequence[str],
    rules: Mapping[str, tuple[int, float, float]] = cfg.SCENARIO_RULES,
    label: str = "lab_anom",
) -> list[Rule]:
    """Least samples and label rate per scenario; absent scenarios are skipped."""
    scenario = "source_file" if "source_file" in columns else "scenario_id"
    if scenario not in columns:
        return []
    severity = cfg.SEVERITY["scenario_rules"]
    out = []
    for name, (least, low, high) in rules.items():
        member = F.coalesce(F.lower(F.col(scenario)).contains(name.lower()), F.lit(False))
        absent = F.count_if(member) == 0
        out.append(
            Rule("scenario_specific", f"scenario_{name}_samples", scenario, F.count_if(member), least, None, severity, absent)
        )
        if label in columns:
            rate = ratio(F.sum(F.when(member, F.col(label))), F.count_if(member))
            out.append(
                Rule("scenario_specific", f"scenario_{name}_anomaly_rate", label, rate, low, high, severity, absent)
            )
    return out


def curation_rules(columns: Sequence[str] = ()) -> list[Rule]:
    """Limits over the figures of a curation run (see ``plans.report``)."""
    limits = cfg.CURATION_LIMITS
    return [
        Rule("curation", "null_pct", "null_pct", F.max("null_pct"), None, limits["max_null_pct"]),
        Rule("curation", "clipped_pct", "clipped_pct", F.max("clipped_pct"), None, limits["max_clipped_pct"]),
        Rule("curation", "duplicate_pct", "duplicate_pct", F.max("duplicate_pct"), None, limits["max_duplicate_pct"]),
        Rule("curation", "output_rows", "output_rows", F.max("output_rows"), limits["min_output_rows"], None),
    ]


def window_rules(limits: Mapping[str, float] = cfg.WINDOW_LIMITS) -> list[Rule]:
    """Checks of a windows table; the means are reported without a bound."""
    rate = ratio(F.count_if(F.col(cfg.TARGET) == 1), _rows())
    return [
        Rule("windows", "min_windows", "*", _rows(), limits["min_windows"]),
        Rule("windows", "gap_ratio_mean", "gap_ratio", F.avg("gap_ratio"), None, limits["max_gap_ratio"]),
        Rule("windows", "gap_ratio_max", "gap_ratio", F.max("gap_ratio")),
        Rule("windows", "weak_label_rate", cfg.TARGET, rate, limits["min_label_rate"], limits["max_label_rate"]),
        Rule("windows", "label_0", cfg.TARGET, F.count_if(F.col(cfg.TARGET) == 0)),
        Rule("windows", "label_1", cfg.TARGET, F.count_if(F.col(cfg.TARGET) == 1)),
        Rule("windows", "sinr_mean_avg", "sinr_mean", F.avg("sinr_mean")),
        Rule("windows", "sinr_std_avg", "sinr_std", F.avg("sinr_std")),
        Rule("windows", "throughput_mean_avg", "app_dl_mean", F.avg("app_dl_mean")),
    ]


def feature_rules(columns: Sequence[str], limits: Mapping[str, float] = cfg.FEATURE_LIMITS) -> list[Rule]:
    """Checks of a feature table: size, missing values per column, means, target."""
    out = [Rule("features", "min_windows", "*", _rows(), limits["min_windows"])]
    out += [
        Rule("features", f"missing_{c}", c, _share(F.col(c).isNull()), None, limits["max_missing_ratio"])
        for c in columns
    ]
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in columns])
    out += [
        Rule("features", "total_missing", "*", missing),
        Rule("features", "sinr_mean_avg", "sinr_mean", F.avg("sinr_mean")),
        Rule("features", "sinr_range_avg", "sinr_range", F.avg("sinr_range")),
        Rule("features", "throughput_avg", "app_dl_mean", F.avg("app_dl_mean")),
        Rule("features", "anomaly_rate", cfg.TARGET, _share(F.col(cfg.TARGET) == 1)),
    ]
    return out


def matrix_rules(columns: Sequence[str], limits: Mapping[str, float] = cfg.MATRIX_LIMITS) -> list[Rule]:
    """Checks of the columns that go into a design matrix."""
    cells = _rows() * F.lit(len(columns))
    value = {c: F.col(c).cast("double") for c in columns}
    missing = reduce(lambda a, b: a + b, [F.count_if(v.isNull() | F.isnan(v)) for v in value.values()])
    infinite = reduce(lambda a, b: a + b, [F.count_if(F.abs(v) == float("inf")) for v in value.values()])
    return [
        Rule("matrix", "min_samples", "*", _rows(), limits["min_samples"]),
        Rule("matrix", "missing_ratio", "*", ratio(missing, cells), None, limits["max_missing_ratio"]),
        Rule("matrix", "infinite_values", "*", infinite, None, 0),
    ]


def dtype_rules(df: DataFrame, declared: Mapping[str, str]) -> list[Rule]:
    """1 where a column has its declared type."""
    actual = dict(df.dtypes)
    return [
        Rule("matrix", f"dtype_{c}", c, F.max(F.lit(float(actual.get(c) == kind))), 1)
        for c, kind in declared.items()
    ]


# --- over results ------------------------------------------------------------


def standard_rules(columns: Sequence[str], raw: bool = False) -> list[Rule]:
    """The whole rule set for clean names, or the same one for raw names."""
    if not raw:
        return [
            *required_columns(columns), *not_null(columns), *nullable(columns), *in_range(columns),
            *in_set(columns), *signatures(columns), *quality(columns), *scenario_rules(columns),
        ]

    def name(c: str) -> str:
        return cfg.RAW_NAMES.get(c, c)

    return [
        *required_columns(columns, [name(c) for c in cfg.CHECK_REQUIRED]),
        *not_null(columns, [name(c) for c in cfg.CHECK_NOT_NULL]),
        *nullable(columns, {name(c): v for c, v in cfg.CHECK_NULLABLE.items()}),
        *in_range(columns, {name(c): v for c, v in cfg.CHECK_RANGES.items()}),
        *in_set(columns),
        *signatures(columns, name("sinr_db"), name("app_dl_mbps")),
        *quality(columns),
        *scenario_rules(columns),
    ]


def check_table(df: DataFrame, raw: bool | None = None) -> DataFrame:
    """All standard checks of a table; the layout is detected from the names."""
    from signalsift.operators.schema import is_clean_layout

    raw = (not is_clean_layout(df.columns)) if raw is None else raw
    return evaluate(df, standard_rules(df.columns, raw)).unionByName(duplicate_rule(df))


def verdict(results: DataFrame) -> DataFrame:
    """Total, passed, failed, pass rate and success per category and overall."""
    counts = results.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("passed")
    )
    overall = counts.agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"))
    both = counts.unionByName(overall.select(F.lit("overall").alias("category"), "total", "passed"))
    return both.select(
        "category",
        "total",
        "passed",
        (F.col("total") - F.col("passed")).alias("failed"),
        ratio(F.col("passed"), F.col("total")).alias("pass_rate"),
        (F.col("total") == F.col("passed")).alias("success"),
    )


def failures(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("success"))


def schema_failures(df: DataFrame, required: Iterable[str] = cfg.CHECK_REQUIRED, shown: int = 10) -> list[dict]:
    """Missing required columns, with the first columns that do exist."""
    return [
        {"column": c, "available_columns": list(df.columns)[:shown]} for c in required if c not in df.columns
    ]


def with_severity(results: DataFrame, levels: Mapping[str, str] = cfg.SEVERITY) -> DataFrame:
    """Severity of the class of each check, also for results stored without one."""
    groups = {
        "schema": "required_columns",
        "categorical": "categorical_values",
        "anomaly_signatures": "anomaly_signatures",
        "signature_ranges": "anomaly_signatures",
        "data_quality": "quality_thresholds",
        "scenario_specific": "scenario_rules",
    }
    level = F.when(F.col("check").startswith("not_null_"), levels["non_null_columns"])
    level = level.when(F.col("check").startswith("nullable_"), levels["nullable_columns"])
    level = level.when(
        F.col("category") == "numeric_ranges",
        F.when(F.col("expected_min") >= 1, levels["numeric_ranges_strict"]).otherwise(
            levels["numeric_ranges_non_strict"]
        ),
    )
    for category, kind in groups.items():
        level = level.when(F.col("category") == category, levels[kind])
    return results.withColumn("severity", level)
