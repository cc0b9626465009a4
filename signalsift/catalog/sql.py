"""Common table expressions of the SQL side: the views and the stages."""

from __future__ import annotations

from signalsift.config import telemetry as cfg

SCENARIO = (
    "CASE {0} % 4 WHEN 0 THEN 'Lvl4_AllRRUOn' WHEN 1 THEN 'Lvl5_AllRRUOn' "
    "WHEN 2 THEN 'Lvl6_1RRUOn' ELSE 'Lvl6_AllRRUOn' END"
)
ANOMALY = "CASE WHEN event_type = 'error' AND k < 30 THEN 1 ELSE 0 END"

TELE = f"""
src AS (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events),
tele AS (
  SELECT event_id AS row_id, {SCENARIO.format('user_id')} AS scenario_id, ts,
    CAST(epoch_us(ts) AS BIGINT) * 1000 AS ts_ns,
    100 + user_id % 3 AS pci,
    CAST(-60 AS DOUBLE) - k * CAST(1.2 AS DOUBLE) AS rsrp_dbm,
    CAST(-25 + event_id % 31 AS DOUBLE) AS rsrq_db,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE 40 - value / 5 END AS sinr_db,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE k % 33 END AS mcs_dl,
    event_id % 29 AS mcs_ul,
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS prb_dl,
    CAST((event_id * 7) % 280 AS DOUBLE) AS prb_ul,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE value * 2 END AS app_dl_mbps,
    CASE WHEN user_id % 4 = 2 THEN NULL ELSE value END AS app_ul_mbps,
    {ANOMALY} AS lab_anom,
    CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS lab_inf,
    CAST(0.25 AS DOUBLE) * ({ANOMALY})
      + CAST(0.75 AS DOUBLE) * (CAST((event_id * 7919 + k * 104729) % 997 AS DOUBLE) / 997) AS y_prob
  FROM src)"""

LINE = f"""
line AS (
  SELECT {SCENARIO.format('l_suppkey')} AS scenario_id, l_shipdate AS ts,
    CAST(epoch_us(l_shipdate) AS BIGINT) * 1000 AS ts_ns,
    l_orderkey, l_linenumber, l_partkey,
    100 + l_partkey % 3 AS pci,
    CAST(-160 AS DOUBLE) + l_quantity * 3 AS rsrp_dbm,
    CAST(-25 + l_orderkey % 31 AS DOUBLE) AS rsrq_db,
    l_extendedprice / 2500 - 11 AS sinr_db,
    l_partkey % 33 AS mcs_dl, l_orderkey % 29 AS mcs_ul,
    l_quantity * 6 AS prb_dl, CAST(l_partkey % 280 AS DOUBLE) AS prb_ul,
    l_extendedprice / 300 AS app_dl_mbps,
    CASE WHEN l_returnflag = 'R' AND l_tax > 0.075 THEN 1 ELSE 0 END AS lab_anom,
    CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END AS lab_inf
  FROM lineitem)"""


def number(text: str) -> str:
    return f"TRY_CAST({text} AS DOUBLE)"


_CELLS = {
    "RSRP": "CASE WHEN row_id % 41 = 0 THEN 'ERR' ELSE CAST(rsrp_dbm AS VARCHAR) END",
    "SS_RSRQ_dB": "CAST(rsrq_db AS VARCHAR)",
    "SINR": "CAST(sinr_db AS VARCHAR)",
    "PDSCH_MCS": "CAST(mcs_dl + CASE WHEN row_id % 7 = 0 THEN 0.5e0 ELSE 0e0 END AS VARCHAR)",
    "PUSCH_MCS_CW0": "CAST(mcs_ul + CASE WHEN row_id % 7 = 0 THEN 0.5e0 ELSE 0e0 END AS VARCHAR)",
    "PDSCH PRBs": "CAST(prb_dl AS VARCHAR)",
    "PUSCH_PRBs": "CAST(prb_ul AS VARCHAR)",
    "APP_DL_Mbps": "CAST(app_dl_mbps AS VARCHAR)",
    "throughput_UL": "CAST(app_ul_mbps AS VARCHAR)",
    "PCI": "CAST(pci AS VARCHAR)",
    "lab_anom": "CAST(lab_anom AS VARCHAR)",
    "lab_inf": "CAST(lab_inf AS VARCHAR)",
}
RAW = f"""{TELE},
once AS (
  SELECT CAST(row_id AS VARCHAR) AS row_id, scenario_id,
    CASE WHEN row_id % 43 = 0 THEN 'bad-time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS "Time",
    {', '.join(f'{v} AS "{n}"' for n, v in _CELLS.items())}
  FROM tele),
raw AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE CAST(row_id AS BIGINT) % 100 = 0)"""

# names, numbers, integers and time of the raw table
TYPED = f"""{RAW},
parsed AS (SELECT *, TRY_CAST("Time" AS TIMESTAMP) AS t FROM raw),
timed AS (
  SELECT p.*, CAST(epoch_us(t) - f.first AS DOUBLE) / 1000000 AS time_s0
  FROM parsed p JOIN (SELECT scenario_id AS s, min(epoch_us(t)) AS first FROM parsed GROUP BY 1) f ON p.scenario_id = f.s),
typed AS (
  SELECT row_id, scenario_id, coalesce(time_s0, CAST(0 AS DOUBLE)) AS time_s,
    {cfg.START_EPOCH_NS} + CAST(trunc(coalesce(time_s0, CAST(0 AS DOUBLE)) * 1e9) AS BIGINT) AS ts_ns,
    CAST(round_even({number('"PCI"')}, 0) AS BIGINT) AS pci,
    {number('"RSRP"')} AS rsrp_dbm, {number('"SS_RSRQ_dB"')} AS rsrq_db, {number('"SINR"')} AS sinr_db,
    CAST(round_even({number('"PDSCH_MCS"')}, 0) AS BIGINT) AS mcs_dl,
    CAST(round_even({number('"PUSCH_MCS_CW0"')}, 0) AS BIGINT) AS mcs_ul,
    {number('"PDSCH PRBs"')} AS prb_dl, {number('"PUSCH_PRBs"')} AS prb_ul,
    {number('"APP_DL_Mbps"')} AS app_dl_mbps, {number('"throughput_UL"')} AS app_ul_mbps,
    CAST(round_even({number('lab_anom')}, 0) AS BIGINT) AS lab_anom,
    CAST(round_even({number('lab_inf')}, 0) AS BIGINT) AS lab_inf,
    CAST(0 AS BIGINT) AS lab_bs, CAST(0 AS BIGINT) AS lab_1rr, CAST(0 AS DOUBLE) AS nr_arfcn
  FROM timed)"""


def clip(column: str) -> str:
    low, high = cfg.CLIP_BOUNDS[column]
    return f"CASE WHEN {column} < {low} THEN {low} WHEN {column} > {high} THEN {high} ELSE {column} END"


def clipped(source: str, columns: list[str], rest: list[str]) -> str:
    return f"SELECT {', '.join([*rest, *[f'{clip(c)} AS {c}' for c in columns]])} FROM {source}"


_CLIPPED = list(cfg.CLIP_BOUNDS)
_REST = ["row_id", "scenario_id", "time_s", "ts_ns", "pci", "lab_anom", "lab_inf", "lab_bs", "lab_1rr", "nr_arfcn"]


def fills(source: str) -> str:
    """Global mode and median of a table, smallest value first on ties."""

    def mode(c: str) -> str:
        return (
            f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}"
        )

    return f"SELECT {mode('mcs_dl')}, {mode('mcs_ul')}, " + ", ".join(
        f"(SELECT quantile_cont({c}, 0.5) FROM {source}) AS {c}" for c in ("prb_dl", "prb_ul")
    )


def carried(source: str, column: str, order: str) -> str:
    """Forward fill in the scenario, then the next known value over the table."""
    return (
        f"last_value({column} IGNORE NULLS) OVER (PARTITION BY scenario_id ORDER BY {order} "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


# the whole cleaning stage; order inside a scenario: ts_ns, then the row number
CLEAN = f"""{TYPED},
cut AS ({clipped('typed', _CLIPPED, _REST)}),
complete AS (SELECT * FROM cut WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cfg.CRITICAL)}),
fill AS ({fills('complete')}),
forward AS (
  SELECT c.* EXCLUDE (mcs_dl, mcs_ul, prb_dl, prb_ul, app_dl_mbps, app_ul_mbps),
    CAST(coalesce(c.mcs_dl, fill.mcs_dl) AS BIGINT) AS mcs_dl, CAST(coalesce(c.mcs_ul, fill.mcs_ul) AS BIGINT) AS mcs_ul,
    coalesce(c.prb_dl, fill.prb_dl) AS prb_dl, coalesce(c.prb_ul, fill.prb_ul) AS prb_ul,
    {carried('c', 'c.app_dl_mbps', 'c.ts_ns, CAST(c.row_id AS BIGINT)')} AS app_dl_mbps,
    {carried('c', 'c.app_ul_mbps', 'c.ts_ns, CAST(c.row_id AS BIGINT)')} AS app_ul_mbps
  FROM complete c, fill),
filled AS (
  SELECT * EXCLUDE (app_dl_mbps, app_ul_mbps),
    coalesce(app_dl_mbps, first_value(app_dl_mbps IGNORE NULLS) OVER back) AS app_dl_mbps,
    coalesce(app_ul_mbps, first_value(app_ul_mbps IGNORE NULLS) OVER back) AS app_ul_mbps
  FROM forward
  WINDOW back AS (ORDER BY scenario_id, ts_ns, CAST(row_id AS BIGINT) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
clean AS (SELECT DISTINCT * FROM filled)"""


def window_ctes(source: str, order: str) -> str:
    """Count windows, deltas, ratios and features over a sample table."""

    def mean(c: str) -> str:
        return f"coalesce(avg({c}), CAST(0 AS DOUBLE))"

    def dev(c: str) -> str:
        return f"coalesce(stddev_pop({c}), CAST(0 AS DOUBLE))"

    def mode(c: str) -> str:
        return (
            f"{c}_top AS (SELECT scenario_id, window_no, {c}, row_number() OVER "
            f"(PARTITION BY scenario_id, window_no ORDER BY count(*) DESC, {c}) AS place "
            f"FROM numbered WHERE {c} IS NOT NULL GROUP BY scenario_id, window_no, {c})"
        )

    def delta(c: str) -> str:
        return f"coalesce({c} - lag({c}) OVER w, CAST(0 AS DOUBLE)) AS d_{c}"

    hour = "((ts_start_ns // 3600000000000) % 24)"
    return f"""
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY scenario_id ORDER BY {order}) - 1) // 10 AS window_no FROM {source}),
{mode('mcs_dl')}, {mode('mcs_ul')}, {mode('pci')},
win0 AS (
  SELECT scenario_id, window_no, min(ts_ns) AS ts_start_ns, count(*) AS window_samples,
    CAST(1 AS DOUBLE) - CAST(count(*) AS DOUBLE) / 10 AS gap_ratio,
    {mean('rsrp_dbm')} AS rsrp_mean, {dev('rsrp_dbm')} AS rsrp_std,
    {mean('rsrq_db')} AS rsrq_mean, {dev('rsrq_db')} AS rsrq_std,
    {mean('sinr_db')} AS sinr_mean, {dev('sinr_db')} AS sinr_std,
    coalesce(min(sinr_db), 0) AS sinr_min, coalesce(max(sinr_db), 0) AS sinr_max,
    {mean('prb_dl')} AS prb_dl_mean, {mean('prb_ul')} AS prb_ul_mean,
    {mean('app_dl_mbps')} AS app_dl_mean, {dev('app_dl_mbps')} AS app_dl_std,
    max(CASE WHEN lab_anom <> 0 OR lab_inf <> 0 THEN 1 ELSE 0 END) AS weak_label
  FROM numbered GROUP BY scenario_id, window_no HAVING count(*) = 10),
win1 AS (
  SELECT w.*, CAST(coalesce(a.mcs_dl, 0) AS INTEGER) AS mcs_dl_mode,
    CAST(coalesce(b.mcs_ul, 0) AS INTEGER) AS mcs_ul_mode, CAST(coalesce(c.pci, 0) AS INTEGER) AS pci_mode
  FROM win0 w
  LEFT JOIN mcs_dl_top a ON a.scenario_id = w.scenario_id AND a.window_no = w.window_no AND a.place = 1
  LEFT JOIN mcs_ul_top b ON b.scenario_id = w.scenario_id AND b.window_no = w.window_no AND b.place = 1
  LEFT JOIN pci_top c ON c.scenario_id = w.scenario_id AND c.window_no = w.window_no AND c.place = 1),
win AS (
  SELECT *, {', '.join(delta(c) for c in cfg.DELTAS)},
    rsrp_mean / (abs(rsrq_mean) + 1e-6) AS rsrp_rsrq_ratio,
    app_dl_mean / (abs(prb_dl_mean) + 1e-6) AS throughput_per_prb,
    sinr_max - sinr_min AS sinr_range
  FROM win1 WINDOW w AS (PARTITION BY scenario_id ORDER BY window_no)),
feat AS (
  SELECT *, prb_dl_mean / (prb_dl_mean + prb_ul_mean + 1e-3) AS prb_util_ratio,
    sin(2 * pi() * {hour} / 24) AS hour_sin, cos(2 * pi() * {hour} / 24) AS hour_cos,
    sinr_std / (abs(sinr_mean) + 1e-6) AS sinr_cv,
    app_dl_mean / (sinr_mean + 1e-6) AS throughput_efficiency,
    CASE WHEN lower(scenario_id) LIKE '%1rru%' THEN 1 ELSE 0 END AS is_single_rru,
    coalesce(TRY_CAST(nullif(regexp_extract(scenario_id, 'Lvl([0-9]+)', 1), '') AS DOUBLE), 0) AS scenario_level
  FROM win)"""


WIN = f"{TELE},{window_ctes('tele', 'ts_ns, row_id')}"
LINE_WIN = f"{LINE},{window_ctes('line', 'ts_ns, l_orderkey, l_linenumber, l_partkey')}"

# prediction table: rows of the events view, fold = rank of the scenario by size
PRED = f"""{TELE},
sizes AS (SELECT scenario_id, count(*) AS n FROM tele GROUP BY scenario_id),
folds AS (SELECT scenario_id, CAST(row_number() OVER (ORDER BY n DESC, scenario_id) AS INTEGER) AS fold FROM sizes),
pred AS (SELECT t.*, f.fold, t.lab_anom AS y_true FROM tele t JOIN folds f ON t.scenario_id = f.scenario_id)"""


def values(numbers) -> str:
    return ", ".join(f"(CAST({n!r} AS DOUBLE))" for n in map(float, numbers))


def counts_at(source: str, thresholds, by: str = "") -> str:
    """tp, fp, tn, fn at each of a list of thresholds, by definition."""
    key = f"{by}, " if by else ""
    return f"""
SELECT {key}threshold,
  sum(CASE WHEN y_true = 1 AND y_prob >= threshold THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y_true = 0 AND y_prob >= threshold THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 0 AND y_prob < threshold THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN y_true = 1 AND y_prob < threshold THEN 1 ELSE 0 END) AS fn
FROM {source} CROSS JOIN (VALUES {values(thresholds)}) AS v(threshold) GROUP BY {key}threshold"""


def safe(top: str, bottom: str) -> str:
    return f"coalesce(CAST({top} AS DOUBLE) / nullif({bottom}, 0), 0)"


RATES = {
    "f2_score": safe("5 * tp", "5 * tp + 4 * fn + fp"),
    "f1_score": safe("2 * tp", "2 * tp + fn + fp"),
    "precision": safe("tp", "tp + fp"),
    "recall": safe("tp", "tp + fn"),
    "fpr": safe("fp", "fp + tn"),
    "far_per_hour": f"{safe('fp', 'fp + tn')} * {safe('fp + tn', 'tp + fp + tn + fn')} * 720",
    "total_alerts_per_hour": f"{safe('tp + fp', 'tp + fp + tn + fn')} * 720",
    "accuracy": safe("tp + tn", "tp + fp + tn + fn"),
}


def rates_of(source: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return (
        f"SELECT {key}threshold, {', '.join(f'{v} AS {n}' for n, v in RATES.items())}, "
        f"CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn "
        f"FROM ({source}) AS c"
    )
