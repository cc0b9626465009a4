"""Fixed values of the 5G telemetry domain.

Every operator takes its columns and bounds as parameters; this module only
holds the defaults. The values are domain facts (3GPP bounds, column names of
the measurement tool, agreed thresholds) and must not be changed lightly:
trained models and stored reports depend on them.
"""

from __future__ import annotations

# --- raw names ---------------------------------------------------------------
# Clean column -> raw names of it, in order of preference.
ALIASES: dict[str, tuple[str, ...]] = {
    "time_s": ("Time",),
    "nr_arfcn": ("NR-ARFCN", "NR_ARFCN"),
    "pci": ("PCI",),
    "cell_id": ("Cell ID",),
    "c_rnti": ("C-RNTI", "C_RNTI"),
    "rsrp_dbm": ("SS_RSRP_dBm", "RSRP"),
    "rsrq_db": ("SS_RSRQ_dB", "RSRQ"),
    "sinr_db": ("SS_SINR_dB", "SINR"),
    "mcs_dl": ("PDSCH_MCS_CW0", "PDSCH_MCS"),
    "mcs_ul": ("PUSCH_MCS_CW0", "PUSCH_MCS"),
    "prb_dl": ("PDSCH_PRBs", "PDSCH PRBs"),
    "prb_ul": ("PUSCH_PRBs", "PUSCH PRBs"),
    "app_dl_mbps": ("APP_DL_Mbps", "throughput_DL"),
    "app_ul_mbps": ("APP_UL_Mbps", "throughput_UL"),
    "lab_anom": ("lab_anom",),
    "lab_bs": ("lab_bs",),
    "lab_inf": ("lab_inf",),
    "lab_1rr": ("lab_1rr",),
}

REQUIRED = ("time_s", "rsrp_dbm", "rsrq_db", "sinr_db", "pci", "lab_anom")
OPTIONAL_DEFAULTS = {"lab_bs": 0, "lab_inf": 0, "lab_1rr": 0, "nr_arfcn": 0, "c_rnti": 0}

# --- types -------------------------------------------------------------------
# Columns read as numbers, kept as integers, stored as floats.
NUMERIC = (
    "time_s", "nr_arfcn", "pci", "rsrp_dbm", "rsrq_db", "sinr_db",
    "mcs_dl", "mcs_ul", "prb_dl", "prb_ul", "app_dl_mbps", "app_ul_mbps",
)
INTEGER = ("pci", "mcs_dl", "mcs_ul", "lab_anom", "lab_bs", "lab_inf", "lab_1rr")
FLOAT = (
    "time_s", "rsrp_dbm", "rsrq_db", "sinr_db",
    "prb_dl", "prb_ul", "app_dl_mbps", "app_ul_mbps",
)

START_EPOCH_NS = 1_700_000_000_000_000_000

# --- cleaning ----------------------------------------------------------------
# Inclusive physical bounds.
CLIP_BOUNDS: dict[str, tuple[float, float]] = {
    "rsrp_dbm": (-156, -31),
    "rsrq_db": (-20, 3),
    "sinr_db": (-10, 30),
    "mcs_dl": (0, 28),
    "mcs_ul": (0, 28),
    "prb_dl": (0, 273),
    "prb_ul": (0, 273),
    "app_dl_mbps": (0, 100_000_000),
    "app_ul_mbps": (0, 100_000_000),
}

CRITICAL = ("rsrp_dbm", "rsrq_db", "sinr_db", "pci")

# Column -> how a missing value is filled.
IMPUTE: dict[str, str] = {
    "mcs_dl": "mode",
    "mcs_ul": "mode",
    "prb_dl": "median",
    "prb_ul": "median",
    "app_dl_mbps": "ffill",
    "app_ul_mbps": "ffill",
}

CLEAN_COLUMNS = (
    "ts_ns", "scenario_id", "time_s", "nr_arfcn", "pci",
    "rsrp_dbm", "rsrq_db", "sinr_db", "mcs_dl", "mcs_ul",
    "prb_dl", "prb_ul", "app_dl_mbps",
    "lab_anom", "lab_bs", "lab_inf", "lab_1rr",
)

# Limits of one curation run, in percent and rows.
CURATION_LIMITS = {
    "max_null_pct": 5.0,
    "max_clipped_pct": 10.0,
    "max_duplicate_pct": 1.0,
    "min_output_rows": 5000,
}

# --- windows -----------------------------------------------------------------
WINDOW_SECONDS = 5
SAMPLE_RATE_HZ = 2
WINDOW_SAMPLES = WINDOW_SECONDS * SAMPLE_RATE_HZ
MIN_WINDOW_SAMPLES = 7
WINDOWS_PER_HOUR = 3600 / WINDOW_SECONDS

# Column -> statistics kept for a window.
WINDOW_STATS: dict[str, tuple[str, ...]] = {
    "rsrp_dbm": ("mean", "std"),
    "rsrq_db": ("mean", "std"),
    "sinr_db": ("mean", "std", "min", "max"),
    "prb_dl": ("mean",),
    "prb_ul": ("mean",),
    "app_dl_mbps": ("mean", "std"),
    "mcs_dl": ("mode",),
    "mcs_ul": ("mode",),
    "pci": ("mode",),
}
UNIT_SUFFIXES = ("_dbm", "_db", "_mbps")
LABELS = ("lab_anom", "lab_inf")
TARGET = "weak_label"

DELTAS = ("rsrp_mean", "rsrq_mean", "sinr_mean", "sinr_std", "app_dl_mean")
# Ratio -> (numerator, denominator).
RATIOS = {
    "rsrp_rsrq_ratio": ("rsrp_mean", "rsrq_mean"),
    "throughput_per_prb": ("app_dl_mean", "prb_dl_mean"),
}

WINDOW_COLUMNS = (
    "ts_start_ns", "scenario_id", "pci_mode",
    "rsrp_mean", "rsrp_std", "rsrq_mean", "rsrq_std",
    "sinr_mean", "sinr_std", "sinr_min", "sinr_max",
    "prb_dl_mean", "prb_ul_mean", "app_dl_mean", "app_dl_std",
    "mcs_dl_mode", "mcs_ul_mode",
    "gap_ratio", "window_samples", "weak_label",
    "d_rsrp_mean", "d_rsrq_mean", "d_sinr_mean", "d_sinr_std", "d_app_dl_mean",
    "rsrp_rsrq_ratio", "sinr_range", "throughput_per_prb",
)

# Limits of a windows table.
WINDOW_LIMITS = {
    "min_windows": 500,
    "max_gap_ratio": 0.20,
    "min_label_rate": 0.05,
    "max_label_rate": 0.80,
}

# --- features ----------------------------------------------------------------
# Numeric features in the order a trained model expects.
NUMERIC_FEATURES = (
    "rsrp_mean", "rsrp_std", "rsrq_mean", "rsrq_std",
    "sinr_mean", "sinr_std", "sinr_min", "sinr_max",
    "prb_dl_mean", "prb_ul_mean", "mcs_dl_mode", "mcs_ul_mode",
    "app_dl_mean", "app_dl_std",
    "d_rsrp_mean", "d_rsrq_mean", "d_sinr_mean", "d_sinr_std", "d_app_dl_mean",
    "rsrp_rsrq_ratio", "sinr_range", "throughput_per_prb",
    "prb_util_ratio", "sinr_cv", "throughput_efficiency",
    "hour_sin", "hour_cos", "is_single_rru", "scenario_level",
)
CATEGORICAL_FEATURES = ("pci_mode", "scenario_id")
FEATURE_COLUMNS = ("ts_start_ns", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, TARGET)

FEATURE_LIMITS = {"min_windows": 500, "max_missing_ratio": 0.05}
MATRIX_LIMITS = {"min_samples": 500, "max_missing_ratio": 0.01}

# --- checks ------------------------------------------------------------------
# Names that tell a raw layout from a clean one.
CLEAN_MARKERS = ("rsrp_dbm", "rsrq_db", "sinr_db", "time_s", "app_dl_mbps")
RAW_MARKERS = ("RSRP", "RSRQ", "SINR", "Time", "throughput_DL")

# The rule set for clean tables.
CHECK_REQUIRED = ("time_s", "rsrp_dbm", "rsrq_db", "sinr_db", "mcs_dl", "app_dl_mbps", "lab_anom")
CHECK_NOT_NULL = ("time_s", "rsrp_dbm", "rsrq_db", "sinr_db", "lab_anom")
CHECK_NULLABLE = {"mcs_dl": 0.05, "mcs_ul": 0.05, "app_dl_mbps": 0.02, "app_ul_mbps": 0.10}
# column -> (low, high, strict)
CHECK_RANGES: dict[str, tuple[float, float, bool]] = {
    "rsrp_dbm": (-156, -31, False),
    "rsrq_db": (-20, 3, False),
    "sinr_db": (-10, 30, False),
    "mcs_dl": (0, 28, True),
    "mcs_ul": (0, 28, True),
    "prb_dl": (0, 273, True),
    "prb_ul": (0, 273, True),
    "app_dl_mbps": (0, 100_000_000, False),
    "app_ul_mbps": (0, 1000, False),
}
CHECK_SETS = {"lab_anom": (0, 1), "lab_inf": (0, 1), "lab_1rr": (0, 1)}
RANGE_TOLERANCE = 0.95

# Limits of the signature checks.
SIGNATURE_SEPARATION_DB = 10
SIGNATURE_LOW_SINR_DB = 15
SIGNATURE_LOW_SHARE = 0.6
SIGNATURE_THROUGHPUT_DROP = 0.3
# name -> (metric, label value, low, high)
SIGNATURE_RANGES = {
    "sinr_normal_range": ("sinr_db", 0, 10, 35),
    "sinr_anomaly_range": ("sinr_db", 1, -10, 15),
    "throughput_normal_range": ("app_dl_mbps", 0, 80, 400),
    "throughput_anomaly_range": ("app_dl_mbps", 1, 0, 150),
}

QUALITY_LIMITS = {
    "min_samples": 5000,
    "max_duplicate_rows": 0.01,
    "min_anomaly_rate": 0.20,
    "max_anomaly_rate": 0.60,
    "max_null_share": 0.05,
}

# Scenario -> (least samples, lowest and highest anomaly rate).
SCENARIO_RULES = {
    "Lvl4_AllRRUOn": (2000, 0.30, 0.40),
    "Lvl5_AllRRUOn": (1800, 0.50, 0.65),
    "Lvl6_1RRUOn": (2000, 0.35, 0.45),
    "Lvl6_AllRRUOn": (2000, 0.45, 0.55),
}

# Severity of each class of check.
SEVERITY = {
    "required_columns": "CRITICAL",
    "non_null_columns": "CRITICAL",
    "categorical_values": "CRITICAL",
    "numeric_ranges_strict": "HIGH",
    "quality_thresholds": "HIGH",
    "numeric_ranges_non_strict": "MEDIUM",
    "anomaly_signatures": "MEDIUM",
    "nullable_columns": "LOW",
    "scenario_rules": "LOW",
}

CRITICAL_FEATURES = ("sinr_db", "rsrp_dbm", "rsrq_db", "app_dl_mbps", "mcs_dl")

# The same rule set under raw names; the two differ only in the names.
RAW_NAMES = {
    "time_s": "Time",
    "rsrp_dbm": "RSRP",
    "rsrq_db": "RSRQ",
    "sinr_db": "SINR",
    "mcs_dl": "PDSCH_MCS",
    "mcs_ul": "PUSCH_MCS",
    "prb_dl": "PDSCH PRBs",
    "prb_ul": "PUSCH PRBs",
    "app_dl_mbps": "throughput_DL",
    "app_ul_mbps": "throughput_UL",
}

# --- model -------------------------------------------------------------------
# Hyper-parameters of the boosted trees.
BOOSTING = {
    "n_estimators": 350,
    "max_depth": 7,
    "learning_rate": 0.08,
    "subsample": 0.85,
    "colsample_bytree": 0.85,
    "colsample_bylevel": 0.90,
    "reg_alpha": 0.3,
    "reg_lambda": 1.5,
    "gamma": 0.2,
    "min_child_weight": 2,
    "random_state": 42,
}
FOLDS = 4
MIN_FOLD_ROWS = 100
BASE_THRESHOLD = 0.10
BASELINE_ROC_AUC = 0.8090
TOP_FEATURES = 20
DRIFT_LIMIT = 0.05

# Search space, name -> (kind, low, high, step).
SEARCH_SPACE = {
    "n_estimators": ("int", 50, 500, 50),
    "max_depth": ("int", 3, 12, 1),
    "min_child_weight": ("int", 1, 10, 1),
    "learning_rate": ("log", 0.01, 0.3, None),
    "subsample": ("float", 0.5, 1.0, None),
    "colsample_bytree": ("float", 0.5, 1.0, None),
    "colsample_bylevel": ("float", 0.5, 1.0, None),
    "reg_alpha": ("float", 0.0, 2.0, None),
    "reg_lambda": ("float", 0.0, 3.0, None),
    "gamma": ("float", 0.0, 2.0, None),
}

# --- thresholds --------------------------------------------------------------
SWEEP = tuple(0.1 + 0.01 * i for i in range(81))
FAR_THRESHOLDS = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50)
FAR_BUDGETS = (5, 10, 15, 30, 60)
SUSTAINABLE_FAR = 30
REPORT_THRESHOLDS = (0.3, 0.5, 0.7)
