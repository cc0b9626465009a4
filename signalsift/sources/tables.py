"""Reading telemetry: CSV folders, parquet tables, either of them."""

from __future__ import annotations

import csv
import io
import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalsift.config import telemetry as cfg
from signalsift.operators.combine import stack
from signalsift.operators.schema import require_columns

_EXTRA = "__extra_fields"
_RECORD = "__record"
_HEADER_READERS = 16


def _file_system(spark: SparkSession, path: str):
    """Hadoop path and its file system, so any storage Spark knows works."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """The file itself, or the files of a folder with the suffix, by name."""
    hadoop, fs = _file_system(spark, path)
    if not fs.exists(hadoop):
        return []
    if fs.getFileStatus(hadoop).isFile():
        return [path]
    found = [s.getPath() for s in fs.listStatus(hadoop)]
    return sorted(p.toString() for p in found if p.getName().lower().endswith(suffix))


def _has_nested(spark: SparkSession, path: str, suffix: str) -> bool:
    """Whether a file with the suffix lies anywhere under the folder."""
    hadoop, fs = _file_system(spark, path)
    if not fs.exists(hadoop):
        return False
    files = fs.listFiles(hadoop, True)
    while files.hasNext():
        if files.next().getPath().getName().lower().endswith(suffix):
            return True
    return False


def _header(spark: SparkSession, path: str) -> tuple[str, ...] | None:
    """Field names from the first line of one file; None if it cannot be read."""
    try:
        hadoop, fs = _file_system(spark, path)
        stream = fs.open(hadoop)
        try:
            reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            line = reader.readLine()
        finally:
            stream.close()
    except Exception as problem:  # noqa: BLE001  storage errors come in many types
        warnings.warn(f"{path} skipped: {problem}", stacklevel=2)
        return None
    if not line:
        warnings.warn(f"{path} skipped: no header line", stacklevel=2)
        return None
    return tuple(next(csv.reader(io.StringIO(line.lstrip("\ufeff")))))


def _stem(column: str = "_metadata.file_name") -> F.Column:
    return F.regexp_replace(F.url_decode(F.regexp_replace(column, r"\+", "%2B")), r"\.[^.]*$", "")


def read_csv(
    spark: SparkSession, path: str, source_column: str = "scenario_id", skip_corrupt: bool = False
) -> DataFrame:
    """CSV file or folder as text columns plus the file stem.

    Spark maps the columns of all files of one read by position, so files are
    grouped by their header line, one read per header, and the reads are
    stacked by name. Rows with too many fields are left to :func:`rejected_rows`, short rows are
    filled with NULL; nothing is inferred. A file that breaks off while it is read
    is an error, unless ``skip_corrupt`` asks for the part that can be read.
    """
    files = list_files(spark, path, ".csv")
    if not files:
        raise FileNotFoundError(f"no CSV files in {path}")
    with ThreadPoolExecutor(_HEADER_READERS) as pool:
        headers = list(pool.map(lambda f: _header(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers):
        if header:
            groups.setdefault(header, []).append(file)
    if not groups:
        raise ValueError("no data loaded")
    parts = []
    for header, members in groups.items():
        # Positional names: a header may hold names that differ in case only.
        names = [f"__c{i}" for i in range(len(header))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _EXTRA]])
        rows = (
            spark.read.schema(schema)
            .options(header=True, mode="PERMISSIVE", enforceSchema=True, escape='"', ignoreCorruptFiles=skip_corrupt)
            .csv(members)
            .filter(F.col(_EXTRA).isNull())
        )
        parts.append(
            rows.select(
                *[F.nullif(F.col(n), F.lit("")).alias(h) for n, h in zip(names, header)],
                _stem().alias(source_column),
            )
        )
    return stack(parts)


def rejected_rows(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`read_csv` leaves out, as rows (file, record, reason): records with too many
    fields, and the header lines of files that have nothing else to be read by.

    ``record`` is the text of the record. Count it against the rows that were read, or write it to
    a folder of its own (``sinks.write_report``); kept and rejected rows together are all records.
    """
    files = list_files(spark, path, ".csv")
    with ThreadPoolExecutor(_HEADER_READERS) as pool:
        headers = list(pool.map(lambda f: _header(spark, f), files))
    parts = [
        spark.createDataFrame(
            [(f.rsplit("/", 1)[-1], None, "no header line") for f, h in zip(files, headers) if not h],
            "file string, record string, reason string",
        )
    ]
    groups: dict[int, list[str]] = {}
    for file, header in zip(files, headers):
        if header:
            groups.setdefault(len(header), []).append(file)
    for size, members in groups.items():
        names = [*[f"__c{i}" for i in range(size)], _EXTRA, _RECORD]
        rows = (
            spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
            .options(header=True, mode="PERMISSIVE", enforceSchema=True, escape='"', columnNameOfCorruptRecord=_RECORD)
            .csv(members)
        )
        # Fields beyond the extra one are told by the record alone, so all fields are read.
        kept = rows.select("*", F.col("_metadata.file_name").alias("file")).where(F.col(_EXTRA).isNotNull())
        record = F.coalesce(_RECORD, F.concat_ws(",", *names[:-1]))
        parts.append(kept.select("file", record.alias("record"), F.lit("too many fields").alias("reason")))
    return stack(parts)


def read_files(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Parquet files stacked by column name, with ``source_file``."""
    return spark.read.option("mergeSchema", True).parquet(*files).withColumn("source_file", _stem())


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A file by its suffix; a folder as parquet if it holds any, else as CSV.
    Rows of a folder carry ``source_file``."""
    hadoop, fs = _file_system(spark, path)
    if fs.exists(hadoop) and fs.getFileStatus(hadoop).isFile():
        if path.lower().endswith(".parquet"):
            return spark.read.parquet(path)
        return read_csv(spark, path, "source_file").drop("source_file")
    parquet = list_files(spark, path, ".parquet")
    if parquet:
        return read_files(spark, parquet)
    if _has_nested(spark, path, ".parquet"):
        # A table in folders named by column values: Spark gives the columns back.
        return spark.read.option("mergeSchema", True).parquet(path).withColumn("source_file", _stem())
    return read_csv(spark, path, "source_file")


def read_samples(
    spark: SparkSession, path: str, required: Sequence[str] = ("ts_ns", "scenario_id", "sinr_db", "rsrp_dbm")
) -> DataFrame:
    """Clean sample table."""
    return require_columns(spark.read.parquet(path), required)


def sample_stats(df: DataFrame) -> DataFrame:
    """Rows, scenarios, first and last timestamp."""
    return df.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_distinct("scenario_id").alias("input_scenarios"),
        F.min("ts_ns").alias("ts_min"),
        F.max("ts_ns").alias("ts_max"),
    )


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def window_table_stats(df: DataFrame) -> DataFrame:
    """Windows, columns, scenarios."""
    return df.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.max(F.lit(len(df.columns))).cast("long").alias("n_columns"),
        F.count_distinct("scenario_id").alias("n_scenarios"),
    )


def read_features(
    spark: SparkSession,
    path: str,
    numeric: Sequence[str] = cfg.NUMERIC_FEATURES,
    categorical: Sequence[str] = cfg.CATEGORICAL_FEATURES,
    target: str = cfg.TARGET,
) -> DataFrame:
    """Feature table with its contract checked."""
    return require_columns(spark.read.parquet(path), [*numeric, *categorical, target])
