"""Telemetry-shaped views of general-purpose tables.

``events`` and ``lineitem`` tables are read as if they were radio telemetry,
with missing values, values out of range, a scenario without any uplink
throughput, and a score that does not depend on a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCENARIOS = ("Lvl4_AllRRUOn", "Lvl5_AllRRUOn", "Lvl6_1RRUOn", "Lvl6_AllRRUOn")


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _scenario(number: Column) -> Column:
    rest = number % 4
    return (
        F.when(rest == 0, SCENARIOS[0])
        .when(rest == 1, SCENARIOS[1])
        .when(rest == 2, SCENARIOS[2])
        .otherwise(SCENARIOS[3])
    )


def _ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000)


def _unless(step: int, value: Column) -> Column:
    """NULL on every row whose number divides by ``step``."""
    return F.when(F.col("event_id") % step != 0, value)


def telemetry_events(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    anomaly = F.when((F.col("event_type") == "error") & (F.col("k") < 30), 1).otherwise(0)
    noise = ((e * 7919 + F.col("k") * 104729) % 997).cast("double") / 997
    value = F.col("value")
    return (
        load(spark, folder, "events")
        .withColumn("k", k)
        .select(
            e.alias("row_id"),
            _scenario(F.col("user_id")).alias("scenario_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            _ns(F.col("ts")).alias("ts_ns"),
            (F.lit(100) + F.col("user_id") % 3).alias("pci"),
            (F.lit(-60.0) - F.col("k") * F.lit(1.2)).alias("rsrp_dbm"),
            (F.lit(-25) + e % 31).cast("double").alias("rsrq_db"),
            _unless(50, F.lit(40) - value / 5).alias("sinr_db"),
            _unless(17, F.col("k") % 33).alias("mcs_dl"),
            (e % 29).alias("mcs_ul"),
            _unless(19, value).alias("prb_dl"),
            ((e * 7) % 280).cast("double").alias("prb_ul"),
            _unless(23, value * 2).alias("app_dl_mbps"),
            F.when(F.col("user_id") % 4 != 2, value).alias("app_ul_mbps"),
            anomaly.alias("lab_anom"),
            F.when(e % 97 == 0, 1).otherwise(0).alias("lab_inf"),
            (F.lit(0.25) * anomaly + F.lit(0.75) * noise).alias("y_prob"),
        )
    )


def telemetry_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    part, order, price = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_extendedprice")
    return load(spark, folder, "lineitem").select(
        _scenario(F.col("l_suppkey")).alias("scenario_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        _ns(F.col("l_shipdate")).alias("ts_ns"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.lit(100) + part % 3).alias("pci"),
        (F.lit(-160.0) + F.col("l_quantity") * 3).alias("rsrp_dbm"),
        (F.lit(-25) + order % 31).cast("double").alias("rsrq_db"),
        (price / 2500 - 11).alias("sinr_db"),
        (part % 33).alias("mcs_dl"),
        (order % 29).alias("mcs_ul"),
        (F.col("l_quantity") * 6).alias("prb_dl"),
        (part % 280).cast("double").alias("prb_ul"),
        (price / 300).alias("app_dl_mbps"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.075), 1).otherwise(0).alias("lab_anom"),
        F.when(order % 97 == 0, 1).otherwise(0).alias("lab_inf"),
    )


#: Sort keys of the two views, the last columns are tie-breakers.
EVENT_ORDER = ("ts_ns", "row_id")
LINEITEM_ORDER = ("ts_ns", "l_orderkey", "l_linenumber", "l_partkey")


def telemetry_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The events view as text under raw names, with values that do not parse
    and with one row in a hundred given twice."""
    t = telemetry_events(spark, folder)
    r = F.col("row_id")

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    def half(name: str) -> Column:
        moved = F.col(name).cast("double") + F.when(r % 7 == 0, 0.5).otherwise(0.0)
        return moved.cast("string")

    raw = t.select(
        text("row_id").alias("row_id"),
        "scenario_id",
        F.when(r % 43 == 0, "bad-time")
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .alias("Time"),
        text("pci").alias("PCI"),
        F.when(r % 41 == 0, "ERR").otherwise(text("rsrp_dbm")).alias("RSRP"),
        text("rsrq_db").alias("SS_RSRQ_dB"),
        text("sinr_db").alias("SINR"),
        half("mcs_dl").alias("PDSCH_MCS"),
        half("mcs_ul").alias("PUSCH_MCS_CW0"),
        text("prb_dl").alias("PDSCH PRBs"),
        text("prb_ul").alias("PUSCH_PRBs"),
        text("app_dl_mbps").alias("APP_DL_Mbps"),
        text("app_ul_mbps").alias("throughput_UL"),
        text("lab_anom").alias("lab_anom"),
        text("lab_inf").alias("lab_inf"),
    )
    return raw.unionByName(raw.filter(F.col("row_id").cast("long") % 100 == 0))
