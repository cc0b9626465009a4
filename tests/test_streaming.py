"""A stream gives what the batch gives."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from signalsift.operators import clean
from signalsift.operators.windows import add_deltas, event_windows
from signalsift.plans import train
from signalsift.plans.curate import featurize
from signalsift.plans.surrogate import EVENT_ORDER, telemetry_events
from signalsift.session import staged
from signalsift.streaming.curation import curate_stream
from signalsift.streaming.late import account, accounted_windows
from signalsift.streaming.scoring import alert_rate, alerts
from signalsift.streaming.windows import delta_writer, stream_windows


def as_stream(spark, df, path, files=3):
    df.repartition(files).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, spark, name, path, mode="append"):
    """Drain the stream into a table."""
    job = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", path).trigger(availableNow=True).start()
    )
    job.awaitTermination(240)
    assert job.exception() is None
    return spark.table(name)


def test_curation(spark, tmp_path):
    raw = spark.createDataFrame(
        [(str(i / 2), "100", str(-80 - i), "-5", "x" if i == 3 else "20", None if i % 2 else "3", "0") for i in range(20)],
        "Time string, PCI string, RSRP string, RSRQ string, SINR string, `PDSCH_MCS` string, lab_anom string",
    )
    batch = curate_stream(raw, {"mcs_dl": 7})
    stream = curate_stream(as_stream(spark, raw, str(tmp_path / "in")), {"mcs_dl": 7})
    got = run(stream, spark, "curated", str(tmp_path / "cp"))
    assert rows(got) == rows(batch)
    assert got.count() == 19
    assert rows(got.select("mcs_dl").distinct()) == [(3,), (7,)]


@pytest.fixture
def ordered(spark, folder):
    return telemetry_events(spark, folder)


def test_windows_below_the_watermark(spark, tmp_path, ordered):
    stream = stream_windows(as_stream(spark, ordered.orderBy("ts").coalesce(1), str(tmp_path / "in"), 1), "1 hour", "10 minutes", min_samples=1)
    got = run(stream, spark, "windowed", str(tmp_path / "cp"))
    batch = event_windows(ordered, "1 hour", min_samples=1)
    newest = ordered.agg(F.max("ts")).first()[0]
    cut = F.lit(newest) - F.expr("INTERVAL 10 MINUTES")
    done = batch.filter(F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= cut)
    columns = ["scenario_id", "window_start", "window_samples", "weak_label", "mcs_ul_mode", F.round("rsrp_std", 6)]
    assert rows(got.select(*columns)) == rows(done.select(*columns))
    assert got.count() > 100


def test_late_rows_are_dropped(spark, tmp_path):
    def at(*seconds):
        return spark.createDataFrame([("a", s) for s in seconds], "scenario_id string, s long").selectExpr(
            "scenario_id", "timestamp_seconds(s) AS ts", "s * 1000000000 AS ts_ns", "double(s) AS sinr_db"
        )

    source = str(tmp_path / "in")
    cp = str(tmp_path / "cp")
    at(0, 1, 2, 100).coalesce(1).write.parquet(source)
    schema = at(0).schema
    stream = lambda: stream_windows(spark.readStream.schema(schema).parquet(source), delay="10 seconds", min_samples=1)
    out = str(tmp_path / "out")

    def drain():
        job = stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        job.awaitTermination(120)

    drain()
    at(3, 200).coalesce(1).write.mode("append").parquet(source)  # 3 s is far behind the watermark of 90 s
    drain()
    got = rows(spark.read.parquet(out).select("ts_start_ns", "window_samples"))
    assert (0, 3) in got and all(n <= 3 for _, n in got)


def test_deltas_across_batches(spark, tmp_path):
    data = [(s, i * 10, float((i * 37) % 11)) for s in ("a", "b") for i in range(30)]
    whole = spark.createDataFrame(data, "scenario_id string, ts_start_ns long, sinr_mean double")
    write = delta_writer(str(tmp_path / "out"), str(tmp_path / "state"), ["sinr_mean"])
    parts = [whole.filter(f"ts_start_ns >= {lo} AND ts_start_ns < {hi}") for lo, hi in ((0, 70), (70, 80), (80, 300))]
    for number, part in enumerate(parts):
        write(part, number)
        write(part, number)  # a batch that is repeated replaces itself
    got = spark.read.parquet(str(tmp_path / "out")).select("scenario_id", "ts_start_ns", "d_sinr_mean")
    want = add_deltas(whole, ["sinr_mean"]).select("scenario_id", "ts_start_ns", "d_sinr_mean")
    assert rows(got) == rows(want)


def test_deltas_of_a_scenario_missing_in_a_batch(spark, tmp_path):
    def part(*data):
        return spark.createDataFrame(data, "scenario_id string, ts_start_ns long, sinr_mean double")

    write = delta_writer(str(tmp_path / "out"), str(tmp_path / "state"), ["sinr_mean"])
    write(part(("a", 1, 1.0), ("b", 1, 5.0)), 0)
    write(part(("b", 2, 6.0)), 1)
    write(part(("a", 3, 4.0), ("a", 0, 9.0)), 2)  # the second one is late
    got = spark.read.parquet(str(tmp_path / "out")).select("scenario_id", "ts_start_ns", "d_sinr_mean")
    assert rows(got) == [("a", 0, 0.0), ("a", 1, 0.0), ("a", 3, 3.0), ("b", 1, 0.0), ("b", 2, 1.0)]


def test_delta_writer_behind_a_stream(spark, tmp_path):
    data = [("a", i * 10, float(i * i)) for i in range(12)]
    whole = spark.createDataFrame(data, "scenario_id string, ts_start_ns long, sinr_mean double")
    stream = as_stream(spark, whole, str(tmp_path / "in"), 1)
    write = delta_writer(str(tmp_path / "out"), str(tmp_path / "state"), ["sinr_mean"])
    job = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert job.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_scoring(spark, tmp_path, ordered):
    features = staged(featurize(ordered, EVENT_ORDER))
    model = train.train_all(features, overrides={"maxIter": 2, "maxDepth": 2})
    batch = alerts(features, model, 0.5)
    stream = alerts(as_stream(spark, features, str(tmp_path / "in"), 2), model, 0.5)
    got = run(stream, spark, "alerted", str(tmp_path / "cp"))
    columns = ["scenario_id", "ts_start_ns", "alert", F.round("y_prob", 9)]
    assert rows(got.select(*columns)) == rows(batch.select(*columns))
    rate = alert_rate(batch).filter("windows > 0").first()
    assert rate["alerts_per_hour"] == pytest.approx(rate["alerts"] / rate["windows"] * 720)


def test_fill_values_carry_over(spark, ordered):
    values = clean.fill_values(ordered)
    assert set(values) == {"mcs_dl", "mcs_ul", "prb_dl", "prb_ul"}
    assert clean.fill_constants(ordered, values).filter("prb_dl IS NULL OR mcs_dl IS NULL").count() == 0


def test_late_rows_are_told(spark, tmp_path, ordered):
    """Kept and late rows are all rows; windows are those of the kept rows and never change."""
    out = str(tmp_path / "out")
    write = accounted_windows(out, 3600, 600, min_samples=1)
    timed = ordered.withColumn("ts", F.col("ts").cast("timestamp"))
    middle = timed.agg(F.expr("timestamp_micros(unix_micros(min(ts)) div 2 + unix_micros(max(ts)) div 2)")).first()[0]
    early = timed.where(F.col("ts") < F.lit(middle))
    write(timed.where(F.col("ts") >= F.lit(middle)), 0)
    first = rows(spark.read.parquet(f"{out}/windows/batch=0"))
    write(early.unionByName(timed.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))), 1)
    write(early, 1)  # the batch is run again after a failure
    write(timed.limit(0), 2)
    got = account(spark, out).agg(F.sum("arrived"), F.sum("kept"), F.sum("late"), F.sum("timeless")).first()
    assert got[0] == ordered.count() == got[1] + got[2] and got[2] > 0 and got[3] == 0
    late = spark.read.parquet(f"{out}/late")
    assert late.where("unix_micros(ts) >= watermark_us").count() == 0
    assert rows(spark.read.parquet(f"{out}/windows/batch=0")) == first
    windows = spark.read.parquet(f"{out}/windows").drop("batch")
    kept = spark.read.parquet(f"{out}/kept").drop("batch")
    mark = kept.agg(F.max(F.unix_micros("ts")) - 600_000_000).first()[0]
    whole = event_windows(kept, "3600 seconds", "ts", min_samples=1)
    whole = whole.where(F.unix_micros("window_start") + 3_600_000_000 <= mark)
    assert rows(windows.select(*whole.columns)) == rows(whole) and whole.count() > 0


def test_rows_without_time_and_empty_streams(spark, tmp_path, ordered):
    out = str(tmp_path / "out")
    write = accounted_windows(out, 3600, 600)
    write(ordered.limit(0), 0)
    write(ordered.limit(5).withColumn("ts", F.lit(None).cast("timestamp")), 1)
    sums = [F.sum(c) for c in ("arrived", "kept", "late", "timeless")]
    assert tuple(account(spark, out).agg(*sums).first()) == (5, 0, 0, 5)
    assert spark.read.parquet(f"{out}/windows").count() == 0
