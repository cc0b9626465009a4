"""Windows over a stream, and the change from one window to the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.operators.windows import add_deltas, event_windows
from signalsift.session import released, removed, staged


def stream_windows(
    samples: DataFrame,
    every: str = f"{cfg.WINDOW_SECONDS} seconds",
    delay: str = "10 seconds",
    ts: str = "ts",
    min_samples: int = cfg.MIN_WINDOW_SAMPLES,
) -> DataFrame:
    """Event-time windows behind a watermark; rows later than ``delay`` are dropped."""
    timed = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return event_windows(timed, every, ts, min_samples=min_samples)


def delta_writer(
    out: str, state: str, columns: Sequence[str] = cfg.DELTAS, scenario: str = "scenario_id"
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: change against the previous window of the scenario.

    The state is the last window of each scenario, one row, stored per batch
    under ``state``; deltas go to ``out``. Both are written to a folder of the
    batch number, so a batch that is run again after a failure replaces its
    own output and nothing else; the state before the last one is removed. The change itself is the batch operator, so a
    scenario with many windows in one batch is cut into chunks there.
    A window that arrives after a later one was handled has no predecessor
    and gets 0, as the first one does.
    """
    columns = list(columns)
    keep = [scenario, "ts_start_ns", *columns]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = staged(batch.select(*keep, F.lit(False).alias("carried")), "batch")  # the source is read once
        stored = fresh
        past = f"{state}/batch={batch_id - 1}"
        if batch_id > 0:
            last = spark.read.schema(fresh.schema).parquet(past)
            fresh = fresh.unionByName(last.withColumn("carried", F.lit(True)))
        changed = add_deltas(fresh, columns, scenario)
        changed.filter(~F.col("carried")).select(
            scenario, "ts_start_ns", *[f"d_{c}" for c in columns]
        ).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        newest = fresh.groupBy(scenario).agg(F.max_by(F.struct(*keep[1:]), "ts_start_ns").alias("w"))
        newest.select(scenario, "w.*", F.lit(True).alias("carried")).write.mode("overwrite").parquet(
            f"{state}/batch={batch_id}"
        )
        released(stored)
        if batch_id > 1:
            removed(spark, f"{state}/batch={batch_id - 2}")  # a repeated batch reads only the state before it

    return write
