"""Windows over a stream that account for every row.

The watermark of a stateful operator drops what is late without a trace. Here each
batch is divided by the watermark that earlier batches have reached: rows in time are
kept, all others go to a side table with the reason and the watermark they missed. A
window is written once, by the batch that closes it, from the kept rows; as later rows of it
are late by definition, it is final.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsift.config import telemetry as cfg
from signalsift.operators.windows import event_windows
from signalsift.session import released, staged

_SECOND = 1_000_000


def accounted_windows(
    out: str,
    every: int = cfg.WINDOW_SECONDS,
    delay: int = 10,
    ts: str = "ts",
    min_samples: int = cfg.MIN_WINDOW_SAMPLES,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: writes ``kept``, ``late``, ``windows`` and ``seen`` under ``out``.

    ``every`` and ``delay`` are seconds. The watermark before a batch is the newest time of all earlier ones
    less ``delay``; a row is late if its window ends at or before it, and rows without
    a time are told apart by their reason. Each table has a folder per batch, so a batch that is run
    again after a failure replaces its own output and nothing else. Of a batch the driver sees one
    number. The windows a batch closes are read back from the kept rows between two watermarks, whose files
    Parquet's statistics of the time column tell.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = staged(batch.withColumn(ts, F.col(ts).cast("timestamp")), "arrived")  # the source is read once
        before = None
        if batch_id > 0:
            before = spark.read.schema("newest long").parquet(f"{out}/seen/batch={batch_id - 1}").first()["newest"]
        newest = rows.agg(F.max(F.unix_micros(ts))).first()[0]
        newest = max((x for x in (before, newest) if x is not None), default=None)
        mark = None if before is None else before - delay * _SECOND
        micros = F.unix_micros(ts)
        end = micros - F.pmod(micros, F.lit(every * _SECOND)) + F.lit(every * _SECOND)
        missed = end <= F.lit(mark).cast("long")
        reason = F.when(F.col(ts).isNull(), "no time").when(missed, "late")
        told = rows.withColumn("reason", reason).withColumn("watermark_us", F.lit(mark).cast("long"))
        told.where("reason is null").drop("reason", "watermark_us").write.mode("overwrite").parquet(f"{out}/kept/batch={batch_id}")
        told.where("reason is not null").write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        after = None if newest is None else newest - delay * _SECOND
        kept = spark.read.schema(rows.schema).option("basePath", f"{out}/kept").parquet(f"{out}/kept")
        kept = kept.select(*rows.columns)
        # Windows that end after the watermark before and not after the one now; without a watermark, none.
        closed = kept.where(F.col(ts) < F.timestamp_micros(F.lit(after).cast("long"))).where(end <= F.lit(after).cast("long"))
        if mark is not None:
            closed = closed.where(F.col(ts) >= F.timestamp_micros(F.lit(mark - every * _SECOND))).where(end > F.lit(mark))
        windows = event_windows(closed, f"{every} seconds", ts, min_samples=min_samples)
        windows.write.mode("overwrite").parquet(f"{out}/windows/batch={batch_id}")
        # Written last: a batch that fails before is divided by the same watermark again.
        spark.range(1).select(F.lit(newest).cast("long").alias("newest")).write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")
        released(rows)

    return write


def account(spark: SparkSession, out: str, scenario: str = "scenario_id") -> DataFrame:
    """Rows of each scenario by what became of them: ``scenario, arrived, kept, late, timeless``; a null scenario is one of its own."""
    kept = spark.read.parquet(f"{out}/kept").select(F.col(scenario), F.lit("kept").alias("what"))
    late = spark.read.parquet(f"{out}/late").select(F.col(scenario), F.col("reason").alias("what"))
    what = F.col("what")
    return kept.unionByName(late).groupBy(scenario).agg(
        F.count(F.lit(1)).alias("arrived"),
        F.count_if(what == "kept").alias("kept"),
        F.count_if(what == "late").alias("late"),
        F.count_if(what == "no time").alias("timeless"),
    )
