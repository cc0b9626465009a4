"""Session settings the operators are planned for."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that matter to the plans of this package; all are ordinary Spark
#: SQL settings, so a cluster may override each of them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # mode() and percentile() run in object hash aggregates, which turn to
    # sorting after 128 keys per task by default.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "50000",
    # The JVM does not compile methods of more than 8000 bytecodes. A generated
    # stage beyond that would be interpreted; its operators one by one are not.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


#: Only for sessions made here: without the place in the Python source kept for
#: every column expression, wide plans are built in half the time.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "signalsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with these settings; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **BUILD_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where nothing is
    named and all tasks run in this process, as in tests, a temporary folder is set.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="signalsift-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write a table to the shared folder and go on from the copy.

    For a table that several jobs read: expensive steps before it run once,
    later jobs read only their columns, and nothing is lost with an executor.
    """
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy.staged_path = path
    return copy


def released(*copies: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for copy in copies:
        removed(copy.sparkSession, copy.staged_path)


#: With this Spark removes the shuffle files of a query when the query ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run in here go when each query ends, not when the driver collects its garbage.

    For steps that are staged, each of which runs once; a query that runs again makes its files again.
    """
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now.

    Spark removes them when the driver's collector finds that nothing refers to
    them any more, which a driver with little to do may not notice for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
