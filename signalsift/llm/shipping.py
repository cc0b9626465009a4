"""Makes this package importable in the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between the JVM and a worker: long texts make small batches, whatever the number of rows.
BATCH_BYTES = 4 << 20

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules with the session's tasks, unless the workers find them anyway
    (the folder is in ``PYTHONPATH``, is the working folder, or the package is installed); bound its Arrow batches."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    found = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd().resolve()}
    if _ROOT in found or _ROOT.name == "site-packages" or getattr(context, "_signalsift_shipped", False):
        return spark
    archive = Path(tempfile.mkdtemp(prefix="signalsift-")) / "signalsift-modules.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((_ROOT / "signalsift").rglob("*.py")):
            out.write(file, file.relative_to(_ROOT))
    context.addPyFile(str(archive))
    context._signalsift_shipped = True
    return spark
