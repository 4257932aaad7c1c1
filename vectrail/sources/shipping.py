"""Sends this package to the executors, so that none of them needs it installed, and keeps the batches
that go to Python small: texts are long, and a batch is held by the JVM and by Python."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import vectrail


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds the package as a Python file of the session's context, once. Batches have 2,000 rows
    unless the session was given a number of its own."""
    context = spark.sparkContext
    if spark.conf.get(BATCH) == "10000" and not context.getConf().contains(BATCH):
        spark.conf.set(BATCH, "2000")
    root = Path(vectrail.__file__).parent
    if getattr(context, "_vectrail_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="vectrail-")) / "vectrail.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path("vectrail") / file.relative_to(root))
    context.addPyFile(str(archive))
    context._vectrail_shipped = True
