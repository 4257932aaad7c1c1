"""Fresh folders on storage that driver and executors share, and tables written there.

The folder is ``spark.checkpoint.dir``, else the context's checkpoint directory. Only a local master
may do without either: it gets a temporary folder. Whatever is left is deleted when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(str(Path(tempfile.gettempdir()) / "vectrail-checkpoints"))
        found = context.getCheckpointDir()
    return found


def _storage(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _own(spark: SparkSession) -> str:
    """This application's folder, made once and deleted when the driver ends."""
    context, base = spark.sparkContext, root(spark)
    known = getattr(context, "_vectrail_scratch", {})
    if base not in known:
        path = f"{base}/vectrail-{uuid.uuid4().hex}"
        storage, where = _storage(spark, path)
        storage.mkdirs(where)
        storage.deleteOnExit(where)
        context._vectrail_scratch = known | {base: path}
    return context._vectrail_scratch[base]


def folder(spark: SparkSession, label: str) -> str:
    """A path of no other use within this application's folder."""
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


class Tables:
    """Tables written in the shared folder, which can be deleted together."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` as a Parquet table: it is computed once however often it is used, its lineage is
        cut, and a lost executor costs no recomputation."""
        spark = df.sparkSession
        path = folder(spark, label)
        self.paths.append((spark, path))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for spark, path in self.paths:
            storage, where = _storage(spark, path)
            storage.delete(where, True)
        self.paths.clear()


@contextmanager
def tables() -> Iterator[Tables]:
    """Tables that are deleted at the end of the block: nothing that leaves it may read them."""
    own = Tables()
    try:
        yield own
    finally:
        own.drop()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table that stays until the driver ends."""
    return Tables().written(df, label)
