"""Reading and writing the tables of the dataset pipeline, by Spark's readers and writers only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.functions.vectors import dim_columns, fold_dims, spread_dims
from vectrail.operators.relational import MISSING

RAW = T.StructType([T.StructField("label", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("sentence", T.StringType())])
GOLDEN = T.StructType([T.StructField("label", T.StringType()), T.StructField("utterance", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, lenient_missing: bool = False) -> DataFrame:
    """A CSV file with a header. Without a schema every column is text, by its header name.
    ``lenient_missing`` also takes words such as NA and null for missing."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    df = (reader.option("mode", "FAILFAST").schema(schema) if schema else reader).csv(path)
    if lenient_missing:
        df = df.select(*[F.when(~F.col(c).isin(list(MISSING)), F.col(c)).alias(c) for c in df.columns])
    return df


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """A labelled dataset and whether it has vectors: Parquet with dim_* columns (folded into
    ``embedding``) or an ``embedding`` column, else CSV."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        if dim_columns(df):
            return fold_dims(df), True
        return df, "embedding" in df.columns
    return read_csv(spark, path), False


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV file, or None where there is none."""
    try:
        return read_csv(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of (label, utterance); blank lines are skipped."""
    return spark.read.schema(GOLDEN).json(path).where("label is not null")


def parquet_path(path: str) -> str:
    stem, dot, suffix = path.rpartition(".")
    return path if suffix == "parquet" else (f"{stem}.parquet" if dot and "/" not in suffix else f"{path}.parquet")


def write_csv(df: DataFrame, path: str) -> None:
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").option("header", True).option("escape", '"').options(**kept).csv(path)


def write_parquet(df: DataFrame, path: str, dims: int | None = None) -> str:
    """Written under a .parquet name, with vectors spread over dim_* columns if ``dims`` is given."""
    path = parquet_path(path)
    (spread_dims(df, dims) if dims else df).write.mode("overwrite").parquet(path)
    return path
