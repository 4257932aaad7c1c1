"""Vectors as array columns: norms, products, angular distance, dim_* columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = re.compile(r"dim_(\d+)")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(v: Column, least: float = 0.0) -> Column:
    """Scaled to length 1; a zero vector stays zero. ``least`` bounds the divisor from below."""
    size = F.greatest(norm(v), F.lit(least)) if least else norm(v)
    return F.when(size == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / size)).cast("array<float>")


def angular(a: Column, b: Column) -> Column:
    """arccos of the product over pi, in 0..1, of unit vectors."""
    return angle(dot(a, b))


def angle(product: Column) -> Column:
    return F.acos(F.least(F.greatest(product, F.lit(-1.0)), F.lit(1.0))) / F.lit(3.141592653589793)


def dim_columns(df: DataFrame) -> list[str]:
    """dim_0, dim_1, ... by number, whatever their place in the file."""
    found = [(int(m[1]), c) for c in df.columns if (m := DIM.fullmatch(c))]
    return [c for _, c in sorted(found)]


def fold_dims(df: DataFrame, name: str = "embedding") -> DataFrame:
    dims = dim_columns(df)
    if not dims:
        raise ValueError("no dim_* columns")
    return df.withColumn(name, F.array(*[F.col(c).cast("float") for c in dims])).drop(*dims)


def spread_dims(df: DataFrame, dims: int, name: str = "embedding") -> DataFrame:
    kept = [c for c in df.columns if c != name and not DIM.fullmatch(c)]
    return df.select(*kept, *[F.col(name)[k].alias(f"dim_{k}") for k in range(dims)])
