"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import words as W

#: Upper and lower ASCII letters; text outside A-Z is never folded.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def kept_rows(df: DataFrame, text: str, keep: Callable[[list[bytes]], Sequence[bool]]) -> DataFrame:
    """The rows of ``df`` whose texts ``keep`` marks, with all columns, whatever their names."""
    places = [f"_c{i}" for i in range(len(df.columns))]
    own = df.toDF(*places)
    at = places[df.columns.index(text)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(keep(W.texts_of(batch.column(at))), pa.bool_()))

    return own.mapInArrow(W.mapped(work, at), own.schema).toDF(*df.columns)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Array of exclusive prefix folds of long ``values`` by ``op`` from 0 (one longer than
    ``values``), with built-in functions.

    Two levels of blocks of about sqrt(n) keep the array copies at n^1.5 instead of n^2.
    """
    zero = F.lit(0).cast("long")

    def folds(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def cut(xs: Column) -> Column:
        block = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), block), lambda i: F.slice(xs, i, block))

    def joined(blocks: Column) -> Column:
        return let(
            folds(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero),
            lambda starts: F.concat(
                F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, o: F.slice(folds(b, o), 1, F.size(b)))),
                F.array(F.element_at(starts, -1)),
            ),
        )

    return let(values, lambda xs: let(cut(xs), joined))


def running_starts(lengths: Column) -> Column:
    """Array of exclusive prefix sums."""
    return running(lengths, lambda a, b: a + b)
