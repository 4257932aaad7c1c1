"""Labels and label hierarchies as column expressions.

A hierarchical label is text split by a separator; the class at level L is its first L parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUFFIX = ".intent"


def strip_all(c: Column) -> Column:
    """Without any white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_label(c: Column) -> Column:
    """Trimmed, with exactly one ``.intent`` suffix."""
    return F.concat(F.regexp_replace(strip_all(c), r"(\.intent)+$", ""), F.lit(SUFFIX))


def compose(domain: Column, intent: Column, sep: str = ":") -> Column:
    """Null if either part is null."""
    return F.concat(domain, F.lit(sep), intent)


def part(label: Column, index: int, sep: str = ":") -> Column:
    """Part ``index`` (from 0); null beyond the last."""
    return F.get(F.split(label, _quoted(sep)), index)


def _quoted(sep: str) -> str:
    return rf"\Q{sep}\E"


def path(label: Column, sep: str = ":") -> Column:
    return F.split(label, _quoted(sep))


def level_class(label: Column, level: int, sep: str = ":") -> Column:
    return F.array_join(F.slice(path(label, sep), 1, level), sep)


def parent(cls: Column, sep: str = ":") -> Column:
    """The class one level up; null at level 1."""
    parts = path(cls, sep)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), sep))


def domain(intent: Column, sep: str = ":") -> Column:
    """Text before the first separator, or all of it."""
    return F.substring_index(intent, sep, 1)


def depth(df: DataFrame, label: str, sep: str = ":", truncate: bool = False) -> int:
    """Levels of the labels. Ragged labels are an error unless cut to the shallowest."""
    low, high = df.agg(F.min(F.size(path(F.col(label), sep))), F.max(F.size(path(F.col(label), sep)))).first()
    if low is None:
        return 0
    if low != high and not truncate:
        raise ValueError(f"labels have {low} to {high} levels")
    return low


def class_dim(df: DataFrame, label: str, levels: int, sep: str = ":") -> DataFrame:
    """(level, class_id, class_name, parent): classes of each level in sorted order, ids from 0."""
    names = df.select(label).distinct()
    rows = names.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("level"), level_class(F.col(label), n, sep).alias("class_name")) for n in range(1, levels + 1)])
        ).alias("x")
    )
    rows = rows.select("x.level", "x.class_name").distinct()
    ranked = rows.withColumn("class_id", F.dense_rank().over(Window.partitionBy("level").orderBy("class_name")) - 1)
    return ranked.select("level", "class_id", "class_name", parent(F.col("class_name"), sep).alias("parent"))
