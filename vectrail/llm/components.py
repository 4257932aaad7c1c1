"""Connected components of a link table by alternating large-star and small-star steps.

Scale: a round shuffles the links that are left, of which a node keeps one to its least neighbour at
the end; there are about as many rounds as the logarithm of the longest path, and each round's links
replace the last one's in the shared folder. A node with very many links is aggregated before the
shuffle.

Defined results: links of a node to itself and repeated links say nothing; a null at either end is no
link; an empty table gives no rows; links that ``most`` rounds don't settle are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.sources.scratch import Tables, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours are linked to the least of its neighbourhood."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = near.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.where("u <> v").distinct()


def components(links: DataFrame, label: str, most: int = 50) -> DataFrame:
    """(node, root) of every linked node: root is the least node it reaches. Links are (a, b)."""
    last = Tables()
    edges = last.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v and a is not null and b is not null").distinct(), f"{label}-0")
    mark = None
    for k in range(1, most + 1):
        own = Tables()
        edges = own.written(_stars(_stars(edges, large=True), large=False), f"{label}-{k}")
        last.drop()
        last = own
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            found = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), label)
            last.drop()
            return found
        mark = now
    raise RuntimeError(f"links left unsettled by {most} rounds")
