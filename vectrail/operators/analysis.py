"""Diversity, spread and structure of labelled vectors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions.vectors import unit
from vectrail.operators.knn import _matrix
from vectrail.operators.relational import md5_order, word_bag_distinct
from vectrail.sources.scratch import tables


def _capped(df: DataFrame, label: str, id: str, most: int | None, parts: int = 64) -> DataFrame:
    """At most ``most`` rows of a label, those first by md5. Only ids are ordered, those of a label in
    several parts first, so that no task holds a large label."""
    if most is None:
        return df
    order = (md5_order(F.col(id), "42"), id)
    ids = df.select(label, id).withColumn("_part", F.pmod(F.xxhash64(id), F.lit(parts)))
    for by in ((label, "_part"), (label,)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        ids = ids.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    ids = ids.select(F.col(label).alias("_label"), F.col(id).alias("_id")).distinct()
    return df.join(ids, F.col(label).eqNullSafe(F.col("_label")) & F.col(id).eqNullSafe(F.col("_id")), "left_semi")


def _sized(df: DataFrame, label: str) -> DataFrame:
    """With _n, the rows of a label: counted before the shuffle."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(label, "_label")
    return df.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def cosine_diversity(df: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(label, n, diversity): mean cosine distance over all pairs of a label's unit vectors, from
    the length of their sum: no pairs are made."""
    parts = df.select(label, F.posexplode(embedding).alias("_d", "_x"))
    sums = parts.groupBy(label, "_d").agg(F.sum(F.col("_x").cast("double")).alias("_s"))
    length = sums.groupBy(label).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") < 2, 0.0).otherwise(1 - (F.col("_q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))
    return n.join(length, label).select(label, "n", value.alias("diversity"))


def _rows(x: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in x])


def spread(x: np.ndarray, block: int = 1024) -> float:
    """Mean angular distance over all pairs, in blocks."""
    n = len(x)
    if n < 2:
        return 0.0
    total = 0.0
    for at in range(0, n, block):
        d = np.arccos(np.clip(x[at : at + block] @ x[at:].T, -1, 1)) / np.pi
        total += d[np.triu(np.ones(d.shape, bool), 1)].sum()
    return total / (n * (n - 1) / 2)


def angular_spread(
    df: DataFrame, label: str = "label", id: str = "vec_id", embedding: str = "embedding", most: int | None = None, block: int = 5_000
) -> DataFrame:
    """(label, n, spread) over all pairs of a label, or of at most ``most`` rows. A label's rows are
    dealt to blocks of about ``block``; a task sums the distances of two blocks."""
    total = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    kind = df.schema[label].dataType.simpleString()
    own = _capped(df.select(label, id, embedding), label, id, most)
    parts = own.groupBy(label).agg(F.count(F.lit(1)).alias("_m"), F.ceil(F.count(F.lit(1)) / block).alias("_parts"))
    dealt = own.join(parts, label).withColumn("_b", F.pmod(F.xxhash64(id), F.col("_parts")))
    dealt = dealt.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    dealt = dealt.select(label, embedding, "_b", F.least("_b", "_k").alias("_i"), F.greatest("_b", "_k").alias("_j"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        x, first = _rows(rows[embedding]), (rows["_b"] == rows["_i"].iloc[0]).to_numpy()
        if rows["_i"].iloc[0] == rows["_j"].iloc[0]:
            value = spread(x) * (len(x) * (len(x) - 1) / 2)
        else:
            a, b = x[first], x[~first]
            value = sum(float(np.arccos(np.clip(a[at : at + 1024] @ b.T, -1, 1)).sum()) / np.pi for at in range(0, len(a), 1024))
        return pd.DataFrame({label: [rows[label].iloc[0]], "_s": [float(value)]})

    sums = dealt.groupBy(label, "_i", "_j").applyInPandas(work, f"{label} {kind}, _s double").groupBy(label).agg(F.sum("_s").alias("_s"))
    value = F.when(F.col("_m") < 2, 0.0).otherwise(F.col("_s") / (F.col("_m") * (F.col("_m") - 1) / 2))
    return total.join(sums.join(parts, label).select(label, value.alias("spread")), label)


def maximin(x: np.ndarray, k: int) -> list[int]:
    """Farthest-point selection by cosine distance, in O(n k) without a matrix of all pairs. It
    starts from the row with the largest mean distance."""
    n = len(x)
    if n <= k:
        return list(range(n))
    mean = 1 - x @ x.sum(axis=0) / n
    chosen = [int(mean.argmax())]
    free = np.ones(n, bool)
    free[chosen] = False
    near = 1 - x @ x[chosen[0]]
    while len(chosen) < k:
        at = int(np.where(free, near, -1.0).argmax())
        chosen.append(at)
        free[at] = False
        near = np.minimum(near, 1 - x @ x[at])
    return chosen


def diverse_subset(
    df: DataFrame, *, caps: Mapping[str, int] | None = None, cap: int = 100, intact: int = 5, pool: int = 10_000,
    label: str = "label", sentence: str = "sentence", seq: str = "seq", embedding: str = "embedding",
) -> DataFrame:
    """The rows kept for each label: without repeated word bags, then the ``cap`` most diverse of
    at most ``pool``. Labels of ``intact`` rows or fewer stay whole."""
    own = _sized(df, label)
    small = own.where(F.col("_n") <= intact).drop("_n")
    rest = own.where(F.col("_n") > intact).drop("_n")
    bags = word_bag_distinct(rest, sentence, seq, [label])
    limits = dict(caps or {})
    schema = rest.schema

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first_seq", kind="stable").drop(columns="first_seq")
        most = limits.get(rows[label].iloc[0], cap)
        return rows if len(rows) <= most else rows.iloc[maximin(_rows(rows[embedding]), most)]

    capped = _capped(bags, label, seq, pool)
    return small.unionByName(capped.groupBy(label).applyInPandas(work, schema))


def subset_stats(df: DataFrame, subset: DataFrame, *, label: str = "label", sentence: str = "sentence", embedding: str = "embedding") -> DataFrame:
    """label, n_before, n_deduped, n_after, div_before, div_after, kept_pct."""
    from vectrail.functions.text import word_bag

    before = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_before"), F.countDistinct(word_bag(F.col(sentence))).alias("n_deduped"))
    a = cosine_diversity(df, label, embedding).select(label, F.round("diversity", 4).alias("div_before"))
    b = cosine_diversity(subset, label, embedding).select(label, F.col("n").alias("n_after"), F.round("diversity", 4).alias("div_after"))
    kept = F.round(100 * F.col("n_after") / F.col("n_before"), 1).alias("kept_pct")
    return before.join(a, label).join(b, label).select(label, "n_before", "n_deduped", "n_after", "div_before", "div_after", kept)


def lloyd(x: np.ndarray, k: int, seed: int = 42, starts: int = 10, most: int = 100) -> np.ndarray:
    """Cluster numbers of the best of several k-means++ starts."""
    rng = np.random.default_rng(seed)
    best, found = np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        centres = x[[int(rng.integers(len(x)))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
            centres = np.vstack([centres, x[int(rng.choice(len(x), p=d / d.sum() if d.sum() else None))]])
        own = np.full(len(x), -1)
        for _ in range(most):
            d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
            new = d.argmin(1)
            if (new == own).all():
                break
            own = new
            for c in range(k):
                if (own == c).any():
                    centres[c] = x[own == c].mean(0)
        cost = ((x - centres[own]) ** 2).sum()
        if cost < best:
            best, found = cost, own.copy()
    return found


def silhouette(x: np.ndarray, own: np.ndarray) -> float:
    """Mean cosine silhouette from cluster sums: mean distances to a cluster need no pairs."""
    names = np.unique(own)
    if len(names) < 2:
        return -1.0
    sums = np.stack([x[own == c].sum(0) for c in names])
    size = np.array([(own == c).sum() for c in names])
    place = np.searchsorted(names, own)
    total = size - x @ sums.T
    rows = np.arange(len(x))
    alone = size[place] == 1
    inner = total[rows, place] / np.maximum(size[place] - 1, 1)
    mean = total / size
    mean[rows, place] = np.inf
    outer = mean.min(1)
    s = np.where(alone, 0.0, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300))
    return float(s.mean())


def topology(df: DataFrame, *, label: str = "label", id: str = "vec_id", embedding: str = "embedding", min_samples: int = 20, most: int = 10_000, floor: float = 0.15) -> DataFrame:
    """Intent, Total_Samples, Spread_Score, Estimated_Islands, Island_Separation_Score."""
    own = df.select(F.col(label).cast("string").alias("Intent"), id, unit(F.col(embedding), 1e-10).alias("_v"))
    own = _sized(own, "Intent")
    schema = "Intent string, Total_Samples long, Spread_Score double, Estimated_Islands int, Island_Separation_Score double"

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id, kind="stable")
        x, n = _rows(rows["_v"]), int(rows["_n"].iloc[0])
        islands, separation = None, None
        if n >= min_samples:
            islands, top = 1, -1.0
            for k in range(2, min(6, len(x) // 5)):
                score = silhouette(x, lloyd(x, k))
                if score > top:
                    top, islands = score, k
            if top >= floor:
                separation = round(top, 3)
            else:
                islands = 1
        return pd.DataFrame({"Intent": [rows["Intent"].iloc[0]], "Total_Samples": [n], "Spread_Score": [round(spread(x), 4)], "Estimated_Islands": pd.Series([islands], dtype="object"), "Island_Separation_Score": pd.Series([separation], dtype="object")})

    return _capped(own, "Intent", id, most).groupBy("Intent").applyInPandas(work, schema)


def _nearest_centres(x: np.ndarray, centres: np.ndarray, strip: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first on ties, and the squared distance to it. Products of
    single precision choose; the distance is of double precision."""
    c = centres.astype(np.float32)
    half = (c * c).sum(1) / 2
    near = np.concatenate([(half - x[at : at + strip].astype(np.float32) @ c.T).argmin(1) for at in range(0, len(x), strip)])
    return near, np.concatenate([((x[at : at + strip] - centres[near[at : at + strip]]) ** 2).sum(1) for at in range(0, len(x), strip)])


def _added(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct codes, and the sums of each value by code."""
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=-1))
    return codes[order[first]], *(np.add.reduceat(v[order], first, axis=0) for v in values)


def medoids(df: DataFrame, k: int, *, id: str = "vec_id", embedding: str = "embedding", seed: int = 42, rounds: int = 20, tol: float = 1e-4) -> DataFrame:
    """(cluster, id, centre): the row nearest each k-means centre, and the centre. The first centres are
    ``k`` different vectors by md5 order; each round is one pass over all rows, whose tasks hold the
    centres and send on sums by centre. Centres reach the driver, rows don't. A centre that lost its rows
    moves to the row farthest from its own; a null vector is in no cluster, and of no rows there are no centres."""
    spark, kind = df.sparkSession, df.schema[id].dataType.simpleString()
    with tables() as own:
        given = df.select(F.col(id).alias("_id"), F.col(embedding).alias("_v")).where("_v is not null")
        rows = own.written(given.repartition(spark.sparkContext.defaultParallelism, "_id"), "vectors")  # a small table is one task else
        first = rows.groupBy("_v").agg(F.min(F.struct(md5_order(F.col("_id"), str(seed)).alias("order"), "_id")).alias("x"))
        centres = _matrix(first.orderBy("x.order", "x._id").limit(k).select("_v").toArrow().column(0))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[tuple] = []
            for b in batches:
                if len(b):
                    x = _matrix(b.column("_v"))
                    found.append(_added(_nearest_centres(x, shared.value)[0], np.ones(len(x), np.int64), x))
            yield from _sums(found)

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _sums([(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))) for b in batches if len(b)])

        def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    near, gap = _nearest_centres(_matrix(b.column("_v")), shared.value)
                    yield pa.record_batch({"cluster": pa.array(near, pa.int32()), "gap": gap, "_id": b.column("_id"), "_v": b.column("_v")})

        for _ in range(rounds if len(centres) else 0):
            shared = spark.sparkContext.broadcast(centres)
            part = rows.mapInArrow(sums, "cluster int, n long, s array<double>").repartition("cluster").mapInArrow(total, "cluster int, n long, s array<double>").toArrow()
            shared.destroy()
            at, old = part.column("cluster").to_numpy(), centres
            centres = centres.copy()
            centres[at] = _matrix(part.column("s")) / part.column("n").to_numpy()[:, None]
            if ((centres - old) ** 2).sum(1).max() <= tol**2:
                break
        for _ in range(3):
            shared = spark.sparkContext.broadcast(centres)
            placed = rows.mapInArrow(closest, f"cluster int, gap double, _id {kind}, _v {df.schema[embedding].dataType.simpleString()}")
            found = placed.groupBy("cluster").agg(F.min(F.struct("gap", "_id")).alias("x")).select("cluster", F.col("x._id").alias(id)).toArrow()
            lost = np.setdiff1d(np.arange(len(centres)), found.column("cluster").to_numpy())
            if not len(lost):
                break
            far = placed.where("gap > 0").orderBy(F.desc("gap"), "_id").limit(len(lost)).select("_v").toArrow()
            if len(far):
                centres[lost[: len(far)]] = _matrix(far.column(0))
    found = found.append_column("centre", pa.array(list(centres[found.column("cluster").to_numpy()]), pa.list_(pa.float64())))
    return spark.createDataFrame(found, f"cluster int, `{id}` {kind}, centre array<double>")


def _sums(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """(cluster, n, s) of parts (cluster, n, s)."""
    if found:
        at, n, s = _added(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.record_batch({"cluster": pa.array(at, pa.int32()), "n": n, "s": pa.array(list(s), pa.list_(pa.float64()))})
