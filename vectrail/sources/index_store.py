"""A vector index as plain Parquet: a corpus partitioned by cell, centroids and JSON metadata."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions.labels import class_dim, depth, level_class
from vectrail.functions.vectors import unit
from vectrail.operators import classify, knn
from vectrail.operators.coupling import Kernel
from vectrail.operators.relational import at_least, cleaned, fixed_sample, in_languages


@dataclass(frozen=True)
class Spec:
    id: str = "vec_id"
    label: str = "label"
    embedding: str = "embedding"
    sep: str = ":"
    k: int = 10
    n: int = 5
    nlist: int = 1024
    nprobe: int = 32
    gamma: float = 1.0
    tau: float = 0.05
    margin: float = 0.10
    anchor_to_global: bool = True
    renormalize: bool = True
    train_rows_per_cell: int = 40
    rows_per_cell: int = 256
    rows_per_file: int = 1_000_000
    pq_m: int | None = None  # sub-spaces of product-quantised codes; None: no codes
    encoder_path: str | None = None
    encoder_file: str | None = None

    def pruned(self, rows: int) -> bool:
        """Whether the corpus is large enough for cells."""
        return rows >= self.nlist * self.rows_per_cell


@dataclass(frozen=True)
class Index:
    spec: Spec
    corpus: DataFrame
    classes: DataFrame
    centroids: DataFrame | None
    meta: dict
    books: np.ndarray | None = None

    def model(self) -> classify.Model:
        s = self.spec
        kernel = Kernel(k=s.k, gamma=s.gamma, tau=s.tau, margin=s.margin)
        return classify.Model(
            self.corpus, s.id, s.label, s.embedding, s.sep, s.n, kernel, s.anchor_to_global, s.renormalize, centroids=self.centroids, nprobe=s.nprobe
        )

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, qid: str = "qid", coded: bool = False) -> DataFrame:
        """The nearest rows: in the probed cells if the index has cells, else exact. ``coded`` reads
        the codes instead of the vectors, a byte for each sub-space, with distances of that precision."""
        s = self.spec
        if coded and self.books is None:
            raise ValueError("the index has no codes: build it with pq_m")
        options = dict(id=s.id, qid=qid, embedding=s.embedding, books=self.books if coded else None)
        if self.centroids is None:
            return knn.distances(self.corpus, queries, k, **options)
        return knn.probe(self.corpus, self.centroids, queries, k, nprobe or s.nprobe, **options)


def prepared(df: DataFrame, *, languages: Sequence[str] | None = None, min_count: int = 10, label: str = "label", sentence: str = "sentence") -> DataFrame:
    """Rows fit for an index: complete, in the languages, of labels with enough rows. Labels are
    composed from domain and intent where there is no label column."""
    from vectrail.functions.labels import compose
    from vectrail.functions.text import strip_slots

    if label not in df.columns:
        df = cleaned(df, ["domain", "intent", sentence]).withColumn(label, compose(F.col("domain"), F.col("intent")))
    else:
        df = cleaned(df, [label, sentence])
    if "embedding" not in df.columns:
        df = df.withColumn(sentence, strip_slots(F.col(sentence))).where(F.length(sentence) > 0)
    if languages is not None:
        df = in_languages(df, languages)
    return at_least(df, label, min_count)


def _books(sample: DataFrame, spec: Spec, dims: int) -> np.ndarray:
    """(sub-spaces, codes, length): k-means centres of each slice of the sample's vectors."""
    if dims % spec.pq_m:
        raise ValueError(f"{dims} dimensions can't be cut in {spec.pq_m} sub-spaces")
    size, found = dims // spec.pq_m, []
    for j in range(spec.pq_m):
        own = sample.select(array_to_vector(F.slice(spec.embedding, j * size + 1, size)).alias("_f"))
        centres = np.array(KMeans(k=256, seed=42 + j, featuresCol="_f", maxIter=10).fit(own).clusterCenters())
        found.append(np.concatenate([centres, np.repeat(centres[:1], 256 - len(centres), axis=0)]))
    return np.array(found)


def _coded(rows: DataFrame, books: np.ndarray, embedding: str) -> DataFrame:
    """With ``code``: the nearest centre of each slice, a byte each."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("binary")
    def code(vectors: pd.Series) -> pd.Series:
        books = shared.value
        x = np.stack([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), len(books), -1)
        near = [((b**2).sum(1) - 2 * x[:, j] @ b.T).argmin(1) for j, b in enumerate(books)]
        return pd.Series([bytes(r) for r in np.stack(near, axis=1).astype(np.uint8)])

    return rows.withColumn("code", code(F.col(embedding)))


def build(df: DataFrame, path: str, spec: Spec = Spec(), cells: bool | None = None) -> Index:
    """Writes an index of (id, label, embedding). The quantiser is trained on a bounded sample by
    md5 order; assignment is one pass and one write partitioned by cell."""
    spark = df.sparkSession
    rows = df.withColumn(spec.embedding, unit(F.col(spec.embedding)))
    n = rows.count()
    levels = depth(rows, spec.label, spec.sep)
    cells = spec.pruned(n) if cells is None else cells
    if spec.pq_m and n:
        sample = fixed_sample(rows, spec.id, min(n, 256 * spec.train_rows_per_cell))
        books = _books(sample, spec, len(rows.first()[spec.embedding]))
        spark.createDataFrame([(j, b.tolist()) for j, b in enumerate(books)], "part int, book array<array<double>>").write.mode("overwrite").parquet(f"{path}/books")
        rows = _coded(rows, books, spec.embedding)
    class_dim(rows, spec.label, levels, spec.sep).write.mode("overwrite").parquet(f"{path}/classes")
    sizes = rows.groupBy(level_class(F.col(spec.label), 1, spec.sep).alias("d")).count().agg(F.min("count")).first()
    if cells:
        featured = rows.withColumn("_f", array_to_vector(spec.embedding))
        sample = fixed_sample(featured, spec.id, min(n, spec.nlist * spec.train_rows_per_cell))
        model: KMeansModel = KMeans(k=min(spec.nlist, n), seed=42, featuresCol="_f", predictionCol="cell", distanceMeasure="cosine", maxIter=10).fit(sample)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        table = spark.createDataFrame(centres, "cell int, embedding array<double>")
        table = table.withColumn("embedding", unit(F.col("embedding"))).withColumnRenamed("embedding", spec.embedding)
        table.write.mode("overwrite").parquet(f"{path}/centroids")
        placed = model.transform(featured).drop("_f")
        # A large cell is written by several tasks.
        files = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / spec.rows_per_file).alias("_files"))
        placed = placed.join(F.broadcast(files), "cell").withColumn("_file", F.pmod(F.xxhash64(spec.id), F.col("_files"))).drop("_files")
        placed.repartition("cell", "_file").drop("_file").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/corpus")
    else:
        rows.write.mode("overwrite").parquet(f"{path}/corpus")
    meta = {"spec": asdict(spec), "rows": n, "levels": levels, "cells": cells, "codes": bool(spec.pq_m and n), "min_domain_rows": sizes[0] if sizes else None}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return load(spark, path)


def load(spark: SparkSession, path: str, **changes) -> Index:
    """An index at any path that Spark can read. ``changes`` override saved parameters."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    known = {k: v for k, v in meta["spec"].items() if k in Spec.__dataclass_fields__}
    spec = Spec(**(known | changes))
    centroids = spark.read.parquet(f"{path}/centroids") if meta["cells"] else None
    books = None
    if meta.get("codes"):
        books = np.array([r["book"] for r in spark.read.parquet(f"{path}/books").orderBy("part").collect()])
    return Index(spec, spark.read.parquet(f"{path}/corpus"), spark.read.parquet(f"{path}/classes"), centroids, meta, books)


def sanity(index: Index, n: int = 5) -> DataFrame:
    """(n, n_correct, accuracy) of a few rows of the corpus predicted again."""
    s = index.spec
    some = fixed_sample(index.corpus, s.id, n, "0").select(F.col(s.id).alias("qid"), s.label, s.embedding)
    return classify.accuracy(classify.predict(index.model(), some.select("qid", s.embedding)), some, label=s.label)
