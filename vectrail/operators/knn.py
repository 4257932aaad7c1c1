"""k-nearest-neighbour joins by normalised angular distance, exact and pruned by cells.

Up to ``block`` queries (a checked count) go to every task, which multiplies its vectors with them in
one scan of the corpus. More queries never reach the driver: blocks of them meet chunks of the
corpus in a cogroup, each pair of which fits a task. With cells, only the rows of a query's nearest
cells are looked at: partitions of the corpus that no query probes are not read, or, beyond
``block`` queries, cells meet their queries in the cogroup, large cells in several parts.

A task emits its own nearest ``k`` of each query and group, merged over its batches; of these,
``margin`` leaves only what is as near to the nearest. Ties in distance go to the lower id.

With code books the vectors are read back from product-quantised codes, a byte a sub-space, and only
the codes are read; distances are those of what the codes stand for.

Defined results: an empty corpus or no queries give no rows; vectors of different lengths are an
error; repeated rows each count; a null vector has no neighbours and is none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vectrail.functions.vectors import angle

#: Products of a task's vectors with so many queries at once.
STRIP = 256
#: Rows of a corpus chunk in the cogroup.
CHUNK = 200_000


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


@dataclass(frozen=True)
class _Plan:
    """What is kept of each query's rows."""

    id: str
    within: tuple[str, ...]
    kept: tuple[str, ...]
    k: int
    margin: float | None
    whole: bool  # the margin counts from the nearest of all groups
    inside: str | None  # rows where this is false give only their nearest
    books: np.ndarray | None = None  # (sub-spaces, codes, length): vectors are given as codes

    def most(self, inside: np.ndarray) -> np.ndarray:
        return np.where(inside, self.k, 1)


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """A number for each distinct combination of values."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        own = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out = np.unique(out * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return out


def _nearest(d: np.ndarray, pools: list[tuple[np.ndarray, int]], plan: _Plan) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of the nearest rows of each pool, whose rows are in order of id."""
    who, which = [], []
    for pool, most in pools:
        own = d[:, pool]
        mask = np.ones(own.shape, bool)
        if own.shape[1] > most:
            last = np.partition(own, most - 1, axis=1)[:, most - 1 : most]
            less, same = own < last, own == last
            mask = less | (same & (same.cumsum(axis=1) <= most - less.sum(axis=1, keepdims=True)))
        if plan.margin is not None:
            mask &= own <= (d if plan.whole else own).min(axis=1, keepdims=True) + plan.margin + 1e-9
        q, j = np.nonzero(mask)
        who.append(q)
        which.append(pool[j])
    return np.concatenate(who), np.concatenate(which)


def _searched(rows: pa.Table, v: np.ndarray, q: np.ndarray, at: np.ndarray, plan: _Plan) -> Iterator[pa.Table]:
    """Rows (_q, kept, dist) of a batch for the queries at some places."""
    if q.shape[1] != v.shape[1]:
        raise ValueError(f"query vectors have {q.shape[1]} dimensions, the corpus has {v.shape[1]}")
    order = pa.compute.sort_indices(rows, [(plan.id, "ascending")]).to_numpy()
    groups = [rows.column(c) for c in plan.within]
    inside = np.ones(len(rows), bool) if plan.inside is None else rows.column(plan.inside).to_numpy(zero_copy_only=False).astype(bool)
    codes = _codes([*groups, pa.array(inside)])[order]
    cuts = np.argsort(codes, kind="stable")
    bounds = np.flatnonzero(np.diff(codes[cuts], prepend=-1, append=codes.max() + 1))
    pools = [(order[cuts[a:b]], int(plan.most(inside[order[cuts[a]]]))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for begin in range(0, len(at), STRIP):
        some = at[begin : begin + STRIP]
        d = np.arccos(np.clip(q[some] @ v.T, -1, 1)) / np.pi
        who, which = _nearest(d, pools, plan)
        own = rows.take(pa.array(which))
        yield own.append_column("_q", pa.array(some[who])).append_column("dist", pa.array(d[who, which]))


def _merged(found: list[pa.Table], plan: _Plan) -> pa.Table:
    """The nearest of what several batches gave."""
    t = pa.concat_tables(found)
    if len(found) < 2 or not len(t):
        return t
    t = t.sort_by([(c, "ascending") for c in ("_q", *plan.within, *([plan.inside] if plan.inside else []), "dist", plan.id)]).combine_chunks()
    q, dist = t.column("_q").to_numpy(), t.column("dist").to_numpy()
    inside = np.ones(len(t), bool) if plan.inside is None else t.column(plan.inside).to_numpy(zero_copy_only=False).astype(bool)
    code = _codes([t.column(c) for c in ("_q", *plan.within)] + [pa.array(inside)])
    new = np.diff(code, prepend=-1) != 0
    first = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    keep = np.arange(len(t)) - first < plan.most(inside)
    if plan.margin is not None:
        low = dist[first]
        if plan.whole:
            least = np.full(q.max() + 1, np.inf)
            np.minimum.at(least, q, dist)
            low = least[q]
        keep &= dist <= low + plan.margin + 1e-9
    return t.filter(pa.array(keep))


class _Search:
    """Collects the nearest rows of batches."""

    def __init__(self, ids: pa.Array, q: np.ndarray, probes: dict | None, plan: _Plan, qid: str, embedding: str):
        self.ids, self.q, self.probes, self.plan, self.qid, self.embedding = ids, q, probes, plan, qid, embedding
        self.found: list[pa.Table] = []
        self.size, self.least = 0, 200_000

    def add(self, batch: pa.Table) -> None:
        batch = batch.filter(batch.column(self.embedding).is_valid())
        if not len(batch) or not len(self.q):
            return
        v = self.vectors(batch.column(self.embedding))
        kept = batch.select([*self.plan.kept])
        if self.probes is None:
            parts = [(np.arange(len(v)), np.arange(len(self.q)))]
        else:
            cell = batch.column("cell").to_numpy()
            parts = [(np.flatnonzero(cell == c), self.probes[c]) for c in np.unique(cell).tolist() if c in self.probes]
        for rows, at in parts:
            for t in _searched(kept.take(pa.array(rows)), v[rows], self.q, at, self.plan):
                self.found.append(t)
                self.size += len(t)
        if self.size > self.least:
            self.found = [_merged(self.found, self.plan)]
            self.size = len(self.found[0])
            self.least = 2 * self.size + 200_000

    def vectors(self, column: pa.ChunkedArray) -> np.ndarray:
        books = self.plan.books
        if books is None:
            return _matrix(column)
        codes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), len(books))
        return unit_rows(np.concatenate([book[codes[:, j]] for j, book in enumerate(books)], axis=1))

    def result(self) -> pa.Table | None:
        if not self.found:
            return None
        t = _merged(self.found, self.plan).combine_chunks()
        own = pa.table({self.qid: self.ids.take(t.column("_q").combine_chunks())})
        for c in (*self.plan.kept, "dist"):
            own = own.append_column(c, t.column(c))
        return own


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _few(queries: DataFrame, qid: str, embedding: str, block: int) -> tuple[pa.Array, np.ndarray] | None:
    """Ids and vectors of at most ``block`` queries, else None."""
    rows = queries.select(qid, embedding).where(F.col(embedding).isNotNull()).limit(block + 1).collect()
    if len(rows) > block:
        return None
    return pa.array([r[0] for r in rows], to_arrow_type(queries.schema[qid].dataType)), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)


def _cells(centroids: DataFrame, q: np.ndarray, nprobe: int, embedding: str) -> dict[int, np.ndarray]:
    """The queries that probe each cell. An index has few centroids."""
    rows = centroids.select("cell", embedding).collect()
    cell = np.array([r[0] for r in rows])
    order = np.argsort(cell)
    cell, c = cell[order], np.array([r[1] for r in rows], np.float64)[order]
    if not len(q):
        return {}
    near = cell[np.argsort(-np.clip(q @ c.T, -1, 1), axis=1, kind="stable")[:, :nprobe]]
    return {int(x): np.flatnonzero((near == x).any(axis=1)) for x in np.unique(near)}


def nearest(
    corpus: DataFrame, queries: DataFrame, k: int, *, id: str = "vec_id", qid: str = "qid", embedding: str = "embedding",
    within: Sequence[str] = (), carry: Sequence[str] = (), inside: str | None = None, margin: float | None = None, whole: bool = False,
    centroids: DataFrame | None = None, nprobe: int = 32, books: np.ndarray | None = None, code: str = "code", block: int = 20_000,
) -> DataFrame:
    """(qid, id, within and carry columns, dist), with the nearest ``k`` rows of each query and
    value of ``within`` among others: what ``distances`` ranks."""
    kept = tuple(dict.fromkeys([id, *within, *carry, *([inside] if inside else [])]))
    plan = _Plan(id, tuple(within), kept, k, margin, whole, inside, books)
    kinds = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    schema = ", ".join([f"`{qid}` {queries.schema[qid].dataType.simpleString()}", *(f"`{c}` {kinds[c]}" for c in kept), "dist double"])
    if books is not None:
        corpus = corpus.drop(embedding).withColumnRenamed(code, embedding)
    columns = [*kept, embedding, *(["cell"] if centroids is not None and "cell" not in kept else [])]
    rows = corpus.select(*columns)
    few = _few(queries, qid, embedding, block)
    if few is None:
        return _grid(rows, queries, plan, schema, qid, embedding, centroids, nprobe, block)
    ids, q = few
    probes = None if centroids is None else _cells(centroids, q, nprobe, embedding)
    if probes is not None:
        rows = rows.where(F.col("cell").isin(list(probes)))
    shared = corpus.sparkSession.sparkContext.broadcast((ids, q, probes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        search = _Search(*shared.value, plan, qid, embedding)
        for batch in batches:
            search.add(pa.Table.from_batches([batch]))
        found = search.result()
        if found is not None:
            yield from found.to_batches()

    return rows.mapInArrow(run, schema)


def _grid(rows: DataFrame, queries: DataFrame, plan: _Plan, schema: str, qid: str, embedding: str, centroids: DataFrame | None, nprobe: int, block: int) -> DataFrame:
    """Blocks of queries against chunks of the corpus, or of the cells that they probe."""
    asked = queries.select(F.col(qid).alias("_qid"), F.col(embedding).alias("_vector")).where("_vector is not null")
    spread: Callable[[Column, Column], Column] = lambda c, n: F.pmod(F.xxhash64(c), n)
    each: Callable[[Column], Column] = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    if centroids is None:
        rows, asked = rows.withColumn("_cell", F.lit(0)), asked.withColumn("_cell", F.lit(0))
    else:
        near = distances(centroids, asked, nprobe, id="cell", qid="_qid", embedding="_vector", corpus_embedding=embedding, block=block)
        asked = asked.join(near.select("_qid", F.col("cell").alias("_cell")), "_qid")
        rows = rows.withColumn("_cell", F.col("cell"))
    count = lambda df, size, name: df.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias(name))
    parts = count(rows, CHUNK, "_chunks").join(count(asked, block, "_blocks"), "_cell")
    left = rows.join(parts, "_cell").withColumn("_c", spread(F.col(plan.id), F.col("_chunks"))).withColumn("_b", each(F.col("_blocks")))
    right = asked.join(parts, "_cell").withColumn("_b", spread(F.col("_qid"), F.col("_blocks"))).withColumn("_c", each(F.col("_chunks")))
    keys = ["_cell", "_c", "_b"]
    left, right = left.drop("_chunks", "_blocks"), right.drop("_chunks", "_blocks")
    names = [qid, *plan.kept, "dist"]

    def work(own: pa.Table, asked: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        search = _Search(asked.column("_qid").combine_chunks(), _matrix(asked.column("_vector")), None, plan, qid, embedding)
        for at in range(0, len(own) if len(asked) else 0, 10_000):
            search.add(own.slice(at, 10_000))
        found = search.result()
        if found is not None:
            return found
        empty = {qid: asked.schema.field("_qid").type, **{c: own.schema.field(c).type for c in plan.kept}, "dist": pa.float64()}
        return pa.table({n: pa.array([], empty[n]) for n in names})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def distances(
    corpus: DataFrame, queries: DataFrame, k: int, *, id: str = "vec_id", qid: str = "qid", embedding: str = "embedding",
    within: Sequence[str] = (), corpus_embedding: str | None = None, **options,
) -> DataFrame:
    """(qid, id, dist, rank, within and carry columns): the ``k`` nearest rows of the corpus for
    each query, or for each query and value of ``within``."""
    if corpus_embedding:
        corpus = corpus.withColumnRenamed(corpus_embedding, embedding)
    found = nearest(corpus, queries, k, id=id, qid=qid, embedding=embedding, within=within, **options)
    window = Window.partitionBy(qid, *within).orderBy("dist", id)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _dims(corpus: DataFrame, queries: DataFrame, embedding: str) -> int:
    """The length of all vectors; 0 without vectors in either."""
    sizes = [df.where(F.col(embedding).isNotNull()).agg(F.min(F.size(embedding)), F.max(F.size(embedding))).first() for df in (queries, corpus)]
    if any(x[0] is None for x in sizes):
        return 0
    if len({*sizes[0], *sizes[1]}) > 1:
        raise ValueError(f"query vectors have {sizes[0][0]} to {sizes[0][1]} dimensions, the corpus has {sizes[1][0]} to {sizes[1][1]}")
    return sizes[0][0]


def by_expressions(
    corpus: DataFrame, queries: DataFrame, k: int, *, id: str = "vec_id", qid: str = "qid", embedding: str = "embedding", block: int = 20_000, part: int = 16
) -> DataFrame:
    """The same with built-in functions only: blocks of queries, each against all rows. Vectors are
    spread over columns, as functions of arrays are interpreted. Only what is as near as a bound of the query
    is ranked: one of every ``part`` rows is dealt to groups, the nearest of ``k`` groups are ``k``
    rows, and so the farthest of these is no nearer than the ``k``-th row of all."""
    dims = _dims(corpus, queries, embedding)
    spread = lambda df, key, name: df.where(F.forall(embedding, lambda x: x.isNotNull())).select(
        key, *[F.coalesce(F.col(embedding)[i].cast("double"), F.lit(0.0)).alias(f"{name}{i}") for i in range(dims)]
    )
    cores = corpus.sparkSession.sparkContext.defaultParallelism  # a small file is one task of a scan
    rows, every = spread(corpus.select(id, embedding).repartition(cores, id), id, "_v"), spread(queries, qid, "_q")
    dist = angle(sum((F.col(f"_v{i}") * F.col(f"_q{i}") for i in range(dims)), F.lit(0.0)))
    some = rows.where(F.pmod(F.xxhash64(id, F.lit("part")), F.lit(part)) == 0)
    group = F.pmod(F.xxhash64(id, F.lit("group")), F.lit(4 * k)).alias("_g")
    blocks = max(1, -(-queries.count() // block))
    found = None
    for b in range(blocks):
        asked = every.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b)
        least = some.crossJoin(F.broadcast(asked)).groupBy(qid, group).agg(F.min(dist).alias("_d")).groupBy(F.col(qid).alias("_qid"))
        least = least.agg(F.try_element_at(F.array_sort(F.collect_list("_d")), F.lit(k)).alias("_most"))
        asked = asked.join(least, F.col(qid) == F.col("_qid"), "left").drop("_qid")
        pairs = rows.crossJoin(F.broadcast(asked)).where(F.col("_most").isNull() | (dist <= F.col("_most"))).select(qid, id, dist.alias("dist"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy("dist", id))).where(F.col("rank") <= k)


def active(corpus: DataFrame, domains: Sequence[str] | None, column: str) -> DataFrame:
    """Rows of the active domains. None, none named or none known clears the filter."""
    if not domains:
        return corpus
    known = [r[0] for r in corpus.where(F.col(column).isin(list(domains))).select(column).distinct().collect()]
    return corpus.where(F.col(column).isin(known)) if known else corpus


def with_anchor(corpus: DataFrame, queries: DataFrame, k: int, inside, *, qid: str = "qid", id: str = "vec_id", **options) -> DataFrame:
    """The ``k`` nearest rows for which ``inside`` holds, and anchor: the distance of the nearest
    row of all. One scan serves both."""
    marked = corpus.withColumn("_inside", F.coalesce(inside, F.lit(False)))
    found = nearest(marked, queries, k, qid=qid, id=id, inside="_inside", **options)
    found = found.withColumn("anchor", F.min("dist").over(Window.partitionBy(qid))).where("_inside").drop("_inside")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy("dist", id))).where(F.col("rank") <= k)


def probe(corpus: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, **options) -> DataFrame:
    """Search in each query's ``nprobe`` nearest cells. The corpus has a ``cell`` column; written
    partitioned by it, other cells are not read. Centroids are (cell, embedding)."""
    return distances(corpus, queries, k, centroids=centroids, nprobe=nprobe, **options)
