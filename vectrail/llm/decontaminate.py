"""Benchmark decontamination: size-partitioned MinHash containment, verified exactly.

An item is contained in a document when the document has at least ``percent`` of the item's distinct
shingles: runs of five words, or the one run of all its words if it has fewer. Items are partitioned
by their number of shingles (powers of two) and the length of their runs. A partition fixes how
many of an item's smallest hashes, its MinHash sketch, are kept: one more than the shingles that a
contained item of the partition's upper size may miss. The greatest hash that any of a partition's
sketches has is the partition's limit, and a document's sketch for the partition is all its hashes
within that limit: a sketch by limit, as one of fixed length would lose short items in long
documents. By the pigeonhole principle a document that contains an item shares a hash of both
sketches. Items of which it has enough (sketch size less misses) are counted over all their shingles.
Recall is 1.

Words are as told by ASCII white space, A-Z lower-cased and ASCII punctuation dropped.

Scale: items within ``block_items`` and ``block_chars`` go to every task: one pass over the documents,
no shuffle. Beyond that, it is one pass too: distinct hashes of the documents' sketches meet those of
the items in a join by hash, and the candidates' texts and items are verified document by document;
shuffled are the documents' sketches (up to 24 bytes a word) and the texts of candidates. Texts are told
by 128 bits of hash there. Nothing of the documents and, beyond the bound, of the items goes to the
driver but a limit for each partition.

Defined results: null and empty texts contain nothing and are contained nowhere; an item of one word
is contained wherever the word is; repeated documents and items each give their own rows; ids may be
of any type; empty tables give no rows. ``search`` carries the key columns only; ``clean`` keeps all
columns of the documents, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm import words as W
from vectrail.llm.common import kept_rows
from vectrail.sources.scratch import tables, written

SHINGLE = 5
_BITS = 22
_TOP = W.U(1 << 63)


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-percent * n // 100)


def described(texts: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """The sorted shingles of each item, and the length of their runs."""
    words, bounds = W.hashed_words(texts, strip=True)
    runs = [min(SHINGLE, b - a) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return [np.unique(W.windows(words[a:b], r)) for a, b, r in zip(bounds[:-1], bounds[1:], runs, strict=True)], runs


def sketched(own: np.ndarray, percent: int) -> np.ndarray:
    upper = (1 << len(own).bit_length()) - 1
    return own[: upper - needed(upper, percent) + 1]


def enough(own: np.ndarray, percent: int) -> int:
    """Hashes of its sketch that a document with an item has at least."""
    return len(sketched(own, percent)) - (len(own) - needed(len(own), percent))


class Texts:
    """Hashes of all runs of several texts."""

    def __init__(self, texts: list[bytes]):
        self.words, self.bounds = W.hashed_words(texts, strip=True)

    def runs(self, length: int) -> np.ndarray:
        return W.windows(self.words, length)

    def rows(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The texts in which runs begin, and whether they end there too."""
        row = np.searchsorted(self.bounds, places, side="right") - 1
        return row, places + length <= self.bounds[row + 1]

    def set_of(self, row: int, length: int) -> np.ndarray:
        return np.unique(W.windows(self.words[self.bounds[row] : self.bounds[row + 1]], length))


def shared_with(own: np.ndarray, text_set: np.ndarray) -> int:
    if not len(own) or not len(text_set):
        return 0
    j = np.minimum(np.searchsorted(text_set, own), len(text_set) - 1)
    return int((text_set[j] == own).sum())


class Partition:
    """The sketches of items of one size and run length, by hash."""

    def __init__(self, members: list[int], sketches: list[np.ndarray]):
        every = np.concatenate([sketches[k] for k in members])
        who = np.concatenate([np.full(len(sketches[k]), k) for k in members])
        order = np.argsort(every, kind="stable")
        self.hash, first = np.unique(every[order], return_index=True)
        self.owner, self.bounds = who[order], np.append(first, len(every))
        self.limit = self.hash[-1]


class Matcher:
    """Partitioned sketches of items."""

    def __init__(self, texts: list[bytes], percent: int):
        self.sets, self.run = described(texts)
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.need = needed(self.size, percent)
        self.hits = [enough(s, percent) for s in self.sets]
        sketches = [sketched(s, percent) for s in self.sets]
        members: dict[tuple[int, int], list[int]] = {}
        for k, own in enumerate(self.sets):
            if len(own):
                members.setdefault((self.run[k], len(own).bit_length()), []).append(k)
        self.partitions: dict[int, list[Partition]] = {}
        for (run, _), own in sorted(members.items()):
            self.partitions.setdefault(run, []).append(Partition(own, sketches))
        self.seen = {run: np.zeros(1 << _BITS, bool) for run in self.partitions}
        for run, parts in self.partitions.items():
            for part in parts:
                self.seen[run][part.hash >> W.U(64 - _BITS)] = True

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of contained items, by row and item."""
        docs, hits = Texts(texts), {}
        for run, parts in self.partitions.items():
            own = docs.runs(run)
            some = np.flatnonzero(self.seen[run][own >> W.U(64 - _BITS)])
            for part in parts:
                at = some[own[some] <= part.limit]  # the documents' sketches for this partition
                place = np.searchsorted(part.hash, own[at])
                same = part.hash[np.minimum(place, len(part.hash) - 1)] == own[at]
                row, inside = docs.rows(at[same], run)
                for k, j in set(zip(row[inside].tolist(), place[same][inside].tolist(), strict=True)):
                    for item in part.owner[part.bounds[j] : part.bounds[j + 1]].tolist():
                        hits[k, item] = hits.get((k, item), 0) + 1
        found, last, text_set = [], None, None
        for (k, item), n in sorted(hits.items(), key=lambda x: (x[0][0], self.run[x[0][1]], x[0][1])):
            if n >= self.hits[item]:
                if (k, self.run[item]) != last:
                    last = (k, self.run[item])
                    text_set = docs.set_of(*last)
                shared = shared_with(self.sets[item], text_set)
                if shared >= self.need[item]:
                    found.append((k, item, shared))
        return sorted(found)


def _small(items: DataFrame, block_items: int, block_chars: int) -> bool:
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    return size["n"] <= block_items and size["chars"] <= block_chars


def _matcher(items: DataFrame, percent: int) -> tuple[list[int], Matcher]:
    found = items.collect()
    return [r["iid"] for r in found], Matcher([r["text"].encode() for r in found], percent)


def _longs(x: np.ndarray) -> pa.Array:
    """Hashes as longs of the same order."""
    return pa.array((x ^ _TOP).view(np.int64))


def _item_sketches(items: DataFrame, percent: int) -> DataFrame:
    """(iid, run, part, hits, need, size, sketch, shingles) of each item."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, runs = described(W.texts_of(batch.column("text")))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("iid"), pa.array(runs, pa.int32()), pa.array([len(s).bit_length() for s in sets], pa.int32()),
                pa.array([enough(s, percent) if len(s) else 0 for s in sets], pa.int64()), pa.array([needed(len(s), percent) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([_longs(sketched(s, percent)) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ],
            ["iid", "run", "part", "hits", "need", "size", "sketch", "shingles"],
        )

    schema = "iid long, run int, part int, hits long, need long, size long, sketch array<long>, shingles binary"
    return items.select("iid", "text").mapInArrow(W.mapped(work, "text"), schema).where("size > 0")


def _text_sketches(texts: DataFrame, limits: dict[int, int]) -> DataFrame:
    """(a, b, run, hash): the distinct hashes of each text (a, b) within a run length's limit."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = Texts(W.texts_of(batch.column("text")))
        rows, runs, hashes = [], [], []
        for run, limit in limits.items():
            own = docs.runs(run)
            at = np.flatnonzero((own ^ _TOP).view(np.int64) <= limit)
            row, inside = docs.rows(at, run)
            row, own = row[inside], own[at[inside]]
            order = np.lexsort((own, row))
            row, own = row[order], own[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (own[1:] != own[:-1])
            rows.append(row[new])
            hashes.append(own[new])
            runs.append(np.full(int(new.sum()), run, np.int32))
        row = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays(
            [batch.column("a").take(row), batch.column("b").take(row), pa.array(np.concatenate(runs)), _longs(np.concatenate(hashes))], ["a", "b", "run", "hash"]
        )

    return texts.mapInArrow(W.mapped(work, "text"), "a long, b long, run int, hash long")


def _key(text: Column) -> list[Column]:
    """Two independent hashes that tell a text."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b")]


def _by_hash(docs: DataFrame, text: str, items: DataFrame, percent: int) -> DataFrame:
    """(a, b, iid, n_item, n_shared) of the texts (a, b) that contain items, for any number of items."""
    own = F.col(f"`{text}`")
    with tables() as scratch:
        texts = docs.where(own.isNotNull() & (own != "")).select(*_key(own), own.alias("text"))
        about = scratch.written(_item_sketches(items, percent), "items")
        limits = {r["run"]: r["m"] for r in about.groupBy("run").agg(F.max(F.array_max("sketch")).alias("m")).collect()}
        parts = about.groupBy("run", "part").agg(F.max(F.array_max("sketch")).alias("limit"))
        if not limits:
            return docs.sparkSession.createDataFrame([], "a long, b long, iid long, n_item long, n_shared long")
        sketches = about.join(F.broadcast(parts), ["run", "part"]).select("run", "part", "limit", "iid", "hits", F.explode("sketch").alias("hash"))
        met = _text_sketches(texts, limits).join(sketches, ["run", "hash"]).where(F.col("hash") <= F.col("limit"))
        # A repeated text meets an item's hash once for each of its rows: distinct hashes count.
        some = met.groupBy("a", "b", "iid", "hits").agg(F.countDistinct("hash").alias("n")).where("n >= hits").select("a", "b", "iid")
        some = scratch.written(some, "candidates")
        left = some.join(about.select("iid", "run", "need", "size", "shingles"), "iid")
        right = texts.join(some.select("a", "b").distinct(), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.min("text").alias("text"))

        def check(left: pa.Table, right: pa.Table) -> pa.Table:
            found, sets = [], {}
            docs = Texts(W.texts_of(right.column("text").combine_chunks()) if right.num_rows else [b""])
            for r in left.to_pylist():
                if r["run"] not in sets:
                    sets[r["run"]] = docs.set_of(0, r["run"])
                shared = shared_with(np.frombuffer(r["shingles"], W.U), sets[r["run"]])
                if shared >= r["need"]:
                    found.append((r["a"], r["b"], r["iid"], r["size"], shared))
            names = ["a", "b", "iid", "n_item", "n_shared"]
            return pa.table({n: pa.array([x[j] for x in found], pa.int64()) for j, n in enumerate(names)})

        found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(check, "a long, b long, iid long, n_item long, n_shared long")
        return written(found, "contained")


def _numbered(items: DataFrame, item: str, text: str) -> DataFrame:
    own = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null")
    return written(own.withColumn("iid", F.monotonically_increasing_id()), "items")


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    keys: Sequence[str],
    item: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    percent: int = 80,
    block_items: int = 50_000,
    block_chars: int = 1 << 25,
) -> DataFrame:
    """``keys``, item, n_item, n_shared and containment of every contained item."""
    known = _numbered(items, item, item_text)
    rows = docs.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col(f"`{text}`").alias("_text"))
    names = [f"_k{i}" for i in range(len(keys))]
    if _small(known, block_items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(_matcher(known, percent))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, matcher = shared.value
            found = matcher.find(W.texts_of(batch.column("_text")))
            at = pa.array([k for k, _, _ in found], pa.int64())
            columns = [[ids[j] for _, j, _ in found], [int(matcher.size[j]) for _, j, _ in found], [n for _, _, n in found]]
            return pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in names), *(pa.array(c, pa.int64()) for c in columns)], [*names, "iid", "n_item", "n_shared"])

        kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
        found = rows.mapInArrow(W.mapped(work, "_text"), ", ".join([*kinds, "iid long, n_item long, n_shared long"]))
        known = F.broadcast(known.select("iid", "item"))
    else:
        found = rows.select(*names, *_key(F.col("_text"))).join(_by_hash(rows, "_text", known, percent), ["a", "b"])
    return found.join(known.select("iid", "item"), "iid").select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)],
        F.col("item").alias(item),
        "n_item",
        "n_shared",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def clean(
    docs: DataFrame, items: DataFrame, *, item: str = "item_id", text: str = "text", percent: int = 80,
    block_items: int = 50_000, block_chars: int = 1 << 25, broadcast_texts: int = 500_000,
) -> DataFrame:
    """The documents that contain no item."""
    known = _numbered(items, item, "text")
    if not _small(known, block_items, block_chars):
        gone = written(_by_hash(docs, text, known, percent).select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct(), "gone")
        if gone.count() <= broadcast_texts:
            gone = F.broadcast(gone)
        a, b = _key(F.col(f"`{text}`"))
        return docs.join(gone, (a == F.col("_a")) & (b == F.col("_b")), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(_matcher(known, percent)[1])

    def keep(texts: list[bytes]) -> np.ndarray:
        own = np.ones(len(texts), bool)
        own[[k for k, _, _ in shared.value.find(texts)]] = False
        return own

    return kept_rows(docs, text, keep)


ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(regexp_replace(text, '[!-/:-@\[-`{-~]+', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents where text is not null),
i as (select row_number() over () as iid, item_id, regexp_extract_all(translate(regexp_replace(text, '[!-/:-@\[-`{-~]+', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from benchmark where text is not null),
runs as (select distinct least(5, len(ws)) as run from i where len(ws) > 0),
ds as (select distinct rid, doc_id, run, array_to_string(ws[k:k + run - 1], ' ') as sh
    from (select rid, doc_id, ws, run, unnest(range(1, len(ws) - run + 2)) as k from d, runs where len(ws) >= run)),
si as (select distinct iid, item_id, run, array_to_string(ws[k:k + run - 1], ' ') as sh
    from (select iid, item_id, ws, least(5, len(ws)) as run, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as k from i where len(ws) > 0)),
size as (select iid, count(*) as n_item from si group by iid)
select doc_id, item_id, n_item, count(*) as n_shared, count(*) / n_item as containment
from ds join si using (run, sh) join size using (iid) group by rid, doc_id, iid, item_id, n_item having 100 * count(*) >= 80 * n_item
"""
