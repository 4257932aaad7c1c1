"""The registry of intents and matching, as Structured Streaming.

Change events (source, kind, intent, ts) update a keyed state that holds each intent's latest
change, so a source that falls silent keeps its last good snapshot. Queries are matched against
the snapshot as it is when their micro-batch starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectrail.operators import gate

EVENTS = "event_id long, ts timestamp, source string, kind string, intent string"


def changes(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latest(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(source, intent, kind, ts, event_id): each intent's change whenever it is newer than the one
    held. Late repeats of an event are dropped within the watermark."""
    own = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = (held[0], held[1]) if held else (-1, -1)
        newest = None
        for part in parts:
            row = part.sort_values(["ts", "event_id"]).iloc[-1]
            mark = (int(row["ts"].value // 1000), int(row["event_id"]))
            if mark > best:
                best, newest = mark, row
        if newest is not None:
            state.update((best[0], best[1], newest["kind"]))
            yield pd.DataFrame({"source": [key[0]], "intent": [key[1]], "kind": [newest["kind"]], "ts": [newest["ts"]], "event_id": [best[1]]})

    return own.groupBy("source", "intent").applyInPandasWithState(
        update, "source string, intent string, kind string, ts timestamp, event_id long", "ts long, event_id long, kind string", "update", "NoTimeout"
    )


KEY = ("source", "intent")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a kept snapshot, oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def _kept(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    known = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={known[-1]}") if known else None


def keep_version(batch: DataFrame, number: int, path: str) -> None:
    """The snapshot before ``number`` and a batch of changes, merged to each intent's latest change,
    as a version of its own; the last two stay. Its size is that of the registry, not of its history,
    and a replayed batch writes the same version again."""
    spark = batch.sparkSession
    held = _kept(spark, path, number)
    rows = batch if held is None else held.unionByName(batch.select(*held.columns))
    others = [c for c in rows.columns if c not in KEY]
    last = rows.groupBy(*KEY).agg(F.max(F.struct("ts", "event_id", *[c for c in others if c not in ("ts", "event_id")])).alias("x"))
    last.select(*KEY, *[F.col(f"x.{c}").alias(c) for c in others]).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")
    for old in [v for v in _versions(spark, path) if v < number - 1][:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keep_snapshot(events: DataFrame, path: str, checkpoint: str, seconds: int | None = 3, delay: str = "10 minutes") -> StreamingQuery:
    """Keeps the snapshot of changes at ``path``; batches debounce bursts of events. Without
    ``seconds`` the stream ends when all there is has been read."""
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    stream = latest(events, delay).writeStream.outputMode("update").foreachBatch(lambda batch, number: keep_version(batch, number, path))
    return stream.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def registered(spark: SparkSession, path: str, added: str = "register") -> DataFrame:
    """(intent) registered by any source, from a kept snapshot or a log of changes."""
    held = _kept(spark, path)
    log = spark.read.parquet(path) if held is None else held
    return gate.snapshot(log, key=KEY, order="event_id", added=added).select("intent").distinct()


def match_stream(queries: DataFrame, predict: Callable[[DataFrame], DataFrame], registry_path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, options: gate.Gate = gate.Gate()) -> StreamingQuery:
    """Matches of all tiers for a stream of queries (qid, embedding); ``predict`` gives (qid, label, prob)."""

    def run(batch: DataFrame, number: int) -> None:
        intents = registered(batch.sparkSession, registry_path)
        sink(gate.tiers(gate.candidates(predict(batch), intents, gate=options), gate=options), number)

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
