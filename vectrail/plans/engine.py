"""One object from a configuration to matches: index, encoder, registry, tiers and streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectrail.functions.encoders import EncoderSpec, encode
from vectrail.operators import classify, gate
from vectrail.sources import index_store
from vectrail.sources.scratch import written
from vectrail.streaming import registry_stream

#: Settings that change saved parameters of the index.
INDEX = ("k", "n", "nprobe", "gamma", "tau", "margin", "anchor_to_global", "renormalize")


class Engine:
    """An index at ``index``, any path that Spark reads, matched against a registry of intents.

    Settings: ``index``; any of INDEX; ``tiers`` (name -> least probability); ``ignore``;
    ``renormalize_matches``; ``encoder`` (an EncoderSpec). Until a registry is synced only special
    labels match.
    """

    def __init__(self, spark: SparkSession, settings: Mapping):
        unknown = set(settings) - {"index", "tiers", "ignore", "renormalize_matches", "encoder", *INDEX}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        self.spark = spark
        self.index = index_store.load(spark, settings["index"], **{k: settings[k] for k in INDEX if k in settings})
        self.encoder: EncoderSpec = settings.get("encoder") or EncoderSpec()
        base = gate.Gate()
        self.gate = gate.Gate(tiers=dict(settings.get("tiers", base.tiers)), ignore=tuple(settings.get("ignore", ())), renormalize=settings.get("renormalize_matches", False))
        self.intents = spark.createDataFrame([], "intent string")

    def sync(self, *manifests: DataFrame) -> bool:
        """Replaces the registry, unless the manifests (intent) name none. The registry is written,
        so that later changes of its sources change no match."""
        new = written(gate.registry(*manifests, ignore=self.gate.ignore), "registry") if manifests else None
        if new is None or new.isEmpty():
            return False
        self.intents = new
        return True

    def domains(self) -> DataFrame:
        return gate.active_domains(self.intents, self.gate)

    def embedded(self, utterances: DataFrame, qid: str = "qid") -> DataFrame:
        """(qid, embedding) of (qid, utterance)."""
        return utterances.select(qid, encode(F.col("utterance"), self.encoder, query=True).alias("embedding"))

    def predict(self, queries: DataFrame, qid: str = "qid", **options) -> DataFrame:
        queries = queries if "embedding" in queries.columns else self.embedded(queries, qid)
        return classify.predict_proba(self.index.model(), queries, qid=qid, **options)

    def candidates(self, queries: DataFrame, sessions: DataFrame | None = None, qid: str = "qid") -> DataFrame:
        domains = [r[0] for r in self.domains().collect()]
        return gate.candidates(self.predict(queries, qid, domains=domains), self.intents, sessions=sessions, qid=qid, gate=self.gate)

    def match(self, queries: DataFrame, tier: str, sessions: DataFrame | None = None, qid: str = "qid") -> DataFrame:
        said = queries if "utterance" in queries.columns else None
        return gate.match(self.candidates(queries, sessions, qid), tier, utterances=said, qid=qid, gate=self.gate)

    def stream(self, queries: DataFrame, registry_path: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
        """Matches of all tiers for a stream of queries, against the kept registry at a path."""
        return registry_stream.match_stream(queries, lambda batch: self.predict(batch).select("qid", "label", "prob"), registry_path, sink, checkpoint, self.gate)
