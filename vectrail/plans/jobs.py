"""Whole jobs of the dataset pipeline, each one lazy plan from table to table."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import labels, text
from vectrail.functions.encoders import EncoderSpec, encode, encode_missing
from vectrail.functions.vectors import DIM
from vectrail.operators import analysis, relational
from vectrail.sources.scratch import written


def with_seed(df: DataFrame, columns: Sequence[str], name: str = "_seed") -> DataFrame:
    return df.withColumn(name, F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])))


def preprocess(df: DataFrame, missing: Sequence[str] = ()) -> DataFrame:
    """label, lang, entity, original_sentence, sentence and all other columns: labels normalised,
    entities named, slots filled from a seed of the row's own text."""
    relational.require(df, "label", "sentence", "lang")
    out = relational.cleaned(df, ["label", "sentence"], missing)
    out = out.withColumn("label", labels.normalize_label(F.col("label"))).withColumn("original_sentence", F.col("sentence"))
    out = out.withColumn("entity", text.entity(F.col("original_sentence")))
    out = with_seed(out, ["label", "lang", "original_sentence"])
    out = out.withColumn("sentence", text.fill_slots(F.col("original_sentence"), F.col("label"), F.col("lang"), F.col("_seed"))).drop("_seed")
    first = ["label", "lang", "entity", "original_sentence", "sentence"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_before, n_after, n_removed)."""
    a = before.agg(F.count(F.lit(1)).alias("n_before"))
    b = after.agg(F.count(F.lit(1)).alias("n_after"))
    return a.crossJoin(b).withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def encode_dataset(df: DataFrame, spec: EncoderSpec = EncoderSpec(), sentence: str = "sentence") -> DataFrame:
    """The table with an embedding; dim_* columns of an earlier run are dropped."""
    return df.drop(*[c for c in df.columns if DIM.fullmatch(c)]).withColumn("embedding", encode(F.col(sentence), spec))


def variants(df: DataFrame, n: int = 10) -> DataFrame:
    """``n`` refilled copies of every row with entities, without an embedding."""
    own = df.where((F.col("entity").isNotNull()) & (F.col("entity") != ""))
    own = with_seed(own, ["label", "lang", "original_sentence"]).withColumn("_v", F.explode(F.sequence(F.lit(1), F.lit(n))))
    seed = F.concat(F.col("_seed"), F.lit("#"), F.col("_v").cast("string"))
    own = own.withColumn("sentence", text.fill_slots(F.col("original_sentence"), F.col("label"), F.col("lang"), seed))
    if "embedding" in df.columns:
        own = own.withColumn("embedding", F.lit(None).cast(df.schema["embedding"].dataType))
    return own.select(*df.columns)


@dataclass(frozen=True)
class Balance:
    huge: int = 1_000_000
    large: int = 5_000
    small: int = 100
    variants: int = 10
    examples: int = 5


#: (label, lang, examples, needed) -> new sentences; runs in tasks, once a label and language.
Paraphrase = Callable[[str, str, list[str], int], list[str]]


def paraphrased(df: DataFrame, needs: DataFrame, provider: Paraphrase, examples: int = 5) -> DataFrame:
    """Rows (label, lang, sentence, error) that a provider makes for the labels of ``needs`` (label,
    needed). Where it fails, one row has the error and no sentence. The result is written once, as
    a provider need not answer the same twice."""
    own = df.select("label", "lang", "sentence").where("sentence is not null").distinct()
    place = F.row_number().over(Window.partitionBy("label", "lang").orderBy(F.md5("sentence"), "sentence"))
    some = own.join(needs, "label").withColumn("_k", place).where(F.col("_k") <= examples)
    some = some.groupBy("label", "lang", "needed").agg(F.array_sort(F.collect_list("sentence")).alias("examples"))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                try:
                    rows += [(r.label, r.lang, s, None) for s in provider(r.label, r.lang, list(r.examples), int(r.needed))]
                except Exception as e:  # noqa: BLE001  a provider may fail in any way: the error is a row
                    rows.append((r.label, r.lang, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["label", "lang", "sentence", "error"])

    return written(some.mapInPandas(ask, "label string, lang string, sentence string, error string"), "paraphrases")


def balance(df: DataFrame, sizes: Balance = Balance(), provider: Paraphrase | None = None, spec: EncoderSpec = EncoderSpec(), id: str = "id") -> DataFrame:
    """Labels brought towards equal size: the largest to medoids, large ones to a sample by
    language, small ones refilled and paraphrased; the rest stay. New rows are encoded last."""
    routed = relational.routed(df, "label", huge=sizes.huge, large=sizes.large, small=sizes.small)
    part = lambda t: routed.where(F.col("tier") == t).drop("label_count", "tier")
    out = part("keep").unionByName(relational.stratified_sample(part("sample"), "label", "lang", id, sizes.large))
    huge = [r["label"] for r in routed.where("tier = 'medoids'").select("label").distinct().collect()]
    for label in huge:  # one fit a label; there are few labels this large
        own = part("medoids").where(F.col("label") == label)
        near = analysis.medoids(own, sizes.large, id=id).select(id, F.col("centre").cast("array<float>").alias("_c"))
        out = out.unionByName(own.join(F.broadcast(near.dropDuplicates([id])), id).withColumn("embedding", F.col("_c")).select(*df.columns))
    short = part("augment")
    more = variants(short, sizes.variants) if "entity" in df.columns else short.limit(0)
    if provider is not None:
        grown = short.unionByName(more)
        needs = relational.counts(grown, "label").where(F.col("n") < sizes.small).select("label", (F.lit(sizes.small) - F.col("n")).cast("int").alias("needed"))
        made = paraphrased(short, needs, provider, sizes.examples)
        failed = made.where("error is not null").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("first")).first()
        if failed["n"]:
            warnings.warn(f"no paraphrases for {failed['n']} labels and languages, such as: {failed['first']}", stacklevel=2)
        new = made.where("error is null").drop("error")
        new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        short, more = relational.first_of(grown.unionByName(new).withColumn("_new", F.col("embedding").isNull()), ["label", "sentence"], ["_new", F.md5("sentence")]).drop("_new"), None
    out = out.unionByName(short)
    if more is not None:
        out = out.unionByName(more)
    return encode_missing(out, spec)


def diverse(df: DataFrame, full: DataFrame | None = None, caps: Mapping[str, int] | None = None, **options) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(compact subset, subset with domain and intent, stats)."""
    subset = analysis.diverse_subset(df, caps=caps, **options)
    compact = subset.select("lang", "label", "sentence")
    wide = None
    if full is not None:
        wide = relational.full_rows(compact, full, ["lang", "sentence"], ["domain", "intent"], ["domain", "intent"]).select("lang", "domain", "intent", "sentence")
    return compact, wide, analysis.subset_stats(df, subset).orderBy(F.desc("n_before"), "label")


def summary(stats: DataFrame) -> DataFrame:
    """(n_before, n_after, kept_pct, n_labels, div_before, div_after): totals, and means over labels."""
    before, after = F.sum("n_before"), F.sum("n_after")
    return stats.agg(
        before.alias("n_before"), after.alias("n_after"), F.round(100 * after / before, 1).alias("kept_pct"), F.count(F.lit(1)).alias("n_labels"),
        F.avg("div_before").alias("div_before"), F.avg("div_after").alias("div_after"),
    )


def trimmed(stats: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest labels that lost rows."""
    return stats.where("n_before > n_after").orderBy(F.desc("n_before"), "label").limit(n)


def plot_inputs(before: DataFrame, after: DataFrame, stats: DataFrame) -> dict[str, DataFrame]:
    """The figures behind the subset's plots, as tables."""
    top = stats.orderBy(F.desc("n_before"), "label").limit(30)
    gain = stats.withColumn("gain", F.col("div_after") - F.col("div_before"))
    return {
        "sizes": relational.log_histogram(stats, "n_before"),
        "kept": stats.groupBy((F.floor(F.col("kept_pct") / 10) * 10).alias("bin")).count(),
        "diversity": stats.select("label", "div_before", "div_after", "n_after"),
        "gain": gain.groupBy((F.floor(F.col("gain") / 0.02) * 0.02).alias("bin")).count(),
        "languages": relational.aligned_counts(before, after, "lang"),
        "dedup": top.select("label", "n_before", "n_deduped", "n_after").orderBy("n_before", F.desc("label")),
    }
