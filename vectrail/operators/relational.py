"""Row operators of the dataset pipeline: cleaning, counts, duplicates, samples, tiers, joins.

Samples are ordered by the md5 of a seed and a key, so they are the same on every run and engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions.labels import strip_all
from vectrail.functions.text import word_bag

#: Languages kept by default. Fixed values.
LANGUAGES = ("en", "pt", "es", "fr", "it", "de", "nl", "ca", "gl", "da", "eu")
#: What a lenient CSV reader takes as missing. Fixed values.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def require(df: DataFrame, *columns: str) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def cleaned(df: DataFrame, columns: Sequence[str], missing: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``columns`` are neither null nor blank (nor one of ``missing``)."""
    out = df.dropna(subset=list(columns))
    for c in columns:
        out = out.where(strip_all(F.col(c)) != "")
        if missing:
            out = out.where(~F.col(c).isin(list(missing)))
    return out


def in_languages(df: DataFrame, languages: Sequence[str] = LANGUAGES, lang: str = "lang") -> DataFrame:
    return df.where(F.col(lang).isin(list(languages)))


def at_least(df: DataFrame, label: str, count: int = 10) -> DataFrame:
    """Rows of labels with ``count`` rows or more. Counts are aggregated before the shuffle and
    joined back, so a hot label is never gathered."""
    kept = df.groupBy(label).count().where(F.col("count") >= count).select(label)
    return df.join(kept, label, "left_semi")


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def word_bag_distinct(df: DataFrame, sentence: str, seq: str, by: Sequence[str] = ()) -> DataFrame:
    """Of rows with the same set of words, the longest sentence (first on ties); first_seq is the
    earliest row of the set."""
    bag = F.to_json(word_bag(F.col(sentence)))
    own = df.withColumn("_bag", bag)
    window = Window.partitionBy(*by, "_bag")
    place = F.row_number().over(window.orderBy(F.desc(F.length(sentence)), seq))
    own = own.withColumn("_place", place).withColumn("first_seq", F.min(seq).over(window))
    return own.where("_place = 1").drop("_bag", "_place")


def md5_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def fixed_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows by md5 order."""
    return df.orderBy(md5_order(F.col(key), seed), key).limit(n)


def stratified_sample(df: DataFrame, label: str, stratum: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """For each label about ``n`` rows, shared among strata by size, each rounded up; a null
    stratum counts as 'und'."""
    own = df.withColumn("_s", F.coalesce(F.col(stratum), F.lit("und")))
    window = Window.partitionBy(label, "_s")
    total = own.groupBy(label).agg(F.count(F.lit(1)).alias("_all"))
    sizes = own.groupBy(label, "_s").agg(F.count(F.lit(1)).alias("_own")).join(total, label)
    sizes = sizes.withColumn("_take", F.ceil(F.col("_own") * n / F.col("_all"))).select(label, "_s", "_take")
    own = own.join(sizes, [label, "_s"])
    place = F.row_number().over(window.orderBy(md5_order(F.col(key), seed), key))
    return own.withColumn("_place", place).where(F.col("_place") <= F.col("_take")).drop("_s", "_take", "_place")


def tier(count: Column, huge: int = 1_000_000, large: int = 5_000, small: int = 100) -> Column:
    """What a label of ``count`` rows needs: medoids, sample, augment or keep."""
    return F.when(count >= huge, "medoids").when(count > large, "sample").when(count < small, "augment").otherwise("keep")


def routed(df: DataFrame, label: str, **sizes: int) -> DataFrame:
    """The rows with label_count and tier of their label."""
    found = df.groupBy(label).agg(F.count(F.lit(1)).alias("label_count"))
    return df.join(found.withColumn("tier", tier(F.col("label_count"), **sizes)), label)


def full_rows(subset: DataFrame, full: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join of a subset with the table it came from, one row for each (lang, label, sentence)."""
    one = first_of(full.select(*keys, *columns, *[c for c in order if c not in (*keys, *columns)]), keys, order).select(*keys, *columns)
    return subset.dropDuplicates().join(one, list(keys), "left")


def aligned_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, n_before, n_after) over the keys of either, missing ones 0."""
    a, b = counts(before, key).withColumnRenamed("n", "n_before"), counts(after, key).withColumnRenamed("n", "n_after")
    return a.join(b, key, "full_outer").fillna(0, ["n_before", "n_after"])


def log_histogram(df: DataFrame, value: str) -> DataFrame:
    """(bin, n): values from 10^bin up to 10^(bin + 1)."""
    return df.where(F.col(value) > 0).groupBy(F.floor(F.log10(F.col(value).cast("double")) + 1e-9).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
