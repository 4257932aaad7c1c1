"""URL filtering by hashed host-suffix and path-prefix expressions (DataFrame functions only).

Each URL is expanded into the expressions a rule could equal: every host suffix with as many
labels as some rule has, joined to every path prefix as long as some rule's path. Expressions
meet the rules in an equi-join on the first 32 bits of their SHA-256; the full digest is then
compared, and the longest confirmed rule wins (ties: longer host, then block before allow).

Scale: only the key columns and the url are read. The rules are broadcast when their count is
within ``broadcast_rules``; beyond it the join is left to the planner, with AQE splitting hot
prefixes. One shuffle follows, of one partially aggregated row per URL.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; a URL
that no rule fits gets ``default``; repeated rows each keep a row; an empty table gives none.
Only the named key columns are carried along, so other columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import ascii_lower, let

#: (host, path, verdict): the rules of the registered query. Fixed values.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SHORT_HEX = 8


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def expressions(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Every host suffix of some number of labels, joined to every path prefix of some length."""

    def made(parts: Column) -> Column:
        suffixes = F.transform(
            F.filter(F.array(*[F.lit(k) for k in labels]), lambda k: F.size(parts) >= k),
            lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
        )
        prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: F.length(path) >= n), lambda n: F.substring(path, F.lit(1), n))
        return let(prefixes, lambda ps: F.flatten(F.transform(suffixes, lambda s: F.transform(ps, lambda p: F.concat(s, p)))))

    return let(F.split(host, r"\."), made) if labels and lengths else F.array().cast("array<string>")


def filter_urls(
    df: DataFrame,
    rules: DataFrame,
    *,
    keys: Sequence[str],
    url: str = "url",
    default: str = "allow",
    broadcast_rules: int = 200_000,
) -> DataFrame:
    """``keys``, host, path, rule and verdict for every row of ``df``."""
    rules = rules.select(
        ascii_lower(F.col("host")).alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v")
    ).distinct()
    shape = rules.agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.size(F.split("_h", r"\."))).alias("labels"),
        F.collect_set(F.length("_p")).alias("lengths"),
    ).first()
    digests = rules.select(
        F.sha2(F.concat("_h", "_p"), 256).alias("_rule_full"),
        F.struct(
            (F.length("_h") + F.length("_p")).alias("size"),
            F.length("_h").alias("host_size"),
            F.when(F.col("_v") == "block", 1).otherwise(0).alias("block"),
            F.concat("_h", "_p").alias("rule"),
            F.col("_v").alias("verdict"),
        ).alias("_found"),
    ).withColumn("_rule_short", F.substring("_rule_full", 1, SHORT_HEX))
    if shape["n"] <= broadcast_rules:
        digests = F.broadcast(digests)

    base = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(url).alias("_url"))
    group = [*(f"_k{i}" for i in range(len(keys))), "_url"]
    exprs = expressions(host_of(F.col("_url")), path_of(F.col("_url")), sorted(shape["labels"]), sorted(shape["lengths"]))
    # The null entry keeps a row for every URL and counts repeated rows.
    spread = base.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), exprs)).alias("_e"))
    spread = spread.withColumn("_full", F.sha2("_e", 256)).withColumn("_short", F.substring("_full", 1, SHORT_HEX))
    best = (
        spread.join(digests, F.col("_short") == F.col("_rule_short"), "left")
        .groupBy(*group)
        .agg(
            F.max(F.when(F.col("_full") == F.col("_rule_full"), F.col("_found"))).alias("_best"),
            F.sum(F.when(F.col("_e").isNull(), 1).otherwise(0)).alias("_copies"),
        )
    )
    rows = best.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return rows.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
    )


ORACLE = """
with rules(rh, rp, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts as (select row_number() over () as rid, page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
fits as (select p.*, r.rh || r.rp as rule, r.verdict,
  row_number() over (partition by p.rid order by length(r.rh || r.rp) desc nulls last, length(r.rh) desc) as k
  from parts p left join rules r on (p.host = r.rh or ends_with(p.host, '.' || r.rh)) and starts_with(p.path, r.rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where k = 1
"""
