"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectrail.llm import chat_format, decontaminate, html_extract, mixing, ngram_join, quality_rules, secrets, subword, token_counts, url_filter
from vectrail.llm.queries import PIECES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, g int, token string, node long, rank int, label string"
LONG = " ".join(f"w{k}" for k in range(200_000))


@pytest.fixture(scope="module")
def docs(spark):
    same = " ".join(f"copy{k}" for k in range(40))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, same), (4, same), (5, same), (None, same), (None, None), (6, LONG), (7, "one two"), (8, "x" * 300_000), (9, "One TWO")]
    return spark.createDataFrame([(i, t, None, None, None, True, 1, "t", 5, 2, "l") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0), (4, 1, 0), (6, 0, 0), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(0, None), (1, ""), (2, " ".join(f"w{k}" for k in range(500, 530))), (2, "one, TWO!"), (3, "absent words are never ever found")]
    return spark.createDataFrame(rows, "item_id long, text string")


def operators(items, labels):
    return {
        "1": lambda d: decontaminate.search(d, items, keys=["doc_id"]),
        "1 clean": lambda d: decontaminate.clean(d, items),
        "2": lambda d: token_counts.count_tokens(d, PIECES, keys=["doc_id"]),
        "3": lambda d: html_extract.main_text(d, keys=["doc_id"], html="text"),
        "4": lambda d: url_filter.filter_urls(d, url_filter.rule_table(d.sparkSession, url_filter.RULES), keys=["doc_id"], url="text"),
        "5": lambda d: quality_rules.judge(d, keys=["doc_id"]),
        "5 accepted": quality_rules.accepted,
        "6": lambda d: secrets.digests(secrets.scan(d, keys=["doc_id"]), key="doc_id"),
        "6 redact": secrets.redact,
        "7": lambda d: chat_format.digests(chat_format.format_chats(chat_format.canonical(d.select("doc_id", F.lit(0).alias("turn"), F.lit("user").alias("role"), "text"), keys=["doc_id"]), keys=["doc_id"]), key="doc_id"),
        "8": ngram_join.join,
        "8 deduplicated": ngram_join.deduplicated,
        "9": lambda d: subword.quality(d, labels, least_steps=20),
        "10": lambda d: mixing.rates(d, labels, least_steps=20),
        "10 mix": lambda d: mixing.mix(d, labels, least_steps=20),
    }


@pytest.mark.parametrize("name", operators(None, None))
def test_empty_table(spark, docs, items, labels, name):
    assert operators(items, labels)[name](docs.limit(0)).collect() == []


COUNTS = {"1": 3, "1 clean": 9, "2": 12, "3": 12, "4": 12, "5": 12, "5 accepted": 5, "6": 12, "6 redact": 12, "7": 10, "8": 12, "8 deduplicated": 9, "9": 12, "10": 12}


@pytest.mark.parametrize("name", COUNTS)
def test_odd_rows(docs, items, labels, name):
    out = operators(items, labels)[name](docs)
    assert len(out.collect()) == COUNTS[name]


def test_odd_rows_are_mixed(docs, labels):
    odd = docs.withColumn("_doc", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("posteriors", F.lit(2)).withColumn("rate", F.lit("gone"))
    found = mixing.rates(odd, labels, least_steps=20).where("copies > 0").count()
    got = mixing.mix(odd, labels, least_steps=20)
    rows = got.collect()
    assert 7 <= len(rows) == found and set(got.columns) == {*docs.columns, "_doc", "a.b", "posteriors", "rate", "copies"}
    assert {(r["_doc"], r["a.b"], r["posteriors"], r["label"]) for r in rows} == {("x", 1, 2, "l")} and all(r["rate"] >= 0 for r in rows)


def test_columns_of_any_name_are_kept(docs, items, labels):
    made = operators(items, labels)
    odd = docs.where("doc_id is not null").withColumn("a.b", F.lit(1)).withColumn("_c0", F.lit(2)).withColumn("_text", F.lit(3)).withColumn("spans", F.lit(4))
    for name in ("1 clean", "5 accepted", "6 redact", "8 deduplicated"):
        got = made[name](odd)
        assert got.columns == odd.columns
        assert {(r["a.b"], r["_c0"], r["_text"], r["spans"]) for r in got.collect()} == {(1, 2, 3, 4)}


def test_defined_results(docs, items, labels):
    made = operators(items, labels)
    got = {r["doc_id"]: r for r in made["8"](docs).where("doc_id is not null").collect()}
    assert [got[k]["n_shingles"] for k in (1, 2, 3, 4, 6, 7, 8)] == [0, 0, 0, 36, 199_996, 1, 1]
    assert {k: got[k]["component_id"] for k in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 7}
    found = sorted((r["doc_id"], r["n_item"], r["n_shared"]) for r in made["1"](docs).collect())
    assert found == [(6, 26, 26), (7, 1, 1), (9, 1, 1)]
    assert set(made["5 accepted"](docs).columns) == set(docs.columns)
    kept = {r["doc_id"] for r in made["8 deduplicated"](docs).collect()}
    assert kept == {1, 2, 3, 4, 6, 7, 8, None}
    scores = [r["score"] for r in made["9"](docs).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_unlabelled(spark, docs, labels):
    none = labels.limit(0)
    assert {r["score"] for r in subword.quality(docs, none).collect()} == {0.5}
    assert {r["rate"] for r in mixing.rates(docs, none).where("n_tokens = 0").collect()} == {1.0}


def test_pipeline_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), small)
        assert empty.columns[: len(docs.columns)] == docs.columns and empty.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert empty.schema.simpleString() == docs.schema.simpleString()
