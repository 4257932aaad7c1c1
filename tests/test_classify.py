import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.operators import classify, gate, knn
from vectrail.operators.coupling import Kernel
from vectrail.plans import registry
from vectrail.plans.engine import Engine
from vectrail.sources import index_store

LABELS = ["home:lamp", "home:door", "music:song", "music:radio"]


@pytest.fixture(scope="module")
def corpus(spark):
    # Six rows a label around an axis of its own, each leaning a little towards another free axis.
    rows = []
    for c, label in enumerate(LABELS):
        for lean in range(6):
            v = np.eye(8)[2 * c] + 0.1 * np.eye(8)[2 * ((lean + c) % 4) + 1] * (1 + lean % 3)
            rows.append((len(rows), label, [float(x) for x in v / np.linalg.norm(v)]))
    return spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")


@pytest.fixture(scope="module")
def model(corpus):
    return classify.Model(corpus, n=2, kernel=Kernel(k=3))


def ask(spark, *vectors):
    rows = [(k, [float(x) for x in np.array(v) / (np.linalg.norm(v) or 1)]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "qid long, embedding array<float>")


X, Z = [5, 1, 0, 0, 0, 0, 0, 1], [0, 0, 0, 1, 5, 0, 1, 0]


def test_top_class_of_each_query(spark, model):
    got = {r["qid"]: r["label"] for r in classify.predict(model, ask(spark, X, Z)).collect()}
    assert got == {0: "home:lamp", 1: "music:song"}


def test_probabilities_sum_to_one_at_every_level(spark, model):
    rows = classify.predict_proba(model, ask(spark, X, Z), every_level=True).groupBy("qid", "level").agg(F.sum("prob").alias("s")).collect()
    assert len(rows) == 4 and all(r["s"] == pytest.approx(1) for r in rows)


def test_level_one(spark, model):
    got = {r["label"] for r in classify.predict_proba(model, ask(spark, X), level=1).collect()}
    assert got <= {"home", "music"}


def test_domain_filter(spark, model):
    rows = classify.predict_proba(model, ask(spark, Z), domains=["home"]).collect()
    assert rows and all(r["label"].startswith("home:") for r in rows)


@pytest.mark.parametrize("domains", [None, [], ["nowhere"]])
def test_filter_is_cleared(spark, model, domains):
    assert classify.predict(model, ask(spark, Z), domains=domains).first()["label"] == "music:song"


def test_more_classes_wanted_than_there_are(spark, corpus):
    rows = classify.predict_proba(classify.Model(corpus, n=9), ask(spark, X)).collect()
    assert 0 < len(rows) <= 4


def test_dimensions_must_agree(spark, corpus):
    with pytest.raises(Exception, match="dimensions"):
        knn.distances(corpus, ask(spark, [0.0] * 16), 3).collect()


def test_blocks_of_queries_change_nothing(spark, corpus):
    q = ask(spark, X, Z, [1] * 8, [0, 1, 0, 1, 0, 1, 0, 1])
    key = lambda df: sorted((r["qid"], r["rank"], r["vec_id"]) for r in df.collect())
    assert key(knn.distances(corpus, q, 4)) == key(knn.distances(corpus, q, 4, block=1)) == key(knn.by_expressions(corpus, q, 4))


def test_index_round_trip(spark, corpus, tmp_path):
    index = index_store.build(corpus, str(tmp_path / "i"), index_store.Spec(k=3, n=2))
    assert index.centroids is None and index.meta["rows"] == 24 and index.meta["levels"] == 2 and index.meta["min_domain_rows"] == 12
    assert classify.predict(index.model(), ask(spark, X)).first()["label"] == "home:lamp"
    assert index_store.sanity(index).first()["accuracy"] == 1.0
    assert index_store.load(spark, str(tmp_path / "i"), nprobe=3).spec.nprobe == 3


def test_three_levels_and_ragged_labels(spark):
    rows = [(k, f"a:{k % 2}:{k % 4}", [float(x) for x in np.eye(4)[k % 4]]) for k in range(12)]
    deep = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    assert classify.predict(classify.Model(deep), ask(spark, [0, 0, 1, 0])).first()["label"] == "a:0:2"
    ragged = deep.unionByName(spark.createDataFrame([(99, "b:y", [0.0] * 4)], deep.schema))
    with pytest.raises(ValueError):
        classify.Model(ragged).levels()
    assert classify.Model(ragged, truncate=True).levels() == 2


def gated(spark, rows, intents, pipeline=None, **options):
    predicted = spark.createDataFrame([(0, label, p) for label, p in rows], "qid long, label string, prob double")
    known = spark.createDataFrame([(i,) for i in intents], "intent string")
    sessions = None if pipeline is None else spark.createDataFrame([(0, pipeline)], "qid long, pipeline array<string>")
    g = gate.Gate(**options)
    found = gate.candidates(predicted, known, sessions=sessions, gate=g)
    return found.orderBy("rank").collect(), {r["tier"] for r in gate.tiers(found, gate=g).collect()}


def test_registered_labels_only(spark):
    rows, tiers = gated(spark, [("s:a", 0.9), ("", 0.1)], ["s:a"])
    assert [(r["skill_id"], r["match_type"], r["prob"]) for r in rows] == [("s", "s:a", 0.9)] and tiers == {"high", "medium", "low"}
    assert gated(spark, [("s:a", 0.9)], [])[0] == []


@pytest.mark.parametrize("prob, want", [(0.7, {"high", "medium", "low"}), (0.6, {"medium", "low"}), (0.4, {"low"}), (0.05, set())])
def test_tiers(spark, prob, want):
    assert gated(spark, [("s:a", prob)], ["s:a"])[1] == want


def test_renormalised(spark):
    rows, _ = gated(spark, [("s:a", 0.6), ("s:b", 0.2), ("s:c", 0.2)], ["s:a", "s:b"], renormalize=True)
    assert sum(r["prob"] for r in rows) == pytest.approx(1)
    assert gated(spark, [("s:a", 0.0)], ["s:a"], renormalize=True)[0][0]["prob"] == 0


@pytest.mark.parametrize("pipeline, allowed", [(None, True), ([], True), (["other"], False), (["v-ocp-pipeline-plugin-high"], True)])
def test_special_labels_follow_the_session(spark, pipeline, allowed):
    rows, _ = gated(spark, [("ocp:play", 0.95)], [], pipeline)
    assert [r["match_type"] for r in rows] == (["common_play.play_search"] if allowed else [])


def test_ignored_special_label(spark):
    assert gated(spark, [("ocp:play", 0.95)], [], ignore=("ocp:play",))[0] == []


def test_match_rows(spark):
    predicted = spark.createDataFrame([(0, "s:a", 0.9)], "qid long, label string, prob double")
    known = gate.from_adapt(spark.createDataFrame([([("s:a",)],)], "intents array<struct<name:string>>"))
    known = gate.registry(known, gate.from_padatious(spark.createDataFrame([(["s:b", "s:a"],)], "intents array<string>")))
    assert sorted(r[0] for r in known.collect()) == ["s:a", "s:b"]
    said = spark.createDataFrame([(0, "do it")], "qid long, utterance string")
    row = gate.match(gate.candidates(predicted, known), "high", utterances=said).first()
    assert row["match_data"].asDict() == {"utterance": "do it", "confidence": 0.9} and row["skill_id"] == "s"


def brute(spark, sf, k):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    asked = [r for r in rows if r["vec_id"] % 50 == 0]
    rest = sorted((r for r in rows if r["vec_id"] % 50), key=lambda r: r["vec_id"])
    x = np.array([r["embedding"] for r in rest], np.float64)
    near = {}
    for r in asked:
        d = np.arccos(np.clip(x @ np.array(r["embedding"], np.float64), -1, 1))
        near[r["vec_id"]] = {rest[j]["vec_id"] for j in np.argsort(d, kind="stable")[:k]}
    return near


def test_recall_of_probed_cells(spark):
    sf = "/root/testdata/sf0.01"
    want = brute(spark, sf, 10)
    found = registry.queries()["knn_probed"](spark, sf).collect()
    hits = sum(r["vec_id"] in want[r["qid"]] for r in found)
    assert hits / (10 * len(want)) >= 0.9


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 8)) + 3 * np.eye(8)[rng.integers(0, 6, 600)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, f"d{k % 3}:i{k % 6}", v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    return df, index_store.build(df, str(tmp_path_factory.mktemp("cells") / "i"), index_store.Spec(nlist=6, nprobe=2, n=3, rows_per_file=40), cells=True)


def test_probing_is_the_same_by_scan_and_cogroup(spark, cells):
    df, index = cells
    q = df.where("vec_id < 40").select(F.col("vec_id").alias("qid"), "embedding")
    key = lambda found: sorted((r["qid"], r["rank"], r["vec_id"]) for r in found.collect())
    some = key(knn.probe(index.corpus, index.centroids, q, 5, 2))
    assert some == key(knn.probe(index.corpus, index.centroids, q, 5, 2, block=7)) and len(some) == 200
    assert key(knn.probe(index.corpus, index.centroids, q, 5, 6)) == key(knn.distances(df, q, 5))


def test_predicting_through_cells(spark, cells):
    df, index = cells
    q = df.where("vec_id % 15 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    plain = classify.Model(df, n=3)
    key = lambda model, **o: {(r["qid"], r["level"], r["label"]): r["prob"] for r in classify.predict_proba(model, q, every_level=True, **o).collect()}
    whole = index_store.load(spark, index.corpus.inputFiles()[0].split("/corpus/")[0], nprobe=6).model()
    for options in ({}, {"domains": ["d1", "d2"]}):
        a, b = key(whole, **options), key(plain, **options)
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)
    near = {k[0]: k[2] for k, p in sorted(key(index.model()).items(), key=lambda x: x[1]) if k[1] == 2}
    want = {k[0]: k[2] for k, p in sorted(key(plain).items(), key=lambda x: x[1]) if k[1] == 2}
    assert sum(near[k] == want[k] for k in want) >= 0.9 * len(want)


@pytest.mark.parametrize("kernel", [Kernel(k=3), Kernel(k=3, shell=False), Kernel(k=3, on_empty_shell="pool_anchor", margin=0.02), Kernel(k=2, tau=0.3)])
@pytest.mark.parametrize("global_anchor", [True, False])
def test_leaving_out_what_has_no_weight_changes_nothing(spark, cells, kernel, global_anchor, monkeypatch):
    df, _ = cells
    q = df.where("vec_id % 29 = 0").select(F.col("vec_id").alias("qid"), F.transform("embedding", lambda x: -x).alias("embedding"))
    model = classify.Model(df.where("vec_id < 150"), n=2, kernel=kernel, anchor_to_global=global_anchor)
    key = lambda: sorted((r["qid"], r["rank"], r["label"], round(r["prob"], 9), r["degenerate"]) for r in classify.predict_proba(model, q, domains=["d0", "d2"]).collect())
    some, whole = key(), knn.nearest
    monkeypatch.setattr(knn, "nearest", lambda *a, **o: whole(*a, **(o | {"margin": None})))
    assert some == key()


def test_an_index_from_settings_to_matches(spark, corpus, tmp_path):
    index_store.build(corpus, str(tmp_path / "i"), index_store.Spec(k=3, n=2))
    engine = Engine(spark, {"index": str(tmp_path / "i"), "tiers": {"high": 0.6}, "ignore": ["music:radio"]})
    assert engine.candidates(ask(spark, X)).count() == 0 and not engine.sync(spark.createDataFrame([], "intent string"))
    known = spark.createDataFrame([(x,) for x in LABELS], "intent string")
    assert engine.sync(known) and {r[0] for r in engine.domains().collect()} >= {"home", "music"}
    assert [r["match_type"] for r in engine.match(ask(spark, X), "high").collect()] == ["home:lamp"]
    assert not engine.sync() and engine.intents.count() == 3
    said = spark.createDataFrame([(7, "hello there")], "qid long, utterance string")
    assert len(engine.embedded(said).first()["embedding"]) == 64
    with pytest.raises(ValueError):
        Engine(spark, {"index": str(tmp_path / "i"), "nonsense": 1})


def test_special_labels_may_have_the_suffix(spark):
    rows, _ = gated(spark, [("ocp:play.intent", 0.9), ("stop:stop.intent.intent", 0.5)], [])
    assert [r["match_type"] for r in rows] == ["common_play.play_search", "stop"]


def test_codes(spark, cells, tmp_path):
    df, _ = cells
    q = df.where("vec_id % 12 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    index = index_store.build(df, str(tmp_path / "i"), index_store.Spec(nlist=4, nprobe=4, pq_m=4), cells=True)
    assert index.books.shape == (4, 256, 2) and all(len(r["code"]) == 4 for r in index.corpus.select("code").collect())
    want = {(r["qid"], r["vec_id"]) for r in index.search(q, 10).collect()}
    got = index.search(q, 10, coded=True).collect()
    assert sum((r["qid"], r["vec_id"]) in want for r in got) >= 0.8 * len(want) == 0.8 * 500
    with pytest.raises(ValueError):
        index_store.build(df, str(tmp_path / "j"), index_store.Spec(pq_m=3))
    with pytest.raises(ValueError):
        cells[1].search(q, 3, coded=True)


def test_expressions_skip_nulls_and_find_all_behind_the_bound(spark):
    """More rows than groups of the bound, copies among them, and vectors that are null."""
    x = np.random.default_rng(3).normal(size=(150, 6))
    x = np.concatenate([x, x]) / np.linalg.norm(np.concatenate([x, x]), axis=1, keepdims=True)
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(k, None) for k in (300, 301)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = ask(spark, *np.random.default_rng(4).normal(size=(5, 6)))
    key = lambda df: sorted((r["qid"], r["rank"], r["vec_id"], round(r["dist"], 9)) for r in df.collect())
    want = key(knn.distances(corpus, q, 4))
    assert len(want) == 20 and all(key(knn.by_expressions(corpus, q, 4, **o)) == want for o in ({}, {"part": 1}, {"part": 2, "block": 2}))
    with pytest.raises(ValueError, match="dimensions"):
        knn.by_expressions(corpus, ask(spark, [0.0] * 16), 3)
    assert knn.by_expressions(corpus.where("vec_id >= 300"), q, 3).count() == knn.by_expressions(corpus, q.limit(0), 3).count() == 0
