import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.functions import encoders, labels, text, vectors
from vectrail.operators import analysis, relational
from vectrail.plans import jobs
from vectrail.sources import tables
from vectrail.streaming import registry_stream


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("demo.weather:forecast", "en-US", "what is the weather in {location}", 1),
        ("demo.weather:forecast.intent.intent", "de", "wetter in {Ort}", 2),
        ("demo.media:play.intent", "es", "pon {track_name} de {nombre}", 3),
        ("demo.media:play", "en", "  ", 4),
        (None, "en", "text", 5),
        ("voice.recording:save", "en", "save {name} {genre} {date} {lower} {upper} {offset} {query} {sentence} {new}", 6),
    ]
    return spark.createDataFrame(rows, "label string, lang string, sentence string, extra int")


def test_preprocess(raw):
    got = {r["extra"]: r for r in jobs.preprocess(raw).collect()}
    assert sorted(got) == [1, 2, 3, 6]
    assert got[2]["label"] == "demo.weather:forecast.intent" and got[2]["entity"] == "location"
    assert got[3]["entity"] == "track_name,name" and "{" not in got[3]["sentence"]
    assert got[6]["sentence"].split()[1].rsplit(".", 1)[1] in text.FILE_TYPES["recording"]
    assert [r["sentence"] for r in jobs.preprocess(raw.repartition(3)).orderBy("extra").collect()] == [got[k]["sentence"] for k in sorted(got)]
    with pytest.raises(ValueError):
        jobs.preprocess(raw.drop("lang"))


def test_normalising_labels_twice(spark, raw):
    once = raw.select(labels.normalize_label(F.col("label")).alias("l"))
    assert once.collect() == once.select(labels.normalize_label(F.col("l")).alias("l")).collect()


def test_variants_and_balance(spark, raw):
    own = jobs.preprocess(raw).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("id", F.col("extra").cast("long"))
    assert jobs.variants(own, 4).count() == 16
    out = jobs.balance(own, jobs.Balance(small=3, variants=2), provider=lambda label, lang, some, n: [f"{some[0]} {k}" for k in range(n)])
    rows = out.collect()
    assert {r["label"] for r in rows} == {r["label"] for r in own.collect()} and all(len(r["embedding"]) == 64 for r in rows)

    def broken(*_):
        raise RuntimeError

    assert jobs.balance(own, jobs.Balance(small=3, variants=2), provider=broken).count() > 0


def test_files(spark, raw, tmp_path):
    tables.write_csv(raw, str(tmp_path / "x.csv"))
    again, has = tables.read_dataset(spark, str(tmp_path / "x.csv"))
    assert not has and again.count() == 6
    wide = raw.limit(2).withColumn("embedding", F.array(*[F.lit(float(k)) for k in range(12)]).cast("array<float>"))
    path = tables.write_parquet(wide, str(tmp_path / "y.csv"), dims=12)
    assert path.endswith("y.parquet")
    back, has = tables.read_dataset(spark, path)
    assert has and back.first()["embedding"] == [float(k) for k in range(12)]
    assert tables.read_optional(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "g.jsonl").write_text('{"label": "a:b", "utterance": "x"}\n\n')
    assert tables.read_golden(spark, str(tmp_path / "g.jsonl")).count() == 1


def test_encoder(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "sentence string")
    rows = [r[0] for r in df.select(encoders.encode(F.col("sentence"), encoders.EncoderSpec(dim=16))).collect()]
    assert rows[0] == rows[1] and np.linalg.norm(rows[0]) == pytest.approx(1, abs=1e-5) and not any(rows[2])
    with pytest.raises(FileNotFoundError):
        encoders.EncoderSpec.resolve("/nowhere", "model.onnx")


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(vectors.unit(F.col("v"))).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]


def test_maximin_is_a_prefix_and_silhouette_is_exact():
    x = np.random.default_rng(3).standard_normal((40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert analysis.maximin(x, 9)[:8] == analysis.maximin(x, 8)
    own = analysis.lloyd(x, 3)
    d = 1 - x @ x.T
    want = []
    for i in range(len(x)):
        same = (own == own[i]) & (np.arange(len(x)) != i)
        a = d[i, same].mean() if same.any() else None
        b = min(d[i, own == c].mean() for c in set(own) - {own[i]})
        want.append(0.0 if a is None else (b - a) / max(a, b))
    assert analysis.silhouette(x, own) == pytest.approx(np.mean(want))
    assert analysis.spread(x, block=7) == pytest.approx((np.arccos(np.clip(x @ x.T, -1, 1)) / np.pi)[np.triu_indices(40, 1)].mean())


def test_spread_of_all_rows(spark):
    x = np.random.default_rng(5).normal(size=(10_400, 4))
    x[:2000, 0] += 5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, "a" if k < 10_300 else "b", v.tolist()) for k, v in enumerate(x)] + [(20_000, "c", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = {r["label"]: (r["n"], r["spread"]) for r in analysis.angular_spread(df).collect()}
    want = {"a": (10_300, analysis.spread(x[:10_300])), "b": (100, analysis.spread(x[10_300:])), "c": (1, 0.0)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_islands(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "two", [float(v) for v in np.eye(4)[k % 2] + 0.02 * rng.standard_normal(4)]) for k in range(40)]
    rows += [(100, "one", [1.0, 0.0, 0.0, 0.0])]
    got = {r["Intent"]: r for r in analysis.topology(spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")).collect()}
    assert got["two"]["Estimated_Islands"] == 2 and got["two"]["Island_Separation_Score"] > 0.9
    assert got["one"]["Estimated_Islands"] is None and got["one"]["Spread_Score"] == 0


def test_diverse_job(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"l{k % 2}", "en", f"w{k % 13} w{k % 7}", "d", f"i{k}", [float(v) for v in rng.standard_normal(4)]) for k in range(60)]
    df = spark.createDataFrame(rows, "seq long, label string, lang string, sentence string, domain string, intent string, embedding array<float>")
    df = df.withColumn("embedding", vectors.unit(F.col("embedding")))
    compact, wide, stats = jobs.diverse(df, df, cap=6)
    assert compact.count() == wide.count() == 12 and {r["n_after"] for r in stats.collect()} == {6}
    plots = jobs.plot_inputs(df, compact, stats)
    assert set(plots) == {"sizes", "kept", "diversity", "gain", "languages", "dedup"} and all(p.count() for p in plots.values())


def test_sample_sizes(spark):
    df = spark.range(100).selectExpr("id", "'a' as label", "case when id < 70 then 'en' when id < 90 then 'de' end as lang")
    got = relational.stratified_sample(df, "label", "lang", "id", 10)
    assert {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()} == {"en": 7, "de": 2, None: 1}


def test_registry_stream(spark, tmp_path):
    def event(k, second, kind, intent, source="adapt"):
        return (k, f"2024-01-01 00:00:{second:02d}", source, kind, intent)

    def put(name, rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, source string, kind string, intent string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        q = registry_stream.latest(registry_stream.changes(spark, str(tmp_path / "in" / "*")))
        q = q.writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "log")))
        q.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    put("a", [event(1, 1, "register", "s:a"), event(2, 2, "register", "s:b"), event(3, 3, "detach", "s:b")])
    run()
    assert [r[0] for r in registry_stream.registered(spark, str(tmp_path / "log")).collect()] == ["s:a"]
    put("b", [event(4, 4, "register", "s:b"), event(5, 5, "register", "p:c", "padatious"), event(0, 0, "detach", "s:a")])
    run()
    assert sorted(r[0] for r in registry_stream.registered(spark, str(tmp_path / "log")).collect()) == ["p:c", "s:a", "s:b"]


def test_kept_snapshot_and_matches_of_a_stream(spark, tmp_path):
    def put(name, rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, source string, kind string, intent string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def keep():
        registry_stream.keep_snapshot(registry_stream.changes(spark, str(tmp_path / "in" / "*")), str(tmp_path / "kept"), str(tmp_path / "c"), seconds=None).awaitTermination()

    at = "2024-01-01 00:00:{:02d}"
    for k, intent in enumerate(["s:a", "s:b", "s:c", "s:d", "s:e"]):
        put(f"f{k}", [(k, at.format(k), "adapt", "register", intent)])
        keep()
    put("g", [(9, at.format(9), "adapt", "detach", "s:b")])
    keep()
    assert sorted(r[0] for r in registry_stream.registered(spark, str(tmp_path / "kept")).collect()) == ["s:a", "s:c", "s:d", "s:e"]
    assert len(list((tmp_path / "kept").glob("version=*"))) <= 3
    registry_stream.keep_version(spark.createDataFrame([(9, "adapt", "detach", "s:b")], "event_id long, source string, kind string, intent string").withColumn("ts", F.to_timestamp(F.lit(at.format(9)))), 6, str(tmp_path / "kept"))
    assert registry_stream.registered(spark, str(tmp_path / "kept")).count() == 4

    spark.createDataFrame([(1, "s:a"), (2, "s:b")], "qid long, label string").write.parquet(str(tmp_path / "q"))
    seen = []
    stream = spark.readStream.schema("qid long, label string").parquet(str(tmp_path / "q"))
    q = registry_stream.match_stream(stream, lambda batch: batch.withColumn("prob", F.lit(0.8)), str(tmp_path / "kept"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "c2"))
    q.awaitTermination()
    assert {(r["qid"], r["tier"]) for r in seen} == {(1, "high"), (1, "medium"), (1, "low")}


def test_errors_of_a_provider_are_rows(spark):
    df = spark.createDataFrame([("a", "en", f"s{k}") for k in range(9)] + [("b", "de", "x")], "label string, lang string, sentence string")
    needs = spark.createDataFrame([("a", 2), ("b", 3)], "label string, needed int")

    def provider(label, lang, some, n):
        if label == "b":
            raise ValueError("down")
        return [f"{x}!" for x in some[:n]] if len(some) == 5 else []

    rows = {(r["label"], r["sentence"] is None, r["error"]) for r in jobs.paraphrased(df, needs, provider).collect()}
    assert rows == {("a", False, None), ("b", True, "ValueError: down")}


def test_csv_keeps_white_space_and_missing(spark, tmp_path):
    rows = [("  a ", "x\ny", '"q", z'), (None, " ", "é")]
    df = spark.createDataFrame(rows, "label string, lang string, sentence string")
    tables.write_csv(df, str(tmp_path / "w"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "w")).collect()), key=str) == sorted(rows, key=str)


def test_a_hot_label_is_capped_in_parts(spark):
    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 4900, "hot").alias("label"))
    got = {r["label"]: r["count"] for r in analysis._capped(df, "label", "vec_id", 300).groupBy("label").count().collect()}
    order = df.where("label = 'hot'").orderBy(F.md5(F.concat(F.lit("42"), F.col("vec_id").cast("string"))), "vec_id").limit(300)
    assert got == {"hot": 300, None: 100}
    assert {r[0] for r in analysis._capped(df, "label", "vec_id", 300).where("label = 'hot'").select("vec_id").collect()} == {r["vec_id"] for r in order.collect()}


def proto(*fields):
    """Bytes of a protocol buffer's fields (number, value)."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.fixture
def onnx_folder(tmp_path):
    """A model that looks its tokens' vectors up, and a tokenizer of four words."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = np.array([[0, 0, 1], [3, 4, 0], [0, 1, 0], [1, 1, 1]], np.float32)
    tensor = lambda name, kind, *dims: proto((1, name), (2, proto((1, proto((1, kind), (2, b"".join(proto((1, proto((2, d) if isinstance(d, str) else (1, d)))) for d in dims)))))))
    graph = proto(
        (1, proto((1, "table"), (1, "input_ids"), (2, "hidden"), (4, "Gather"))), (2, "g"),
        (5, proto((1, 4), (1, 3), (2, 1), (8, "table"), (9, table.tobytes()))), (11, tensor("input_ids", 7, "b", "s")), (12, tensor("hidden", 1, "b", "s", 3)),
    )
    (tmp_path / "model.onnx").write_bytes(proto((1, 8), (7, graph), (8, proto((1, ""), (2, 13)))))
    words = Tokenizer(models.WordLevel({"[UNK]": 0, "hello": 1, "other": 2, "[PAD]": 3}, unk_token="[UNK]"))
    words.pre_tokenizer = pre_tokenizers.Whitespace()
    words.save(str(tmp_path / "tokenizer.json"))
    return str(tmp_path)


def test_onnx_encoder(spark, onnx_folder):
    spec = encoders.EncoderSpec.resolve(onnx_folder, "model.onnx")
    assert spec.kind == "onnx" and encoders.dimension(spec) == 3 and encoders.dimension(encoders.EncoderSpec(dim=17)) == 17
    df = spark.createDataFrame([("hello other",), ("other",), ("unknown words here",)], "sentence string")
    got = [r[0] for r in df.select(encoders.encode(F.col("sentence"), spec)).collect()]
    assert got == [[pytest.approx(0.6), pytest.approx(0.8), 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


def test_static_encoder(monkeypatch):
    import sys
    import types

    class StaticModel:
        @staticmethod
        def from_pretrained(path):
            return types.SimpleNamespace(encode=lambda texts: [[3.0, 4.0] if path in t else [0.0, 2.0] for t in texts])

    monkeypatch.setitem(sys.modules, "model2vec", types.SimpleNamespace(StaticModel=StaticModel))
    spec = encoders.EncoderSpec.resolve("hello")
    assert spec.kind == "static" and encoders.dimension(spec) == 2
    assert np.allclose(encoders.encoder(spec)(["hello", "x"]), [[0.6, 0.8], [0.0, 1.0]])


def test_medoids_of_many_centres(spark):
    """As many centres as asked for, with copies and null vectors among the rows."""
    x = np.random.default_rng(5).normal(size=(400, 8)).astype(np.float32)
    rows = [(k, [float(v) for v in x[k % 400]]) for k in range(800)] + [(800, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = analysis.medoids(df, 60).collect()
    centres = np.array([r["centre"] for r in sorted(got, key=lambda r: r["cluster"])])
    gap = ((x[:, None].astype(float) - centres[None]) ** 2).sum(-1)
    near = gap.argmin(1)
    want = {c: min(np.flatnonzero(near == c), key=lambda k: (gap[k, c], k)) for c in range(60)}
    assert len(got) == 60 and {r["cluster"]: r["vec_id"] for r in got} == want
    assert gap.min(1).sum() < 0.8 * min(((x[:, None] - x[None, at : at + 60]) ** 2).sum(-1).min(1).sum() for at in range(0, 340, 60))
    assert analysis.medoids(df, 1000).count() == 400
    assert analysis.medoids(df.limit(0), 3).count() == 0
