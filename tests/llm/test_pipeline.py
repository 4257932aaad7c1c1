"""The pipeline's rows against brute force over each stage's own input."""

import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_texts import SHAPES, battery_by_hand, shingle_set

import corpus_pipeline
from vectrail.llm import mixing, secrets
from vectrail.llm.queries import PIECES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def good(text):
    ws = WORDS.findall(text or "")
    places = {}
    for i in range(len(ws) - 7):
        places.setdefault(tuple(ws[i : i + 8]), []).append(i)
    twice = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    longs = [tuple(ws[i : i + 101]) for i in range(len(ws) - 100)]
    return len(ws) >= 20 and 100 * len(twice) <= 30 * len(ws) and len(set(longs)) == len(longs)


def leaders(rows):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def stripped(text):
    kept = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "" if c not in string.punctuation)
    ws = kept.encode().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def hidden(text):
    """``text`` with its spans masked, found and judged one by one."""
    least = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    spans = [(m.start(2) if kind == "assign" else m.start(), m.end()) for kind, p in SHAPES.items() for m in p.finditer(text) if least[kind](m)]
    runs = list(re.finditer(secrets.RUN, text))
    tests = []
    for m in runs:
        run = m[0]
        fit = [e for e in secrets.ENCODINGS if re.match(e.pattern, run)]
        whole = re.fullmatch(f"{secrets.HEX}|{secrets.ACCESS}", run)
        tests.append(battery_by_hand(run, fit[0]) if fit and not whole else (1.0, 0.0))
    ranked = sorted(p for p, _ in tests)
    passed = [p for k, p in enumerate(ranked, 1) if p <= 0.02 * k / len(tests)]
    spans += [m.span() for m, (p, q) in zip(runs, tests) if passed and p <= passed[-1] and q >= 0.001]
    out, at = "", 0
    for start, end in sorted(spans):
        out += text[at:start] + "[SECRET]" * (start >= at)
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], small).cache())
    return [[r.asDict() for r in df.collect()] for df in found], found


def test_quality_rules_stage(stages):
    (before, after, *_), _ = stages
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if good(r["text"])} and 0 < len(after) < len(before)


def test_near_copies_stage(stages):
    (_, before, after, *_), _ = stages
    assert {r["doc_id"] for r in after} == leaders(before) and len(after) < len(before)


def test_decontamination_stage(spark, small, stages):
    (_, _, before, after, *_), _ = stages
    items = [stripped(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r in before if not any(i and 100 * len(i & stripped(r["text"])) >= 80 * len(i) for i in items)}
    assert {r["doc_id"] for r in after} == want and len(after) < len(before)


def test_secret_scans_stage(stages):
    (_, _, _, before, after, _), _ = stages
    want = {r["doc_id"]: hidden(r["text"]) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == want and any("[SECRET]" in t for t in want.values())
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_mixing_stage(spark, small, stages):
    (*_, before, after), (*_, docs, _) = stages
    rows = mixing.rates(docs, spark.read.parquet(f"{small}/labels.parquet"), pieces=PIECES).collect()
    p = np.array([[r[f"p_{d}"] for d in sorted(mixing.TARGETS)] for r in rows])
    tokens = np.array([r["n_tokens"] for r in rows], float)
    share, goal = tokens / tokens.sum(), np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)])
    # The dual of least change under the targets, by plain Newton steps with halving.
    m, used = np.zeros(3), lambda m: np.maximum(1 - p @ m, 0)
    value = lambda m: (share * used(m) ** 2).sum() / 2 + m @ goal + 5e-9 * m @ m
    for _ in range(500):
        rate = used(m)
        gradient = goal - (share * rate) @ p + 1e-8 * m
        curve = (p[rate > 0] * share[rate > 0, None]).T @ p[rate > 0] + 1e-8 * np.eye(3)
        way, step = np.linalg.solve(curve, gradient), 1.0
        while step > 1e-12 and value(m - step * way) > value(m):
            step /= 2
        m = m - step * way
    want = dict(zip([r["doc_id"] for r in rows], used(m), strict=True))
    assert all(abs(r["rate"] - want[r["doc_id"]]) < 1e-3 * max(1, want[r["doc_id"]]) for r in rows)
    luck = {r["doc_id"]: r["u"] for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)).alias("u")).collect()}
    found = {r["doc_id"]: r for r in after}
    for r in rows:
        copies = int(np.floor(r["rate"] + luck[r["doc_id"]]))
        assert (r["doc_id"] in found) == (copies > 0)
        if copies:
            assert (found[r["doc_id"]]["copies"], found[r["doc_id"]]["rate"]) == (copies, r["rate"])
    assert {r["doc_id"]: r["text"] for r in before}.items() >= {r["doc_id"]: r["text"] for r in after}.items()


def test_run_is_its_stages(spark, small, stages):
    (*_, want), _ = stages
    got = [r.asDict() for r in corpus_pipeline.run(spark, small).collect()]
    key = lambda r: (r["doc_id"], r["text"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, want))
