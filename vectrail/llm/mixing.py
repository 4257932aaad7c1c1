"""Mixing documents to target weights of domains, by soft membership.

A classifier trained on the labelled table gives each document a posterior of every domain. The
expected tokens of a domain under document rates r are sum(r * tokens * posterior). Rates start at 1
and are fitted by distributed projected-gradient least squares so that these totals come to the
targets. A step moves every rate by -posterior . m, clipped at 0, where the multipliers m are the
gradient at the rates that the step leads to, over ``ridge``: an implicit (proximal) step, which
never raises the squared shortfall whatever its length. It minimises
|totals - targets|^2 + ridge * sum(tokens * (rate - rate before)^2), both as shares of all tokens.
The m of a step, one number a domain, are found by Newton's method with step control on the dual:
each round adds up totals and the Gram matrix of the documents in use over the whole table, at
several step lengths at once. A document's rate follows from its posterior and the steps'
multipliers, so no rates are stored. Steps go on while each halves the shortfall.

Tokens are those of ``token_counts`` under a piece file, or words without one. Domains come from
labels: ``junk`` (quality 0), else ``toxic``, else ``clean``.

Scale: posteriors and tokens are written once in the shared folder (by ``mix`` with the documents, so
that no text is ever shuffled or joined); each round is one aggregation of them, of a few numbers
to the driver. Nothing is shuffled but those sums.

Defined results: documents without words have rate 1 and weigh nothing; targets that nonnegative
rates can't meet are met as nearly as the first step's minimum, and a fit that doesn't converge is an
error; a domain that no label names has posterior 0; ties and repeated rows get equal rates; an
empty table gives no rows. ``copies`` is the rate rounded up with the probability of its fraction,
by a hash of the id. ``mix`` keeps all columns of the documents, whatever their names; its outputs
replace columns ``rate`` and ``copies``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm import subword, token_counts
from vectrail.llm import words as W
from vectrail.sources.scratch import Tables

#: Domain -> share of the mixture's tokens.
TARGETS = {"clean": 0.9, "junk": 0.05, "toxic": 0.05}


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, "junk").when(toxic == 1, "toxic").when(quality == 1, "clean")


def _rate(steps: list[list[float]], posteriors: Column) -> Column:
    rate = F.lit(1.0)
    for step in steps:
        move = sum(F.lit(float(x)) * F.element_at(posteriors, d + 1) for d, x in enumerate(step))
        rate = F.greatest(rate - move, F.lit(0.0))
    return rate


def _newton(scored: DataFrame, steps: list[list[float]], goal: np.ndarray, total: float, ridge: float, most: int) -> tuple[list[float], float]:
    """The next step's multipliers, and the largest shortfall that it leaves."""
    k = len(goal)
    p = [F.element_at("posteriors", d + 1) for d in range(k)]
    rows = scored.where("n_tokens > 0").withColumn("_rate", _rate(steps, F.col("posteriors")))

    def at(tried: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """The dual's value, gradient and curvature at each of some multipliers."""
        sums = []
        for m in tried:
            rate = F.greatest(F.col("_rate") - sum(F.lit(float(x)) * c for x, c in zip(m, p, strict=True)), F.lit(0.0))
            own, used = rate * F.col("n_tokens"), F.when(rate > 0, F.col("n_tokens")).otherwise(0)
            sums += [F.sum(own * rate), *[F.sum(own * c) for c in p]]
            sums += [F.sum(used * p[a] * p[b]) for a in range(k) for b in range(a, k)]
        got = np.array([float(x or 0.0) for x in rows.agg(*sums).first()]).reshape(len(tried), -1) / total
        out = []
        for m, x in zip(tried, got, strict=True):
            gram = np.zeros((k, k))
            gram[np.triu_indices(k)] = x[k + 1 :]
            gram = gram + np.triu(gram, 1).T
            out.append((x[0] / 2 + ridge / 2 * m @ m + m @ goal, ridge * m + goal - x[1 : k + 1], gram + ridge * np.eye(k)))
        return out

    now, way, longest = np.zeros(k), None, 1.0
    value, gradient, curve = at([now])[0]
    for _ in range(most):
        if np.abs(gradient).max() <= 1e-10 or longest < 1e-16:
            break
        if way is None:
            way = -np.linalg.solve(curve, gradient)
        tried = [now + way * (longest * length) for length in (1, 1 / 2, 1 / 4, 1 / 16, 1 / 64)]
        found = at(tried)
        best = min(range(len(tried)), key=lambda j: found[j][0])
        if found[best][0] < value:
            now, (value, gradient, curve) = tried[best], found[best]
            way, longest = None, 1.0
        else:
            longest /= 256
    if np.abs(gradient).max() > 1e-7:
        raise RuntimeError(f"the rates' fit stopped at a gradient of {np.abs(gradient).max():.1e} of all tokens")
    return now.tolist(), float(np.abs(gradient - ridge * now).max())


def fit_rates(scored: DataFrame, targets: Sequence[float], *, ridge: float = 1e-8, near: float = 1e-6, most_steps: int = 8, most_rounds: int = 100) -> list[list[float]]:
    """Multipliers of each step for rows (n_tokens, posteriors); targets are token totals. Totals
    are met to ``near`` of all tokens, if rates can."""
    total = max(float(scored.agg(F.sum("n_tokens")).first()[0] or 0), float(sum(targets)), 1.0)
    goal = np.array(targets, float) / total
    steps: list[list[float]] = []
    short = np.inf
    while len(steps) < most_steps:
        try:
            step, left = _newton(scored, steps, goal, total, ridge, most_rounds)
        except RuntimeError:
            if not steps:
                raise
            break  # the first step's minimum stands
        if left > short / 2:
            break
        steps.append(step)
        short = left
        if short <= near:
            break
    return steps


def _scored(docs: DataFrame, labels: DataFrame, keep: bool, own: Tables, *, doc: str, text: str, targets: Mapping[str, float], pieces: str | None, **options) -> DataFrame:
    """Written rows of _doc, n_tokens and posteriors in the order of the sorted targets, and, if
    ``keep``, of the documents' columns by place."""
    domains = sorted(targets)
    named = labels.select(F.col(doc), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    model = subword.train(docs, named.where(F.col("domain").isin(domains)), doc=doc, label="domain", text=text, **options)
    place = {c: k for k, c in enumerate(model.classes)}
    chosen = [place.get(d) for d in domains]
    spark = docs.sparkSession
    vocabulary = token_counts.Pieces(token_counts.zipf_pieces(pieces)) if pieces else None
    shared = spark.sparkContext.broadcast((model, vocabulary))
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)] if keep else []
    rows = docs.select(F.col(f"`{doc}`").alias("_doc"), F.col(f"`{text}`").alias("_text"), *kept)
    fields = [f"_doc {docs.schema[doc].dataType.simpleString()}", *(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields) if keep)]

    def run(batches):
        model, vocabulary = shared.value
        trie = token_counts.Trie(vocabulary) if vocabulary else None

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = W.texts_of(batch.column("_text"))
            p = model.posteriors(texts)
            p = np.stack([np.zeros(len(p)) if j is None else p[:, j] for j in chosen], axis=1)
            tokens = trie.counts(texts)[1] if trie is not None else [len(x.split()) for x in texts]
            names = [n for n in batch.schema.names if n != "_text"]
            arrays = [*(batch.column(n) for n in names), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(arrays, [*names, "n_tokens", "posteriors"])

        yield from W.mapped(work, "_text", token_counts.BLOCK)(batches)

    return own.written(rows.mapInArrow(run, ", ".join([*fields, "n_tokens long", "posteriors array<double>"])), "posteriors")


def _rated(scored: DataFrame, targets: Mapping[str, float], size: float) -> DataFrame:
    total = scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    weight = sum(targets.values())
    steps = fit_rates(scored, [size * total * targets[d] / weight for d in sorted(targets)])
    rate = F.when(F.col("n_tokens") > 0, _rate(steps, F.col("posteriors"))).otherwise(1.0)
    luck = F.pmod(F.xxhash64("_doc", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return scored.withColumn("_rate", rate).withColumn("_copies", F.floor(F.col("_rate") + luck).cast("long"))


def rates(
    docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text",
    targets: Mapping[str, float] = TARGETS, size: float = 1.0, pieces: str | None = None, **options,
) -> DataFrame:
    """``doc``, n_tokens, p_<domain> for each target, rate and copies of every row. ``size`` is the
    mixture's tokens as a share of the documents'."""
    scored = _scored(docs, labels, False, Tables(), doc=doc, text=text, targets=targets, pieces=pieces, **options)
    return _rated(scored, targets, size).select(
        F.col("_doc").alias(doc),
        "n_tokens",
        *[F.element_at("posteriors", k + 1).alias(f"p_{d}") for k, d in enumerate(sorted(targets))],
        F.col("_rate").alias("rate"),
        F.col("_copies").alias("copies"),
    )


def mix(
    docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text",
    targets: Mapping[str, float] = TARGETS, size: float = 1.0, pieces: str | None = None, **options,
) -> DataFrame:
    """The documents that the mixture uses (copies of 1 or more), with rate and copies."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("rate", "copies")])
    scored = _scored(docs, labels, True, Tables(), doc=doc, text=text, targets=targets, pieces=pieces, **options)
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return _rated(scored, targets, size).where("_copies > 0").select(*own, F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))
