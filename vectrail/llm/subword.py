"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax.

A text's features are its words, pairs of neighbouring words (a repeated word is one feature of its
own, whichever word it is) and its runs of 3 and 5 characters' bytes, spaces included. Each is
hashed to one of 2^bits learned vectors; the mean over all features goes to a softmax. Training is
numpy stochastic gradient descent on the driver over at most ``rows`` labelled texts (the bound is
a parameter), whose features executors count over the whole texts.

As the mean and the output layer are both linear, scoring looks up one logit a feature and class
and averages: the same figures, without the vectors.

Scale: training data is bounded; the table of logits (2^bits x classes) goes to every task; scoring
is one pass without a shuffle and memory follows a block of texts.

Defined results: null and empty texts have the class shares of the training rows, as has every
text if no row is labelled at all; ties and repeated rows are scored alike; an empty table gives
no rows. Only key columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm import words as W

GRAMS = (3, 5)
_SALT = [W.U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _features(block: bytes, words: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the features of a block of one text, kind by kind; of runs, those that begin in
    its first W.BLOCK bytes."""
    shift = W.U(64 - bits)
    if len(words):
        yield (words * _SALT[0]) >> shift
    if len(words) > 1:
        a, b = words[:-1], words[1:]
        yield (np.where(a == b, W.U(1), W.mix(a * W.U(3) + b)) * _SALT[1]) >> shift
    raw = np.frombuffer(block, np.uint8).astype(np.uint64)
    for k, n in enumerate(GRAMS):
        m = min(len(raw) - n + 1, W.BLOCK)
        if m > 0:
            x = raw[:m].copy()
            for j in range(1, n):
                x |= raw[j : m + j] << W.U(8 * j)
            yield (x * _SALT[2 + k]) >> shift


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    words, bounds = W.hashed_words(texts, fold=False)
    for k, text in enumerate(texts):
        raw = b" " + text + b" "
        for at in range(0, len(raw), W.BLOCK):
            # A block goes on for the rest of the runs that begin in it; words go with the first.
            yield k, raw[at : at + W.BLOCK + max(GRAMS) - 1], words[bounds[k] : bounds[k + 1] if at == 0 else bounds[k]]


def bucket_counts(texts: list[bytes], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text and how often each occurs."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for k, text, words in _blocks(texts):
        parts[k] += _features(text, words, bits)
    out = []
    for own in parts:
        every = np.concatenate(own) if own else np.empty(0, np.uint64)
        found, n = np.unique(every, return_counts=True)
        out.append((found.astype(np.int32), n.astype(np.float32)))
    return out


@dataclass
class Model:
    classes: list
    logits: np.ndarray  # (classes, 2^bits)
    bias: np.ndarray
    bits: int

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.classes)))
        count = np.zeros(len(texts))
        for k, text, words in _blocks(texts):
            for buckets in _features(text, words, self.bits):
                count[k] += len(buckets)
                at = buckets.astype(np.int64)
                for c in range(1, len(self.classes)):
                    total[k, c] += self.logits[c].take(at).sum(dtype=np.float64)
        z = self.bias + total / np.maximum(count, 1)[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], classes: list, *,
    bits: int, dim: int = 16, least_steps: int = 9000, epochs: int = 4, rate: float = 20.0, seed: int = 7,
) -> Model:
    """Stochastic gradient descent over the rows in a seeded order, with a rate falling to zero:
    ``epochs`` times, and as often as ``least_steps`` needs where rows are few."""
    epochs = max(epochs, -(-least_steps // max(len(rows), 1)))
    rng = np.random.default_rng(seed)
    k = len(classes)
    share = np.bincount(np.asarray(labels, np.int64), minlength=k) + 1.0
    bias = np.log(share / share.sum())
    vectors = rng.uniform(-1, 1, (1 << bits, dim)).astype(np.float32) / dim
    out = np.zeros((k, dim), np.float32)
    offset = np.zeros(k, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = rate * (1 - done / steps)
            done += 1
            at, n = rows[i]
            if not len(at):
                continue
            w = n / n.sum()
            own = vectors[at]
            mean = w @ own
            z = out @ mean + bias + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = p.astype(np.float32)
            # A mean over many features moves each of them little; their number evens that out.
            vectors[at] = own - lr * np.sqrt(w)[:, None] * (step @ out) * 0.2
            out -= 0.05 * lr * np.outer(step, mean)
            offset -= 0.002 * lr * step
    logits = (out @ vectors.T).astype(np.float32)
    logits -= logits[0]
    bias = bias + offset
    return Model(classes, logits, bias - bias[0], bits)


def train(
    docs: DataFrame, labelled: DataFrame, *, doc: str = "doc_id", label: str = "label", text: str = "text",
    rows: int = 2000, bits: int = 16, **options,
) -> Model:
    """A model of ``label`` from at most ``rows`` labelled documents, those of the least hashes."""
    pick = labelled.where(F.col(doc).isNotNull() & F.col(label).isNotNull()).select(F.col(doc).alias("_doc"), F.col(label).alias("_label"))
    pick = pick.groupBy("_doc").agg(F.max("_label").alias("_label"))
    pick = pick.orderBy(F.xxhash64("_doc"), "_doc").limit(rows)
    own = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(pick), "_doc")
    own = own.groupBy("_doc", "_label").agg(F.min("_text").alias("_text"))  # one text of a repeated id
    kind = docs.schema[doc].dataType.simpleString()
    label_kind = labelled.schema[label].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = bucket_counts(W.texts_of(batch.column("_text")), bits)
        return pa.RecordBatch.from_arrays(
            [batch.column("_doc"), batch.column("_label"), pa.array([compress(a.tobytes(), 1) for a, _ in found], pa.binary()), pa.array([compress(n.tobytes(), 1) for _, n in found], pa.binary())],
            ["doc", "label", "buckets", "counts"],
        )

    got = own.select("_doc", "_label", "_text").mapInArrow(W.mapped(work, "_text"), f"doc {kind}, label {label_kind}, buckets binary, counts binary").collect()
    got.sort(key=lambda r: (r["doc"], r["buckets"]))
    classes = sorted({r["label"] for r in got})
    if not classes:
        return Model([None], np.zeros((1, 1 << bits), np.float32), np.zeros(1), bits)
    data = [(np.frombuffer(decompress(r["buckets"]), np.int32), np.frombuffer(decompress(r["counts"]), np.float32)) for r in got]
    return fit(data, [classes.index(r["label"]) for r in got], classes, bits=bits, **options)


def score(docs: DataFrame, model: Model, *, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys``, n_words and posteriors, array<double> in the order of the model's classes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
    kinds = [f"_k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = W.texts_of(batch.column("_text"))
        p = shared.value.posteriors(texts)
        own = [batch.column(f"_k{i}") for i in range(len(keys))]
        return pa.RecordBatch.from_arrays(
            [*own, pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))],
            [*(f"_k{i}" for i in range(len(keys))), "n_words", "posteriors"],
        )

    out = rows.mapInArrow(W.mapped(work, "_text"), ", ".join([*kinds, "n_words long", "posteriors array<double>"]))
    return out.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})


def held_out(doc: Column) -> Column:
    """The fifth of ids whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """``doc``, held_out, score (the posterior of quality 1) and predicted."""
    model = train(docs, labels.where(~held_out(F.col(doc))), doc=doc, label="quality", text=text, **options)
    at = model.classes.index(1) if 1 in model.classes else None
    own = F.lit(0.5) if at is None else F.element_at("posteriors", at + 1)
    out = score(docs, model, keys=[doc], text=text)
    return out.select(doc, held_out(F.col(doc)).alias("held_out"), own.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )
