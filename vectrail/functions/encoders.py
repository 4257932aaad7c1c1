"""Text encoders: texts to unit vectors, as iterator pandas UDFs that load a model once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions.text import DOCUMENT_PREFIX, QUERY_PREFIX

#: Model files looked for, in order, and the pooling of each. Fixed values.
ONNX_FILES = (("model_q4", "second_output"), ("model_quint8_avx2", "cls"), ("model_uint8", "cls"), ("model", "cls"))


@dataclass(frozen=True)
class EncoderSpec:
    """How to encode: ``hashing`` needs no files; ``onnx`` needs a folder with a model and a
    tokenizer that every executor can read."""

    kind: str = "hashing"
    dim: int = 64
    path: str | None = None
    file: str | None = None
    pooling: str = "cls"
    max_tokens: int = 256
    document_prefix: str = ""
    query_prefix: str = ""

    @staticmethod
    def resolve(path: str, file: str | None = None) -> EncoderSpec:
        """The spec of a model folder. A named file must be there; else the first known one."""
        from pathlib import Path

        root = Path(path)
        if file is not None:
            if not (root / file).exists() and not (root / "onnx" / file).exists():
                raise FileNotFoundError(file)
            return EncoderSpec("onnx", path=path, file=file)
        for stem, pooling in ONNX_FILES:
            for place in (root / f"{stem}.onnx", root / "onnx" / f"{stem}.onnx"):
                if place.exists():
                    asymmetric = pooling == "second_output"
                    return EncoderSpec(
                        "onnx", path=path, file=str(place.relative_to(root)), pooling=pooling,
                        document_prefix=DOCUMENT_PREFIX if asymmetric else "", query_prefix=QUERY_PREFIX if asymmetric else "",
                    )
        return EncoderSpec("static", path=path)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(size == 0, 1, size)).astype(np.float32)


def hashing(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of words and word pairs."""
    import xxhash

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for k, text in enumerate(texts):
            words = text.lower().split()
            for feature in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = xxhash.xxh64_intdigest(feature.encode())
                out[k, h % dim] += 1 if h >> 63 else -1
        return _unit(out)

    return encode


def _onnx(spec: EncoderSpec) -> Callable[[list[str]], np.ndarray]:
    from pathlib import Path

    import onnxruntime
    from tokenizers import Tokenizer

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    root = Path(spec.path)
    place = root / spec.file if (root / spec.file).exists() else root / "onnx" / spec.file
    session = onnxruntime.InferenceSession(str(place), options)
    tokenizer = Tokenizer.from_file(str(root / "tokenizer.json"))
    tokenizer.enable_truncation(spec.max_tokens)
    tokenizer.enable_padding()
    names = {x.name for x in session.get_inputs()}

    def encode(texts: list[str]) -> np.ndarray:
        found = tokenizer.encode_batch(texts)
        ids = np.array([e.ids for e in found], np.int64)
        feed = {"input_ids": ids, "attention_mask": np.array([e.attention_mask for e in found], np.int64), "token_type_ids": np.zeros_like(ids)}
        got = session.run(None, {k: v for k, v in feed.items() if k in names})
        return _unit(got[1] if spec.pooling == "second_output" else got[0][:, 0])

    return encode


def _static(spec: EncoderSpec) -> Callable[[list[str]], np.ndarray]:
    from model2vec import StaticModel  # optional

    model = StaticModel.from_pretrained(spec.path)
    return lambda texts: _unit(np.asarray(model.encode(texts)))


def encoder(spec: EncoderSpec) -> Callable[[list[str]], np.ndarray]:
    """Texts to unit vectors; loads what the spec names."""
    return {"hashing": lambda: hashing(spec.dim), "onnx": lambda: _onnx(spec), "static": lambda: _static(spec)}[spec.kind]()


def dimension(spec: EncoderSpec) -> int:
    """The length of the spec's vectors; of a model, as it encodes a word."""
    return spec.dim if spec.kind == "hashing" else len(encoder(spec)(["hello"])[0])


def encode(text: Column, spec: EncoderSpec = EncoderSpec(), query: bool = False, batch: int = 512) -> Column:
    """array<float> of unit length for each text; a null text is empty."""
    prefix = spec.query_prefix if query else spec.document_prefix

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder(spec)
        for part in parts:
            rows: list = []
            for at in range(0, len(part), batch):
                rows += list(model(part.iloc[at : at + batch].tolist()))
            yield pd.Series(rows, index=part.index, dtype=object)

    return run(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))))


def encode_missing(df: DataFrame, spec: EncoderSpec = EncoderSpec(), text: str = "sentence", name: str = "embedding") -> DataFrame:
    """Vectors for the rows that have none; only those pass through the encoder."""
    if name not in df.columns:
        return df.withColumn(name, encode(F.col(text), spec))
    columns = [c for c in df.columns if c != name]
    done = df.where(F.col(name).isNotNull())
    late = df.where(F.col(name).isNull()).select(*columns, encode(F.col(text), spec).alias(name))
    return done.select(*columns, name).unionByName(late)
