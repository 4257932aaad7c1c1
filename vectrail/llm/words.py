"""Words and shingles of texts as 64-bit hashes, in numpy over Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D. A word's hash is a polynomial over its
bytes, taken from running sums over a whole block of texts and then mixed; a shingle's hash mixes
its words' hashes with one odd factor for each place. Texts are cut into blocks of a quarter
megabyte, at white space where one text is longer, so memory follows the block and one text's
words, never the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
U = np.uint64
_BASE = 0xC6A4A7935BD1E995
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: ASCII punctuation becomes a marker that is dropped from words.
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        _powers[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(b))])) for b in (_BASE, _INVERSE)]
    return _powers


def _block(data: bytes, fold: bool, strip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and where each starts."""
    a = np.frombuffer(data, np.uint8)
    if fold:
        a = _FOLD[a]
    if strip:
        a = a[~_PUNCT[a]]
    gap = _SPACE[a]
    inside = ~gap
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, U), start
    power, inverse = _tables(len(a) + 1)
    total = np.empty(len(a) + 1, U)
    total[0] = 0
    np.cumsum((a.astype(U) + U(1)) * power[: len(a)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(U) * U(0x9E3779B97F4A7C15)), start


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(b" ", at, at + BLOCK), text.rfind(b"\n", at, at + BLOCK))
        if cut <= at:
            found = [x for x in (text.find(b" ", at + BLOCK), text.find(b"\n", at + BLOCK)) if x >= 0]
            cut = min(found) if found else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def hashed_words(texts: list[bytes], fold: bool = True, strip: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, and the bounds of each text's words among them.
    ``fold`` lower-cases A-Z; ``strip`` drops ASCII punctuation from words."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    pending: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not pending:
            return
        if strip:  # places shift, so each text is counted on its own
            for k, x in zip(owners, pending, strict=True):
                h, _ = _block(x, fold, True)
                hashes.append(h)
                counts[k] += len(h)
        else:
            h, start = _block(b" ".join(pending), fold, False)
            bounds = np.cumsum([0] + [len(x) + 1 for x in pending])
            np.add.at(counts, owners, np.diff(np.searchsorted(start, bounds)))
            hashes.append(h)
        pending.clear()
        owners.clear()
        size = 0

    for k, text in enumerate(texts):
        for piece in _pieces(text):
            if size + len(piece) > BLOCK:
                flush()
            pending.append(piece)
            owners.append(k)
            size += len(piece) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, U)), np.concatenate([[0], np.cumsum(counts)])


_FACTORS = mix(np.arange(1, 4097, dtype=U)) | U(1)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = words[:n] * _FACTORS[0]
    for j in range(1, k):
        out = out + words[j : j + n] * _FACTORS[j]
    return mix(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``k`` words; of fewer words, of the whole sequence."""
    if not len(words):
        return np.empty(0, U)
    if len(words) < k:
        return windows(words, len(words)) ^ U(len(words))
    h = windows(words, k)
    h.sort()
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def texts_of(column: pa.Array) -> list[bytes]:
    """Nulls are empty texts."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 * BLOCK, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``limit`` bytes of text, one row at least."""
    at = batch.schema.get_field_index(text)
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for k, n in enumerate(lengths):
        if k > begin and (size + n > limit or k - begin >= rows):
            yield batch.slice(begin, k - begin)
            begin, size = k, 0
        size += int(n)
    if begin < len(lengths):
        yield batch.slice(begin)


def release() -> None:
    """What a task's arrays leave free goes back to the system, as Python workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mapped(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str, limit: int = 4 * BLOCK) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``work`` over slices of each batch, of at most ``limit`` bytes of text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in slices(batch, text, limit):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
        release()

    return run
