"""Main text of HTML pages, by gradient-boosted trees over DOM nodes and hierarchical decoding.

Each node (block element or run of text) gets a log-odds of holding main text from trees over its
tag, depth, length, link share, subtree density, sibling figures and the families of the words in
its own and its ancestors' attributes. Decoding picks the likeliest labels of the whole tree under
the rule that a node holds main text only if its parent does: bottom up, a node's gain is its own
log-odds plus its children's positive gains; top down, a child of a chosen node is chosen if its
gain is positive. So no descendant of a rejected node survives, and no chosen one stands alone.
The trees are trained once a process on pages made from a seed (``sample_pages``).

Scale: one pass, no shuffle; a page's memory follows its own size. The trees go to every task.

Defined results: a null, empty or text-free page gives an empty text; text without markup is main
text if the trees say so; repeated rows are each extracted; an empty table gives no rows. Only key
columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm import boosting, sample_pages
from vectrail.llm import words as W
from vectrail.llm.dom import Page, features


def labelled(html: str) -> tuple[Page, np.ndarray]:
    """A made page without its marks, and for each node whether it holds main text."""
    page = Page(html)
    holds = np.zeros(len(page.parent), bool)
    for k, text in enumerate(page.text):
        if text is not None:
            holds[k] = sample_pages.MAIN in text
            page.text[k] = text.replace(sample_pages.MAIN, "").replace(sample_pages.REST, "") or "."
    for k in range(len(holds) - 1, 0, -1):
        holds[page.parent[k]] |= holds[k]
    return page, holds


@lru_cache(maxsize=4)
def trained(pages: int = 900, seed: int = 13, trees: int = 90, **options) -> boosting.Trees:
    made = [labelled(x) for x in sample_pages.pages(pages, seed)]
    return boosting.fit(np.concatenate([features(p) for p, _ in made]), np.concatenate([y for _, y in made]).astype(float), trees=trees, **options)


def decode(parent: list[int], logits: np.ndarray, most: float = 6.0) -> np.ndarray:
    """The likeliest labels with no chosen node below a rejected one."""
    own = np.clip(logits, -most, most).tolist()
    gain = own[:]
    for k in range(len(parent) - 1, 0, -1):
        if gain[k] > 0:
            gain[parent[k]] += gain[k]
    chosen = [False] * len(parent)
    for k, p in enumerate(parent):
        chosen[k] = gain[k] > 0 and (p < 0 or chosen[p])
    return np.array(chosen)


def extract(pages: list[str], trees: boosting.Trees) -> list[str]:
    parsed = [Page(x) for x in pages]
    if not parsed:
        return []
    logits = trees.logits(np.concatenate([features(p) for p in parsed]))
    out, at = [], 0
    for p in parsed:
        n = len(p.parent)
        chosen = decode(p.parent, logits[at : at + n])
        at += n
        out.append(" ".join(t for t, c in zip(p.text, chosen, strict=True) if c and t is not None))
    return out


def main_text(df: DataFrame, *, keys: Sequence[str], html: str = "html", trees: boosting.Trees | None = None) -> DataFrame:
    """``keys``, text and n_chars of every page."""
    shared = df.sparkSession.sparkContext.broadcast(trees or trained())
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(html).alias("_html"))
    kinds = [f"_k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract([x or "" for x in batch.column("_html").to_pylist()], shared.value)
        own = [batch.column(f"_k{i}") for i in range(len(keys))]
        return pa.RecordBatch.from_arrays(
            [*own, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(f"_k{i}" for i in range(len(keys))), "text", "n_chars"]
        )

    out = rows.mapInArrow(W.mapped(work, "_html"), ", ".join([*kinds, "text string, n_chars long"]))
    return out.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})
