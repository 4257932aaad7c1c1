"""Quality rules on repetition inside a text, by suffix arrays.

The suffix array of a text's words (prefix doubling) and the common prefixes of neighbouring
suffixes give the LCP intervals, whose prefixes are the maximal repeated substrings. The spans of
those of ``min_words`` or more are united; a text goes if they cover more than ``max_percent`` of
its words or if the longest has more than ``max_repeat`` words. A text of which no run of
``min_words`` words occurs twice has no such interval, which sorted window hashes tell first.

Scale: one pass, no shuffle; memory follows one text.

Defined results: a null or empty text has no words, so it fails by length; ties and repeated rows
are judged alike, row by row; an empty table gives no rows. Only key columns are carried along,
under their names; any other column is left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm import words as W
from vectrail.llm.common import kept_rows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    min_words: int = 8
    max_percent: int = 30
    max_repeat: int = 100
    least_words: int = 20


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and the ranks of the prefixes of 1, 2, 4, ... words."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    while step < n and rank.max() < n - 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        levels.append(rank)
        step *= 2
    return order, levels


def repeats(words: np.ndarray) -> np.ndarray:
    """For each place, how long a prefix of its suffix occurs elsewhere too: the larger LCP with
    its neighbours in the suffix array."""
    n = len(words)
    order, levels = suffix_order(words)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step, ranks = 1 << k, levels[k]
        fits = np.flatnonzero((a + step <= n) & (b + step <= n))
        # Ranks tell prefixes cut off by the end apart from full ones, as these sort first.
        same = fits[ranks[a[fits]] == ranks[b[fits]]]
        lcp[same] += step
        a[same] += step
        b[same] += step
        keep = (a < n) & (b < n)
        a, b = np.where(keep, a, n), np.where(keep, b, n)
    longest = np.zeros(n, np.int64)
    longest[order[1:]] = lcp
    longest[order[:-1]] = np.maximum(longest[order[:-1]], lcp)
    return longest


def covered(words: np.ndarray, least: int) -> tuple[int, int]:
    """Words under repeated substrings of ``least`` words or more, and the longest of those."""
    if len(words) <= least:
        return 0, 0
    h = np.sort(W.windows(words, least))
    if not (h[1:] == h[:-1]).any():
        return 0, 0
    found = repeats(words)
    at = np.flatnonzero(found >= least)
    if not len(at):
        return 0, 0
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + found[at], -1)
    return int((np.cumsum(depth[:-1]) > 0).sum()), int(found.max())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, "
    "base_failed boolean, kept boolean"
)


def judged(texts: list[bytes], rules: Rules) -> dict[str, list]:
    words, bounds = W.hashed_words(texts, fold=False)
    out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
    for k, text in enumerate(texts):
        own = words[bounds[k] : bounds[k + 1]]
        raw = np.frombuffer(text, np.uint8)
        chars = int(np.count_nonzero(((raw & 0xC0) != 0x80) & ~W._SPACE[raw]))
        n, (again, longest) = len(own), covered(own, rules.min_words)
        failed = n < rules.least_words or 100 * again > rules.max_percent * n
        row = (n, chars, int(SYMBOLS[raw].sum()), repeated_lines(text), again, longest, failed, not failed and longest <= rules.max_repeat)
        for name, x in zip(out, row, strict=True):
            out[name].append(x)
    return out


def judge(df: DataFrame, *, keys: Sequence[str], text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``keys`` and the figures and verdict of every row."""
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
    kinds = ", ".join(f"_k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = judged(W.texts_of(batch.column("_text")), rules)
        own = [batch.column(f"_k{i}") for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(x) for x in found.values())], [*(f"_k{i}" for i in range(len(keys))), *found])

    out = rows.mapInArrow(W.mapped(work, "_text"), f"{kinds}, {SCHEMA}" if kinds else SCHEMA)
    return out.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})


def accepted(df: DataFrame, *, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""
    return kept_rows(df, text, lambda texts: judged(texts, rules)["kept"])


#: Base figures by windows; the longest repeat is over R if a window of R + 1 words occurs twice.
ORACLE = r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
spread as (select rid, unnest(range(1, len(ws) - 6)) as i, ws from w),
wins as (select rid, i, array_to_string(ws[i:i + 7], ' ') as win from spread),
dups as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from wins) where c > 1),
cov as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest(range(i, i + 8)) as p from dups) group by rid),
longs as (select distinct rid from (select rid, array_to_string(ws[i:i + 100], ' ') as win from spread
  where rid in (select rid from dups) and i + 100 <= len(ws)) group by rid, win having count(*) > 1),
lines as (select rid, count(*) - count(distinct line) as n_dup_lines from (select rid, unnest(string_split(text, chr(10))) as line from t)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
base as (select w.rid, doc_id, len(ws) as n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  w.rid in (select rid from longs) as long_repeat
  from w left join lines on lines.rid = w.rid left join cov on cov.rid = w.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not long_repeat as kept
from base
"""
