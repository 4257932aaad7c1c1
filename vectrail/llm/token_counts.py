"""Token counts under a unigram model, by dynamic programming shared along a trie.

The distinct pre-tokens of a block of texts (a word with the word-start mark before it) go into a
trie, level by level: the words that share a prefix share its node. A node's forward score, the best
log-probability of any segmentation of its prefix, and the token count of that segmentation are
computed once, for all nodes of a level together, from the nodes above; the count at a pre-token's
last node is its terminal count. A document's count is the sum over its pre-tokens.

Pieces come from a SentencePiece file, whose path is a parameter. A BPE file holds merge ranks, not
probabilities, so the piece of rank r gets Zipf's log(1 / (r + 1)). A character that no piece
covers scores 10 below the worst piece and counts one token for each of its bytes. Among equal
scores the segmentation whose last piece is longest wins.

Scale: one pass, no shuffle. The driver reads the file and sends its pieces (tens of thousands). A block
has at most ``BLOCK`` bytes of text, and its trie ends with it; terminal counts of up to ``most``
words are remembered by a task, then it starts anew. A word of over ``deep`` characters, such as a text
without spaces, is scored on its own in a window as long as the longest piece, without nodes.

Defined results: words are runs of bytes other than space and 0x09-0x0D; a null or empty text has
no tokens; repeated rows are counted each; an empty table gives no rows. Only key columns are
carried along, under their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm import words as W

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def zipf_pieces(path: str) -> dict[str, float]:
    """Pieces of a SentencePiece file with their log-probabilities."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [k for k in range(p.get_piece_size()) if not (p.is_unknown(k) or p.is_control(k) or p.is_byte(k) or p.is_unused(k))]
    own.sort(key=lambda k: (-p.get_score(k), k))
    return {p.id_to_piece(k): -math.log(r + 1) for r, k in enumerate(own)}


#: Bytes of text whose distinct words share a trie.
BLOCK = 1 << 22
_CHAR = 21  # bits of a code point


class Pieces:
    """Pieces as a trie over their characters from the last to the first."""

    def __init__(self, pieces: dict[str, float]):
        step: dict[int, int] = {}
        score = [math.nan]
        for piece, own in pieces.items():
            state = 0
            for char in reversed(piece):
                key = state << _CHAR | ord(char)
                state = step.get(key, 0)
                if not state:
                    state = step[key] = len(score)
                    score.append(math.nan)
            score[state] = own
        self.keys = np.array(sorted(step), np.int64)
        self.states = np.array([step[k] for k in self.keys.tolist()], np.int64)
        self.score = np.array(score)
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY

    def after(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states after a further character, 0 where no piece goes on."""
        if not len(self.keys):
            return np.zeros(len(states), np.int64)
        keys = states << _CHAR | chars
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.states[at], 0)


class _Nodes:
    """Nodes of a trie, parents first; node 0 is the empty prefix."""

    def __init__(self, pieces: Pieces, most: int):
        self.pieces, self.n = pieces, 1
        self.up, self.char, self.count = (np.zeros(most + 1, np.int64) for _ in range(3))
        self.best = np.zeros(most + 1)

    def add(self, up: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Nodes below others, with their forward scores and counts."""
        new = np.arange(self.n, self.n + len(up))
        self.n += len(up)
        self.up[new], self.char[new] = up, char
        top, count = np.full(len(up), -np.inf), np.zeros(len(up), np.int64)
        alive, at, state = np.arange(len(up)), new, np.zeros(len(up), np.int64)
        covered = ~np.isnan(self.pieces.score[self.pieces.after(state, char)])
        while len(alive):
            state = self.pieces.after(state, self.char[at])
            alive, at, state = alive[state > 0], at[state > 0], state[state > 0]
            before = self.up[at]
            score = self.pieces.score[state]
            found = self.best[before] + score
            better = found >= top[alive]  # of equal scores the longest last piece, found last
            top[alive[better]] = found[better]
            count[alive[better]] = self.count[before[better]] + 1
            on = before > 0
            alive, at, state = alive[on], before[on], state[on]
        unknown = self.best[up] + self.pieces.unknown
        late = ~covered & (unknown > top)
        top[late] = unknown[late]
        size = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        count[late] = self.count[up[late]] + size[late]
        self.best[new], self.count[new] = top, count
        return new


class Trie(dict):
    """Word -> terminal count, computed when first asked for, best for many words at once."""

    def __init__(self, pieces: Pieces, most: int = 1_000_000, deep: int = 64):
        super().__init__()
        self.pieces, self.most, self.deep = pieces, most, deep

    def __missing__(self, word: bytes) -> int:
        self.learn([word])
        return self[word]

    def learn(self, words: list[bytes]) -> None:
        texts = [MARK + w.decode() for w in words]
        short = [(w, t) for w, t in zip(words, texts, strict=True) if len(t) <= self.deep]
        for w, t in zip(words, texts, strict=True):
            if len(t) > self.deep:
                self[w] = self._alone(t)
        if short:
            size = np.array([len(t) for _, t in short])
            chars = np.frombuffer("".join(t for _, t in short).encode("utf-32-le"), np.uint32).astype(np.int64)
            begin = np.cumsum(size) - size
            nodes, at = _Nodes(self.pieces, len(chars)), np.zeros(len(short), np.int64)
            for depth in range(size.max()):
                on = np.flatnonzero(size > depth)
                keys, which = np.unique(at[on] << _CHAR | chars[begin[on] + depth], return_inverse=True)
                at[on] = nodes.add(keys >> _CHAR, keys & ((1 << _CHAR) - 1))[which]
            self.update(zip((w for w, _ in short), nodes.count[at].tolist(), strict=True))

    def _alone(self, text: str) -> int:
        """The count of one long text, from the scores of as many places as the longest piece has."""
        pieces, scores, counts = self.pieces, [0.0], [0]
        step = dict(zip(pieces.keys.tolist(), pieces.states.tolist(), strict=True))
        for end in range(len(text)):
            top, n, state, whole = -math.inf, 0, 0, False
            for back in range(1, min(pieces.longest, end + 1) + 1):
                state = step.get(state << _CHAR | ord(text[end + 1 - back]), 0)
                if not state:
                    break
                own = float(pieces.score[state])
                if own == own:
                    whole = whole or back == 1
                    if scores[-back] + own >= top:
                        top, n = scores[-back] + own, counts[-back] + 1
            if not whole and scores[-1] + pieces.unknown > top:
                top, n = scores[-1] + pieces.unknown, counts[-1] + len(text[end].encode())
            scores.append(top)
            counts.append(n)
            if len(scores) > 4096 + pieces.longest:
                del scores[: -pieces.longest], counts[: -pieces.longest]
        return counts[-1]

    def counts(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text of a block."""
        split = [x.split() for x in texts]
        if len(self) > self.most:
            self.clear()
        new = set()
        for words in split:
            new.update(words)
        new.difference_update(self)
        self.learn(sorted(new))
        return [len(words) for words in split], [sum(map(self.__getitem__, words)) for words in split]


def count_tokens(
    df: DataFrame, model_path: str, *, keys: Sequence[str], text: str = "text", most: int = 1_000_000
) -> DataFrame:
    """``keys``, n_words and n_tokens of every row."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces(zipf_pieces(model_path)))
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
    kinds = [f"_k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]

    def run(batches):
        trie = Trie(shared.value, most)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [batch.column(f"_k{i}") for i in range(len(keys))]
            names = [*(f"_k{i}" for i in range(len(keys))), "n_words", "n_tokens"]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in trie.counts(W.texts_of(batch.column("_text"))))], names)

        yield from W.mapped(work, "_text", BLOCK)(batches)

    out = rows.mapInArrow(run, ", ".join([*kinds, "n_words long, n_tokens long"]))
    return out.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})
