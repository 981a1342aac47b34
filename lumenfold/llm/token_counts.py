"""Token counts under a unigram model, by dynamic programming along a trie.

The distinct pre-tokens of a group of texts are put into a trie (walked as the sorted list, in which each word
shares its prefix with the last). The forward score of a prefix - the best log probability of any cut of it
into pieces - is computed once for all words below it; a word's token count is stored at its end. Texts then
add up the counts of their words. One map without a shuffle; words and counts are kept in a bounded cache.

Pieces come from a sentencepiece file. Such a file orders its pieces and gives no probabilities, so piece
number r of that order has a probability in proportion to 1 / (r + 1). A letter that is no piece costs its
UTF-8 bytes as tokens. Words are runs of anything but ASCII white space, with the file's word mark before.

Defined cases: null, empty and blank texts count 0. Equal scores go to the longest last piece. Repeated rows
and equal ids don't matter. Further columns are carried along; one with the name of a result is replaced.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenfold.llm.common import WORD, add_columns

MARK = "▁"
CACHED_WORDS = 300_000
GROUP_CHARS = 1 << 20
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType())])
_WORDS = re.compile(WORD).findall


def load_pieces(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece file with their log probabilities."""
    from sentencepiece import SentencePieceProcessor

    file = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(file.get_piece_size()) if not (file.is_control(i) or file.is_unknown(i) or file.is_unused(i) or file.is_byte(i))]
    ids.sort(key=lambda i: (-file.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(ids))))
    return {file.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ids)}


class Counter:
    """Forward scores along the trie, and the cache of words."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.byte = min(pieces.values(), default=0.0) - 10.0
        self.reach: dict[str, int] = {}  # the longest piece that ends with this letter pair
        for p in pieces:
            self.reach[p[-2:]] = max(len(p), self.reach.get(p[-2:], 1))
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.tokens, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cache": {}, "tokens": self.tokens[:0], "scores": self.scores[:0]}

    def walk(self, words: list[str]) -> list[tuple[int, float]]:
        """(tokens, score) of each word of a sorted list."""
        out, last = [], MARK
        get, reach, byte = self.pieces.get, self.reach.get, self.byte
        best, count = [0.0], [0]
        self._extend(MARK, 0, best, count)
        for word in words:
            marked = MARK + word
            shared, most = 1, min(len(last), len(marked))
            while shared < most and last[shared] == marked[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for j in range(shared + 1, len(marked) + 1):
                top, tokens = -math.inf, 0
                for i in range(max(0, j - reach(marked[max(0, j - 2) : j], 1)), j):
                    score = get(marked[i:j])
                    if score is not None and best[i] + score > top:
                        top, tokens = best[i] + score, count[i] + 1
                if top == -math.inf:
                    size = len(marked[j - 1].encode("utf-8", "surrogatepass"))
                    top, tokens = best[j - 1] + size * byte, count[j - 1] + size
                best.append(top)
                count.append(tokens)
            out.append((count[-1], best[-1]))
            last = marked
        return out

    def _extend(self, text: str, at: int, best: list[float], count: list[int]) -> None:
        score = self.pieces.get(text)
        size = len(text.encode())
        best.append(score if score is not None else size * self.byte)
        count.append(1 if score is not None else size)

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, tokens, log probability) of each text."""
        found = [_WORDS(t) for t in texts]
        if len(self.cache) > CACHED_WORDS:
            self._forget()
        new = sorted({w for words in found for w in words}.difference(self.cache))
        if new:
            self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new))))
            made = self.walk(new)
            self.tokens = np.append(self.tokens, [n for n, _ in made])
            self.scores = np.append(self.scores, [s for _, s in made])
        sizes = np.array([len(words) for words in found], np.int64)
        places = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        tokens = np.bincount(owner, self.tokens[places], len(texts)).astype(np.int64)
        return sizes, tokens, np.bincount(owner, self.scores[places], len(texts))


def count(documents: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with n_words, n_tokens and log_prob of each text. ``vocabulary``: a file's path."""
    shipped = documents.sparkSession.sparkContext.broadcast(Counter(load_pieces(vocabulary)))

    def compute(texts: pa.Array) -> list:
        rows, parts, at = texts.to_pylist(), [], 0
        while at < len(rows):
            group, size = [], 0
            while at < len(rows) and (not group or size < GROUP_CHARS):
                group.append(rows[at] or "")
                size += len(group[-1])
                at += 1
            parts.append(shipped.value.measure(group))
        return [np.concatenate(column) for column in zip(*parts)]

    return add_columns(documents, [text], RESULT, compute, keep)
