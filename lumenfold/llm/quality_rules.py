"""Quality rules by repetition coverage.

Word windows of several lengths are hashed by rolling polynomials in numpy; the measure is the share of word
characters that lie in windows and lines already seen in the same text. One map over the rows, no shuffle.

Defined cases: a null, empty or blank text has no words, counts 0 everywhere and is rejected for having fewer
than ``min_words``. Repeated rows and equal ids are judged one by one. Further columns are carried along; one
with the name of a result is replaced. Memory is some 60 bytes a word of the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import add_columns, pieces, text_bytes
from lumenfold.llm.words import Words, find_words, mix, range_hashes, windows

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("line_coverage", T.DoubleType()), T.StructField("ngram_coverage", T.ArrayType(T.DoubleType()))]
)


@dataclass(frozen=True)
class Limits:
    """The most a kept text may hold: shares of word characters in repeats after the first."""

    min_words: int = 50
    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.15, 7: 0.13, 10: 0.10})
    lines: float = 0.20


def repeated(keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Indices of valid keys that occur at least twice."""
    ordered = np.sort(keys[valid])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return np.flatnonzero((twice[at] == keys) & valid)


def later(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Those of the repeated indices that aren't the first with their key."""
    _, first = np.unique(keys[found], return_index=True)
    keep = np.ones(len(found), bool)
    keep[first] = False
    return found[keep]


def covered(found: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the words lie in the n-word windows that begin at ``found``."""
    steps = np.zeros(total + 1, np.int64)
    steps[found] += 1
    steps[found + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """Counts and coverages of the documents whose bytes are data[offsets[i]:offsets[i + 1]]."""
    n_docs = len(offsets) - 1
    words = find_words(data, offsets)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = points[words.end] - points[words.start]
    salt = mix(np.arange(n_docs, dtype=np.uint64) + np.uint64(0x5851F42D))

    def total(weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, weights, n_docs).astype(np.int64)

    out = {"n_words": np.bincount(words.doc, minlength=n_docs), "word_chars": total(chars, words.doc)}
    symbols = np.flatnonzero(SYMBOLS[data])
    out["n_symbols"] = np.bincount(np.searchsorted(offsets, symbols, side="right") - 1, minlength=n_docs)

    def window_repeats(n: int) -> tuple[np.ndarray, np.ndarray]:
        hashes, same = windows(words, n)
        keys = hashes ^ salt[words.doc[: len(hashes)]]
        return keys, repeated(keys, same)

    _, triples = window_repeats(3)
    out["n_repeat_words"] = total(covered(triples, 3, len(words.doc)), words.doc)

    breaks = np.flatnonzero(data == 0x0A)
    edges = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    edges = edges[edges < len(data)] if len(data) else edges[:0]
    stops = np.append(edges[1:], len(data))[: len(edges)]
    stops = stops - ((stops > edges) & (data[np.maximum(stops, 1) - 1] == 0x0A)) if len(edges) else stops
    first_word = np.searchsorted(words.start, edges)
    last_word = np.searchsorted(words.start, stops)
    filled = last_word > first_word
    edges, stops, first_word, last_word = edges[filled], stops[filled], first_word[filled], last_word[filled]
    line_doc = np.searchsorted(offsets, edges, side="right") - 1
    line_keys = range_hashes(data, edges, stops) ^ salt[line_doc]
    again = later(line_keys, repeated(line_keys, np.ones(len(edges), bool)))
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n_docs)
    reach = np.concatenate(([0], np.cumsum(chars)))
    line_chars = total(reach[last_word[again]] - reach[first_word[again]], line_doc[again])

    size = np.maximum(out["word_chars"], 1)
    out["line_coverage"] = line_chars / size
    shares = []
    for n in limits.ngrams:
        keys, found = window_repeats(n)
        inside = covered(later(keys, found), n, len(words.doc))
        shares.append(total(chars * inside, words.doc) / size)
    out["ngram_coverage"] = np.stack(shares, 1) if shares else np.zeros((n_docs, 0))
    out["base_failed"] = (out["n_words"] < limits.min_words) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    fine = (out["line_coverage"] <= limits.lines) & (out["ngram_coverage"] <= np.array(list(limits.ngrams.values()))).all(1)
    out["kept"] = ~out["base_failed"] & fine
    return out


def assess(documents: DataFrame, limits: Limits | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with the counts, coverages and verdict of each text."""
    limits = limits or Limits()

    def compute(texts: pa.Array) -> list:
        data, offsets = text_bytes(texts)
        parts = [measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], limits) for i, j in pieces(offsets)]
        whole = {c: np.concatenate([p[c] for p in parts]) for c in RESULT.fieldNames()}
        shares = whole["ngram_coverage"]
        whole["ngram_coverage"] = pa.ListArray.from_arrays(
            pa.array(np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1]), pa.array(shares.ravel())
        )
        return [whole[c] for c in RESULT.fieldNames()]

    return add_columns(documents, [text], RESULT, compute, keep)


def keep_good(documents: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The documents that pass, with their own columns."""
    own = documents.select([F.struct("*").alias("row"), F.col("text").alias("text")])
    return assess(own, limits).where("kept").select("row.*")
