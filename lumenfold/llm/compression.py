"""Quality by compression: zstandard dictionaries of good and of bad text.

Text like the good examples compresses better with the dictionary built from them. Each text is cut into
blocks, all of it, and each block compressed with both dictionaries; the difference of the two sizes over the
text's own is the evidence. A logistic curve fitted on labelled texts that no dictionary has seen turns it into a
probability, by length: a difference says more of a long text than of a short one, so both the curve's place and its
slope go with the logarithm of the length.

The model is fitted on a bounded sample of labelled rows: at most ``Sample.rows`` of each label, those with
the least hash, and of each id its least text of at most ``Sample.chars``; so what the driver holds doesn't grow with
the input, and two fits are equal. The
dictionaries (2 x 64 KB) are broadcast. Scoring is one map without a shuffle, whole texts in blocks.

Defined cases: null and empty texts have no evidence and get the score of no difference at the least length. Rows with a null id
or a null label aren't learned from. Rows that repeat an id are scored one by one. With no usable label of
either kind every score is 0.5. Further columns are carried along; one with the name of a result is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import add_columns

BLOCK = 2048
LEVEL = 3


@dataclass(frozen=True)
class Sample:
    """The bound of what is learned from: labelled rows of each label, and the characters of one."""

    rows: int = 1500
    chars: int = 20_000
    dictionary: int = 64 << 10


class Scorer:
    """Sizes of a text under both dictionaries, and the fitted curve."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = good, bad
        self.weights = np.zeros(4)
        self._tools: list | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tools": None}

    def evidence(self, text: str) -> tuple[float, float]:
        """(size with the bad less size with the good dictionary, over the raw size; log of the raw size)."""
        if not text:
            return 0.0, 0.0
        if self._tools is None:
            used = [zstandard.ZstdCompressionDict(d) if d else None for d in (self.good, self.bad)]
            for d in used:
                if d is not None:
                    d.precompute_compress(level=LEVEL)
            self._tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in used]
        good, bad = self._tools
        data = text.encode("utf-8", "surrogatepass")
        less = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            less += len(bad(block)) - len(good(block))
        return less / len(data), math.log(len(data))

    @staticmethod
    def _terms(evidence: np.ndarray) -> np.ndarray:
        difference, length = evidence.T
        return np.column_stack([np.ones(len(evidence)), difference, length, difference * length])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """Probabilities for rows of evidence."""
        return 1 / (1 + np.exp(-np.clip(self._terms(evidence) @ self.weights, -30, 30)))

    def calibrate(self, evidence: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression by Newton's method with a small ridge."""
        x = self._terms(evidence)
        scale = np.append(1.0, np.maximum(x[:, 1:].std(0), 1e-9))
        x, w, ridge = x / scale, np.zeros(4), np.diag([1e-9, 1e-3, 1e-3, 1e-3]) * len(x)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (labels - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w / scale


def _dictionary(texts: list[str], size: int) -> bytes:
    blocks = [b[i : i + BLOCK] for t in texts for b in [t.encode("utf-8", "surrogatepass")] for i in range(0, len(b), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(blocks)[-size:]


def fit(documents: DataFrame, labels: DataFrame, sample: Sample | None = None) -> Scorer:
    """A scorer from documents(doc_id, text) and labels(doc_id, label); half the sample makes dictionaries, half the curve.

    The sample's ids are chosen before any text is touched; there are at most 2 x ``Sample.rows``, so they are
    broadcast, and only their texts come to the driver.
    """
    sample = sample or Sample()
    usable = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", "label").distinct()
    order = [F.xxhash64(F.lit(11), "doc_id"), "doc_id"]
    chosen = [usable.where(F.col("label") == k).orderBy(*order).limit(sample.rows) for k in (1, 0)]
    wanted = F.broadcast(chosen[0].union(chosen[1]))
    short = documents.where((F.length("text") > 0) & (F.length("text") <= sample.chars)).select("doc_id", "text")
    rows = short.join(wanted, "doc_id").groupBy("label", "doc_id").agg(F.min("text").alias("text"), F.first(order[0]).alias("place")).collect()
    rows.sort(key=lambda r: (r.place, r.doc_id))
    texts = [[r.text for r in rows if r.label == k] for k in (1, 0)]
    if not all(texts):
        return Scorer(b"", b"")
    scorer = Scorer(*(_dictionary(t[::2], sample.dictionary) for t in texts))
    rest = [t[1::2] or t for t in texts]
    evidence = np.array([scorer.evidence(t) for side in rest for t in side])
    scorer.calibrate(evidence, np.repeat([1.0, 0.0], [len(t) for t in rest]))
    return scorer


def score(documents: DataFrame, scorer: Scorer, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with the score of each text."""

    def compute(texts: pa.Array) -> list:
        return [pa.array(scorer.score(np.array([scorer.evidence(t.as_py()) for t in texts]).reshape(-1, 2)))]

    return add_columns(documents, [text], T.StructType([T.StructField("score", T.DoubleType())]), compute, keep)
