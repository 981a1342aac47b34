"""Language identification, words first.

A known word adds its log frequency in each language. An unknown word falls back to the character n-grams at
its end and beginning: for each place the longest known n-gram, from ``longest`` letters down to one. A
text's evidence is the sum over its words divided by the square root of their number, and the probability a softmax
over the languages.

The model is fitted on a bounded sample of each language by itself, so that every language with a label is
learned at every size and skew: about ``Sample.rows`` ids of each language, those whose hash is under the
language's share (all, if it has no more). Their words are counted by Spark, and of each language the
``Sample.words`` most frequent come to the driver; n-grams are limited by language likewise. With very many
languages, both limits fall so that languages times rows stay within ``Sample.cells`` for each of the two. The
model is broadcast. Predicting is one map without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Rows without id or language
aren't learned from. With nothing to learn from, all is ``und``. Ties go to the first language by code point.
Rows that repeat an id are predicted one by one. Further columns are carried along; one with the name of a
result is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import add_columns

UNKNOWN = "und"
_WORDS = regex.compile(r"\p{L}+").findall
CACHED_WORDS = 200_000
GROUP_CHARS = 1 << 20
#: What is added to each count of a word or n-gram.
SMOOTH = 0.05
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class Sample:
    """The bound of what is learned from, and of the model: rows, words and n-grams of each language."""

    rows: int = 6000
    words: int = 60_000
    ngrams: int = 40_000
    longest: int = 4
    cells: int = 8_000_000

    def each(self, limit: int, languages: int) -> int:
        """``limit`` for each of so many languages, or what ``cells`` leave of it."""
        return max(1, min(limit, self.cells // max(languages, 1) ** 2))


def _largest(values: dict[str, float], most: int) -> list[str]:
    """The ``most`` names of the largest values, equal ones in order of name."""
    if len(values) <= most:
        return list(values)
    least = np.partition(np.fromiter(values.values(), float, len(values)), len(values) - most)[len(values) - most]
    above = [name for name, value in values.items() if value > least]
    return above + sorted(name for name, value in values.items() if value == least)[: most - len(above)]


class Model:
    """Log frequencies by language of words and of n-grams (with ^ and $ for a word's ends)."""

    def __init__(self, languages: list[str], words: dict[str, np.ndarray], sample: Sample) -> None:
        self.languages, self.longest = languages, sample.longest
        # Smoothing counts in the totals, or what a language with few words lacks would seem likely in it.
        totals = sum(words.values(), np.zeros(len(languages))) + 1.0 + SMOOTH * len(words)
        known = [w for w, n in words.items() if n.sum() > 1]
        grams: list[dict[str, float]] = [defaultdict(float) for _ in languages]
        for word, n in words.items():
            parts = self._grams(word)
            for k in np.flatnonzero(n):
                weight, of = float(np.sqrt(n[k])), grams[k]
                for g in parts:
                    of[g] += weight
        most = sample.each(sample.ngrams, len(languages))
        best = sorted({g for of in grams for g in _largest(of, most)})
        weights = np.array([[of.get(g, 0.0) for of in grams] for g in best]).reshape(len(best), len(languages))
        sizes = np.array([len(g) for g in best], np.int64)
        by_size = np.stack([np.bincount(sizes, weights[:, k] + SMOOTH, sample.longest + 1) + 1.0 for k in range(len(languages))], 1) if languages else np.ones((sample.longest + 1, 0))
        counts = np.array([words[w] for w in known]).reshape(len(known), len(languages))
        self.words = {w: i for i, w in enumerate(known)}
        self.grams = {g: len(known) + i for i, g in enumerate(best)}
        self.table = np.concatenate([np.log((counts + SMOOTH) / totals), np.log((weights + SMOOTH) / by_size[sizes]), np.zeros((1, len(languages)))])
        self.table -= self.table.mean(1, keepdims=True) if languages else 0.0
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.seen = np.zeros((0, len(self.languages)))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cache": {}, "seen": self.seen[:0]}

    def _grams(self, word: str) -> list[str]:
        marked = f"^{word}$"
        return [marked[i : i + n] for n in range(1, self.longest + 1) for i in range(len(marked) - n + 1)]

    def evidence(self, words: list[str]) -> np.ndarray:
        """Each word's evidence by language: its own row if known, else the mean over its n-grams."""
        rows, sizes, grams, longest = [], [], self.grams.get, self.longest
        for word in words:
            known = self.words.get(word)
            before = len(rows)
            if known is not None:
                rows.append(known)
            else:
                marked = f"^{word}$"
                for i in range(len(marked)):
                    for j in range(min(i + longest, len(marked)), i, -1):
                        if (row := grams(marked[i:j])) is not None:
                            rows.append(row)
                            break
                if len(rows) == before:
                    rows.append(len(self.table) - 1)
            sizes.append(len(rows) - before)
        starts = np.cumsum([0, *sizes[:-1]])
        return np.add.reduceat(self.table[rows], starts) / np.array(sizes)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [_WORDS(t.lower()) if t else [] for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if len(self.cache) > CACHED_WORDS:
            self._forget()
        new = list({w for words in found for w in words}.difference(self.cache))
        if new:
            self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new))))
            self.seen = np.concatenate((self.seen, self.evidence(new)))
        sizes = np.array([len(words) for words in found])
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        filled = np.flatnonzero(sizes)
        if len(filled):
            places = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
            starts = np.cumsum(np.append(0, sizes[filled][:-1]))
            total = np.add.reduceat(self.seen[places], starts) / np.sqrt(sizes[filled])[:, None]
            share = np.exp(total - total.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            for i, best, row in zip(filled, total.argmax(1), share):
                names[i], scores[i] = self.languages[best], float(row[best])
        return names, scores


def _place(column: str) -> Column:
    """An even value in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(17), column), 11) / F.lit(float(1 << 53))


#: The most languages of a model.
MOST_LANGUAGES = 500


def _cut(times: dict[int, int], most: int) -> tuple[int, float]:
    """(count, share): with all words above the count, and this share of those at it, there are about ``most``."""
    taken = 0
    for n in sorted(times, reverse=True):
        if taken + times[n] > most:
            return n, (most - taken) / times[n]
        taken += times[n]
    return 0, 0.0


def fit(labelled: DataFrame, sample: Sample | None = None) -> Model:
    """A model from ``labelled(doc_id, text, lang)``.

    The sample's ids are about ``Sample.rows`` a language, of those with a text, taken by hash and a table of at most MOST_LANGUAGES sizes. Of more than
    MOST_LANGUAGES values of lang (labels that are typed by hand, say) those with the most documents are learned, equal ones by
    name, so that the model on the driver is bounded. No step sorts or collects a language in one task: shares are taken by hash.
    """
    sample = sample or Sample()
    usable = labelled.where("doc_id is not null and lang is not null")
    sizes = usable.where("text is not null").groupBy("lang").agg(F.countDistinct("doc_id").alias("ids"))
    sizes = sizes.orderBy(F.desc("ids"), "lang").limit(MOST_LANGUAGES)
    rows = usable.where("text is not null").select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang")
    rows = rows.where(_place("doc_id") * F.col("ids") < sample.rows)
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy("word", "lang").count().persist()
    times = defaultdict(dict)
    for r in counted.groupBy("lang", "count").agg(F.count("*").alias("words")).collect():
        times[r.lang][r["count"]] = r.words
    languages = sorted(times)
    most = sample.each(sample.words, len(languages))
    cuts = labelled.sparkSession.createDataFrame([(lang, *_cut(times[lang], most)) for lang in languages], "lang string, least long, share double")
    wanted = (F.col("count") > F.col("least")) | ((F.col("count") == F.col("least")) & (_place("word") < F.col("share")))
    counts = counted.join(cuts, "lang").where(wanted).select("word", "lang", "count").toArrow()
    counted.unpersist()
    table: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for word, lang, n in sorted(zip(*(counts.column(k).to_pylist() for k in range(3)))):
        table[word][languages.index(lang)] += n
    return Model(languages, dict(table), sample)


def identify(documents: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with lang_pred and score of each text."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list:
        rows, names, scores, at = texts.to_pylist(), [], [], 0
        while at < len(rows):
            group, size = [], 0
            while at < len(rows) and (not group or size < GROUP_CHARS):
                group.append(rows[at])
                size += len(rows[at] or "")
                at += 1
            for whole, part in zip((names, scores), shipped.value.predict(group)):
                whole += part
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return add_columns(documents, [text], RESULT, compute, keep)
