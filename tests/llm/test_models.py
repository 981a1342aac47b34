"""The learned operators' scores, and token counts, worked out again in plain Python on small models."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import zstandard
from llm import brute

from lumenfold.llm import compression, langid, token_counts


def plain_language_scores(model_words, languages, longest, text):
    """Word-first backoff as the docstring tells it: known words by frequency, others by their longest known n-grams."""
    totals = [sum(n[k] for n in model_words.values()) + 1 + langid.SMOOTH * len(model_words) for k in range(len(languages))]
    grams = {}
    for word, n in model_words.items():
        marked = f"^{word}$"
        for size in range(1, longest + 1):
            for i in range(len(marked) - size + 1):
                old = grams.setdefault(marked[i : i + size], [0.0] * len(languages))
                for k, c in enumerate(n):
                    old[k] += math.sqrt(c)
    by_size = {s: [1 + sum(v[k] + langid.SMOOTH for g, v in grams.items() if len(g) == s) for k in range(len(languages))] for s in range(1, longest + 1)}

    def centred(row):
        return [x - sum(row) / len(row) for x in row]

    def of_word(word):
        if word in model_words and sum(model_words[word]) > 1:
            return centred([math.log((c + langid.SMOOTH) / t) for c, t in zip(model_words[word], totals)])
        rows, marked = [], f"^{word}$"
        for i in range(len(marked)):
            found = next((marked[i:j] for j in range(min(i + longest, len(marked)), i, -1) if marked[i:j] in grams), None)
            if found:
                rows.append(centred([math.log((v + langid.SMOOTH) / t) for v, t in zip(grams[found], by_size[len(found)])]))
        return [sum(c) / len(rows) for c in zip(*rows)] if rows else [0.0] * len(languages)

    words = re.findall(r"[^\W\d_]+", text.lower())
    sums = [sum(c) / math.sqrt(len(words)) for c in zip(*map(of_word, words))]
    top = max(sums)
    shares = [math.exp(s - top) for s in sums]
    return [s / sum(shares) for s in shares]


def test_language_scores():
    languages, rng = ["de", "en", "fi"], random.Random(3)
    words = {}
    for k in range(3):
        for _ in range(30):
            word = "".join(rng.choice(("abcde", "cdefg", "efghi")[k]) for _ in range(rng.randint(1, 6)))
            words.setdefault(word, np.zeros(3))[k] += rng.randint(1, 9)
    model = langid.Model(languages, words, langid.Sample())
    for _ in range(50):
        text = " ".join("".join(rng.choice("abcdefghiz") for _ in range(rng.randint(1, 7))) if rng.random() < 0.5 else rng.choice(list(words)) for _ in range(rng.randint(1, 9)))
        wanted = plain_language_scores({w: n.tolist() for w, n in words.items()}, languages, 4, text)
        names, scores = model.predict([text])
        assert scores[0] == pytest.approx(max(wanted)) and wanted[languages.index(names[0])] == pytest.approx(max(wanted))


def test_ngram_limit_is_by_value_then_name():
    values = {"b": 2.0, "a": 2.0, "c": 3.0, "d": 1.0, "e": 2.0}
    for most in range(1, 7):
        assert sorted(langid._largest(values, most)) == sorted(sorted(values, key=lambda g: (-values[g], g))[:most])


def test_compression_scores():
    rng = random.Random(8)
    good = ["the quick brown fox number " + " ".join(rng.choices(["jumps", "over", "lazy", "dogs", "today"], k=60)) for _ in range(40)]
    bad = [" ".join(rng.choices(["buy", "now", "$$$", "click", "free!!!"], k=60)) for _ in range(40)]
    scorer = compression.Scorer("".join(good).encode()[-4000:], "".join(bad).encode()[-4000:])
    evidence = np.array([scorer.evidence(t) for t in good + bad])
    labels = np.repeat([1.0, 0.0], 40)
    scorer.calibrate(evidence, labels)

    def size(data, dictionary=None):
        used = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        plain = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=used, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(plain.compress(data[i : i + compression.BLOCK])) for i in range(0, len(data), compression.BLOCK))

    for text in [*good[:3], *bad[:3], "x" * 5000, "é" * 10, ""]:
        data = text.encode()
        pair = ((size(data, scorer.bad) - size(data, scorer.good)) / len(data), math.log(len(data))) if data else (0.0, 0.0)
        assert scorer.evidence(text) == pytest.approx(pair)
        x = scorer.weights[0] + scorer.weights[1] * pair[0] + scorer.weights[2] * pair[1] + scorer.weights[3] * pair[0] * pair[1]
        assert scorer.score(np.array([pair]))[0] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, x)))))
    # At the fitted weights the ridge and the log loss balance, in every direction.
    x = np.column_stack([np.ones(80), evidence[:, 0], evidence[:, 1], evidence[:, 0] * evidence[:, 1]])
    scale = np.append(1.0, np.maximum(x[:, 1:].std(0), 1e-9))
    slope = (x / scale).T @ (labels - 1 / (1 + np.exp(-np.clip(x @ scorer.weights, -30, 30)))) - np.array([1e-9, 1e-3, 1e-3, 1e-3]) * 80 * scorer.weights * scale
    assert np.abs(slope).max() < 1e-4


def test_two_fits_are_equal(spark):
    texts = [(i % 40, f"text {i} " + ("good words here " if i % 2 else "bad!!! ") * (i % 7 + 3)) for i in range(120)] + [(7, None), (8, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0)], "doc_id long, label int")
    one, two = (compression.fit(docs.repartition(n), labels.repartition(n), compression.Sample(rows=10)) for n in (2, 7))
    assert (one.good, one.bad, one.weights.tolist()) == (two.good, two.bad, two.weights.tolist())


def test_held_out_ranking(spark):
    from lumenfold.llm import queries

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = queries.QUERIES["op2_compression_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g, b in itertools.product(good, bad)) >= 0.85 * len(good) * len(bad) > 0


def all_cuts(word, pieces, byte):
    """(score, tokens of the best cuts) over every way to cut a word."""
    best = [(0.0, {0})]
    for j in range(1, len(word) + 1):
        ways = [(best[i][0] + pieces[word[i:j]], i, 1) for i in range(j) if word[i:j] in pieces]
        if not ways:
            size = len(word[j - 1].encode())
            ways = [(best[j - 1][0] + byte * size, j - 1, size)]
        top = max(w[0] for w in ways)
        # Of equal scores the longest last piece counts, which is the one that begins first.
        _, i, n = min((w for w in ways if w[0] == top), key=lambda w: w[1])
        best.append((top, {c + n for c in best[i][1]}))
    return best[-1]


def test_token_counts_with_ties():
    mark = token_counts.MARK
    pieces = {mark: -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, mark + "a": -2.0, "bb": -1.5, "abb": -2.5}
    counter = token_counts.Counter(pieces)
    words = sorted({"".join(p) for n in range(1, 6) for p in itertools.product("abc", repeat=n)})
    for word, (tokens, score) in zip(words, counter.walk(words)):
        wanted = all_cuts(mark + word, pieces, counter.byte)
        assert score == pytest.approx(wanted[0]) and {tokens} == wanted[1], word
        assert score == pytest.approx(brute.best_cut(mark + word, pieces, counter.byte))
