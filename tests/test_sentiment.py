"""Sentiment by rule: each rule on a sentence of its own, and random sentences against a plain loop."""

import math
import random
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import segments, sentiment

LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "awful": -2.0, "no": -1.2, "kind": 2.4, "least": -0.5, "hope": 1.9, ":)": 2.0}
UP = {"very": 0.293, "really": 0.293, "so": 0.293, "barely": -0.293, "somewhat": -0.293}
NOT = {"not", "never", "without", "nor", "isn't", "dont", "hardly-n't"}


def loop(text):
    """The published rules, word by word, for the words of LEXICON, UP and NOT."""
    words = []
    for w in text.split():
        bare = w.strip(string.punctuation)
        words.append(bare if len(bare) > 2 else w)
    if not words:
        return None
    low = [w.lower() for w in words]
    capitals = sum(w.isupper() for w in words)
    mixed = 0 < capitals < len(words)
    at = lambda i, *given: 0 <= i and low[i] in given
    scores = []
    for i, word in enumerate(low):
        if word in UP or word not in LEXICON or (word == "kind" and i + 1 < len(low) and low[i + 1] == "of"):
            scores.append(0.0)
            continue
        v = LEXICON[word]
        if word == "no" and i + 1 < len(low) and low[i + 1] in LEXICON:
            v = 0.0
        if at(i - 1, "no") or at(i - 2, "no") or (at(i - 3, "no") and at(i - 1, "or", "nor")):
            v = LEXICON[word] * -0.74
        if words[i].isupper() and mixed:
            v += 0.733 if v > 0 else -0.733
        for k in (1, 2, 3):
            j = i - k
            if j < 0 or low[j] in LEXICON:
                continue
            by = UP.get(low[j], 0.0) * (-1 if v < 0 else 1)
            if low[j] in UP and words[j].isupper() and mixed:
                by += 0.733 if v > 0 else -0.733
            v += by * (1, 0.95, 0.9)[k - 1]
            never = k > 1 and at(j, "never") and any(at(m, "so", "this") for m in range(j + 1, i) if m >= i - 2)
            doubt = k > 1 and at(j, "without") and any(at(m, "doubt") for m in range(j + 1, i) if m >= i - 2)
            if never:
                v *= 1.25
            elif not doubt and (low[j] in NOT or "n't" in low[j]):
                v *= -0.74
        if at(i - 1, "least") and "least" not in LEXICON and not at(i - 2, "at", "very"):
            v *= -0.74
        scores.append(v)
    if "but" in low:
        turn = low.index("but")
        scores = [s * (0.5 if i < turn else 1.5 if i > turn else 1) for i, s in enumerate(scores)]
    total = math.fsum(scores)
    asks = text.count("?")
    push = min(text.count("!"), 4) * 0.292 + (0 if asks < 2 else asks * 0.18 if asks < 4 else 0.96)
    total += push if total > 0 else -push if total < 0 else 0
    return total / math.sqrt(total * total + 15)


def scored(spark, texts, lexicon=LEXICON):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = sentiment.compounds(frame, spark.createDataFrame(list(lexicon.items()), "word string, valence double"), ["id"])
    return {r.id: r.compound for r in found.collect()}


RULES = [
    ("it is good", "it is very good", 1), ("it is good", "it is barely good", -1), ("it is bad", "it is very bad", -1), ("it is good", "it is GOOD", 1), ("IT IS GOOD", "it is good", 0),
    ("very good", "VERY good", 1), ("really x good", "really x y good", -1), ("it is good", "it is good!", 1), ("good!!!!", "good!!!!!", 0), ("good?", "good", 0), ("good", "good??", 1),
    ("good", "not good", -1), ("good", "isn't good", -1), ("not x y good", "not x y z good", 1), ("good", "never so good", 1), ("good", "without doubt good", 0), ("good but bad", "good and bad", 1 - 2),
    ("hope", "no hope", -1), ("kind person", "kind of person", -1), ("good", "good, though", 0), ("good", "food", -1), ("x :) y", "x y", -1),
]


def test_each_rule(spark):
    found = scored(spark, [t for a, b, _ in RULES for t in (a, b)])
    for i, (a, b, sign) in enumerate(RULES):
        was, now = found[2 * i], found[2 * i + 1]
        assert was == pytest.approx(loop(a), abs=6e-5) and now == pytest.approx(loop(b), abs=6e-5), (a, b)
        assert (now > was) - (now < was) == sign if a != "good but bad" else now > was, (a, b, was, now)


def test_least(spark):
    lexicon = {"good": 1.9}
    found = scored(spark, ["good", "least good", "at least good", "very least good"], lexicon)
    assert found[1] < 0 < found[0] == found[2] < found[3]


def test_random_sentences_against_the_loop(spark):
    rng = random.Random(11)
    pool = [*LEXICON, *UP, *NOT, "but", "or", "this", "doubt", "of", "plain", "words", "here", "at", "Kind", "GREAT", "VERY", "NOT", "good,", "(bad)", "so!", "what?", "BUT"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) + rng.choice(["", "", "!", "!!", "???", "????"]) for _ in range(400)] + ["", " \n", "!!!", "GOOD BAD"]
    found = scored(spark, texts)
    for i, t in enumerate(texts):
        if loop(t) is None:
            assert i not in found
        else:
            assert found[i] == pytest.approx(loop(t), abs=6e-5), t


@pytest.mark.parametrize("size", [1, 300, 4 << 20])
def test_texts_in_a_task_against_the_loop(monkeypatch, size):
    """The same rules where a task holds the lexicon, in batches of any size."""
    monkeypatch.setattr(sentiment, "BATCH_BYTES", size)
    rng = random.Random(12)
    pool = [*LEXICON, *UP, *NOT, "but", "or", "nor", "this", "doubt", "of", "plain", "at", "Kind", "GREAT", "VERY", "NOT", "NO", "good,", "(bad)", "so!", "BUT", "Ümlaut", "(:"]
    texts = [rng.choice([" ", "\n "]).join(rng.choice(pool) for _ in range(rng.randint(0, 14))) + rng.choice(["", "", "!", "!!!!!", "???", "????"]) for _ in range(600)]
    texts += [t for a, b, _ in RULES for t in (a, b)] + ["", " \n", "!!!", "GOOD BAD", None]
    found = sentiment.of_texts(pa.array(texts, pa.string()), LEXICON)
    assert len(found) == len(texts)
    for t, c in zip(texts, found):
        assert c == pytest.approx(loop(t), abs=6e-5) if t and t.strip() else np.isnan(c), t
    least = sentiment.of_texts(pa.array(["good", "least good", "at least good", "very least good"]), {"good": 1.9})
    assert least[1] < 0 < least[0] == least[2] < least[3]
    assert len(sentiment.of_texts(pa.array([], pa.string()), LEXICON)) == 0


def test_flows_are_scored_where_their_text_lies(spark, monkeypatch):
    """One exchange, no join, no window; a lexicon too large for a task, or with a word twice, is joined to the same result."""
    rng = random.Random(13)
    pool = [*LEXICON, *UP, *NOT, "but", "plain", "words", "Great", "GOOD"]
    texts = ["".join(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) + rng.choice(".!?") for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", "ok.", "\n\n\n\n\n", None, "one sentence is good"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    held = segments.emotional_flows(frame, lexicon, ["id"])
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1
    all_rows = segments.with_emotion(frame.withColumn("more", F.lit(1)), lexicon, ["id"])
    assert all_rows.columns == ["id", "text", "more", "emotion"] and all_rows.count() == len(texts)
    found = {r.id: r.emotion for r in held.collect()}
    assert {i for i, t in enumerate(texts) if t and any(len(s.strip(" ")) > 3 and s.strip() for s in t.replace("!", ".").replace("?", ".").split("."))} == set(found)
    assert found[len(texts) - 1] == 0.0
    monkeypatch.setattr(sentiment, "MOST_HELD", len(LEXICON) - 1)
    assert sentiment.held(lexicon) is None
    joined = {r.id: r.emotion for r in segments.emotional_flows(frame, lexicon, ["id"]).collect()}
    assert joined.keys() == found.keys() and all(joined[i] == pytest.approx(found[i], abs=1e-12) for i in found)
    monkeypatch.undo()
    assert sentiment.held(lexicon) == LEXICON and sentiment.held(lexicon.union(lexicon.limit(1))) is None
