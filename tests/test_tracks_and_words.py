"""Folds over videos against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import exports, segments, tracks, words


def loop_ema(rows, alpha=0.3, hold=2.0):
    out, last, seen = [], None, None
    for t, x, y in rows:
        if x is not None:
            last = (x, y) if last is None else (alpha * x + (1 - alpha) * last[0], alpha * y + (1 - alpha) * last[1])
            seen = t
            out.append((t, *last))
        elif last is not None and t - seen <= hold:
            out.append((t, *last))
    return out


@pytest.mark.parametrize("stretch", [1.0, 7.0, 1000.0])
def test_smoothing_by_stretches(spark, stretch):
    rng, made, wanted = random.Random(4), [], []
    for vid in range(6):
        rows, t = [], 0.0
        for _ in range(rng.choice([1, 5, 150])):
            t += rng.choice([0.1, 0.1, 0.1, 0.7, 3.0])
            rows.append((round(t, 3), *((rng.random(), rng.random()) if rng.random() < 0.5 else (None, None))))
        made += [(vid, *r) for r in rows]
        wanted += [(vid, *r) for r in loop_ema(rows)]
    found = sorted(tuple(r) for r in tracks.ema(spark.createDataFrame(made, "vid int, t double, cx double, cy double"), stretch=stretch).collect())
    assert [r[:2] for r in found] == [r[:2] for r in wanted]
    assert [x for r in found for x in r[2:]] == pytest.approx([x for r in wanted for x in r[2:]])


def test_padding(spark):
    rng, made, wanted = random.Random(9), [], []
    for vid in range(30):
        at, rows, end = rng.random(), [], 0.0
        for _ in range(rng.randint(1, 12)):
            rows.append((round(at, 2), round(at + rng.choice([0.0, 0.2, 1.0]), 2)))
            at = rows[-1][1] + rng.choice([0.0, 0.05, 0.3, 2.0])
        index = 0
        for i, (s, e) in enumerate(rows):
            low, high = max(end, s - 0.1), min(rows[i + 1][0], e + 0.1) if i + 1 < len(rows) else e + 0.1
            if high > low:
                end = round(high, 4)
                wanted.append((vid, index, round(low, 4), end))
                index += 1
        made += [(vid, i, s, e) for i, (s, e) in enumerate(rows)]
    found = words.pad_intervals(spark.createDataFrame(made, "vid int, island int, start double, end double"), 0.1)
    assert sorted(tuple(r) for r in found.collect()) == wanted


@pytest.mark.parametrize("fps", [10, 30])
def test_caption_frames(spark, fps):
    rng, made, wanted = random.Random(1), [], []
    for vid in range(4):
        at, rows = rng.random(), []
        for i in range(rng.randint(1, 20)):
            rows.append((i, f"w{i}", at, at + 0.3))
            at += rng.choice([0.3, 0.5, 1.2])
        made += [(vid, *r) for r in rows]
        t, frame = rows[0][2], 0
        while t < rows[-1][3]:
            begun = [r for r in rows if r[2] <= t]
            lit = next((r[0] for r in begun if r[3] > t), None)
            wanted.append((vid, frame, round(t, 4), " ".join(r[1] for r in begun[-7:]), lit))
            t, frame = t + 1 / fps, frame + 1
    found = words.caption_frames(spark.createDataFrame(made, "vid int, pos long, word string, start double, end double"), fps=fps)
    got = sorted((r.vid, r.frame, r.t, r.text, r.highlighted) for r in found.collect())
    assert [(*r[:2], *r[3:]) for r in got] == [(*r[:2], *r[3:]) for r in wanted]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in wanted], abs=1e-4)


@pytest.mark.parametrize("stretch", [1, 7, 10_000])
@pytest.mark.parametrize("window", [1, 4, 5])
def test_moving_means_by_stretches(spark, stretch, window):
    rng, made, wanted = random.Random(3), [], []
    for vid in range(4):
        rows, t = [], 0
        for _ in range(rng.choice([1, 3, 60])):
            t += rng.choice([1, 1, 2, 40])
            rows.append((t, rng.random(), rng.random(), rng.choice([0.1, 0.5, 0.9])))
        made += [(vid, *r) for r in rows]
        kept = [r for r in rows if r[3] >= 0.3]
        for i, r in enumerate(kept):
            near = kept[max(0, i - window // 2) : i + window // 2 + 1]
            wanted.append((vid, r[0], sum(x[1] for x in near) / len(near), sum(x[2] for x in near) / len(near)))
    found = tracks.smooth(spark.createDataFrame(made, "vid int, t int, cx double, cy double, conf double").repartition(3), window, stretch)
    assert sorted(tuple(r) for r in found.collect()) == [pytest.approx(w) for w in wanted]


@pytest.mark.parametrize("stretch", [1, 9, 10_000])
def test_nearest_by_stretches(spark, stretch):
    rng = random.Random(5)
    track = [(v, t, float(t), -float(t)) for v in range(3) for t in sorted(rng.sample(range(200), 25))] + [(7, 50, 1.0, 2.0)]
    times = [(v, t) for v in (0, 1, 2, 7, 9) for t in rng.sample(range(-30, 260), 40)]
    wanted = []
    for v, t in times:
        best = min((abs(p[1] - t), p[1]) for p in track if p[0] == v) if any(p[0] == v for p in track) else (None, None)
        wanted.append((v, t, best[1]))
    found = tracks.nearest(spark.createDataFrame(times, "vid int, t int").repartition(3), spark.createDataFrame(track, "vid int, t int, cx double, cy double"), stretch)
    assert sorted((r.vid, r.t, r.at) for r in found.collect()) == sorted(wanted, key=lambda r: r[:2])


def shuffled(frame):
    """Names of what is moved between tasks in a frame's plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def transcripts(spark, *videos):
    rows = [(v, [(i, w, i * 500, i * 500 + 300) for i, w in enumerate(ws)]) for v, ws in enumerate(videos)]
    return spark.createDataFrame(rows, "vid long, words array<struct<pos: long, word: string, start: long, end: long>>")


def as_rows(listed):
    return listed.selectExpr("vid", "inline(words)")


def test_frames_of_listed_words_move_nothing(spark):
    listed = transcripts(spark, ["a", "b", "c"], [f"w{i}" for i in range(9)])
    found = words.caption_frames(listed, fps=32)
    assert not shuffled(found)
    assert sorted(found.collect()) == sorted(words.caption_frames(as_rows(listed), fps=32).collect())


def test_times_are_rounded_half_up():
    times = np.array([1 / 32, 3 / 32, 0.00005, 2.00015, 1.23456789, 0.0])
    assert list(words._rounded(times)) == [0.0313, 0.0938, 0.0001, 2.0002, 1.2346, 0.0]


def test_listed_captions_are_those_of_rows_and_move_nothing(spark):
    listed = transcripts(spark, ["a", "b", "c", "d"], ["x"], [f"w{i}" for i in range(9)])
    for made in (words.caption_chunks, words.karaoke_spans, words.full_text):
        found = made(listed)
        assert not shuffled(found)
        assert sorted(found.collect()) == sorted(made(as_rows(listed)).collect())
    listed = listed.withColumn("words", F.transform("words", lambda w: w.withField("start", w["start"] / 1000.0).withField("end", w["end"] / 1000.0)))
    for kind in ("srt", "vtt"):
        found = exports.caption_file(listed.select("vid", words.listed_chunks(3).alias("captions")), kind)
        assert not shuffled(found)
        assert sorted(found.collect()) == sorted(exports.caption_file(words.caption_chunks(as_rows(listed)), kind).collect())


def test_listed_windows_are_those_of_rows_and_move_nothing(spark):
    listed = transcripts(spark, ["a", "bb?", "ccc", "d"], ["x"])
    made = [(0, 0, 0, 1000), (0, 1, 500, 1500), (0, 2, 90_000, 91_000), (1, 0, 0, 60_000)]
    windows = spark.createDataFrame(made, "vid long, idx long, start long, end long")
    lists = windows.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("idx", "start", "end"))).alias("windows"))
    videos = listed.join(lists, "vid").withColumn("rms", F.transform("words", lambda w: F.length(w["word"]).cast("double"))).localCheckpoint()
    found = segments.listed_windows(videos)
    assert not shuffled(found)
    rows = as_rows(listed)
    wanted = segments.words_in(windows, rows)
    assert sorted(found.select(*wanted.columns).collect()) == sorted(wanted.collect())
    loud = segments.audio_features(windows, rows.select("vid", F.col("start").alias("t"), F.length("word").cast("double").alias("rms")))
    assert sorted(segments.engagement(found).select(*loud.columns).collect()) == sorted(loud.collect())


def test_listed_windows_of_words_out_of_order(spark):
    """Words keep their listed order in a text, whatever their times, and missing ones are left out."""
    said = [(0, "c", 5000), (1, "a", 1000), (2, None, 2000), (3, "b", 1000), (4, "d", 9000)]
    videos = spark.createDataFrame([(7, said, [(0, 0, 6000), (1, 1000, 1001), (2, 9500, 9900)], [1.0, 2.0, 3.0, 4.0, 5.0])], "vid long, words array<struct<pos long, word string, start long>>, windows array<struct<idx long, start long, end long>>, rms array<double>")
    found = segments.listed_windows(videos).orderBy("idx").collect()
    assert [(r.text, r.first_text, r.n_words) for r in found] == [("c a b", "a b", 4), ("a b", "a b", 2), ("", "", 0)]
    assert [(r["mean"], r.opening, r.max_all) for r in found] == [(2.5, 3.0, 5.0), (3.0, 3.0, 5.0), (None, None, 5.0)]
