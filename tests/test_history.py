"""Undo histories: blocks of any size against the editor's own rules, written out again."""

import random

import pytest

from lumenfold.operators import history


def loop(log):
    """A list, a cursor, and at most fifty states."""
    states, at = [0], 0
    for kind, state in log:
        if kind == "edit":
            del states[at + 1 :]
            states.append(state)
            at += 1
            if len(states) > 50:
                del states[0]
                at = 49
        elif kind == "undo" and at > 0:
            at -= 1
        elif kind == "redo" and at < len(states) - 1:
            at += 1
    return states, at


def entries(rng, n, edits):
    return [(rng.choices(["edit", "undo", "redo", "save"], [edits, 4, 3, 1])[0], i + 1) for i in range(n)]


@pytest.mark.parametrize("edits", [0, 1, 4, 40])
def test_blocks_compose(edits):
    rng = random.Random(edits)
    for _ in range(25):
        log = entries(rng, rng.choice([0, 1, 30, 400]), edits)
        states, cursor, at = [0], 0, 0
        while at < len(log):
            size = rng.choice([1, 2, 7, 60, 300])
            kinds, made = zip(*log[at : at + size])
            states, cursor = history.apply(states, cursor, history.summarise(list(kinds), list(made)))
            at += size
        assert (states, cursor) == loop(log)


@pytest.mark.parametrize("block", [1, 37, 100_000])
def test_replay(spark, block):
    rng, logs = random.Random(8), {}
    for seq in range(1200):  # one clip holds a third of the log
        clip = rng.choice([1, 1, 1, 2, 3, 4, 5, 6])
        logs.setdefault(clip, []).append((rng.choice(["edit", "edit", "undo", "redo"]), seq))
    rows = [(c, s, k, s) for c, log in logs.items() for k, s in log]
    rng.shuffle(rows)
    found = history.replay(spark.createDataFrame(rows, "clip_id long, seq long, kind string, state long").repartition(5), block=block).collect()
    wanted = {c: loop(log) for c, log in logs.items()}
    assert {r.clip_id: (list(r.states), r.cursor) for r in found} == wanted and all(r.current == r.states[r.cursor] for r in found)


def test_replay_of_nothing(spark):
    assert history.replay(spark.createDataFrame([], "clip_id string, seq long, kind string, state long")).collect() == []


def test_pieces_are_as_many_as_clips_and_tasks(spark):
    log = spark.range(30_000).selectExpr("id % 40 AS clip_id", "id * 1000 AS seq", "if(id % 3 = 0, 'undo', 'edit') AS kind", "id AS state").repartition(4)
    found = history.pieces(log, block=2_000)
    assert found.count() <= 40 + found.rdd.getNumPartitions()
    assert history.replay(log, block=2_000).count() == 40
