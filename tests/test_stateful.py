"""Stage states and keep-alives as streams, against the batch fold after every batch, over a restart."""

import random
import time
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumenfold.functions import constants as C
from lumenfold.operators import events as ops
from lumenfold.streaming import jobs, stateful

NOW = datetime(2024, 1, 5)
STATES = (
    "job_id long, seq long, status string, current_step string, destination_folder string, video_path string, n_outputs int, error string, skipped array<string>, "
    "chapters array<struct<chapter_index: int, status: string, clip_path: string, transcript: string, captions_path: string, output_path: string, error: string>>"
)


@pytest.fixture
def rocks(spark):
    was = {k: spark.conf.get(k, None) for k in stateful.ROCKS}
    for k, v in stateful.ROCKS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def chapter(rng, i):
    status = rng.choice(["pending", "extracting", "rendering", "completed", "failed"])
    some = lambda x: x if rng.random() < 0.5 else None
    return (i, status, some("/c"), some("t"), some("/k"), some("/o"), "broke" if status == "failed" else None)


def job(rng, k, seq):
    return (
        k, seq, rng.choice(["running", "running", "failed", "completed", None]), rng.choice([None, *C.STEPS]), rng.choice([None, "", "/d"]), rng.choice([None, "/v"]), rng.choice([None, 0, 2]),
        rng.choice([None, "job error"]), rng.choice([[], None, ["caption", "chapters"]]), [chapter(rng, i) for i in range(rng.choice([0, 1, 3]))],
    )


def batches(seed, n=4):
    """Events and job states by batch; a job's chapters only grow, so its newest state lists the most."""
    rng, seq, out = random.Random(seed), 0, []
    chapters = {}
    for _ in range(n):
        events, states = [], []
        for _ in range(rng.randint(4, 14)):
            seq += 1
            events.append((rng.randint(1, 5), seq, rng.choice([*C.EVENT_TYPES, "Odd"]), rng.choice([None, 0, 0, 1, 2]), NOW))
        for k in rng.sample(range(1, 5), 2):
            seq += 1
            made = job(rng, k, seq)
            known = chapters.setdefault(k, {})
            known.update({c[0]: c for c in made[-1]})
            states.append((*made[:-1], [known[i] for i in sorted(known)]))
        out.append((events, states))
    return out


def key(rows):
    return {(r.job_id, r.position): tuple(r) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_changes_fold_to_the_states(rocks, tmp_path, seed):
    spark = rocks
    events, states = str(tmp_path / "events"), str(tmp_path / "states")
    spark.createDataFrame([], jobs.EVENTS).write.parquet(events)
    spark.createDataFrame([], STATES).write.parquet(states)
    so_far, seen = {}, []

    def sink(rows, n):
        found = rows.collect()
        seen.append(len(found))
        assert len(key(found)) == len(found)
        for k, v in key(found).items():
            assert so_far.get(k) != v  # changes only
            so_far[k] = v

    for es, js in batches(seed):  # each round restarts from the checkpoint
        spark.createDataFrame(es, jobs.EVENTS).coalesce(1).write.mode("append").parquet(events)
        spark.createDataFrame(js, STATES).coalesce(1).write.mode("append").parquet(states)
        stream = stateful.messages(jobs.read_events(spark, events), spark.readStream.schema(STATES).parquet(states))
        jobs.each_batch(stateful.stage_changes(stream), sink, str(tmp_path / "check")).awaitTermination()
        newest = spark.read.parquet(states).groupBy("job_id").agg(F.max_by(F.struct(*ops.JOB_FIELDS), "seq").alias("s")).select("job_id", "s.*")
        assert so_far == key(ops.stage_states(newest, spark.read.parquet(events)).collect())
    assert sum(seen) > 40


def test_late_state_and_events_before_it(rocks, tmp_path):
    """Events of a job come before its first state; an older state that comes late changes nothing."""
    spark, rng = rocks, random.Random(3)
    first = job(rng, 1, 10)
    frames = [
        stateful.messages(spark.createDataFrame([(1, 1, "FolderCreated", None, NOW), (1, 2, "ChapterClipExtracted", 0, NOW)], jobs.EVENTS), None),
        stateful.messages(None, spark.createDataFrame([(*first[:2], "running", *first[3:8], [], [chapter(rng, 0)])], STATES)),
        stateful.messages(None, spark.createDataFrame([job(rng, 1, 5)], STATES)),
    ]
    path = str(tmp_path / "messages")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
    got = []
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.each_batch(stateful.stage_changes(stream), lambda rows, n: got.append(rows.collect()), str(tmp_path / "check")).awaitTermination()
    assert [len(g) for g in got if g] == [len(C.STAGES)]
    states = {r.stage: (r.state, r.done) for g in got for r in g}
    assert states["folder"][0] == "done" and states["extract"] == ("done", 1)


def test_keep_alive(rocks, tmp_path):
    """Pings of idle jobs come again and again without events, and none for ended jobs."""
    spark = rocks
    path = str(tmp_path / "events")
    spark.createDataFrame([(1, 1, "VideoRequested", None, NOW), (2, 2, "VideoRequested", None, NOW), (3, 3, "JobFailed", None, NOW)], jobs.EVENTS).coalesce(1).write.parquet(path)
    pings = []
    stream = jobs.each_batch(stateful.keep_alive(jobs.read_events(spark, path), 0.3), lambda rows, n: pings.extend(r.job_id for r in rows.collect()), str(tmp_path / "check"), "append", every="100 milliseconds")
    try:
        until = time.time() + 60
        while (pings.count(1) < 2 or pings.count(2) < 2) and time.time() < until and stream.isActive:
            time.sleep(0.2)
        spark.createDataFrame([(2, 4, "JobCompleted", None, NOW)], jobs.EVENTS).coalesce(1).write.mode("append").parquet(path)
        while not (len(pings) > 6 and set(pings[-6:]) == {1}) and time.time() < until and stream.isActive:
            time.sleep(0.2)
    finally:
        stream.stop()
    assert pings.count(2) >= 2 and set(pings[-6:]) == {1} and 3 not in pings
    assert stateful.keep_alive(spark.read.parquet(path), 0).count() == 0


class Calls:
    """Stands for the handle and for each of its states; counts what is asked of them."""

    def __init__(self):
        self.n, self.value, self.map = 0, None, {}

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def _said(self, answer=None):
        self.n += 1
        return answer

    def exists(self):
        return self._said(self.value is not None)

    def get(self):
        return self._said(self.value)

    def update(self, value):
        self._said()

    def containsKey(self, key):
        return self._said(key in self.map)

    def getValue(self, key):
        return self._said(self.map.get(key))

    def updateValue(self, key, value):
        self._said(self.map.update({key: value}))

    def iterator(self):
        return self._said(iter(self.map.items()))


def test_calls_to_the_store_dont_grow_with_a_jobs_events():
    calls, fold = Calls(), stateful.StageFold()
    fold.init(calls)
    rows = [Row(job_id=i % 16, seq=i, type=C.EVENT_TYPES[i % len(C.EVENT_TYPES)], chapter_index=i % 50, job=None, chapters=None, state=None) for i in range(2000)]
    assert list(fold.handleInputRows((0,), iter(rows), None)) == [] and calls.n <= 4
