"""Streams give what their batch forms give, also over several batches and a restart."""

from datetime import datetime

from pyspark.sql import functions as F

from lumenfold.functions import constants as C
from lumenfold.operators import events as ops
from lumenfold.operators import metrics
from lumenfold.streaming import jobs

NOW = datetime(2024, 1, 5)
ROWS = [
    (1, 1, "ChapterClipExtracted", 0), (1, 2, "ThumbnailGenerated", 0), (2, 3, "ChapterClipExtracted", 0), (1, 4, "Odd", None),
    (1, 5, "SocialContentGenerated", 0), (1, 6, "ChapterClipExtracted", 1), (2, 7, "JobFailed", None), (2, 8, "ClipRendered", 0),
    (1, 9, "ChapterClipExtracted", 1), (1, 10, "JobCompleted", None), (1, 11, "JobCompleted", None), (3, 12, "Odd", None), (2, 13, "ClipRendered", 1),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, NOW) for r in rows], jobs.EVENTS)


def folder(spark, tmp_path, rows, parts=3):
    """Event files in order, one a batch."""
    path = str(tmp_path / "events")
    for k in range(0, len(rows), parts):
        frame(spark, rows[k : k + parts]).coalesce(1).write.mode("append").parquet(path)
    return path


def plain(rows):
    return sorted(tuple(r) for r in rows)


def run(stream, tmp_path, name, mode="append"):
    """Every batch's rows, in order of batches."""
    out = []
    jobs.each_batch(stream, lambda rows, n: out.append([tuple(r) for r in rows.collect()]), str(tmp_path / name), mode).awaitTermination()
    return out


def test_subscription_and_unknown_types(spark, tmp_path):
    path = folder(spark, tmp_path, ROWS)
    batch = spark.read.parquet(path)
    stream = jobs.read_events(spark, path, files_per_batch=1)
    got = [r for b in run(jobs.subscribe(stream, ["ClipRendered"], 2), tmp_path, "subscribe") for r in b]
    assert plain(got) == plain(ops.matching(batch, ["ClipRendered"], 2).collect())
    assert [r for b in run(jobs.new_unknown_types(stream), tmp_path, "unknown", "update") for r in b] == [("Odd",)]
    assert [r.type for r in ops.unknown_types(batch).collect()] == ["Odd"]


def test_until_terminal_over_a_restart(spark, tmp_path):
    path = folder(spark, tmp_path, ROWS[:7])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    jobs.write_once(jobs.until_terminal(jobs.read_events(spark, path, files_per_batch=1)), out, check).awaitTermination()
    frame(spark, ROWS[7:]).coalesce(1).write.mode("append").parquet(path)
    jobs.write_once(jobs.until_terminal(jobs.read_events(spark, path, files_per_batch=1)), out, check).awaitTermination()
    assert plain(spark.read.parquet(out).collect()) == plain(ops.until_terminal(spark.read.parquet(path)).collect())


def test_latest_metrics(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    schema = "clip_id long, platform string, captured_at timestamp_ntz, seq long, views long"
    for k in range(3):
        spark.createDataFrame([(c, p, datetime(2024, 1, 3 - k % 2), 10 * k + c, k) for c in (1, 2) for p in "ab"], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    last = run(jobs.latest_metrics(stream, ["views"]), tmp_path, "latest", "complete")[-1]
    assert plain(last) == plain(metrics.latest_per_platform(spark.read.parquet(path), ["views"]).collect())


def test_stage_progress(spark, tmp_path):
    path = folder(spark, tmp_path, ROWS)
    state = {}
    for batch in run(jobs.stage_progress(jobs.read_events(spark, path, files_per_batch=1)), tmp_path, "stages", "update"):
        state |= {r[:2]: r[2] for r in batch}
    counts = ops.event_counts(spark.read.parquet(path)).collect()
    assert state == {(r.job_id, s): r[f"n_{s}"] for r in counts for s in C.CHAPTER_STAGES}
    assert state[1, "extract"] == 2 and state[1, "finalise_chapters"] == 1 and state[2, "render"] == 2 and state[3, "extract"] == 0


def test_polling_queues_the_due(spark, tmp_path):
    posts = spark.createDataFrame([(1, "pending", datetime(2024, 1, 1)), (2, "pending", datetime(2024, 2, 1)), (3, "queued", datetime(2024, 1, 1))], "id long, status string, schedule_at timestamp_ntz")
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    seen = []

    def tick(_, n):
        chosen, after = jobs.poll_due(posts, NOW)
        seen.append(([r.id for r in chosen.collect()], {r.id: r.status for r in after.collect()}))

    stream = jobs.each_batch(ticks.where(F.lit(True)), tick, str(tmp_path / "poll"), "append", every="200 milliseconds")
    while not seen and stream.isActive:
        stream.awaitTermination(1)
    stream.stop()
    assert seen[0] == ([1], {1: "queued", 2: "pending", 3: "queued"})
