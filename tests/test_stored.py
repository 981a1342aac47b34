"""Stored tables, versions and deliveries: conflicts, untouched files, batches run again or stopped half way."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import catalog
from lumenfold.storage import Deliveries, StaleWriter, VersionedTable
from lumenfold.streaming import delivery, jobs

NOW = datetime(2024, 1, 5)


def plain(frame, *columns):
    return sorted(tuple(r) for r in (frame.select(*columns) if columns else frame).collect())


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", i * 10) for i in range(40)], "clip_id long, title string, at long")
    return VersionedTable.create(spark, f"file://{tmp_path}/clips", rows, ["clip_id"], buckets=8)


def test_upsert_keeps_untouched_files(spark, table):
    before = table.manifest().parts
    changes = spark.createDataFrame([(3, "new", 1), (3, "newer", 2), (99, "added", 1)], "clip_id long, title string, at long")
    assert table.upsert(changes, "at") == 2
    after = table.manifest().parts
    touched = {str(r[0]) for r in changes.select(VersionedTable._bucket(["clip_id"], 8)).distinct().collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) < len(after)
    assert plain(table.read()) == plain(catalog.upsert(table.read(1), changes, ["clip_id"], "at").select("clip_id", "title", "at"))
    assert table.delete(changes.where("clip_id = 99")) == 3 and table.read().count() == 40
    assert plain(table.read(2)) != plain(table.read(3)) and table.expire() > 0 and table.read().count() == 40
    with pytest.raises(Exception):
        table.manifest(2)


def test_two_writers_one_conflict(spark, table, monkeypatch):
    changes = spark.createDataFrame([(3, "mine", 1)], "clip_id long, title string, at long")
    other = spark.createDataFrame([(3, "theirs", 1)], "clip_id long, title string, at long")
    with pytest.raises(StaleWriter):
        table.upsert(changes, "at", expected=0)
    rival, written = VersionedTable(spark, table.root), table._write

    def slowly(*a):
        made = written(*a)
        monkeypatch.setattr(table, "_write", written)
        rival.upsert(other, "at")  # commits while this writer's files are written and not yet listed
        return made

    monkeypatch.setattr(table, "_write", slowly)
    with pytest.raises(StaleWriter):
        table.upsert(changes, "at")
    assert table.manifest().version == 2 and table.read().where("clip_id = 3").first().title == "theirs"
    listed = {p.split("/")[0] for v in (1, 2) for parts in table.manifest(v).parts.values() for p in parts}
    assert set(table.files.names("data")) == listed  # what the loser wrote is gone
    assert table.upsert(changes, "at") == 3 and table.read().where("clip_id = 3").first().title == "mine"


def test_appends_meet_without_conflict(spark, table, monkeypatch):
    more = spark.createDataFrame([(3, "again", 5)], "clip_id long, title string, at long")
    rival, written = VersionedTable(spark, table.root), table._write

    def slowly(*a):
        monkeypatch.setattr(table, "_write", written)
        rival.append(more)
        return written(*a)

    monkeypatch.setattr(table, "_write", slowly)
    assert table.append(more, batch=("s", 0)) == 3 and table.append(more, batch=("s", 0)) == 3
    assert table.read().count() == 42 and table.append(more, batch=("s", 1)) == 4


def test_edits_in_order_with_conflicts(spark, tmp_path):
    stored = spark.createDataFrame([(1, 4, "a"), (2, 1, "b"), (5, 7, "e")], "clip_id long, version long, timeline string")
    edits = VersionedTable.create(spark, f"file://{tmp_path}/edits", stored, ["clip_id"], buckets=4)
    asked = [(1, 10, 4, "a5"), (1, 11, 4, "stale"), (1, 12, None, "a6"), (1, 13, 6, "a7"), (2, 14, 9, "stale"), (3, 15, 8, "c1"), (3, 16, 1, "c2")]
    requests = spark.createDataFrame(asked, "clip_id long, seq long, version long, timeline string")
    outcome = delivery.save_edits(edits, requests)
    state, wanted = {1: (4, "a"), 2: (1, "b"), 5: (7, "e")}, []
    for clip, seq, version, body in asked:
        had = state.get(clip)
        if had and version is not None and version != had[0]:
            wanted.append((clip, seq, "conflict", had[0]))
        else:
            state[clip] = (had[0] + 1 if had else 1, body)
            wanted.append((clip, seq, "accepted", state[clip][0]))
    assert plain(outcome, "clip_id", "seq", "outcome", "version") == wanted
    assert plain(edits.read(), "clip_id", "version", "timeline") == sorted((c, *v) for c, v in state.items())
    with pytest.raises(StaleWriter):
        delivery.save_edits(edits, requests, expected=1)


def test_delivery_once(spark, tmp_path):
    out = Deliveries(spark, f"file://{tmp_path}/out")
    rows = spark.range(3)
    assert out.write(rows, 0) and not out.write(rows, 0)
    spark.range(9).write.parquet(f"{out.root}/rows/1-0123abcd")  # stopped before its number was noted
    assert out.read().count() == 3 and out.write(spark.range(10, 12), 1)
    assert plain(out.read(), "id", "batch") == [(0, 0), (1, 0), (2, 0), (10, 1), (11, 1)]


def posts_table(spark, tmp_path):
    rows = [(i, "pending" if i % 3 else "queued", datetime(2024, 1, 1 + i % 10), None) for i in range(30)]
    frame = spark.createDataFrame(rows, "id long, status string, schedule_at timestamp_ntz, promoted_in long")
    return VersionedTable.create(spark, f"file://{tmp_path}/posts", frame, ["id"], buckets=4)


def test_a_poll_run_twice_or_stopped(spark, tmp_path, monkeypatch):
    posts, out = posts_table(spark, tmp_path), Deliveries(spark, f"file://{tmp_path}/polled")
    due = [r.id for r in posts.read().where((F.col("status") == "pending") & (F.col("schedule_at") <= F.lit(NOW).cast("timestamp_ntz"))).orderBy("schedule_at", "id").collect()]
    assert delivery.tick(posts, out, NOW, 4, 0) and not delivery.tick(posts, out, NOW, 4, 0)
    # Stopped after the table's change and before delivery: the next run of the same poll delivers the same posts.
    first = plain(delivery.promote_due(posts, NOW, 4, 1), "id")
    version = posts.manifest().version
    assert delivery.tick(posts, out, NOW, 4, 1) and posts.manifest().version == version and plain(out.read().where("batch = 1"), "id") == first
    # Stopped between writing parts and listing them: nothing has changed, and the same poll does it all.
    make = posts.files.make
    monkeypatch.setattr(posts.files, "make", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        delivery.tick(posts, out, NOW, 4, 2)
    monkeypatch.setattr(posts.files, "make", make)
    assert posts.manifest().version == version and delivery.tick(posts, out, NOW, 4, 2)
    delivery.tick(posts, out, NOW, 50, 3)
    assert [i for b in range(4) for (i,) in plain(out.read().where(f"batch = {b}"), "id")] == [i for b in range(4) for i in sorted(due[b * 4 : b * 4 + 4] if b < 3 else due[12:])]
    assert {r.id for r in posts.read().where("status = 'queued' AND promoted_in IS NOT NULL").collect()} == set(due)


def test_poll_on_a_timer(spark, tmp_path):
    posts, out = posts_table(spark, tmp_path), Deliveries(spark, f"file://{tmp_path}/polled")
    stream = delivery.poll(spark, posts, out, lambda: NOW, limit=5, every="100 milliseconds")
    try:
        while len(out.files.names("noted")) < 3 and stream.isActive:
            stream.awaitTermination(1)
    finally:
        stream.stop()
    ids = [r.id for r in out.read().collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.id for r in posts.read().where("status = 'queued'").collect()}


def test_replay_meets_live_at_one_number(spark, tmp_path):
    path = str(tmp_path / "events")
    kinds = ["ClipRendered", "JobCompleted", "Odd"]

    def publish(a, b):
        spark.createDataFrame([(i % 4, i, kinds[i % 3], None, NOW) for i in range(a, b)], jobs.EVENTS).coalesce(1).write.mode("append").parquet(path)

    def subscribe():
        out = Deliveries(spark, f"file://{tmp_path}/sub")
        delivery.replay_then_live(spark, path, out, keep=10, types=("ClipRendered",), files_per_batch=1).awaitTermination()
        return out.read()

    publish(0, 30)
    assert plain(subscribe(), "seq") == [(i,) for i in range(20, 30) if i % 3 == 0]  # the cut to ten comes first
    publish(30, 41)
    publish(41, 60)
    found = subscribe()
    assert plain(found, "seq") == [(i,) for i in range(20, 60) if i % 3 == 0] and {r.batch for r in found.where("seq < 30").collect()} == {delivery.REPLAY}
    assert plain(subscribe(), "seq") == plain(found, "seq")


def test_replay_of_nothing(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame([], jobs.EVENTS).write.parquet(path)
    out = Deliveries(spark, f"file://{tmp_path}/sub")
    delivery.replay_then_live(spark, path, out).awaitTermination()
    assert out.read().count() == 0
