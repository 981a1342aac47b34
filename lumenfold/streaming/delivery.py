"""Streams whose rows arrive once: a late subscriber's replay followed by live events, and the poller of due posts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfold.operators import catalog, queue
from lumenfold.operators import events as ops
from lumenfold.storage import Deliveries, StaleWriter, VersionedTable
from lumenfold.streaming import jobs

#: The batch that holds what was replayed; live batches count from 0.
REPLAY = -1


def _same(frame: DataFrame) -> DataFrame:
    return frame


def replay_then_live(
    spark: SparkSession,
    path: str,
    out: Deliveries,
    schema: str = jobs.EVENTS,
    keep: int = 200,
    types: Iterable[str] | None = None,
    job_id=None,
    at: int | None = None,
    view: Callable[[DataFrame], DataFrame] = _same,
    files_per_batch: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """A subscription to the event files at ``path``: of the last ``keep`` events those that match, then each later one that does.

    The two meet at one sequence number, the newest when the subscription began (or ``at``). It is stored in ``out`` before
    anything is delivered, so a restart meets at the same one: events up to it come from the batch read, as batch REPLAY, later
    ones from the checkpointed stream, whose batches ``out`` takes once. The cut to ``keep`` comes before the filter. Events are
    numbered in order of publishing; one that turns up late with a number at or before the meeting counts as already published.
    The stream reads files from the first on, and Parquet's statistics skip those up to the meeting.
    """
    past = view(spark.read.schema(schema).parquet(path))
    stored = out.files.read("meeting.json")
    if stored is None:
        newest = past.agg(F.max("seq")).first()[0] if at is None else at
        out.note("meeting", {"seq": newest if newest is not None else -1})
    seq = out.note("meeting", {})["seq"]
    if not out.has(REPLAY):
        out.write(ops.replay(past.where(F.col("seq") <= seq), keep, types, job_id), REPLAY)
    live = view(jobs.read_events(spark, path, schema, files_per_batch)).where(F.col("seq") > seq)
    return jobs.each_batch(ops.matching(live, types, job_id), lambda rows, n: out.write(rows, n), f"{out.root}/checkpoint", "append", every)


def promote_due(posts: VersionedTable, now: datetime, limit: int, number: int, name: str = "poll") -> DataFrame:
    """Poll ``number`` over posts(id, status, schedule_at, promoted_in): the earliest due pending ones become queued. Gives what this poll queued.

    The table notes the number in the version that holds the change, so a poll that is run again, or was stopped at any point,
    changes nothing twice and gives the same posts. Other writers' versions are read and the poll tried again.
    """
    while True:
        m = posts.manifest()
        if m.batches.get(name, -1) >= number:
            break
        rows = posts.read(m.version)
        chosen = queue.due(rows, now, limit).select(*m.key)

        def queued(old: DataFrame, keys: DataFrame) -> DataFrame:
            marked = old.join(keys.withColumn("_due", F.lit(True)), m.key, "left")  # noqa: B023
            hit = F.coalesce("_due", F.lit(False)) & (F.col("status") == "pending")
            made = {"status": F.when(hit, "queued").otherwise(F.col("status")), "promoted_in": F.when(hit, F.lit(number)).otherwise(F.col("promoted_in")).cast("bigint")}
            return marked.select(*(made.get(c, F.col(c)).alias(c) for c in old.columns))

        try:
            posts.rewrite(chosen, queued, expected=m.version, batch=(name, number))
            break
        except StaleWriter:
            continue
    return posts.read().where(F.col("promoted_in") == number)


def poll(spark: SparkSession, posts: VersionedTable, out: Deliveries, clock: Callable[[], datetime], limit: int = 50, every: str = "30 seconds") -> StreamingQuery:
    """Polls on a timer; what each poll queued is delivered to ``out`` once, under the poll's number."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return jobs.each_batch(ticks, lambda _, n: tick(posts, out, clock(), limit, n), f"{out.root}/checkpoint", "append", every)


def tick(posts: VersionedTable, out: Deliveries, now: datetime, limit: int, number: int) -> bool:
    """One poll; whether its posts were delivered now and not before."""
    return not out.has(number) and out.write(promote_due(posts, now, limit, number).drop("promoted_in"), number)


def save_edits(edits: VersionedTable, requests: DataFrame, expected: int | None = None) -> DataFrame:
    """Requests(clip_id, seq, version, ...) into the stored edits(clip_id, version, ...); gives (clip_id, seq, outcome, version) of each.

    Requests of one clip go by seq. A version of the table that this call hasn't read is a StaleWriter: read and try again.
    Requests are made once and folded once: the table's new parts and the outcomes are both read from the stored fold, which
    stays beside the table, in ``outcomes``, for as long as outcomes are read.
    """
    m = edits.manifest()
    before = m.version if expected is None else expected
    if before != m.version:
        raise StaleWriter(f"version {m.version} instead of {before}")
    name = uuid.uuid4().hex
    asked, folded = f"requests/{name}", f"outcomes/{name}"
    stored = edits.read(before).schema
    requests = requests.select("clip_id", "seq", F.col("version").cast("bigint"), *(F.col(f.name).cast(f.dataType) for f in stored if f.name not in ("clip_id", "version")))
    requests.write.parquet(f"{edits.root}/{asked}")

    def merged(now: DataFrame, new: DataFrame) -> DataFrame:
        catalog.fold_edits(now, new).write.parquet(f"{edits.root}/{folded}")
        done = edits.spark.read.parquet(f"{edits.root}/{folded}")
        return done.select(*(F.col(c) if c in ("clip_id", "version") else F.col("body")[c].alias(c) for c in now.columns))

    try:
        edits.rewrite(edits.spark.read.schema(requests.schema).parquet(f"{edits.root}/{asked}"), merged, expected=before)
    except BaseException:
        edits.files.delete(folded)
        raise
    finally:
        edits.files.delete(asked)
    if not edits.files.names(folded):  # no requests
        return catalog.fold_edits(edits.read(before), requests.limit(0)).where("outcomes IS NOT NULL").select("clip_id", F.inline("outcomes"))
    return edits.spark.read.parquet(f"{edits.root}/{folded}").where("outcomes IS NOT NULL").select("clip_id", F.inline("outcomes"))
