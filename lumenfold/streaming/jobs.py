"""Job events as streams. Each function takes a streaming (or batch) frame and gives one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.functions import constants as C
from lumenfold.operators import events as ops
from lumenfold.operators import queue

EVENTS = "job_id long, seq long, type string, chapter_index int, ts timestamp_ntz"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet event files as a stream; the checkpoint remembers what was read, so nothing is lost or doubled."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def subscribe(events: DataFrame, types: Iterable[str] | None = None, job_id=None) -> DataFrame:
    return ops.matching(events, types, job_id)


def latest_metrics(snapshots: DataFrame, counters: list[str]) -> DataFrame:
    """The running latest snapshot of each clip and platform; state is one row a key. Use update or complete mode."""
    newest = F.max_by(F.struct("captured_at", "seq", *counters), F.struct("captured_at", "seq"))
    return snapshots.groupBy("clip_id", "platform").agg(newest.alias("s")).select("clip_id", "platform", "s.*")


def new_unknown_types(events: DataFrame) -> DataFrame:
    """Each undeclared type once, when it first shows; state is one key a type."""
    return events.where(~F.col("type").isin(*C.EVENT_TYPES)).select("type").dropDuplicates(["type"])


def until_terminal(events: DataFrame) -> DataFrame:
    """Events up to and with their job's first terminal one, by job, in order of seq within a batch.

    State is one flag a job, kept for good: whatever a job sends after its end, however late, stays out.
    """
    columns = events.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended = state.exists and bool(state.get[0])
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        stops = rows["type"].isin(C.TERMINAL_TYPES).to_numpy().nonzero()[0]
        if not ended:
            yield (rows.iloc[: stops[0] + 1] if len(stops) else rows)[columns]
        state.update((ended or len(stops) > 0,))

    return events.groupBy("job_id").applyInPandasWithState(step, events.schema, "ended boolean", "append", GroupStateTimeout.NoTimeout)


def stage_progress(events: DataFrame) -> DataFrame:
    """(job_id, stage, done): for every job with new events, how many chapters cleared each chapter stage so far.

    One running aggregate, for update mode: state is the set of (type, chapter) that a job has sent.
    """
    needs = {name: types for name, types, _ in C.STAGES if name in C.CHAPTER_STAGES}
    wanted = sorted({t for types in needs.values() for t in types})
    sent = F.when(F.col("type").isin(*wanted) & F.col("chapter_index").isNotNull(), F.struct("type", "chapter_index"))
    jobs = events.groupBy("job_id").agg(F.collect_set(sent).alias("sent"))

    def chapters(kind: str):
        return F.transform(F.filter("sent", lambda s: s["type"] == kind), lambda s: s["chapter_index"])

    def done(types: tuple[str, ...]):
        cleared = chapters(types[0])
        for kind in types[1:]:
            cleared = F.array_intersect(cleared, chapters(kind))
        return F.size(cleared)

    listed = F.array(*(F.struct(F.lit(name).alias("stage"), done(types).alias("done")) for name, types in needs.items()))
    return jobs.select("job_id", F.inline(listed))


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All there is now to Parquet, then stop."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Batches to ``sink``, once through or on a timer; a restarted batch has the same number, for sinks to skip."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def poll_due(posts: DataFrame, now: datetime, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """One tick of the scheduler: the due posts, and all posts with those queued. Run it from ``each_batch`` on a rate source."""
    chosen = queue.due(posts, now, limit)
    return chosen, queue.promote(posts, chosen)
