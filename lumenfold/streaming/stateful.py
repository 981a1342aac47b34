"""Streams that keep state of their own for each job: stage states as they change, and keep-alives of idle jobs.

State lives in the state store of the session, which must be the one on disk
(``ROCKS``): a job's state is a few rows or texts, and a task holds those of one key at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StructType

from lumenfold.functions import constants as C
from lumenfold.operators import events as ops

#: Spark's state store on disk, which these streams need.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}



def _nested(fields: str) -> str:
    """Fields of a schema as those of a struct in one."""
    return ", ".join(x.replace(" ", ": ", 1) for x in fields.split(", "))


_CHAPTER = "status string, clip_path string, transcript string, captions_path string, output_path string, error string"
_JOB = "status string, current_step string, destination_folder string, video_path string, n_outputs int, error string, skipped array<string>"
_TYPES = sorted({t for _, types, _ in C.STAGES for t in types})
_BIT = {t: 1 << i for i, t in enumerate(_TYPES)}
_NEEDS = [sum(_BIT[t] for t in types) for name, types, _ in C.STAGES if name in C.CHAPTER_STAGES]
_CHAPTERS = f"array<struct<chapter_index: int, {_nested(_CHAPTER)}>>"
_FOLD = ", ".join([_nested(_JOB), f"chapters: {_CHAPTERS}", *(f"{t}: boolean" for t in _TYPES), *(f"n_{s}: int" for s in C.CHAPTER_STAGES)])
#: Messages of a job: an event (type, chapter_index) or its state as of ``seq`` (job, chapters).
MESSAGES = f"job_id long, seq long, type string, chapter_index int, job struct<{_nested(_JOB)}>, chapters {_CHAPTERS}"
_FIELDS = [x.split(" ")[0] for x in _JOB.split(", ")]
#: Of a job's number, the last bits that differ among jobs of one key.
BITS = 4
#: Folds are read whole or not at all: texts of any length, and an error instead of a null.
_READ = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}
_CHAPTER_FIELDS = [x.split(" ")[0] for x in _CHAPTER.split(", ")]


class StageFold(StatefulProcessor):
    """Folds a job's messages: its newest state, its chapters by index, and the event types of each; what goes out is the fold before and after the batch.

    Jobs whose numbers differ in the last BITS bits only share a key, and states and folds are JSON texts, since the time of a
    job goes into calls to the state store and into what is handed over key by key: a batch reads a key's two texts once, whatever
    it holds of those jobs, and writes those it has changed. So a key never holds more than 2 ** BITS jobs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getValueState("jobs", "states string")
        self.seen = handle.getValueState("seen", "sent string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        jobs, seen = (json.loads(found[0]) if found is not None else {} for found in (self.jobs.get(), self.seen.get()))
        before, newer, more = {}, False, False
        for r in rows:
            of = str(r.job_id)
            if of not in before:
                before[of] = self._fold(jobs.get(of), seen.get(of))
            if r.state is not None and (of not in jobs or r.seq >= jobs[of]["seq"]):
                listed = jobs[of]["chapters"] if of in jobs else {}
                job, newer = json.loads(r.state) | {"seq": r.seq}, True
                jobs[of] = job | {"chapters": listed | {str(c["chapter_index"]): c for c in job.get("chapters") or []}}
            bit = _BIT.get(r.type, 0)
            if bit:
                sent = seen.setdefault(of, {"bits": 0, "chapters": {}})
                at = str(r.chapter_index) if r.chapter_index is not None else None
                had = sent["chapters"].get(at, 0)
                if sent["bits"] | bit != sent["bits"] or (at is not None and had | bit != had):
                    more = True
                    sent["bits"] |= bit
                    if at is not None:
                        sent["chapters"][at] = had | bit
        if newer:
            self.jobs.update((json.dumps(jobs),))
        if more:
            self.seen.update((json.dumps(seen),))
        for of, was in before.items():
            now = self._fold(jobs.get(of), seen.get(of))
            if now is not None and now != was:
                yield Row(job_id=int(of), before=None if was is None else json.dumps(was), after=json.dumps(now))

    def _fold(self, job: dict | None, seen: dict | None) -> dict | None:
        if job is None:
            return None
        bits, sent = (seen["bits"], seen["chapters"].values()) if seen is not None else (0, ())
        counts = {f"n_{s}": sum(b & need == need for b in sent) for s, need in zip(C.CHAPTER_STAGES, _NEEDS)}
        listed = sorted(job["chapters"].values(), key=lambda c: c["chapter_index"])
        return {f: job.get(f) for f in _FIELDS} | {"chapters": listed} | {t: bool(bits & b) for t, b in _BIT.items()} | counts

    def close(self) -> None:
        pass


def messages(events: DataFrame | None, jobs: DataFrame | None) -> DataFrame:
    """MESSAGES of events(job_id, seq, type, chapter_index) and of states(job_id, seq, ``ops.JOB_FIELDS``); either may be None."""
    schema = {f.name: f.dataType for f in StructType.fromDDL(MESSAGES).fields}
    parts = []
    if events is not None:
        parts.append(events.select("job_id", "seq", "type", F.col("chapter_index").cast("int"), *(F.lit(None).cast(schema[c]).alias(c) for c in ("job", "chapters"))))
    if jobs is not None:
        nothing = (F.lit(None).cast(schema[c]).alias(c) for c in ("type", "chapter_index"))
        parts.append(jobs.select("job_id", "seq", *nothing, F.struct(*_FIELDS).cast(schema["job"]).alias("job"), _listed(jobs, schema["chapters"])))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _listed(jobs: DataFrame, kind: ArrayType) -> Column:
    fields = ("chapter_index", *_CHAPTER_FIELDS)
    return F.transform("chapters", lambda c: F.struct(*(c[f].alias(f) for f in fields))).cast(kind).alias("chapters")


def stage_changes(stream: DataFrame) -> DataFrame:
    """(job_id, position, stage, state, done, total, error): the stages that a batch of MESSAGES changed, for update mode.

    A job's stages all come with its first state. Folded over batches by (job_id, stage), the changes are what
    ``ops.stage_states`` gives for all states and events so far.
    """
    state = F.when(F.col("job").isNotNull(), F.to_json(F.struct("job.*", "chapters")))
    told = stream.select("job_id", "seq", "type", "chapter_index", state.alias("state")).where(F.col("type").isin(*_TYPES) | F.col("state").isNotNull())
    texts = told.withColumn("jobs", F.shiftright("job_id", BITS)).groupBy("jobs").transformWithState(StageFold(), "job_id long, before string, after string", "Update", "None")
    folds = texts.select("job_id", *(F.from_json(c, f"struct<{_FOLD}>", _READ).alias(c) for c in ("before", "after")))
    both = ops.with_stages(ops.with_stages(folds, "before", "was"), "after", "now")
    changed = F.filter("now", lambda s: F.col("was").isNull() | ~F.element_at("was", s["position"] + 1).eqNullSafe(s))
    return both.select("job_id", F.inline(changed))


class IdleTimer(StatefulProcessor):
    """One timer a job, set anew by each of its events and by each ping; a terminal event ends it for good."""

    def __init__(self, milliseconds: int) -> None:
        self.every = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getValueState("ended", "ended boolean")

    def _clear(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ended = self.ended.exists()
        for r in rows:
            ended = ended or r.type in C.TERMINAL_TYPES
        self._clear()
        if ended:
            self.ended.update((True,))
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.every)
        yield Row(job_id=key[0], at_ms=now)

    def close(self) -> None:
        pass


def keep_alive(events: DataFrame, seconds: float = 15.0) -> DataFrame:
    """(job_id, at_ms): a ping for each job that has sent nothing for ``seconds``, and again after as long; none once it has ended.

    Timers go by processing time, so pings come without new events too. ``seconds`` of 0 or less gives none.
    """
    if seconds <= 0:
        return events.where("false").select("job_id", F.lit(0).cast("bigint").alias("at_ms"))
    return events.select("job_id", "type").groupBy("job_id").transformWithState(IdleTimer(int(seconds * 1000)), "job_id long, at_ms long", "Append", "ProcessingTime")
