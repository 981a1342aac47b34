"""Job events: filters, replay, and the fold of a job's state and events into its stages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import constants as C


def matching(events: DataFrame, types: Iterable[str] | None = None, job_id=None) -> DataFrame:
    """Events of these types and this job; each filter is optional."""
    out = events if types is None else events.where(F.col("type").isin(*types))
    return out if job_id is None else out.where(F.col("job_id") == job_id)


def replay(events: DataFrame, keep: int = 200, types: Iterable[str] | None = None, job_id=None) -> DataFrame:
    """What a late subscriber sees of the last ``keep`` events of all jobs: the cut comes before the filter."""
    return matching(events.orderBy(F.desc("seq")).limit(keep), types, job_id)


def until_terminal(events: DataFrame) -> DataFrame:
    """Each job's events up to and with its first terminal one."""
    ended = events.where(F.col("type").isin(*C.TERMINAL_TYPES)).groupBy("job_id").agg(F.min("seq").alias("_last"))
    return events.join(ended, "job_id", "left").where(F.col("_last").isNull() | (F.col("seq") <= F.col("_last"))).drop("_last")


def unknown_types(events: DataFrame) -> DataFrame:
    """Types outside the declared ones, each with its first event."""
    return events.where(~F.col("type").isin(*C.EVENT_TYPES)).groupBy("type").agg(F.min("seq").alias("first_seq"))


def chapter_index(payload: str) -> Column:
    """The payload's chapter number if it is a JSON number, else null."""
    quoted = F.col(payload).rlike(r'"chapter_index"\s*:\s*"')
    number = F.get_json_object(payload, "$.chapter_index").try_cast("int")
    return F.when(~quoted, number)


def skipped_stages(options: dict[str, Column]) -> Column:
    """The stages that options switch off, with what depends on them."""
    parts = [F.when(~options[name], F.array(*map(F.lit, stages))).otherwise(F.expr("cast(array() as array<string>)")) for name, stages in C.OPTION_STAGES.items() if stages and name in options]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def gate_options(options: dict[str, Column]) -> dict[str, Column]:
    """Options after their dependencies: captions need transcription; reframe, b-roll and thumbnail need render."""
    out = dict(options)
    out["captions"] = options["captions"] & options["transcription"]
    for name in ("reframe", "broll", "thumbnail"):
        out[name] = options[name] & options["render"]
    return out


def step_past(current: str, target: str) -> Column:
    """Whether the current step comes after the target in order; unknown steps don't."""
    rank = F.array_position(F.array(*map(F.lit, C.STEPS)), F.col(current))
    return F.coalesce((rank > 0) & (rank > C.STEPS.index(target) + 1), F.lit(False)) if target in C.STEPS else F.lit(False)


def event_counts(events: DataFrame) -> DataFrame:
    """For each job: the types seen, and for each chapter stage the chapters with all of its types.

    Two aggregates with map-side combine, first by chapter, so that a busy job isn't one task's work.
    """
    types = sorted({t for _, done, _ in C.STAGES for t in done})
    seen = [F.max(F.col("type") == t).alias(t) for t in types]
    chapters = events.groupBy("job_id", "chapter_index").agg(*seen)
    need = {name: done for name, done, _ in C.STAGES}
    counts = [
        F.count_if(F.col("chapter_index").isNotNull() & F.array_min(F.array(*(F.col(t) for t in need[s])))).alias(f"n_{s}") for s in C.CHAPTER_STAGES
    ]
    return chapters.groupBy("job_id").agg(*(F.max(t).alias(t) for t in types), *counts)


def artifact_counts(chapters: str) -> dict[str, Column]:
    """For each chapter stage, how many chapters show its artifact, or for lack of one, its status."""
    fields = {name: field for name, _, field in C.STAGES}
    rank = F.create_map(*(x for k, v in C.STATUS_RANK.items() for x in (F.lit(k), F.lit(v))))
    out = {}

    def shown(field: str):
        return lambda c: c[field].isNotNull()

    for stage in C.CHAPTER_STAGES:
        if fields[stage]:
            out[stage] = F.size(F.filter(chapters, shown(fields[stage])))
        else:
            out[stage] = F.size(F.filter(chapters, lambda c: F.coalesce(F.try_element_at(rank, c["status"]) >= C.STATUS_RANK["completed"], F.lit(False))))
    return {k: F.greatest(v, F.lit(0)) for k, v in out.items()}


#: What stages are derived from, beside the counts and types of ``event_counts``.
JOB_FIELDS = ("status", "current_step", "destination_folder", "video_path", "n_outputs", "error", "skipped", "chapters")


def with_stages(rows: DataFrame, fold: str, out: str) -> DataFrame:
    """``rows`` with ``out``: an array of (position, stage, state, done, total, error) derived from the struct ``fold``.

    ``fold`` holds JOB_FIELDS and the columns of ``event_counts``; a null one gives null.
    """

    def f(name: str) -> Column:
        return F.col(f"{fold}.{name}")

    total = F.greatest(F.size(f("chapters")), F.lit(0))
    artifacts = artifact_counts(f"{fold}.chapters")
    step = f"{fold}.current_step"
    outer = {
        "folder": (F.coalesce(f("destination_folder"), F.lit("")) != "") | step_past(step, "folder"),
        "download": (F.coalesce(f("video_path"), F.lit("")) != "") | step_past(step, "download"),
        "chapters": (total > 0) | step_past(step, "chapters"),
        "export": (F.coalesce(f("n_outputs"), F.lit(0)) >= total) & (total > 0),
        "complete": F.coalesce(f("status") == "completed", F.lit(False)),
    }
    stages = []
    for i, (name, types, _) in enumerate(C.STAGES):
        skip = F.coalesce(F.array_contains(f("skipped"), name), F.lit(False))
        if name in C.CHAPTER_STAGES:
            count = F.greatest(artifacts[name], F.coalesce(f(f"n_{name}"), F.lit(0))).cast("int")
            done, of = (total > 0) & (count >= total), F.when(total > 0, total)
        else:
            count, of = F.lit(0), F.lit(None).cast("int")
            done = outer[name]
            for t in types:
                done = done | F.coalesce(f(t), F.lit(False))
        stages.append(
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), F.lit(name in C.CHAPTER_STAGES).alias("per"), skip.alias("skip"), (done & ~skip).alias("ok"), F.when(skip, 0).otherwise(count).alias("done"), of.alias("total"))
        )
    found = rows.withColumn("_all", F.array(*stages)).withColumn("_bad", F.get(F.filter(f("chapters"), lambda c: c["status"] == "failed"), 0))
    found = found.withColumn("_first", F.array_min(F.transform(F.filter("_all", lambda s: ~s["ok"] & ~s["skip"]), lambda s: s["position"])))
    message = F.coalesce(F.col("_bad.error"), f("error"))

    def derived(s: Column) -> Column:
        broken = (s["stage"] == F.coalesce(f("current_step"), F.lit(""))) | (s["per"] & F.col("_bad").isNotNull() & ~s["ok"])
        state = (
            F.when(s["skip"], "skipped")
            .when((f("status") == "failed") & broken, "failed")
            .when(s["ok"] | (f("status") == "completed"), "done")
            .when(~f("status").eqNullSafe(F.lit("failed")) & (s["position"] == F.col("_first")), "active")
            .otherwise("pending")
        )
        return F.struct(s["position"].alias("position"), s["stage"].alias("stage"), state.alias("state"), s["done"].alias("done"), s["total"].alias("total"), F.when(state == "failed", message).alias("error"))

    return found.withColumn(out, F.when(F.col(fold).isNotNull(), F.transform("_all", derived))).drop("_all", "_bad", "_first")


def stage_states(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """(job_id, position, stage, state, done, total, error): every stage of every job.

    ``jobs``: job_id and JOB_FIELDS, skipped as stages and chapters as an array of structs. Counts are the larger
    of state and events, so progress never goes back.
    """
    j = jobs.join(event_counts(events), "job_id", "left")
    folded = j.select("job_id", F.struct(*(c for c in j.columns if c != "job_id")).alias("fold"))
    return with_stages(folded, "fold", "stages").select("job_id", F.inline("stages"))


def announcements(states: DataFrame) -> DataFrame:
    """One line a job: its active stage and the skipped ones."""
    skipped = F.sort_array(F.collect_list(F.when(F.col("state") == "skipped", F.struct("position", "stage"))))
    return states.groupBy("job_id").agg(
        F.max(F.when(F.col("state") == "active", F.col("stage"))).alias("active"), F.array_join(F.transform(skipped, lambda s: s["stage"]), ", ").alias("skipped")
    )


def progress(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """(job_id, progress) of each of jobs(job_id, n_chapters) from its events(job_id, seq, type, chapter_index).

    While chapters are worked on: 0.25 + 0.70 x the sum of their newest steps' shares over the job's number of chapters, 0.95 at
    most, so chapters that haven't begun count as 0. A job without chapters, or whose newest event of its own ended it, stands at
    that event's value, and where that is unknown or there is none at the least.
    """
    steps, own = (F.create_map(*(F.lit(x) for k, v in table.items() if v is not None for x in (k, v))) for table in (C.STEP_PROGRESS, C.JOB_PROGRESS))
    chapters = events.where(F.col("type").isin(*C.STEP_PROGRESS)).groupBy("job_id", F.coalesce("chapter_index", F.lit(0)).alias("chapter"))
    shares = chapters.agg(F.element_at(steps, F.max_by("type", "seq")).alias("share")).groupBy("job_id").agg(F.sum("share").alias("shares"))
    last = events.where(F.col("type").isin(*C.JOB_PROGRESS)).groupBy("job_id").agg(F.max_by("type", "seq").alias("last"))
    found = jobs.select("job_id", F.coalesce("n_chapters", F.lit(0)).alias("n")).join(shares, "job_id", "left").join(last, "job_id", "left")
    base = F.coalesce(F.try_element_at(own, F.col("last")), F.lit(C.LEAST_PROGRESS))
    stands = (F.col("n") == 0) | F.coalesce(F.col("last").isin(*C.TERMINAL_TYPES), F.lit(False))
    worked = F.least(F.lit(0.95), 0.25 + 0.70 * (F.coalesce("shares", F.lit(0.0)) / F.greatest("n", F.lit(1))))
    return found.select("job_id", F.when(stands, base).otherwise(worked).alias("progress"))


def compact_json(text: str) -> Column:
    """A JSON text without blanks outside of its strings; names, order and numbers stay as they are written."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|[ \t\n\r]+', "$1")


def log_line(kind: str, payload: str, stamp: str) -> Column:
    """An event as a line of the job log; unknown types show their payload as JSON without blanks between its parts."""

    def p(name: str) -> Column:
        return F.get_json_object(payload, f"$.{name}")

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(p(name), F.lit(default))

    def size(name: str) -> Column:
        return F.coalesce(F.json_array_length(p(name)), F.lit(0)).cast("string")

    chapter = (F.coalesce(p("chapter_index").cast("int"), F.lit(0)) + 1).cast("string")
    words = F.size(F.filter(F.split(text("text"), r"\s+"), lambda w: w != "")).cast("string")
    seconds = F.format_string("%.0f", F.bround(F.coalesce(p("duration").cast("double"), F.lit(0.0)), 0))
    # The wording of each line.
    lines = {
        "VideoRequested": ("📥  Job accepted — ", text("url")),
        "FolderCreated": ("📁  Folder created — ", text("destination_folder")),
        "VideoDownloaded": ('⬇️  Video downloaded — "', text("title"), '" (', seconds, "s)"),
        "ChaptersDetected": ("📋  Chapters detected — ", size("chapters"), " chapter(s)"),
        "ChapterClipExtracted": ("✂️  Chapter ", chapter, " clip extracted — ", text("clip_path")),
        "ChapterTranscribed": ("🎙️  Chapter ", chapter, " transcribed — ", words, " words"),
        "CaptionsGenerated": ("💬  Chapter ", chapter, " captions generated (", text("format", "srt"), ")"),
        "SubtitleImageRendered": ("🖼️  Chapter ", chapter, " subtitles rendered — ", size("image_paths"), " image(s)"),
        "ClipRendered": ("✅  Chapter ", chapter, " clip rendered — ", text("output_path")),
        "JobCompleted": ("🎉  Job completed — ", size("output_paths"), " clip(s) saved"),
        "JobFailed": ("❌  Job failed — ", text("error", "unknown error")),
    }
    out = None
    for name, parts in lines.items():
        line = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
        out = F.when(F.col(kind) == name, line) if out is None else out.when(F.col(kind) == name, line)
    out = out.otherwise(F.concat(F.coalesce(F.col(kind), F.lit("Unknown")), F.lit(" — "), F.coalesce(compact_json(payload), F.lit("{}"))))
    return F.concat(F.lit("["), F.col(stamp), F.lit("] "), out)


def running_terminal(events: DataFrame) -> DataFrame:
    """``events`` with whether their job had ended before them; for streams of one job's events in order."""
    before = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("after_end", F.coalesce(F.max(F.col("type").isin(*C.TERMINAL_TYPES)).over(before), F.lit(False)))


def in_order(events: DataFrame, correlation: str = "correlation_id", at: str = "ts") -> DataFrame:
    """Events with ``place`` in their job by publishing order (seq), occurred_at in UTC, and a correlation id, the job's by default."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))
    stamp = F.date_format(F.col(at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    own = F.coalesce(F.nullif(F.col(correlation), F.lit("")), F.col("job_id").cast("string"))
    return events.withColumn("place", place).withColumn("occurred_at", stamp).withColumn(correlation, own)
