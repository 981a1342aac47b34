"""Queries over the event log of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import constants as C
from lumenfold.operators import events, history
from lumenfold.plans import views as V
from lumenfold.registry import query
from lumenfold.sources import table

_KNOWN = ", ".join(f"'{t}'" for t in C.EVENT_TYPES)


@query("p15_t1_subscription", f"WITH {V.EVENTS} SELECT job_id, seq, type FROM job_events WHERE type IN ('ClipRendered', 'JobCompleted') AND job_id = 17")
def subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.matching(V.job_events(spark, sf_dir), ("ClipRendered", "JobCompleted"), 17).select("job_id", "seq", "type")


@query("t2_replay_then_filter", f"WITH {V.EVENTS}, tail AS (SELECT * FROM job_events ORDER BY seq DESC LIMIT 200) SELECT job_id, seq, type FROM tail WHERE type IN ('ClipRendered', 'JobCompleted')")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.replay(V.job_events(spark, sf_dir), 200, ("ClipRendered", "JobCompleted")).select("job_id", "seq", "type")


@query("t3_k11_until_terminal", f"""WITH {V.EVENTS} SELECT job_id, seq, type FROM (SELECT *, coalesce(max(CASE WHEN type IN ('JobCompleted', 'JobFailed') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM job_events) WHERE over = 0""")
def until_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.until_terminal(V.job_events(spark, sf_dir)).select("job_id", "seq", "type")


@query("t5_after_end", f"""WITH {V.EVENTS} SELECT job_id, seq, coalesce(bool_or(type IN ('JobCompleted', 'JobFailed')) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_end FROM job_events""")
def after_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.running_terminal(V.job_events(spark, sf_dir)).select("job_id", "seq", "after_end")


@query("t10_unknown_types", f"WITH {V.EVENTS} SELECT type, min(seq) AS first_seq FROM job_events WHERE type NOT IN ({_KNOWN}) GROUP BY type")
def unknown_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.unknown_types(V.job_events(spark, sf_dir))


@query("n4_payload_chapter", f"WITH {V.EVENTS} SELECT seq, CAST(json_extract(payload, '$.chapter_index') AS INTEGER) AS chapter FROM job_events")
def payload_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.job_events(spark, sf_dir).select("seq", events.chapter_index("payload").alias("chapter"))


_SINGLE = ", ".join(f"count(DISTINCT chapter_index) FILTER (WHERE type = '{types[0]}') AS n_{name}" for name, types, _ in C.STAGES if name in C.CHAPTER_STAGES and len(types) == 1)
COUNTS = f"""{V.EVENTS},
paired AS (SELECT job_id, count(*) AS n FROM (SELECT job_id, chapter_index FROM job_events WHERE type IN ('ThumbnailGenerated', 'SocialContentGenerated') GROUP BY ALL HAVING count(DISTINCT type) = 2) GROUP BY job_id),
counts AS (SELECT e.job_id, {_SINGLE}, coalesce(any_value(paired.n), 0) AS n_finalise_chapters, list(DISTINCT type) AS types FROM job_events e LEFT JOIN paired USING (job_id) GROUP BY e.job_id)"""


@query("a11_a12_stage_counts", f"WITH {COUNTS} SELECT * EXCLUDE (types) FROM counts")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.event_counts(V.job_events(spark, sf_dir))
    return found.select("job_id", *(f"n_{s}" for s in C.CHAPTER_STAGES))


_JOBS = f"""states AS (SELECT c_custkey AS job_id, CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS status, CASE c_custkey % 4 WHEN 0 THEN 'folder' WHEN 1 THEN 'download' WHEN 2 THEN 'chapters' END AS current_step,
  CASE WHEN c_custkey % 5 = 0 THEN '/d' END AS destination_folder, CAST(c_custkey % 6 AS INTEGER) AS n_chapters, CASE WHEN c_custkey % 7 = 0 THEN ['caption', 'chapters'] ELSE [] END AS skipped FROM customer)"""
_STEPS = {"folder": 1, "download": 2, "chapters": 3}


def _stage_sql(i: int, name: str, types: tuple[str, ...], field: str | None) -> str:
    any_type = " OR ".join(f"coalesce(list_contains(types, '{t}'), false)" for t in types)
    past = f"coalesce(list_position(['folder', 'download', 'chapters', 'completed'], current_step) > {_STEPS.get(name, 9)}, false)"
    art = {"extract": "(n_chapters + 1) // 2", "finalise_chapters": "(n_chapters + 2) // 3"}.get(name, "0")
    if name in C.CHAPTER_STAGES:
        count = f"greatest({art}, coalesce(n_{name}, 0))"
        done, total = f"n_chapters > 0 AND {count} >= n_chapters", "CASE WHEN n_chapters > 0 THEN n_chapters END"
    else:
        count, total = "0", "CAST(NULL AS INTEGER)"
        extra = {"folder": "destination_folder IS NOT NULL OR ", "chapters": "n_chapters > 0 OR ", "export": "(n_chapters > 0 AND n_chapters <= 2) OR ", "complete": "status = 'completed' OR "}.get(name, "")
        done = f"{extra}{past} OR {any_type}"
    skip = f"list_contains(skipped, '{name}')"
    return f"SELECT job_id, status, current_step, n_chapters, {i} AS position, '{name}' AS stage, {str(name in C.CHAPTER_STAGES).lower()} AS per, {skip} AS skip, ({done}) AND NOT {skip} AS ok, CASE WHEN {skip} THEN 0 ELSE {count} END AS done, {total} AS total FROM j"


STATES = f"""{COUNTS}, {_JOBS}, j AS (SELECT * FROM states LEFT JOIN counts USING (job_id)),
rows AS ({' UNION ALL '.join(_stage_sql(i, *s) for i, s in enumerate(C.STAGES))}),
firsts AS (SELECT *, min(CASE WHEN NOT ok AND NOT skip THEN position END) OVER (PARTITION BY job_id) AS first FROM rows),
derived AS (SELECT job_id, position, stage, CASE WHEN skip THEN 'skipped' WHEN status = 'failed' AND (stage = coalesce(current_step, '') OR (per AND n_chapters > 0 AND NOT ok)) THEN 'failed' WHEN ok OR status = 'completed' THEN 'done'
  WHEN status <> 'failed' AND position = first THEN 'active' ELSE 'pending' END AS state, CAST(done AS INTEGER) AS done, total, n_chapters FROM firsts)"""


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapter = """transform(CASE WHEN c_custkey % 6 > 0 THEN sequence(0, cast(c_custkey % 6 AS int) - 1) ELSE array() END, i -> named_struct('chapter_index', i, 'status', CASE WHEN i = 0 THEN 'failed' WHEN i % 3 = 0 THEN 'completed' ELSE 'extracting' END,
      'clip_path', CASE WHEN i % 2 = 0 THEN concat('/c/', i) END, 'transcript', cast(NULL AS string), 'captions_path', cast(NULL AS string), 'output_path', cast(NULL AS string), 'error', CASE WHEN i = 0 THEN 'broke' END))"""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS job_id", "CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS status",
        "CASE c_custkey % 4 WHEN 0 THEN 'folder' WHEN 1 THEN 'download' WHEN 2 THEN 'chapters' END AS current_step", "CASE WHEN c_custkey % 5 = 0 THEN '/d' END AS destination_folder",
        "cast(NULL AS string) AS video_path", "2 AS n_outputs", "'job error' AS error", "CASE WHEN c_custkey % 7 = 0 THEN array('caption', 'chapters') ELSE array() END AS skipped", f"{chapter} AS chapters",
    )


@query("t4_w15_stage_states", f"WITH {STATES} SELECT job_id, position, stage, state, done, total, CASE WHEN state = 'failed' THEN CASE WHEN n_chapters > 0 THEN 'broke' ELSE 'job error' END END AS error FROM derived")
def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.stage_states(job_states(spark, sf_dir), V.job_events(spark, sf_dir))


@query("c7_announcements", f"WITH {STATES} SELECT job_id, max(CASE WHEN state = 'active' THEN stage END) AS active, coalesce(string_agg(CASE WHEN state = 'skipped' THEN stage END, ', ' ORDER BY position), '') AS skipped FROM derived GROUP BY job_id")
def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.announcements(events.stage_states(job_states(spark, sf_dir), V.job_events(spark, sf_dir)))


@query("a13_artifact_counts", f"WITH {_JOBS} SELECT job_id, CAST((n_chapters + 1) // 2 AS INTEGER) AS extracted, CAST((n_chapters + 2) // 3 AS INTEGER) AS finalised FROM states")
def artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.artifact_counts("chapters")
    return job_states(spark, sf_dir).select("job_id", found["extract"].alias("extracted"), found["finalise_chapters"].alias("finalised"))


_STEP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.STEP_PROGRESS.items())
_OWN = " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.JOB_PROGRESS.items() if v is not None)
_OWN_TYPES = ", ".join(f"'{k}'" for k in C.JOB_PROGRESS)


@query("a16_overall_progress", f"""WITH {V.EVENTS}, n AS (SELECT c_custkey AS job_id, c_custkey % 6 AS n FROM customer),
steps AS (SELECT job_id, sum(share) AS shares FROM (SELECT job_id, chapter_index, arg_max(CAST(CASE type {_STEP} END AS DOUBLE), seq) AS share FROM job_events WHERE (CASE type {_STEP} END) IS NOT NULL GROUP BY ALL) GROUP BY job_id),
own AS (SELECT job_id, arg_max(type, seq) AS last FROM job_events WHERE type IN ({_OWN_TYPES}) GROUP BY job_id)
SELECT job_id, round(CASE WHEN n = 0 OR coalesce(last IN ('JobCompleted', 'JobFailed'), false) THEN CAST(coalesce(CASE last {_OWN} END, 0.02) AS DOUBLE) ELSE least(0.95, 0.25 + 0.70 * coalesce(shares, 0) / n) END, 6) AS progress
FROM n LEFT JOIN steps USING (job_id) LEFT JOIN own USING (job_id)""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "customer").selectExpr("c_custkey AS job_id", "cast(c_custkey % 6 AS int) AS n_chapters")
    return events.progress(jobs, V.job_events(spark, sf_dir)).select("job_id", F.round("progress", 6).alias("progress"))


@query("k12_log_lines", f"""WITH {V.EVENTS}, p AS (SELECT *, strftime(ts, '%H:%M:%S') AS s, json_extract_string(payload, '$.url') AS u, CAST(chapter_index + 1 AS VARCHAR) AS c, json_extract_string(payload, '$.error') AS e, CAST(json_extract(payload, '$.duration') AS DOUBLE) AS d FROM job_events)
SELECT seq, '[' || s || '] ' || CASE type WHEN 'VideoRequested' THEN '📥  Job accepted — ' || u WHEN 'FolderCreated' THEN '📁  Folder created — ' WHEN 'VideoDownloaded' THEN '⬇️  Video downloaded — "t" (' || CAST(round_even(d, 0) AS BIGINT) || 's)'
  WHEN 'ChaptersDetected' THEN '📋  Chapters detected — 0 chapter(s)' WHEN 'ChapterClipExtracted' THEN '✂️  Chapter ' || c || ' clip extracted — ' WHEN 'ChapterTranscribed' THEN '🎙️  Chapter ' || c || ' transcribed — 3 words'
  WHEN 'CaptionsGenerated' THEN '💬  Chapter ' || c || ' captions generated (srt)' WHEN 'SubtitleImageRendered' THEN '🖼️  Chapter ' || c || ' subtitles rendered — 0 image(s)' WHEN 'ClipRendered' THEN '✅  Chapter ' || c || ' clip rendered — '
  WHEN 'JobCompleted' THEN '🎉  Job completed — 0 clip(s) saved' WHEN 'JobFailed' THEN '❌  Job failed — ' || e ELSE type || ' — ' || payload END AS line FROM p""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.job_events(spark, sf_dir).withColumn("stamp", F.date_format("ts", "HH:mm:ss"))
    return e.select("seq", events.log_line("type", "payload", "stamp").alias("line"))


@query("p19_p20_option_gating", """WITH o AS (SELECT o_orderkey AS job_id, o_orderkey % 2 = 0 AS t, o_orderkey % 3 > 0 AS c, o_orderkey % 5 > 1 AS r, o_orderkey % 7 > 2 AS th, o_orderkey % 11 > 4 AS sp FROM orders)
SELECT job_id, c AND t AS captions, th AND r AS thumbnail, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN t THEN [] ELSE ['transcribe', 'caption'] END, CASE WHEN c THEN [] ELSE ['caption'] END, CASE WHEN r THEN [] ELSE ['extract', 'render', 'finalise_chapters'] END,
  CASE WHEN th THEN [] ELSE ['finalise_chapters'] END, CASE WHEN sp THEN [] ELSE ['chapters'] END))), ',') AS skipped FROM o""")
def option_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS job_id", "o_orderkey % 2 = 0 AS transcription", "o_orderkey % 3 > 0 AS captions", "o_orderkey % 5 > 1 AS render", "o_orderkey % 7 > 2 AS thumbnail", "o_orderkey % 11 > 4 AS segment_proposer")
    options = {c: F.col(c) for c in o.columns[1:]} | {"reframe": F.lit(True), "broll": F.lit(True)}
    gated = events.gate_options(options)
    return o.select("job_id", gated["captions"].alias("captions"), gated["thumbnail"].alias("thumbnail"), F.array_join(events.skipped_stages(options), ",").alias("skipped"))


@query("c5_step_past", """SELECT c_custkey AS job_id, coalesce(list_position(['folder', 'download', 'chapters', 'completed'], CASE c_custkey % 4 WHEN 0 THEN 'folder' WHEN 1 THEN 'download' WHEN 2 THEN 'chapters' END) > 1, false) AS past_folder FROM customer""")
def step_past(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_states(spark, sf_dir).select("job_id", events.step_past("current_step", "folder").alias("past_folder"))


@query("w16_undo_history", f"""WITH RECURSIVE {V.EVENTS}, log AS (SELECT job_id AS clip_id, seq, CASE seq % 5 WHEN 0 THEN 'undo' WHEN 1 THEN 'redo' WHEN 2 THEN 'undo' ELSE 'edit' END AS kind, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM job_events),
r AS (SELECT clip_id, 0::BIGINT AS n, [0::BIGINT] AS h, 1::BIGINT AS i FROM log GROUP BY clip_id
  UNION ALL SELECT r.clip_id, log.n, CASE kind WHEN 'edit' THEN list_slice(list_append(list_slice(h, 1, i), seq), greatest(1, i - 48), i + 1) ELSE h END,
    CASE kind WHEN 'edit' THEN least(i + 1, 50) WHEN 'undo' THEN greatest(1, i - 1) ELSE least(len(h), i + 1) END FROM r JOIN log ON log.clip_id = r.clip_id AND log.n = r.n + 1)
SELECT clip_id, array_to_string(arg_max(h, n), ',') AS states, CAST(arg_max(i, n) - 1 AS INTEGER) AS cursor, arg_max(h[i], n) AS current FROM r GROUP BY clip_id""")
def undo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("undo", "redo", "undo", "edit", "edit"))), (F.col("seq") % 5 + 1).cast("int"))
    log = V.job_events(spark, sf_dir).select(F.col("job_id").alias("clip_id"), "seq", kind.alias("kind"), F.col("seq").alias("state"))
    return history.replay(log, block=2_000).withColumn("states", F.array_join(F.col("states").cast("array<string>"), ","))
