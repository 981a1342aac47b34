"""Queries that write: stored tables with versions, polls and streams, each in a new folder of the shared one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import metrics
from lumenfold.plans import catalog_queries, media_queries
from lumenfold.plans import event_queries as E
from lumenfold.plans import views as V
from lumenfold.registry import ORACLES, query
from lumenfold.plans.word_queries import CHUNKS, captions_of
from lumenfold.sources import captions, table
from lumenfold.storage import Deliveries, VersionedTable, new_folder
from lumenfold.streaming import delivery, jobs, stateful


@query("u1_u2_stored_upsert", ORACLES["u1_u2_upsert_latest"])
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, changes = catalog_queries.clip_changes(spark, sf_dir)
    clips = VersionedTable.create(spark, new_folder(spark, "clips"), rows, ["clip_id"])
    clips.upsert(changes, "turn")
    return clips.read()


_STORED = f"""WITH {V.CLIPS}, first AS (SELECT clip_id, clip_id % 3 <> 0 AND clip_id % 2 = 0 AND job_id % 4 <> clip_id % 5 AS clash, clip_id % 3 = 0 AS new, clip_id % 5 AS stored FROM clips),
said AS (SELECT clip_id, 1::BIGINT AS seq, CASE WHEN clash THEN 'conflict' ELSE 'accepted' END AS outcome, CAST(CASE WHEN clash THEN stored WHEN new THEN 1 ELSE stored + 1 END AS BIGINT) AS version FROM first)"""


def _edits(spark: SparkSession, sf_dir: str) -> tuple[VersionedTable, DataFrame]:
    c = V.clips(spark, sf_dir)
    stored = c.where("clip_id % 3 <> 0").selectExpr("clip_id", "clip_id % 5 AS version", "concat('stored ', clip_id) AS timeline")
    asked = c.selectExpr("clip_id", "1L AS seq", "CASE WHEN clip_id % 2 = 0 THEN job_id % 4 END AS version", "concat('first ', clip_id) AS timeline")
    again = c.where("clip_id % 7 = 0").selectExpr("clip_id", "2L AS seq", "cast(NULL AS bigint) AS version", "concat('second ', clip_id) AS timeline")
    return VersionedTable.create(spark, new_folder(spark, "edits"), stored, ["clip_id"]), asked.union(again)


@query("u3_stored_outcomes", f"{_STORED} SELECT * FROM said UNION ALL SELECT clip_id, 2, 'accepted', version + 1 FROM said WHERE clip_id % 7 = 0")
def stored_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.save_edits(*_edits(spark, sf_dir))


@query("u3_stored_edits", f"""{_STORED} SELECT clip_id, CASE WHEN clip_id % 7 = 0 THEN version + 1 ELSE version END AS version,
  CASE WHEN clip_id % 7 = 0 THEN 'second ' WHEN outcome = 'conflict' THEN 'stored ' ELSE 'first ' END || clip_id AS timeline FROM said""")
def stored_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits, requests = _edits(spark, sf_dir)
    delivery.save_edits(edits, requests)
    return edits.read()


@query("u8_stored_append", ORACLES["u8_snapshot_append"])
def stored_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = media_queries.snapshot_parts(spark, sf_dir)
    stored = VersionedTable.create(spark, new_folder(spark, "snapshots"), old, ["clip_id"])
    stored.append(metrics.append_snapshots(old.where("false"), new, media_queries.NOW, ["views", "likes"]))
    return stored.read()


@query("t7_polled_once", f"""WITH {V.JOBS}, {catalog_queries._POSTS} SELECT id, (rn - 1) // 50 AS batch FROM (SELECT id, row_number() OVER (ORDER BY schedule_at, id) AS rn
  FROM posts WHERE status = 'pending' AND schedule_at <= {catalog_queries._NOW}) WHERE rn <= 150""")
def polled_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three polls of fifty, each run twice."""
    rows = catalog_queries.posts(spark, sf_dir).withColumn("promoted_in", F.lit(None).cast("bigint"))
    posts, out = VersionedTable.create(spark, new_folder(spark, "posts"), rows, ["id"]), Deliveries(spark, new_folder(spark, "polled"))
    for number in (0, 0, 1, 1, 2, 2):
        delivery.tick(posts, out, catalog_queries.NOW, 50, number)
    return out.read().select("id", "batch")


def _log(sf_dir: str) -> str:
    """The event log as a pattern: streams take a pattern where the table is one file, and a folder as well."""
    return f"{sf_dir}/events.parque[t]"


@query("t2_replay_then_live", f"""WITH {V.EVENTS}, middle AS (SELECT max(seq) // 2 AS mid FROM job_events), tail AS (SELECT job_events.* FROM job_events, middle WHERE seq <= mid ORDER BY seq DESC LIMIT 200)
SELECT job_id, seq, type, seq <= mid AS replayed FROM (SELECT * FROM tail UNION ALL SELECT job_events.* FROM job_events, middle WHERE seq > mid), middle WHERE type IN ('ClipRendered', 'JobCompleted')""")
def replay_then_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription that begins in the middle of the event log."""
    log = table(spark, sf_dir, "events")
    middle = V.job_events(spark, sf_dir).agg(F.max("seq")).first()[0] // 2
    out = Deliveries(spark, new_folder(spark, "subscribed"))
    delivery.replay_then_live(spark, _log(sf_dir), out, log.schema, types=("ClipRendered", "JobCompleted"), at=middle, view=V.of_events).awaitTermination()
    return out.read().select("job_id", "seq", "type", (F.col("batch") == delivery.REPLAY).alias("replayed"))


@query("t4_w15_stage_stream", ORACLES["t4_w15_stage_states"])
def stage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of all jobs from a stream of events and states, as they stand after its last batch."""
    was = {k: spark.conf.get(k, None) for k in stateful.ROCKS}
    root = new_folder(spark, "stages")
    E.job_states(spark, sf_dir).withColumn("seq", F.lit(0).cast("bigint")).write.parquet(f"{root}/states")
    states = spark.read.parquet(f"{root}/states").schema
    try:
        for k, v in stateful.ROCKS.items():
            spark.conf.set(k, v)
        log = V.of_events(jobs.read_events(spark, _log(sf_dir), table(spark, sf_dir, "events").schema))
        stream = stateful.stage_changes(stateful.messages(log, jobs.read_events(spark, f"{root}/states", states)))
        out = Deliveries(spark, f"{root}/changes")
        jobs.each_batch(stream, lambda rows, n: out.write(rows, n), f"{root}/checkpoint").awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rest = F.struct("state", "done", "total", "error")
    return out.read().groupBy("job_id", "position", "stage").agg(F.max_by(rest, "batch").alias("s")).select("job_id", "position", "stage", "s.*")


@query("s8_k6_caption_files", f"""SELECT vid, CAST("index" AS INTEGER) AS "index", CAST("start" AS DOUBLE) / 1000 AS "start", CAST("end" AS DOUBLE) / 1000 AS "end", text FROM ({CHUNKS})""")
def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions to one file a video, and read again."""
    path = new_folder(spark, "captions")
    captions.save_captions(captions_of(spark, sf_dir, captions.part_of("doc_id")), path, "vtt", spread=True, dealt=True)
    found = captions.read_files(spark, path)
    return found.select(F.regexp_extract("path", r"([0-9]+)\.vtt$", 1).cast("bigint").alias("vid"), "index", "start", "end", "text")
