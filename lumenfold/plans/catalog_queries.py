"""Queries over jobs and clips: catalog, queues, exports and timelines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import constants as C
from lumenfold.functions import text as T
from lumenfold.operators import catalog, exports, queue, timeline
from lumenfold.plans import views as V
from lumenfold.registry import query
from lumenfold.sources import table

NOW = datetime(1997, 1, 1)
_NOW = "TIMESTAMP '1997-01-01'"


@query("s1_job_by_key", f"WITH {V.JOBS} SELECT * FROM jobs WHERE job_id = 7")
def job_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.by_key(V.jobs(spark, sf_dir), "job_id", 7)


@query("s2_all_ids", f"WITH {V.JOBS} SELECT job_id FROM jobs")
def all_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jobs(spark, sf_dir).select("job_id")


@query("s3_j8_jobs_with_clips", f"""WITH {V.JOBS}, {V.CLIPS},
per AS (SELECT job_id, string_agg(clip_id || ':' || title, ',' ORDER BY clip_id) AS clips, string_agg(output_path, ',' ORDER BY clip_id) FILTER (WHERE NOT retired AND output_path IS NOT NULL) AS paths FROM clips GROUP BY job_id)
SELECT job_id, status, coalesce(clips, '') AS clips, coalesce(paths, '') AS paths FROM jobs LEFT JOIN per USING (job_id)""")
def jobs_with_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = catalog.with_clips(V.jobs(spark, sf_dir), V.clips(spark, sf_dir))
    listed = F.array_join(F.transform("clips", lambda c: F.concat_ws(":", c["clip_id"], c["title"])), ",")
    return j.select("job_id", "status", F.coalesce(listed, F.lit("")).alias("clips"), F.coalesce(F.array_join("output_paths", ","), F.lit("")).alias("paths"))


@query("p1_list_clips", f"WITH {V.CLIPS} SELECT clip_id, score, title FROM clips WHERE NOT retired AND score >= 50 AND title ILIKE '%clip a%'")
def list_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_clips(V.clips(spark, sf_dir), min_score=50, search="clip a").select("clip_id", "score", "title")


@query("p2_list_clips_lenient", f"WITH {V.CLIPS} SELECT clip_id, score, title FROM clips WHERE coalesce(score, 0) >= 0 AND contains(lower(title), 'clip n')")
def list_clips_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_clips_lenient(V.clips(spark, sf_dir), min_score=0, search="Clip N").select("clip_id", "score", "title")


@query("p4_dashboard_filter", f"""WITH {V.CLIPS}, spoken AS (SELECT clips.*, text AS transcript FROM clips LEFT JOIN documents ON doc_id = clip_id % 400)
SELECT clip_id, title, 'liked' AS kind FROM spoken WHERE (contains(lower(title), 'rf') OR contains(lower(coalesce(transcript, '')), 'rf')) AND liked AND "end" - "start" BETWEEN 60 AND 90
UNION ALL SELECT clip_id, title, 'disliked' FROM spoken WHERE (contains(lower(title), 'rf') OR contains(lower(coalesce(transcript, '')), 'rf')) AND disliked""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("of"), F.col("text").alias("transcript"))
    c = V.clips(spark, sf_dir).withColumn("of", F.col("clip_id") % 400).join(spoken, "of", "left")
    liked, disliked = catalog.dashboard(c, "RF", liked=True, short=True), catalog.dashboard(c, "RF", disliked=True)
    return liked.select("clip_id", "title", F.lit("liked").alias("kind")).union(disliked.select("clip_id", "title", F.lit("disliked")))


@query("p5_reusable_job", f"""WITH {V.JOBS}, newest AS (SELECT * FROM jobs ORDER BY created_at DESC, job_id LIMIT 200)
SELECT job_id, url, status FROM newest WHERE url = 'https://www.youtube.com/watch?v=abcdefghij0' AND status IN ('completed', 'running', 'pending') ORDER BY created_at DESC, job_id LIMIT 1""")
def reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reusable_job(V.jobs(spark, sf_dir), "https://www.youtube.com/watch?v=abcdefghij0").select("job_id", "url", "status")


@query("p3_l1_jobs_page", f"WITH {V.JOBS} SELECT job_id, created_at FROM jobs WHERE url ILIKE '%tiktok%' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40")
def jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_jobs(V.jobs(spark, sf_dir), 20, 40, "tiktok").select("job_id", "created_at")


@query("p25_status_counts", f"WITH {V.JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("a2_dashboard_totals", f"WITH {V.CLIPS} SELECT count(*) AS clips, count(*) FILTER (WHERE liked) AS liked, CAST(floor(avg(coalesce(score, 0)) + 0.5) AS BIGINT) AS mean_score FROM clips")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.totals(V.clips(spark, sf_dir))


@query("a3_total_outputs", f"WITH {V.CLIPS} SELECT count(*) AS clips FROM clips WHERE NOT retired AND output_path IS NOT NULL")
def total_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.total_outputs(catalog.with_clips(V.jobs(spark, sf_dir), V.clips(spark, sf_dir)))


@query("f12_f13_grades_times", f"""WITH {V.CLIPS} SELECT clip_id, CASE WHEN score IS NULL THEN '—' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'A-' WHEN score >= 70 THEN 'B+' WHEN score >= 60 THEN 'B' WHEN score >= 50 THEN 'B-' ELSE 'C+' END AS grade,
  printf('%d:%02d', CAST("end" AS BIGINT) // 60, CAST("end" AS BIGINT) % 60) AS short, printf('%d:%02d:%02d', bytes // 3600, bytes % 3600 // 60, bytes % 60) AS long FROM clips""")
def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.clips(spark, sf_dir).select("clip_id", T.grade("score").alias("grade"), T.minutes_seconds("end").alias("short"), T.hours_minutes_seconds("bytes").alias("long"))


@query("u1_u2_upsert_latest", f"""WITH {V.CLIPS}, changes AS (SELECT clip_id, job_id, 'new ' || clip_id AS title, 99 AS score, bytes FROM clips WHERE clip_id % 3 = 0 UNION ALL SELECT clip_id + 5, job_id, 'added', 1, bytes FROM clips WHERE clip_id % 50 = 1),
turns AS (SELECT clip_id, title, score, 0 AS new, CAST(NULL AS BIGINT) AS bytes FROM clips UNION ALL SELECT clip_id, title, score, 1, bytes FROM changes)
SELECT clip_id, title, score FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY new DESC, bytes DESC NULLS LAST, title DESC) AS rn FROM turns) WHERE rn = 1""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upsert(*clip_changes(spark, sf_dir), ["clip_id"], "turn")


def clip_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clips, and new rows for some of them and for some that aren't there yet."""
    c = V.clips(spark, sf_dir)
    changed = c.where("clip_id % 3 = 0").select("clip_id", F.concat(F.lit("new "), F.col("clip_id").cast("string")).alias("title"), F.lit(99).alias("score"), "bytes")
    added = c.where("clip_id % 50 = 1").select((F.col("clip_id") + 5).alias("clip_id"), F.lit("added").alias("title"), F.lit(1).alias("score"), "bytes")
    return c.select("clip_id", "title", "score"), changed.union(added).withColumn("turn", F.struct("bytes", "title"))


@query("u3_versioned_edits", f"""WITH {V.CLIPS} SELECT clip_id, CASE WHEN clip_id % 3 <> 0 AND clip_id % 2 = 0 AND job_id % 4 <> clip_id % 5 THEN 'conflict' ELSE 'accepted' END AS outcome,
  CAST(CASE WHEN clip_id % 3 <> 0 AND clip_id % 2 = 0 AND job_id % 4 <> clip_id % 5 THEN clip_id % 5 WHEN clip_id % 3 = 0 THEN 1 ELSE clip_id % 5 + 1 END AS BIGINT) AS version FROM clips""")
def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.clips(spark, sf_dir)
    stored = c.where("clip_id % 3 <> 0").selectExpr("clip_id", "clip_id % 5 AS version")
    return catalog.apply_edits(stored, c.selectExpr("clip_id", "CASE WHEN clip_id % 2 = 0 THEN job_id % 4 END AS version"))


@query("j7_clips_without_edit", f"WITH {V.CLIPS} SELECT clip_id FROM clips WHERE clip_id % 3 = 0")
def without_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.clips(spark, sf_dir).select("clip_id")
    return c.join(c.where("clip_id % 3 <> 0"), "clip_id", "left_anti")


@query("u4_t9_retention", f"WITH {V.CLIPS} SELECT clip_id, retired OR created_at < {_NOW} - INTERVAL 30 DAY AS retired, NOT retired AND created_at < {_NOW} - INTERVAL 30 DAY AS newly FROM clips")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.retire(V.clips(spark, sf_dir), NOW).select("clip_id", "retired", "newly")


@query("u10_cascade_delete", f"WITH {V.CLIPS} SELECT clip_id, job_id FROM clips WHERE job_id % 10 <> 3")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = V.jobs(spark, sf_dir).where("job_id % 10 = 3")
    return catalog.cascade_delete(V.clips(spark, sf_dir), gone, "job_id").select("clip_id", "job_id")


@query("u11_partial_update", f"WITH {V.JOBS} SELECT job_id, url, CASE WHEN job_id % 2 = 0 THEN 'patched' ELSE status END AS status FROM jobs")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = V.jobs(spark, sf_dir).select("job_id", "url", "status")
    return catalog.partial_update(j, j.selectExpr("job_id", "CASE WHEN job_id % 2 = 0 THEN 'patched' END AS status"), "job_id")


_ASKED = f"""asked AS (SELECT job_id, CASE job_id % 7 WHEN 0 THEN '0-1m' WHEN 1 THEN '3-5m' WHEN 2 THEN 'long' END AS length_range, CASE job_id % 7 WHEN 3 THEN 90 WHEN 4 THEN 50 WHEN 6 THEN 4000 END AS low, CASE job_id % 7 WHEN 3 THEN 30 WHEN 4 THEN 70 END AS high,
  CASE WHEN job_id % 3 = 0 THEN 'again ' || job_id END AS prompt FROM jobs)"""
_FIXED = ",".join(f"{k}={'true' if k == 'segment_proposer' else 'false'}" for k in sorted(C.OPTIONS))


@query("u9_reprompt_options", f"""WITH {V.JOBS}, {_ASKED} SELECT job_id, CASE job_id % 7 WHEN 2 THEN 'unknown length range: long' WHEN 3 THEN 'length_min_seconds must be <= length_max_seconds' WHEN 6 THEN 'length_min_seconds must be between 0 and 3600' END AS error,
  CASE WHEN job_id % 7 NOT IN (2, 3, 6) THEN coalesce(prompt, 'first') ELSE 'first' END AS prompt, CASE WHEN job_id % 7 NOT IN (2, 3, 6) THEN 'pending' ELSE jobs.status END AS status,
  CASE WHEN job_id % 7 IN (2, 3, 6) THEN 'captions=true,theme=dark' ELSE replace('{_FIXED}', ',thumbnail', CASE job_id % 7 WHEN 0 THEN ',target_length_max_seconds=60,target_length_min_seconds=0' WHEN 1 THEN ',target_length_max_seconds=300,target_length_min_seconds=180' WHEN 4 THEN ',target_length_max_seconds=70,target_length_min_seconds=50' ELSE '' END || ',theme=dark,thumbnail') END AS options
  FROM jobs JOIN asked USING (job_id)""")
def reprompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.jobs(spark, sf_dir).select("job_id", "status", F.lit("first").alias("prompt"), F.create_map(F.lit("captions"), F.lit("true"), F.lit("theme"), F.lit("dark")).alias("options"))
    asked = jobs.selectExpr(
        "job_id", "CASE job_id % 7 WHEN 0 THEN '0-1m' WHEN 1 THEN '3-5m' WHEN 2 THEN 'long' END AS length_range", "CASE job_id % 7 WHEN 3 THEN 90 WHEN 4 THEN 50 WHEN 6 THEN 4000 END AS low",
        "CASE job_id % 7 WHEN 3 THEN 30 WHEN 4 THEN 70 END AS high", "CASE WHEN job_id % 3 = 0 THEN concat('again ', job_id) END AS prompt",
    )
    found = catalog.reprompt(jobs, asked)
    entries = F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("job_id", "error", "prompt", "status", F.array_join(entries, ",").alias("options"))


@query("a18_like_toggles", f"""WITH RECURSIVE {V.SNAPSHOTS}, c AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY seq) AS n, likes % 2 = 0 AS is_like FROM snapshots),
r AS (SELECT clip_id, n, is_like AS liked, NOT is_like AS disliked FROM c WHERE n = 1 UNION ALL
  SELECT c.clip_id, c.n, c.is_like AND NOT r.liked, NOT c.is_like AND NOT r.disliked FROM r JOIN c ON c.clip_id = r.clip_id AND c.n = r.n + 1)
SELECT clip_id, arg_max(liked, n) AS liked, arg_max(disliked, n) AS disliked FROM r GROUP BY clip_id""")
def like_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = V.snapshots(spark, sf_dir).selectExpr("clip_id", "seq", "CASE WHEN likes % 2 = 0 THEN 'like' ELSE 'dislike' END AS kind")
    return catalog.toggles(clicks)


_POSTS = f"posts AS (SELECT job_id AS id, created_at AS schedule_at, CASE WHEN job_id % 5 = 0 THEN 'published' ELSE 'pending' END AS status FROM jobs)"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jobs(spark, sf_dir).selectExpr("job_id AS id", "created_at AS schedule_at", "CASE WHEN job_id % 5 = 0 THEN 'published' ELSE 'pending' END AS status")


_DUE = f"due AS (SELECT * FROM posts WHERE status = 'pending' AND schedule_at <= {_NOW} ORDER BY schedule_at, id LIMIT 50)"


@query("l2_l3_due_jobs", f"WITH {V.JOBS}, {_POSTS}, {_DUE} SELECT * FROM due")
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.due(posts(spark, sf_dir), NOW, 50)


@query("u5_promoted", f"WITH {V.JOBS}, {_POSTS}, {_DUE} SELECT id, schedule_at, CASE WHEN id IN (SELECT id FROM due) THEN 'queued' ELSE status END AS status FROM posts")
def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return queue.promote(p, queue.due(p, NOW, 50))


@query("u6_u7_claim_and_finish", f"""WITH {V.JOBS}, {_POSTS}, {_DUE} SELECT id, CASE WHEN id IN (SELECT id FROM due) THEN CASE WHEN id % 2 = 0 THEN 'published' ELSE 'failed' END ELSE status END AS status,
  CASE WHEN id IN (SELECT id FROM due) THEN 'w1' END AS worker_id, CASE WHEN id IN (SELECT id FROM due) THEN 1 ELSE 0 END AS attempts, CASE WHEN id % 2 = 1 AND id IN (SELECT id FROM due) THEN repeat('x', 1024) END AS last_error FROM posts""")
def claim_and_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).selectExpr("*", "cast(NULL AS string) AS worker_id", "cast(NULL AS timestamp_ntz) AS locked_at", "0 AS attempts", "cast(NULL AS string) AS last_error")
    chosen = queue.due(p, NOW, 50)
    results = chosen.selectExpr("id", "id % 2 = 0 AS ok", "repeat('x', 2000) AS error")
    return queue.finish(queue.claim(p, chosen, "w1", NOW), results).select("id", "status", "worker_id", "attempts", "last_error")


_PUBLISH = "publish AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + l_linenumber AS clip_id, l_suppkey AS account_id, CASE WHEN l_partkey % 3 = 0 THEN '' WHEN l_partkey % 3 = 1 THEN NULL ELSE 'own ' || l_partkey END AS title FROM li)"


@query("j5_p23_publish_fields", f"""WITH {V.CLIPS}, {_PUBLISH} SELECT p.id, n_name AS platform, coalesce(nullif(p.title, ''), nullif(c.title, ''), '') AS title, coalesce(array_to_string(c.hashtags, ','), '') AS hashtags
  FROM publish p JOIN clips c USING (clip_id) JOIN supplier ON s_suppkey = account_id JOIN nation ON n_nationkey = s_nationkey WHERE NOT c.retired""")
def publish_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.lines(spark, sf_dir).selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "l_orderkey * 10 + l_linenumber AS clip_id", "l_suppkey AS account_id",
        "CASE WHEN l_partkey % 3 = 0 THEN '' WHEN l_partkey % 3 = 1 THEN NULL ELSE concat('own ', l_partkey) END AS title", "cast(NULL AS array<string>) AS hashtags",
    )
    accounts = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("account_id"), F.col("n_name").alias("platform"))
    found = queue.publish_fields(p, V.clips(spark, sf_dir).where("NOT retired"), accounts)
    return found.withColumn("hashtags", F.array_join("hashtags", ","))


@query("j6_missing_references", f"WITH {V.CLIPS}, {_PUBLISH} SELECT id, 'clip' AS missing FROM publish WHERE clip_id IN (SELECT clip_id FROM clips WHERE retired) UNION ALL SELECT id, 'account' FROM publish WHERE account_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.lines(spark, sf_dir).selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_orderkey * 10 + l_linenumber AS clip_id", "l_suppkey AS account_id")
    accounts = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("account_id"))
    return queue.missing_references(p, V.clips(spark, sf_dir).where("NOT retired").select("clip_id"), accounts)


@query("k13_webhook_delivery", f"""WITH {V.LINES}, a AS (SELECT l_orderkey AS delivery_id, l_linenumber AS attempt, CASE l_suppkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 END AS status FROM li WHERE l_linenumber <= 3),
s AS (SELECT delivery_id, min(attempt) FILTER (WHERE status < 500) AS settled, max(attempt) AS tried FROM a GROUP BY delivery_id)
SELECT s.delivery_id, coalesce(settled, tried) AS attempts, coalesce(a.status BETWEEN 200 AND 299, false) AS delivered FROM s LEFT JOIN a ON a.delivery_id = s.delivery_id AND a.attempt = settled""")
def webhook_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.lines(spark, sf_dir).selectExpr("l_orderkey AS delivery_id", "l_linenumber AS attempt", "CASE l_suppkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 END AS status")
    return queue.delivery(a)


@query("p14_webhook_match", """SELECT s_suppkey AS webhook_id FROM supplier WHERE s_suppkey % 3 <> 0 AND (s_suppkey % 2 = 0 OR s_suppkey % 5 = 0)""")
def webhook_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS webhook_id", "s_suppkey % 3 <> 0 AS active", "CASE WHEN s_suppkey % 2 = 0 THEN array('*') WHEN s_suppkey % 5 = 0 THEN array('clip.published', 'x') ELSE array('job.failed') END AS events")
    return catalog.subscribed(w, "clip.published").select("webhook_id")


@query("p22_live_links", f"WITH {V.JOBS} SELECT job_id FROM jobs WHERE job_id % 4 > 1 AND created_at >= {_NOW}")
def live_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = V.jobs(spark, sf_dir).selectExpr("job_id", "created_at AS expires_at", "CASE WHEN job_id % 4 = 0 THEN true WHEN job_id % 4 > 1 THEN false END AS revoked")
    return catalog.live_links(links, F.lit(NOW).cast("timestamp_ntz")).select("job_id")


@query("k1_manifest", f"""WITH {V.CLIPS} SELECT CASE WHEN output_path IS NULL THEN '' ELSE clip_id || '.mp4' END AS filename, title, "end" - "start" AS duration_seconds, round(bytes / 1048576, 2) AS file_size_mb, '' AS description,
  CASE WHEN hashtags IS NULL THEN '[]' ELSE '["' || hashtags[1] || '","' || hashtags[2] || '"]' END AS hashtags, coalesce(output_path, '') AS export_path, '' AS thumbnail_path, CAST(job_id AS VARCHAR) AS job_id FROM clips""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.clips(spark, sf_dir).withColumn("export_path", F.col("output_path")).withColumn("summary", F.lit(None).cast("string")).withColumn("thumbnail_path", F.lit(None).cast("string"))
    return exports.manifest(c)


@query("k2_k3_bulk_manifest", f"""WITH {V.CLIPS} SELECT clip_id, title, '' AS summary, coalesce(output_path, '') AS output_path, coalesce(score, 0) AS score, coalesce(array_to_string(hashtags, ','), '') AS hashtags FROM clips WHERE clip_id IN (11, 12, 13, 21, 22, 31, 71, 72)""")
def bulk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.bulk_manifest(V.clips(spark, sf_dir).withColumn("summary", F.lit(None).cast("string")), [11, 12, 13, 21, 22, 31, 71, 72])


@query("k4_export_copies", f"WITH {V.CLIPS} SELECT output_path AS source, '/export/' || clip_id || '.mp4' AS target FROM clips WHERE output_path IS NOT NULL")
def export_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.copies(V.clips(spark, sf_dir), "/export")


@query("k5_export_paths", f"WITH {V.CLIPS} SELECT clip_id, CASE WHEN output_path IS NOT NULL AND clip_id % 2 = 0 THEN '/done/x/' || clip_id || '.mov' ELSE '' END AS export_path FROM clips")
def export_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.clips(spark, sf_dir).select("clip_id", "output_path")
    done = c.where("output_path IS NOT NULL AND clip_id % 2 = 0").select(F.concat(F.lit("/done/x/"), F.col("clip_id").cast("string"), F.lit(".mov")).alias("path"))
    return exports.export_paths(c, done).select("clip_id", "export_path")


@query("k9_sequence_frames", f"""WITH {V.CLIPS} SELECT clip_id, CAST(round_even(greatest(0.0, "end" - "start") * 29, 0) AS BIGINT) AS frames FROM clips""")
def sequence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.clips(spark, sf_dir).select("clip_id", exports.frame_count("start", "end", 29).alias("frames"))


@query("k9_sequence_xml", f"""WITH {V.CLIPS}, n AS (SELECT clip_id, CAST(CAST(round_even(greatest(0.0, "end" - "start") * 30, 0) AS BIGINT) AS VARCHAR) AS n, title, coalesce(output_path, '') AS p, CASE WHEN output_path IS NULL THEN '' ELSE clip_id || '.mp4' END AS f FROM clips)
SELECT clip_id, '<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE xmeml><xmeml version="5"><sequence id="' || clip_id || '"><name>' || title || '</name><duration>' || n || '</duration><rate><timebase>30</timebase><ntsc>FALSE</ntsc></rate><media><video><track><clipitem><name>' || title
  || '</name><start>0</start><end>' || n || '</end><in>0</in><out>' || n || '</out><file><name>' || f || '</name><pathurl>file://' || p || '</pathurl></file></clipitem></track></video></media></sequence></xmeml>' AS xml, NULL AS error FROM n WHERE p <> '' UNION ALL SELECT clip_id, NULL, 'clip ' || clip_id || ' has no output_path; render first' FROM n WHERE p = ''""")
def sequence_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.sequence_xml(V.clips(spark, sf_dir))


@query("k9_timeline_xml", f"""WITH {V.CLIPS}, n AS (SELECT clip_id, CAST(greatest(0.0, "end" - "start") AS VARCHAR) || 's' AS d, title AS t, output_path AS p FROM clips)
SELECT clip_id, '<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE fcpxml><fcpxml version="1.10"><resources><format id="r1" name="FFVideoFormat1080p30" frameDuration="1/30s" width="1080" height="1920"/><asset id="r2" name="' || t || '" duration="' || d
  || '" hasVideo="1" hasAudio="1" format="r1"><media-rep kind="original-media" src="file://' || p || '"/></asset></resources><library><event name="Clip Export"><project name="' || t || '"><sequence format="r1" duration="' || d
  || '"><spine><asset-clip ref="r2" offset="0s" name="' || t || '" duration="' || d || '"/></spine></sequence></project></event></library></fcpxml>' AS xml,
  CASE WHEN p IS NULL THEN 'clip ' || clip_id || ' has no output_path; render first' END AS error FROM n""")
def timeline_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.timeline_xml(V.clips(spark, sf_dir))


@query("k10_publish_descriptor", f"""WITH {V.CLIPS} SELECT clip_id AS id, '{{"id":' || clip_id || ',"platform":"youtube","title":"' || title || '","hashtags":["a"]}}' AS value FROM clips""")
def publish_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.publish_descriptor(V.clips(spark, sf_dir).selectExpr("clip_id AS id", "'youtube' AS platform", "title", "array('a') AS hashtags"))


_LINE = """CASE l_partkey % 4 WHEN 0 THEN '{"tracks":[{"kind":"video","items":[{"start":0,"end":' || l_linenumber || '}]},{"kind":"text-overlay","items":[{"start":1,"end":2.5,"text":"hi"},{"start":4,"end":3,"text":"bad"}]}]}'
  WHEN 1 THEN '{"tracks":[{"kind":"caption","items":[{"start":"0.5","end":"4","style":"bold"}]}]}' WHEN 2 THEN '{"tracks":[{"kind":"sticker","items":[{"start":0,"end":1}]},{"kind":"video","items":[{"start":"x","end":2,"src":"/a.mp4","trim_start":1.5}]}]}' ELSE '{"version":1}' END"""
TIMELINES = f"{V.LINES}, timelines AS (SELECT l_orderkey * 10 + l_linenumber AS clip_id, {_LINE} AS timeline FROM li)"


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lines(spark, sf_dir).selectExpr("l_orderkey * 10 + l_linenumber AS clip_id", f"{_LINE} AS timeline", "'base.mp4' AS base_path")


_TYPED = f"""{TIMELINES}, tracks AS (SELECT clip_id, unnest(from_json(json_extract(timeline, '$.tracks'), '["json"]')) AS t, generate_subscripts(from_json(json_extract(timeline, '$.tracks'), '["json"]'), 1) - 1 AS track FROM timelines),
it AS (SELECT clip_id, track, json_extract_string(t, '$.kind') AS kind, unnest(from_json(json_extract(t, '$.items'), '["json"]')) AS i, generate_subscripts(from_json(json_extract(t, '$.items'), '["json"]'), 1) - 1 AS idx FROM tracks),
typed AS (SELECT clip_id, CAST(track AS INTEGER) AS track, kind, CAST(idx AS INTEGER) AS idx, TRY_CAST(coalesce(json_extract_string(i, '$.start'), '0') AS DOUBLE) AS "start", TRY_CAST(coalesce(json_extract_string(i, '$.end'), '0') AS DOUBLE) AS "end",
  CASE WHEN kind = 'video' THEN coalesce(json_extract_string(i, '$.src'), 'base.mp4') END AS src, CASE WHEN kind = 'video' THEN coalesce(TRY_CAST(json_extract_string(i, '$.trim_start') AS DOUBLE), 0) END AS trim_start,
  CASE WHEN kind <> 'video' THEN coalesce(json_extract_string(i, '$.text'), '') END AS text, CASE WHEN kind = 'caption' THEN coalesce(json_extract_string(i, '$.style'), 'default') END AS style,
  CASE WHEN kind = 'text-overlay' THEN 0.5::DOUBLE END AS x, CASE WHEN kind = 'text-overlay' THEN 0.1::DOUBLE END AS y, CASE WHEN kind = 'text-overlay' THEN 36 END AS font_size, CASE WHEN kind = 'text-overlay' THEN '#ffffff' END AS color FROM it),
checked AS (SELECT *, CASE WHEN kind NOT IN ('video', 'caption', 'text-overlay') THEN 'unknown track kind: ' || kind WHEN "start" IS NULL OR "end" IS NULL THEN kind || '[' || idx || ']: expected number' WHEN "end" <= "start" THEN kind || '[' || idx || ']: end must be > start' END AS error FROM typed)"""


@query("n1_n2_n3_timeline_items", f"WITH {_TYPED} SELECT * FROM checked")
def timeline_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.items(timelines(spark, sf_dir))


@query("n2_structural_errors", f"WITH {TIMELINES} SELECT clip_id, 'timeline missing ''tracks'' key' AS error FROM timelines WHERE json_extract(timeline, '$.tracks') IS NULL")
def structural_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.structural_errors(timelines(spark, sf_dir))


@query("a14_plan_duration", f"""WITH {_TYPED} SELECT clip_id, coalesce(max("end"), 0.0) AS duration, count(*) AS items, count(error) AS errors FROM checked GROUP BY clip_id""")
def plan_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.plan_durations(timeline.items(timelines(spark, sf_dir)))


@query("n5_filled_kinds", f"""WITH {_TYPED} SELECT c.clip_id, k.kind, (SELECT count(*) FROM checked x WHERE x.clip_id = c.clip_id AND x.kind = k.kind) AS items FROM (SELECT DISTINCT clip_id FROM checked) c, (SELECT unnest(['video', 'caption', 'text-overlay']) AS kind) k""")
def filled_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.fill_kinds(timeline.items(timelines(spark, sf_dir)))
