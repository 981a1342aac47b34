"""Queries of caption files, footage, metadata, tokens and settings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions import transitions
from lumenfold.operators import captions, catalog, events, exports, library, metrics, segments, sentiment, timeline, words
from lumenfold.plans import views as V
from lumenfold.plans.word_queries import CHUNKS, captions_of
from lumenfold.registry import query
from lumenfold.sources import table

NOW = datetime(1997, 6, 1)
_NOW = "TIMESTAMP '1997-06-01'"


@query("s4_flat_transcripts", f"WITH {V.WORDS} SELECT vid, CAST(pos // 10 AS INTEGER) AS seg, CAST(pos % 10 AS INTEGER) AS at, word, \"start\", \"end\" FROM words")
def flat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def segment(seg: Column) -> Column:
        inner = F.transform(F.slice("words", (seg * 10 + 1).cast("int"), 10), lambda w: F.struct(w["pos"].alias("pos"), F.concat(F.lit(" "), w["word"], F.lit("  ")).alias("word"), w["start"].alias("start"), w["end"].alias("end")))
        return F.struct(seg.alias("seg"), inner.alias("words"))

    segments = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.size("words") - 1) / 10)), segment)
    return words.flatten_transcript(V.transcripts(spark, sf_dir).select("vid", segments.alias("segments")))


_INFO = """CASE p_partkey % 4 WHEN 0 THEN '{"title":"t"}' WHEN 1 THEN '{"chapters":null}' WHEN 2 THEN '{"chapters":[]}'
  ELSE '{"chapters":[{"title":"' || p_name || '","start_time":0,"end_time":' || p_size || '},{"title":"end","start_time":' || p_size || ',"end_time":' || p_size || '.5}]}' END"""
_PLATFORM = "CASE WHEN p_partkey % 5 = 0 THEN 'facebook' ELSE 'youtube' END"


@query("s6_metadata_chapters", f"""WITH v AS (SELECT p_partkey AS vid, p_name, p_size FROM part WHERE p_partkey % 4 = 3 AND p_partkey % 5 <> 0)
SELECT vid, 0 AS idx, p_name AS title, 0.0::DOUBLE AS "start", p_size::DOUBLE AS "end" FROM v UNION ALL SELECT vid, 1, 'end', p_size::DOUBLE, p_size + 0.5::DOUBLE FROM v""")
def metadata_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.metadata_chapters(table(spark, sf_dir, "part").selectExpr("p_partkey AS vid", f"{_PLATFORM} AS platform", f"{_INFO} AS info"))


_READ = f"""SELECT vid, CAST("index" AS INTEGER) AS "index", CAST("start" AS DOUBLE) / 1000 AS "start", CAST("end" AS DOUBLE) / 1000 AS "end", text FROM ({CHUNKS})"""


@query("s8_k7_read_srt", _READ)
def read_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.parse_captions(exports.caption_file(captions_of(spark, sf_dir), "srt"))


@query("s8_k7_read_vtt", _READ)
def read_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.parse_captions(exports.caption_file(captions_of(spark, sf_dir), "vtt"))


@query("f21_upper_captions", f"""SELECT vid, "index", replace(upper(text), 'ẞ', 'SS') AS text FROM ({CHUNKS})""")
def upper_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.upper_captions(words.caption_chunks(V.transcripts(spark, sf_dir), 3)).select("vid", "index", "text")


_FILES = "SELECT n_nationkey AS seq, '/lib/' || lower(n_name) || CASE WHEN n_nationkey % 4 = 0 THEN '.MP4' WHEN n_nationkey % 4 = 1 THEN '.mov' ELSE '.mp4' END AS path, lower(n_name) AS stem FROM nation"
_PHRASES = "list_transform(list_slice(regexp_extract_all(text, '[A-Z][a-z]+(?:[ \\t\\n\\f\\r]+[A-Z][a-z]+)*'), 1, 3), lambda x: lower(x))"


@query("j9_matching_footage", f"""WITH f AS (SELECT * FROM ({_FILES}) WHERE lower(path) LIKE '%.mp4'), p AS (SELECT doc_id, unnest({_PHRASES}) AS phrase, generate_subscripts({_PHRASES}, 1) AS k FROM documents),
w AS (SELECT doc_id, k, unnest(regexp_split_to_array(phrase, '[\\s_-]+')) AS word FROM p)
SELECT doc_id, path FROM (SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY k, seq) AS rn FROM w JOIN f ON contains(stem, word)) WHERE rn = 1""")
def matching_footage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS seq", "concat('/lib/', lower(n_name), CASE WHEN n_nationkey % 4 = 0 THEN '.MP4' WHEN n_nationkey % 4 = 1 THEN '.mov' ELSE '.mp4' END) AS path")
    return library.matching_footage(table(spark, sf_dir, "documents").select("doc_id", T.noun_phrases("text").alias("phrases")), files, "doc_id")


@query("l6_smallest_file", """SELECT l_orderkey AS video_id, link FROM (SELECT l_orderkey, l_linenumber AS link, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_suppkey % 4 = 0 THEN 9999 ELSE l_suppkey % 4 * 360 END, CASE WHEN l_partkey % 3 = 0 THEN 9999 ELSE l_partkey % 3 * 640 END, l_linenumber) AS rn
  FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) WHERE l_linenumber % 2 = 1) WHERE rn = 1""")
def smallest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.expr("""struct(l_linenumber AS link, CASE WHEN l_linenumber % 2 = 1 THEN 'video/mp4' ELSE 'video/webm' END AS file_type,
      CASE WHEN l_suppkey % 4 > 0 THEN cast(l_suppkey % 4 * 360 AS int) END AS height, CASE WHEN l_partkey % 3 > 0 THEN cast(l_partkey % 3 * 640 AS int) END AS width)""")
    per = V.lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(file)).alias("files"))
    return per.select(F.col("l_orderkey").alias("video_id"), library.smallest_file("files")["link"].alias("link")).where("link is not null")


@query("u8_snapshot_append", f"""WITH {V.SNAPSHOTS} SELECT clip_id, platform, captured_at, seq, views, likes FROM snapshots
UNION ALL SELECT c_custkey, 'new', {_NOW}, c_custkey, CAST(c_custkey % 7 AS BIGINT), 0 FROM customer""")
def snapshot_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshot_parts(spark, sf_dir)
    return metrics.append_snapshots(old, new, NOW, ["views", "likes"])


def snapshot_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    new = table(spark, sf_dir, "customer").selectExpr("c_custkey AS clip_id", "'new' AS platform", "c_custkey AS seq", "nullif(c_custkey % 7, 0) AS views")
    return V.snapshots(spark, sf_dir), new


@query("s9_rms_frames", """WITH s AS (SELECT vec_id AS vid, unnest(embedding)::DOUBLE AS sample, unnest(range(len(embedding))) AS pos FROM embeddings),
f AS (SELECT vid, unnest(range(max(pos + 1) // 4 + 1)) AS frame FROM s GROUP BY vid)
SELECT vid, frame, frame * 4 / 16.0::DOUBLE AS t, round(sqrt(sum(sample * sample) / 16), 6) AS rms FROM f JOIN s USING (vid) WHERE pos >= frame * 4 - 8 AND pos < frame * 4 + 8 GROUP BY vid, frame""")
def rms_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), F.posexplode("embedding").alias("pos", "sample"))
    found = segments.rms_frames(samples.withColumn("sample", F.col("sample").cast("double")), 16, hop=4, length=16)
    return found.select("vid", "frame", "t", F.round("rms", 6).alias("rms"))


_ASKED = "lower(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"


@query("s12_cached_searches", f"""WITH r AS (SELECT item_id, left(sha1({_ASKED} || '|' || (item_id % 9)), 16) AS key FROM benchmark)
SELECT item_id, key, CASE WHEN item_id % 3 = 1 AND item_id % 12 <= 7 THEN '{{"n":' || item_id || '}}' END AS body FROM r""")
def cached_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select("item_id", T.cache_key("text", F.col("item_id") % 9).alias("key"))
    body = """CASE item_id % 3 WHEN 0 THEN '{broken' ELSE concat('{"n":', item_id, '}') END"""
    cache = asked.where("item_id % 3 < 2").select("key", F.expr(f"{body} AS body"), F.expr(f"{_NOW.lower().replace('timestamp', 'timestamp_ntz')} - make_dt_interval(cast(item_id % 12 AS int)) AS cached_at"))
    return library.cached_searches(asked, cache, NOW)


@query("p12_dead_air", f"""WITH {V.CHAPTERS} SELECT vid, idx FROM chapters WHERE coalesce(CASE WHEN idx % 3 > 0 THEN (vid + idx) % 10 / 10.0 END, 1.0) >= 0.4""")
def dead_air(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.chapters(V.words(spark, sf_dir)).selectExpr("vid", "idx", "CASE WHEN idx % 3 > 0 THEN (vid + idx) % 10 / 10.0D END AS speech_ratio")
    return segments.drop_dead_air(c).select("vid", "idx")


@query("p16_token_candidates", "SELECT s_suppkey AS token_id FROM supplier WHERE s_nationkey % 5 = 2 AND s_suppkey % 4 <> 0")
def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS token_id", "concat('rs', s_nationkey % 5, '_') AS token_prefix", "s_suppkey % 4 = 0 AS revoked")
    return catalog.token_candidates(tokens, "rs2_abc_def").select("token_id")


@query("l5_newest_first", """SELECT o_orderkey AS id, o_custkey AS clip_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders""")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS clip_id", "o_orderdate AS created_at")
    return catalog.newest_first(jobs, "created_at", "id", within="clip_id").select("id", "clip_id", "place")


@query("p24_media_paths", f"""WITH {V.CLIPS} SELECT p_partkey AS clip_id, output_path AS path, CASE WHEN c.clip_id IS NULL THEN 'clip' WHEN output_path IS NULL THEN 'output_path' END AS missing FROM part LEFT JOIN clips c ON p_partkey = c.clip_id""")
def media_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.media_paths(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clip_id")), V.clips(spark, sf_dir))


_KINDS = "CASE l_partkey % 6 WHEN 0 THEN 'fade' WHEN 1 THEN 'slide-left' WHEN 2 THEN 'slide-right' WHEN 3 THEN 'zoom' WHEN 4 THEN 'spin' END"


@query("f20_cross_fades", f"""WITH {V.LINES}, f AS (SELECT l_orderkey * 10 + l_linenumber AS clip_id, {_KINDS} AS kind, (l_suppkey % 5) / 4.0::DOUBLE AS duration, l_quantity * 1.25::DOUBLE AS "offset" FROM li)
SELECT clip_id, CASE WHEN kind IS NULL OR kind = 'spin' THEN 'no such fade: ' || coalesce(kind, 'null') WHEN duration <= 0 THEN 'a fade takes time' END AS fault,
  CASE WHEN kind <> 'spin' AND duration > 0 THEN printf('[0:v][1:v]xfade=transition=%s:duration=%.3f:offset=%.3f[v]', CASE kind WHEN 'zoom' THEN 'zoomin' ELSE replace(kind, '-', '') END, duration, "offset") END AS filter FROM f""")
def cross_fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.lines(spark, sf_dir).selectExpr("l_orderkey * 10 + l_linenumber AS clip_id", f"{_KINDS} AS kind", "(l_suppkey % 5) / 4.0D AS duration", "l_quantity * 1.25D AS offset")
    return f.select("clip_id", transitions.fade_fault("kind", "duration").alias("fault"), transitions.cross_fade("kind", "duration", "offset").alias("filter"))


@query("f26_capabilities", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'business' END AS value, c_custkey % 4 < 3 AS known FROM customer""")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN 'voiceover' WHEN 1 THEN 'tier' WHEN 2 THEN 'max_brand_fonts' ELSE 'teleport' END AS name")
    return asked.select("c_custkey", F.when(T.is_capability("name"), T.capability("name")).alias("value"), T.is_capability("name").alias("known"))


@query("c2_vocabulary_edits", """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'a=1,k=' || n_name WHEN 1 THEN 'a=' || n_name WHEN 2 THEN 'a=1' ELSE '' END AS entries FROM nation""")
def vocabulary_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name", "map('a', '1') AS vocabulary", "CASE n_nationkey % 4 WHEN 0 THEN ' k ' WHEN 1 THEN ' a' ELSE '  ' END AS key")
    edited = F.when(F.col("n_nationkey") % 4 == 3, T.vocabulary_remove("vocabulary", F.lit("a"))).otherwise(T.vocabulary_add("vocabulary", "key", "n_name"))
    listed = F.array_sort(F.transform(F.map_entries(edited), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return n.select("n_nationkey", F.array_join(listed, ",").alias("entries"))


@query("c4_mode_options", """WITH o AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'chapter' ELSE 'advanced' END AS mode, o_orderkey % 2 = 0 AS short, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 5 > 2 END AS c FROM orders)
SELECT job_id, mode = 'auto' OR mode = 'chapter' OR coalesce(c, false) AS captions, mode <> 'advanced' OR short AS render, mode = 'auto' AS segment_proposer, mode <> 'advanced' AS thumbnail FROM o""")
def mode_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS job_id", "CASE o_orderkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'chapter' ELSE 'advanced' END AS mode", "o_orderkey % 2 = 0 AS short", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 5 > 2 END AS captions")
    made = T.mode_options("mode", "short", {"captions": F.col("captions")})
    return o.select("job_id", *(made[k].alias(k) for k in ("captions", "render", "segment_proposer", "thumbnail")))


@query("c8_settings", """SELECT r_regionkey, array_to_string(list_filter(list_transform(string_split(CASE WHEN r_regionkey % 2 = 0 THEN ' http://a , http://' || r_name || ',, ' ELSE '' END, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS origins,
  CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey / 10.0::DOUBLE END AS hook FROM region""")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").selectExpr("r_regionkey", "CASE WHEN r_regionkey % 2 = 0 THEN concat(' http://a , http://', r_name, ',, ') ELSE '' END AS cors", "CASE WHEN r_regionkey % 2 = 0 THEN concat('{\"hook\": ', r_regionkey / 10.0D, '}') ELSE '{}' END AS weights")
    return r.select("r_regionkey", F.array_join(T.split_list("cors"), "|").alias("origins"), T.score_weights("weights")["hook"].alias("hook"))


@query("n5_replaced_track", """SELECT c_custkey AS clip_id, 'video:' || CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'a,b' END || ';caption:' || CASE WHEN c_custkey % 3 = 1 THEN 'new' WHEN c_custkey % 2 = 0 THEN 'c' ELSE '' END || ';text-overlay:' || CASE WHEN c_custkey % 3 = 2 THEN 'new' ELSE '' END AS tracks FROM customer""")
def replaced_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS clip_id", "element_at(array('video', 'caption', 'text-overlay'), cast(c_custkey % 3 AS int) + 1) AS kind",
        """CASE WHEN c_custkey % 2 = 0 THEN array(named_struct('kind', 'caption', 'items', array('c')), named_struct('kind', 'video', 'items', array('a', 'b')), named_struct('kind', 'video', 'items', array('z')))
           ELSE array(named_struct('kind', 'video', 'items', array('a', 'b'))) END AS tracks""",
    )
    made = timeline.replace_track("tracks", "kind", F.array(F.lit("new")))
    return c.select("clip_id", F.array_join(F.transform(made, lambda t: F.concat(t["kind"], F.lit(":"), F.array_join(t["items"], ","))), ";").alias("tracks"))


@query("t5_event_order", f"""WITH {V.EVENTS} SELECT seq, CAST(row_number() OVER (PARTITION BY job_id ORDER BY seq) AS INTEGER) AS place, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS occurred_at, CASE WHEN seq % 3 = 0 THEN 'corr' || seq ELSE CAST(job_id AS VARCHAR) END AS correlation_id FROM job_events""")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.job_events(spark, sf_dir).withColumn("correlation_id", F.expr("CASE seq % 3 WHEN 0 THEN concat('corr', seq) WHEN 1 THEN '' END"))
    return events.in_order(e).select("seq", "place", "occurred_at", "correlation_id")


FLOWS = f"""{V.LEXICON},
sentences AS (SELECT doc_id, unnest(ss) AS text, generate_subscripts(ss, 1) AS nth FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x)), lambda x: length(x) > 3) AS ss FROM documents)),
{sentiment.compounds_sql("sentences", "doc_id, nth")},
strength AS (SELECT doc_id, nth, abs(compound) AS c FROM compounds)"""


@query("f10_sentiment_flow", f"WITH {FLOWS} SELECT doc_id, round(least(1.0, (var_pop(c) + abs(max_by(c, nth) - min_by(c, nth))) / 2), 9) AS emotion FROM strength GROUP BY doc_id")
def sentiment_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = segments.emotional_flows(table(spark, sf_dir, "documents").select("doc_id", "text"), V.lexicon(spark, sf_dir), ["doc_id"])
    return flows.select("doc_id", F.round("emotion", 9).alias("emotion"))
