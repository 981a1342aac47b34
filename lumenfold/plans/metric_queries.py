"""Queries over metric snapshots and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import metrics, tracks
from lumenfold.plans import views as V
from lumenfold.registry import query
from lumenfold.sources import table

LATEST = f"""WITH {V.SNAPSHOTS}
SELECT clip_id, platform, captured_at, seq, views, likes FROM (
  SELECT *, row_number() OVER (PARTITION BY clip_id, platform ORDER BY captured_at DESC, seq DESC) AS rn FROM snapshots) WHERE rn = 1"""
TOTALS = f"SELECT clip_id, count(*) AS platforms, CAST(sum(views) AS BIGINT) AS views, CAST(sum(likes) AS BIGINT) AS likes FROM ({LATEST}) GROUP BY clip_id"


@query("w1_latest_snapshot", LATEST)
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_per_platform(V.snapshots(spark, sf_dir), ["views", "likes"])


@query("a1_aggregate_latest", TOTALS)
def aggregate_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.totals_per_clip(V.snapshots(spark, sf_dir), ["views", "likes"])


@query("a1_all_clips_with_zeros", f"SELECT c_custkey AS clip_id, coalesce(platforms, 0) AS platforms, coalesce(views, 0) AS views, coalesce(likes, 0) AS likes FROM customer LEFT JOIN ({TOTALS}) ON c_custkey = clip_id")
def all_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"))
    return metrics.totals_for_clips(clips, V.snapshots(spark, sf_dir), ["views", "likes"])


@query("w7_smoothed_track", f"""WITH {V.FACES} SELECT vid, t, round(avg(cx) OVER w, 6) AS cx, round(avg(cy) OVER w, 6) AS cy FROM faces WHERE conf >= 0.3
  WINDOW w AS (PARTITION BY vid ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tracks.smooth(V.faces(spark, sf_dir))
    return s.select("vid", "t", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("p13_confident_faces", f"WITH {V.FACES} SELECT vid, t, conf FROM faces WHERE conf >= 0.3")
def confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.confident(V.faces(spark, sf_dir)).select("vid", "t", "conf")


@query("a10_split_vote", f"""WITH {V.FACES}, f AS (SELECT vid, t // 5 AS t, count(*) FILTER (WHERE conf >= 0.3) >= 2 AND max(cx) FILTER (WHERE conf >= 0.3) - min(cx) FILTER (WHERE conf >= 0.3) > 0.1 AS split FROM faces GROUP BY ALL)
SELECT vid, count(*) AS frames, count(*) FILTER (WHERE split) AS split_frames, count(*) FILTER (WHERE split) > 0.5 * count(*) AS is_split FROM f GROUP BY vid""")
def split_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.split_screen(V.faces(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 5)), apart=0.1)


@query("j4_nearest_point", f"""WITH {V.FACES}, track AS (SELECT vid, t, cx, cy FROM faces WHERE conf >= 0.3),
ranked AS (SELECT f.vid, f.t, k.t AS "at", k.cx, k.cy, row_number() OVER (PARTITION BY f.vid, f.t ORDER BY abs(k.t - f.t), k.t) AS rn FROM faces f JOIN track k ON k.vid = f.vid)
SELECT vid, t, "at", cx, cy FROM ranked WHERE rn = 1""")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.faces(spark, sf_dir)
    return tracks.nearest(f.select("vid", "t"), tracks.confident(f).select("vid", "t", "cx", "cy")).where("at is not null")


@query("l7_largest_face", f"""WITH {V.FACES}, b AS (SELECT vid, t // 5 AS t, t AS seq, cx, cy, conf * 1.0 AS w FROM faces)
SELECT vid, t, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY vid, t ORDER BY w DESC, seq) AS rn FROM b) WHERE rn = 1""")
def largest_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.faces(spark, sf_dir).selectExpr("vid", "t div 5 AS t", "t AS seq", "cx", "cy", "conf AS w", "1.0D AS h")
    return tracks.largest_face(f)


@query("w8_ema_track", f"""WITH RECURSIVE {V.FACES},
s AS (SELECT vid, time AS t, CASE WHEN conf >= 0.1 THEN cx END AS cx, CASE WHEN conf >= 0.1 THEN cy END AS cy, row_number() OVER (PARTITION BY vid ORDER BY t) AS n FROM faces),
r AS (SELECT vid, t, n, cx AS v, cy AS u, cx IS NOT NULL AS keep, CASE WHEN cx IS NOT NULL THEN t END AS seen FROM s WHERE n = 1
  UNION ALL SELECT s.vid, s.t, s.n, CASE WHEN s.cx IS NULL THEN r.v WHEN r.v IS NULL THEN s.cx ELSE 0.3::DOUBLE * s.cx + (1 - 0.3::DOUBLE) * r.v END, CASE WHEN s.cx IS NULL THEN r.u WHEN r.v IS NULL THEN s.cy ELSE 0.3::DOUBLE * s.cy + (1 - 0.3::DOUBLE) * r.u END,
    s.cx IS NOT NULL OR (r.v IS NOT NULL AND s.t - r.seen <= 2.0), CASE WHEN s.cx IS NULL THEN r.seen ELSE s.t END FROM r JOIN s ON s.vid = r.vid AND s.n = r.n + 1)
SELECT vid, round(t, 4) AS t, round(v, 6) AS cx, round(u, 6) AS cy FROM r WHERE keep""")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.faces(spark, sf_dir).selectExpr("vid", "time AS t", "CASE WHEN conf >= 0.1 THEN cx END AS cx", "CASE WHEN conf >= 0.1 THEN cy END AS cy")
    return tracks.ema(f).select("vid", F.round("t", 4).alias("t"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("f23_f24_crop_boxes", f"""WITH {V.FACES} SELECT vid, t, greatest(0, least(1920 - 608, CAST(trunc(cx * 1920) AS INTEGER) - 304)) AS x1, greatest(0, least(1080 - 1080, CAST(trunc(cy * 1080) AS INTEGER) - 540)) AS y1,
  CAST(trunc(1080 * (320 / 569.0::DOUBLE)) AS INTEGER) AS thumb_w FROM faces""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.faces(spark, sf_dir).withColumn("w", F.lit(1920)).withColumn("h", F.lit(1080))
    box = tracks.crop_box("cx", "cy", 1920, 1080, 608, 1080)
    return f.select("vid", "t", box["x1"].alias("x1"), box["y1"].alias("y1"), tracks.centre_crop("w", "h")["w"].alias("thumb_w"))
