"""Metric snapshots: latest per key, then sums."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


COUNTERS = ["impressions", "views", "watch_time_seconds", "likes", "comments", "shares"]


def append_snapshots(snapshots: DataFrame, new: DataFrame, now: datetime, counters: list[str] | None = None) -> DataFrame:
    """All snapshots and the new ones: counters that a new one lacks are 0, a missing time is ``now``."""
    rows = new
    for c in counters or COUNTERS:
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(0)) if c in new.columns else F.lit(0))
    time = F.lit(now).cast(snapshots.schema["captured_at"].dataType)
    rows = rows.withColumn("captured_at", F.coalesce("captured_at", time) if "captured_at" in new.columns else time)
    return snapshots.unionByName(rows.select(*(F.col(c).cast(snapshots.schema[c].dataType) for c in snapshots.columns)))


def latest_per_platform(snapshots: DataFrame, counters: list[str]) -> DataFrame:
    """The newest snapshot of each (clip_id, platform); ``seq`` breaks ties of captured_at.

    One hash aggregate with map-side combine: no sort and no window, so a hot clip costs one row per task.
    """
    newest = F.max_by(F.struct("captured_at", "seq", *counters), F.struct("captured_at", "seq"))
    return snapshots.groupBy("clip_id", "platform").agg(newest.alias("s")).select("clip_id", "platform", "s.*")


def totals_per_clip(snapshots: DataFrame, counters: list[str]) -> DataFrame:
    """Counters summed over the latest snapshot of each platform of a clip; nulls count as 0."""
    latest = latest_per_platform(snapshots, counters)
    return latest.groupBy("clip_id").agg(
        F.count("*").alias("platforms"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters)
    )


def totals_for_clips(clips: DataFrame, snapshots: DataFrame, counters: list[str]) -> DataFrame:
    """Every clip_id of ``clips`` with its totals; clips without snapshots get zeros."""
    totals = totals_per_clip(snapshots, counters)
    joined = clips.select("clip_id").join(totals, "clip_id", "left")
    return joined.select("clip_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ["platforms", *counters]))
