"""Work queues: due rows, claims and the publishing state machine."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("published", "failed", "cancelled")


def _now(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def due(rows: DataFrame, now: datetime, limit: int, at: str = "schedule_at", key: str = "id") -> DataFrame:
    """Pending rows whose time has come, earliest first, at most ``limit``: a top-k, not a sort."""
    return rows.where((F.col("status") == "pending") & (F.col(at) <= _now(now))).orderBy(at, key).limit(limit)


def promote(rows: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """Chosen rows that are still pending become queued."""
    marked = rows.join(chosen.select(key).withColumn("_hit", F.lit(True)), key, "left")
    status = F.when(F.col("_hit") & (F.col("status") == "pending"), "queued").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("_hit")


def claim(rows: DataFrame, chosen: DataFrame, worker: str, now: datetime, key: str = "id") -> DataFrame:
    """Chosen rows become posting, with the worker and the time."""
    marked = rows.join(chosen.select(key).withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = marked.withColumn("status", F.when(hit, "posting").otherwise(F.col("status")))
    out = out.withColumn("worker_id", F.when(hit, worker).otherwise(F.col("worker_id")))
    return out.withColumn("locked_at", F.when(hit, _now(now)).otherwise(F.col("locked_at"))).drop("_hit")


def finish(rows: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Results(id, ok, error) into rows: published or failed, one attempt more, errors cut to 1,024. Terminal rows stay."""
    r = results.select(key, F.col("ok").alias("_ok"), F.left("error", F.lit(1024)).alias("_error"))
    marked = rows.join(r, key, "left")
    hit = F.col("_ok").isNotNull() & ~F.col("status").isin(*TERMINAL)
    out = marked.withColumn("_hit", hit)
    out = out.withColumn("status", F.when(F.col("_hit"), F.when(F.col("_ok"), "published").otherwise("failed")).otherwise(F.col("status")))
    out = out.withColumn("attempts", F.col("attempts") + F.col("_hit").cast("int"))
    return out.withColumn("last_error", F.when(F.col("_hit") & ~F.col("_ok"), F.col("_error")).otherwise(F.col("last_error"))).drop("_ok", "_error", "_hit")


def publish_fields(jobs: DataFrame, clips: DataFrame, accounts: DataFrame) -> DataFrame:
    """What is sent for each publish job: its own title and tags if filled, else the clip's.

    Jobs whose clip or account is missing aren't sent; those ids are ``missing_references``.
    """
    c = clips.select("clip_id", F.col("title").alias("_title"), F.col("hashtags").alias("_tags"))
    joined = jobs.join(accounts.select("account_id", "platform"), "account_id").join(c, "clip_id")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("_title", F.lit("")), F.lit(""))
    tags = F.when(F.size("hashtags") > 0, F.col("hashtags")).otherwise(F.coalesce("_tags", F.expr("cast(array() as array<string>)")))
    return joined.select("id", "platform", title.alias("title"), tags.alias("hashtags"))


def missing_references(jobs: DataFrame, clips: DataFrame, accounts: DataFrame) -> DataFrame:
    without_clip = jobs.join(clips, "clip_id", "left_anti").select("id", F.lit("clip").alias("missing"))
    return without_clip.union(jobs.join(accounts, "account_id", "left_anti").select("id", F.lit("account").alias("missing")))


def delivery(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Outcome of webhook attempts(delivery_id, attempt, status): the first below 500 settles it, within ``most``.

    A null status is a network failure and is tried again like a 5xx.
    """
    a = attempts.where(F.col("attempt") <= most)
    settles = F.col("status") < 500
    per = a.groupBy("delivery_id").agg(F.min(F.when(settles, F.struct("attempt", "status"))).alias("s"), F.max("attempt").alias("tried"))
    ok = F.coalesce(F.col("s.status").between(200, 299), F.lit(False))
    return per.select("delivery_id", F.coalesce("s.attempt", "tried").alias("attempts"), ok.alias("delivered"))
