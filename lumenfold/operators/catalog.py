"""Catalog of jobs and clips: filters, pages, upserts, retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import constants as C
from lumenfold.functions import text
from lumenfold.sources import dealt


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """One row by key; the filter reaches the Parquet scan."""
    return rows.where(F.col(key) == value)


def list_clips(clips: DataFrame, job_id=None, min_score: int | None = None, search: str | None = None) -> DataFrame:
    """Clips that aren't retired; each filter is optional. A null score fails ``min_score``; % and _ in ``search`` are wildcards."""
    out = clips.where(~F.col("retired"))
    if job_id is not None:
        out = out.where(F.col("job_id") == job_id)
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    return out if not search else out.where(F.col("title").ilike(f"%{search}%"))


def list_clips_lenient(clips: DataFrame, job_id=None, min_score: int | None = None, search: str | None = None) -> DataFrame:
    """The variant that keeps retired clips, takes a null score as 0, and searches literally."""
    out = clips
    if job_id is not None:
        out = out.where(F.col("job_id") == job_id)
    if min_score is not None:
        out = out.where(F.coalesce("score", F.lit(0)) >= min_score)
    return out if not search else out.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.lit(search))))


def list_jobs(jobs: DataFrame, limit: int = 20, offset: int = 0, search: str | None = None) -> DataFrame:
    """Newest first, a page of them: a bounded top-k in every task, no global sort."""
    found = jobs if not search else jobs.where(F.col("url").ilike(f"%{search}%"))
    return found.orderBy(F.desc("created_at"), "job_id").offset(offset).limit(limit)


def dashboard(clips: DataFrame, search: str = "", liked: bool = False, disliked: bool = False, short: bool = False) -> DataFrame:
    """The dashboard's filter: text in title or transcript, and switches; short is 60 to 90 seconds."""
    out = clips
    if search:
        q = search.lower()
        out = out.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(q)) | F.contains(F.lower(F.coalesce("transcript", F.lit(""))), F.lit(q)))
    if liked:
        out = out.where("liked")
    if disliked:
        out = out.where("disliked")
    return out.where(F.col("end") - F.col("start") >= 60).where(F.col("end") - F.col("start") <= 90) if short else out


def reusable_job(jobs: DataFrame, url: str, look_back: int = 200) -> DataFrame:
    """The newest job of this URL that is completed, running or pending, among the newest ``look_back``."""
    newest = jobs.orderBy(F.desc("created_at"), "job_id").limit(look_back)
    return newest.where((F.col("url") == url) & F.col("status").isin("completed", "running", "pending")).orderBy(F.desc("created_at"), "job_id").limit(1)


def totals(clips: DataFrame) -> DataFrame:
    """Count, liked, and the mean score (null counts 0) rounded half up; an empty catalog gives zeros."""
    mean = F.floor(F.avg(F.coalesce("score", F.lit(0))) + 0.5)
    return clips.agg(F.count("*").alias("clips"), F.count_if(F.coalesce("liked", F.lit(False))).alias("liked"), F.coalesce(mean, F.lit(0)).cast("bigint").alias("mean_score"))


def total_outputs(jobs: DataFrame, paths: str = "output_paths") -> DataFrame:
    return jobs.agg(F.coalesce(F.sum(F.coalesce(F.size(paths), F.lit(0))), F.lit(0)).cast("bigint").alias("clips"))


def with_clips(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """Each job with its clips in order and the paths of those that have one and aren't retired."""
    item = F.struct("clip_id", "start", "end", "title")
    path = F.when(F.col("output_path").isNotNull() & ~F.col("retired"), F.struct("clip_id", "output_path"))
    per = clips.groupBy("job_id").agg(F.sort_array(F.collect_list(item)).alias("clips"), F.transform(F.sort_array(F.collect_list(path)), lambda x: x["output_path"]).alias("output_paths"))
    return jobs.join(per, "job_id", "left")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` with ``changes`` over it: the row of a key that is last by ``order`` wins.

    One aggregate over both, dealt out by key first, so that rows are sorted once, in small parts; write the result to a new path.
    """
    rest = [c for c in current.columns if c not in keys]
    now = current.select(*keys, F.struct(F.lit(0).alias("new"), F.lit(None).cast(changes.schema[order].dataType).alias("at")).alias("turn"), F.struct(*rest).alias("row"))
    new = changes.select(*keys, F.struct(F.lit(1).alias("new"), F.col(order).alias("at")).alias("turn"), F.struct(*rest).alias("row"))
    return dealt(now.unionByName(new), *keys).groupBy(*keys).agg(F.max_by("row", "turn").alias("row")).select(*keys, "row.*")


def apply_edits(edits: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request's outcome against the stored version: accepted with version + 1, or a conflict.

    A request without a version overwrites; an edit that isn't stored yet gets version 1.
    """
    joined = requests.join(edits.select("clip_id", F.col("version").alias("stored")), "clip_id", "left")
    clash = F.col("stored").isNotNull() & F.col("version").isNotNull() & (F.col("version") != F.col("stored"))
    return joined.select("clip_id", F.when(clash, "conflict").otherwise("accepted").alias("outcome"), F.when(clash, F.col("stored")).otherwise(F.coalesce(F.col("stored") + 1, F.lit(1))).alias("version"))


def fold_edits(edits: DataFrame, requests: DataFrame) -> DataFrame:
    """(clip_id, version, body, outcomes) of edits(clip_id, version, ...) after requests(clip_id, seq, version, ...), one after the other.

    A request whose version is null or the stored one is accepted and adds 1; another one is a conflict and changes nothing; the first
    edit of a clip gets version 1 whatever it asks for. ``body`` are the columns beside clip_id and version; ``outcomes``
    holds (seq, outcome, version) in order, and is null for clips without requests.
    """
    names = [c for c in edits.columns if c not in ("clip_id", "version")]
    body = F.struct(*(F.col(c).cast(edits.schema[c].dataType).alias(c) for c in names))
    asked = requests.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("version").cast("bigint").alias("asked"), body.alias("body")))).alias("asked"))
    now = edits.select("clip_id", F.col("version").cast("bigint").alias("version"), F.struct(*names).alias("body"))
    both = now.join(asked, "clip_id", "full")
    outcome = f"struct<seq: {requests.schema['seq'].dataType.simpleString()}, outcome: string, version: bigint>"

    def step(at: Column, r: Column) -> Column:
        clash = at["version"].isNotNull() & r["asked"].isNotNull() & (r["asked"] != at["version"])
        version = F.when(clash, at["version"]).otherwise(F.coalesce(at["version"] + 1, F.lit(1).cast("bigint")))
        said = F.struct(r["seq"].alias("seq"), F.when(clash, "conflict").otherwise("accepted").alias("outcome"), version.alias("version")).cast(outcome)
        return F.struct(version.alias("version"), F.when(clash, at["body"]).otherwise(r["body"]).alias("body"), F.concat(at["outcomes"], F.array(said)).alias("outcomes"))

    start = F.struct(F.col("version").alias("version"), F.col("body").alias("body"), F.array().cast(f"array<{outcome}>").alias("outcomes"))
    folded = F.aggregate("asked", start, step)
    done = both.withColumn("f", F.when(F.col("asked").isNotNull(), folded).otherwise(F.struct("version", "body", F.lit(None).cast(f"array<{outcome}>").alias("outcomes"))))
    return done.select("clip_id", "f.version", "f.body", "f.outcomes")


def retire(clips: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Clips older than ``days`` that aren't retired yet become so; ``newly`` marks those whose files may go."""
    due = (F.col("created_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")) & ~F.col("retired")
    return clips.withColumn("newly", due).withColumn("retired", F.col("retired") | F.col("newly"))


def cascade_delete(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose parent isn't among the deleted keys."""
    return rows.join(deleted.select(key), key, "left_anti")


def partial_update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Only the non-null fields of a change replace those of its row."""
    fields = [c for c in rows.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in fields if c in changes.columns))
    joined = rows.join(new, key, "left")
    return joined.select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in fields))


def reprompt(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """jobs(job_id, status, prompt, options) after requests(job_id, length_range, low, high, prompt), with ``error``; one row a request.

    A named range gives both limits, else they are the request's own; each known one is an option. Only segments are proposed
    anew, so that option goes on and all others of the mode off; other entries of ``options`` (a map of texts) stay. A request
    with an unknown job or range, a limit outside 0 to 3,600, low above high, or a prompt over 2,000 characters changes nothing.
    """
    asked = requests.select("job_id", "length_range", F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("prompt").alias("_prompt"))
    r = asked.join(jobs.withColumn("_known", F.lit(True)), "job_id", "left")
    named = text.length_range("length_range")
    low, high = (F.when(F.nullif("length_range", F.lit("")).isNotNull(), named[k]).otherwise(F.col(f"_{k}")) for k in ("low", "high"))
    error = F.when(F.nullif("length_range", F.lit("")).isNotNull() & named.isNull(), F.concat(F.lit("unknown length range: "), F.col("length_range")))
    for column, name in (("_low", "min"), ("_high", "max")):
        error = error.when(~F.col(column).between(0, 3600), f"length_{name}_seconds must be between 0 and 3600")
    error = error.when(F.length("_prompt") > 2000, "prompt must have at most 2000 characters").when(F.col("_known").isNull(), "job not found")
    error = error.when(low > high, "length_min_seconds must be <= length_max_seconds")
    fixed = F.create_map(*(F.lit(x) for o in C.OPTIONS for x in (o, "true" if o == "segment_proposer" else "false")))
    limits = F.create_map(F.lit("target_length_min_seconds"), low.cast("string"), F.lit("target_length_max_seconds"), high.cast("string"))
    limits = F.map_filter(limits, lambda _, v: v.isNotNull())
    old = F.map_filter("options", lambda k, _: ~k.isin(*C.OPTIONS) & ~F.array_contains(F.map_keys(limits), k))
    r = r.withColumn("error", error)
    ok = F.col("error").isNull()
    made = F.map_concat(F.coalesce(old, F.expr("cast(map() as map<string, string>)")), limits, fixed)
    return r.select(
        "job_id", F.when(ok, "pending").otherwise(F.col("status")).alias("status"), F.when(ok, F.coalesce("_prompt", "prompt")).otherwise(F.col("prompt")).alias("prompt"),
        F.when(ok, made).otherwise(F.col("options")).alias("options"), "error",
    )


def toggles(clicks: DataFrame) -> DataFrame:
    """The like and dislike state after all clicks(clip_id, seq, kind): the two exclude each other.

    A click toggles its own kind and clears the other, so the state is the parity of the last run of one kind.
    """
    order = Window.partitionBy("clip_id").orderBy("seq")
    turned = clicks.withColumn("run", F.sum(F.when(F.col("kind") != F.lag("kind").over(order), 1).otherwise(0)).over(order))
    runs = turned.groupBy("clip_id", "run", "kind").count()
    last = runs.groupBy("clip_id").agg(F.max_by(F.struct("kind", "count"), "run").alias("l"))
    odd = F.col("l.count") % 2 == 1
    return last.select("clip_id", ((F.col("l.kind") == "like") & odd).alias("liked"), ((F.col("l.kind") == "dislike") & odd).alias("disliked"))


def newest_first(rows: DataFrame, *order: str, within: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows newest first, with their place from 1 on in ``place``; ``within``: in each parent, whose rows are a window.

    A listing of the whole table is a top-k and needs its ``limit``.
    """
    latest = [F.desc(c) for c in order]
    if within is not None:
        placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*latest)))
        return placed if limit is None else placed.where(F.col("place") <= limit)
    if limit is None:
        raise ValueError("a listing of the whole table needs a limit")
    return rows.orderBy(*latest).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*latest)))


def media_paths(requests: DataFrame, clips: DataFrame, field: str = "output_path") -> DataFrame:
    """Requests(clip_id, ...) with the clip's path, or in ``missing`` what there isn't: the clip, or its file."""
    c = clips.select("clip_id", F.nullif(field, F.lit("")).alias("path"), F.lit(True).alias("_known"))
    found = requests.join(c, "clip_id", "left")
    missing = F.when(F.col("_known").isNull(), "clip").when(F.col("path").isNull(), field)
    return found.withColumn("missing", missing).drop("_known")


def live_links(links: DataFrame, now: Column) -> DataFrame:
    """Share links that are stored, not revoked and not expired."""
    return links.where(~F.coalesce("revoked", F.lit(True)) & (F.col("expires_at") >= now))


def token_candidates(tokens: DataFrame, presented: str) -> DataFrame:
    """Stored tokens that a presented one may be: same prefix up to the first _, not revoked."""
    prefix = presented.split("_", 1)[0] + "_"
    return tokens.where((F.col("token_prefix") == prefix) & ~F.col("revoked"))


def subscribed(webhooks: DataFrame, event_type: str) -> DataFrame:
    """Active webhooks that take all events or this one."""
    return webhooks.where(F.col("active") & (F.array_contains("events", "*") | F.array_contains("events", event_type)))
