"""Stock footage, cached searches and video metadata."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.constants import SEARCH_DAYS

_CHAPTERS = "array<struct<title: string, start_time: double, end_time: double>>"


def metadata_chapters(videos: DataFrame, info: str = "info", platform: str = "platform") -> DataFrame:
    """(vid, idx, title, start, end): the chapters in a video's metadata (JSON), counted from 0.

    Only one platform names any; no metadata, no such entry, null and an empty list give no rows.
    """
    listed = F.from_json(F.get_json_object(info, "$.chapters"), _CHAPTERS)
    rows = videos.where(F.col(platform) == "youtube").select("vid", F.posexplode(listed).alias("idx", "c"))
    return rows.select("vid", "idx", F.col("c.title").alias("title"), F.col("c.start_time").alias("start"), F.col("c.end_time").alias("end"))


def matching_footage(texts: DataFrame, files: DataFrame, key: str, phrases: str = "phrases") -> DataFrame:
    """(key, path): for each text's phrases the first file whose stem holds one of the first phrase's words, and so on.

    ``files(seq, path)`` are tried in order of seq. A word inside a stem is one of the stem's substrings, so those
    are listed once, each with its first file, and words are looked up by equality: no product of texts and files.
    Texts without a match have no row.
    """
    stem = F.lower(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    starts = F.sequence(F.lit(1), F.length("stem") + 1)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(0), F.length("stem") + 1 - i), lambda n: F.substr("stem", i, n))))
    named = files.where(F.lower("path").endswith(".mp4")).select("seq", "path", stem.alias("stem"))
    known = named.select("seq", "path", F.explode(F.array_distinct(parts)).alias("word"))
    first = known.groupBy("word").agg(F.min(F.struct("seq", "path")).alias("file"))
    asked = texts.select(key, F.posexplode(phrases).alias("phrase", "words"))
    asked = asked.select(key, "phrase", F.explode(F.split(F.lower("words"), r"[\s_-]+")).alias("word"))
    found = asked.join(first, "word").groupBy(key).agg(F.min(F.struct("phrase", "file.seq", "file.path")).alias("best"))
    return found.select(key, F.col("best.path").alias("path"))


def smallest_file(files: Column | str) -> Column:
    """The smallest MP4 of a list of struct(file_type, height, width, ...) by height, then width; the first of equals.

    A missing size is 9999; a list without an MP4 gives null.
    """
    listed = F.filter(files, lambda f: f["file_type"] == "video/mp4")
    ranked = F.transform(listed, lambda f, i: F.struct(F.coalesce(f["height"], F.lit(9999)).alias("h"), F.coalesce(f["width"], F.lit(9999)).alias("w"), i.alias("i")))
    return F.try_element_at(listed, F.array_min(ranked)["i"] + 1)


def cached_searches(requests: DataFrame, cache: DataFrame, now: datetime, days: int = SEARCH_DAYS) -> DataFrame:
    """``requests(key, ...)`` with ``body``: what cache(key, body, cached_at) holds, if it is JSON and not too old, else null."""
    fresh = cache.where(F.col("cached_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
    readable = fresh.where(F.expr("try_parse_json(body)").isNotNull())
    latest = readable.groupBy("key").agg(F.max_by("body", "cached_at").alias("body"))
    return requests.join(latest, "key", "left")
