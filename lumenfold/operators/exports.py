"""Manifests and other exports as rows ready for a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import srt_time, vtt_time

_NO_TAGS = "cast(array() as array<string>)"


def manifest(clips: DataFrame) -> DataFrame:
    """The manifest's nine columns: length from start and end, megabytes rounded to 2, tags as JSON."""
    length = F.coalesce("end", F.lit(0.0)) - F.coalesce("start", F.lit(0.0))

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return clips.select(
        F.regexp_extract(text("export_path"), r"([^/]*)$", 1).alias("filename"), text("title").alias("title"), length.alias("duration_seconds"),
        F.round(F.col("bytes") / 1048576, 2).alias("file_size_mb"), text("summary").alias("description"),
        F.to_json(F.coalesce("hashtags", F.expr(_NO_TAGS))).alias("hashtags"), text("export_path").alias("export_path"),
        text("thumbnail_path").alias("thumbnail_path"), text("job_id").alias("job_id"),
    )


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def bulk_manifest(clips: DataFrame, ids: list, limit: int = 200) -> DataFrame:
    """The export list of chosen clips: nulls as empty texts, a null score as 0, tags joined by commas."""
    if not ids or len(ids) > limit:
        raise ValueError(f"between 1 and {limit} ids")
    c = clips.where(F.col("clip_id").isin(*ids))
    return c.select(
        "clip_id", *(F.coalesce(x, F.lit("")).alias(x) for x in ("title", "summary", "output_path")),
        F.coalesce("score", F.lit(0)).alias("score"), F.array_join(F.coalesce("hashtags", F.expr(_NO_TAGS)), ",").alias("hashtags"),
    )


def export_paths(clips: DataFrame, exported: DataFrame) -> DataFrame:
    """Clips with the exported path of the same file stem, else an empty text."""

    def stem(c: str) -> Column:
        return F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1)

    e = exported.select(stem("path").alias("_stem"), F.col("path").alias("export_path"))
    joined = clips.join(e, (stem("output_path") == F.col("_stem")) & (F.col("_stem") != ""), "left")
    return joined.drop("_stem").withColumn("export_path", F.coalesce("export_path", F.lit("")))


def copies(clips: DataFrame, folder: str) -> DataFrame:
    """(source, target) of the files to copy; clips without a file add none."""
    c = clips.where(F.col("output_path").isNotNull())
    return c.select(F.col("output_path").alias("source"), F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract("output_path", r"([^/]*)$", 1)).alias("target"))


def _srt_block(index: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(index.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), text, F.lit("\n"))


def _vtt_block(index: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(vtt_time(start), F.lit(" --> "), vtt_time(end), F.lit("\n"), text, F.lit("\n"))


_FIELDS = ("index", "start", "end", "text")


def srt_blocks(captions: DataFrame) -> DataFrame:
    return captions.select("vid", "index", _srt_block(*map(F.col, _FIELDS)).alias("value"))


def vtt_blocks(captions: DataFrame) -> DataFrame:
    return captions.select("vid", "index", _vtt_block(*map(F.col, _FIELDS)).alias("value"))


def caption_file(captions: DataFrame, kind: str = "srt") -> DataFrame:
    """(vid, content): one caption file a video, as a row, which is as long as the file.

    Captions are rows, or listed in order: ``captions``, an array of structs of the same fields, which is written where it lies.
    """
    if kind not in ("srt", "vtt"):
        raise ValueError(f"Unsupported format: {kind}")
    head = F.lit("WEBVTT\n\n" if kind == "vtt" else "")
    if "captions" in captions.columns:
        block = _srt_block if kind == "srt" else _vtt_block
        return captions.select("vid", F.concat(head, F.array_join(F.transform("captions", lambda c: block(*(c[f] for f in _FIELDS))), "\n")).alias("content"))
    blocks = srt_blocks(captions) if kind == "srt" else vtt_blocks(captions)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("index", "value"))), lambda b: b["value"])
    return blocks.groupBy("vid").agg(F.concat(head, F.array_join(listed, "\n")).alias("content"))


def _escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def frame_count(start: str, end: str, fps: int = 30) -> Column:
    """Whole frames, rounded half to even, never negative."""
    return F.bround(F.greatest(F.lit(0.0), F.col(end) - F.col(start)) * fps).cast("bigint")


def _without_file(clips: DataFrame, xml: Column) -> DataFrame:
    """(clip_id, xml, error): a clip that hasn't been rendered has an error and no xml."""
    none = F.nullif("output_path", F.lit("")).isNull()
    error = F.when(none, F.concat(F.lit("clip "), F.col("clip_id").cast("string"), F.lit(" has no output_path; render first")))
    return clips.select("clip_id", F.when(~none, xml).alias("xml"), error.alias("error"))


def timeline_xml(clips: DataFrame, fps: int = 30, event: str = "Clip Export", project: str = "Clip") -> DataFrame:
    """(clip_id, xml, error): a one-clip project in version 1.10 of the XML of the other family of editors, in seconds."""
    # The wording of the format.
    seconds = F.concat(F.greatest(F.lit(0.0), F.coalesce("end", F.lit(0.0)) - F.coalesce("start", F.lit(0.0))).cast("string"), F.lit("s"))
    title = F.nullif("title", F.lit(""))
    name, heading = (_escape(F.coalesce(title, F.lit(x))) for x in ("clip", project))
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE fcpxml><fcpxml version="1.10"><resources>'),
        F.lit(f'<format id="r1" name="FFVideoFormat1080p{fps}" frameDuration="1/{fps}s" width="1080" height="1920"/><asset id="r2" name="'), name, F.lit('" duration="'), seconds,
        F.lit('" hasVideo="1" hasAudio="1" format="r1"><media-rep kind="original-media" src="file://'), _escape(F.col("output_path")),
        F.lit(f'"/></asset></resources><library><event name="{event}"><project name="'), heading, F.lit('"><sequence format="r1" duration="'), seconds,
        F.lit('"><spine><asset-clip ref="r2" offset="0s" name="'), name, F.lit('" duration="'), seconds, F.lit('"/></spine></sequence></project></event></library></fcpxml>'),
    )
    return _without_file(clips, xml)


def sequence_xml(clips: DataFrame, fps: int = 30) -> DataFrame:
    """(clip_id, xml, error): a one-clip sequence in the XML that video editors import, in frames."""
    # The wording of the format.
    n = frame_count("start", "end", fps).cast("string")
    name = _escape(F.coalesce(F.nullif("title", F.lit("")), F.lit("clip")))
    file = F.regexp_extract(F.coalesce("output_path", F.lit("")), r"([^/]*)$", 1)
    rate = f"<rate><timebase>{fps}</timebase><ntsc>FALSE</ntsc></rate>"
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE xmeml><xmeml version="5"><sequence id="'), F.col("clip_id").cast("string"),
        F.lit('"><name>'), name, F.lit("</name><duration>"), n, F.lit(f"</duration>{rate}<media><video><track><clipitem><name>"), name,
        F.lit("</name><start>0</start><end>"), n, F.lit("</end><in>0</in><out>"), n, F.lit("</out><file><name>"), _escape(file),
        F.lit("</name><pathurl>file://"), _escape(F.coalesce("output_path", F.lit(""))),
        F.lit("</pathurl></file></clipitem></track></video></media></sequence></xmeml>"),
    )
    return _without_file(clips, xml)


def publish_descriptor(jobs: DataFrame) -> DataFrame:
    """What the stub publisher writes: one JSON text a job."""
    return jobs.select("id", F.to_json(F.struct("id", "platform", "title", "hashtags")).alias("value"))
