"""Editor timelines: nested JSON to typed items, with their errors as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import constants as C

_TRACKS = "array<struct<kind: string, items: string>>"
_ITEM = "start string, end string, src string, trim_start string, text string, style string, x string, y string, font_size string, color string"


def items(timelines: DataFrame, base: str = "base_path") -> DataFrame:
    """One row an item of timelines(clip_id, timeline JSON), typed, defaults filled in.

    ``error`` says what is wrong with an item or its track, null if nothing: an unknown kind, no number where
    one must be, an end that isn't after its start.
    """
    tracks = timelines.select("clip_id", F.col(base).alias("base"), F.posexplode(F.from_json(F.get_json_object("timeline", "$.tracks"), _TRACKS)).alias("track", "t"))
    rows = tracks.select("clip_id", "base", "track", F.col("t.kind").alias("kind"), F.posexplode(F.from_json("t.items", "array<string>")).alias("idx", "json"))
    i = rows.withColumn("i", F.from_json("json", _ITEM))
    kind = F.col("kind")

    def number(name: str, default: float) -> Column:
        return F.when(F.col(f"i.{name}").isNull(), F.lit(default)).otherwise(F.expr(f"try_cast(i.{name} as double)"))

    src = F.coalesce(F.nullif("i.src", F.lit("")), F.lit("main"))
    typed = i.select(
        "clip_id", "track", "kind", "idx", number("start", 0.0).alias("start"), number("end", 0.0).alias("end"),
        F.when(kind == "video", F.when(src == "main", F.col("base")).otherwise(src)).alias("src"),
        F.when(kind == "video", number("trim_start", 0.0)).alias("trim_start"),
        F.when(kind != "video", F.coalesce("i.text", F.lit(""))).alias("text"),
        F.when(kind == "caption", F.coalesce("i.style", F.lit("default"))).alias("style"),
        F.when(kind == "text-overlay", number("x", 0.5)).alias("x"), F.when(kind == "text-overlay", number("y", 0.1)).alias("y"),
        F.when(kind == "text-overlay", number("font_size", 36.0).cast("int")).alias("font_size"),
        F.when(kind == "text-overlay", F.coalesce("i.color", F.lit("#ffffff"))).alias("color"),
    )
    place = F.concat(kind, F.lit("["), F.col("idx").cast("string"), F.lit("]"))
    error = (
        F.when(kind.isNull() | ~kind.isin(*C.TRACK_KINDS), F.concat(F.lit("unknown track kind: "), F.coalesce(kind, F.lit("null"))))
        .when(F.col("start").isNull() | F.col("end").isNull() | ((kind == "video") & F.col("trim_start").isNull()) | ((kind == "text-overlay") & (F.col("x").isNull() | F.col("y").isNull())), F.concat(place, F.lit(": expected number")))
        .when(F.col("end") <= F.col("start"), F.concat(place, F.lit(": end must be > start")))
    )
    return typed.withColumn("error", error)


def structural_errors(timelines: DataFrame) -> DataFrame:
    """Timelines that can't be read at all, with the reason."""
    tracks = F.get_json_object("timeline", "$.tracks")
    bad = F.when(tracks.isNull(), "timeline missing 'tracks' key").when(~tracks.startswith("["), "timeline.tracks must be a list")
    return timelines.select("clip_id", bad.alias("error")).where("error is not null")


def plan_durations(typed: DataFrame) -> DataFrame:
    """The rightmost end of each timeline's items, 0 without any, and how many items are wrong."""
    return typed.groupBy("clip_id").agg(F.coalesce(F.max("end"), F.lit(0.0)).alias("duration"), F.count("*").alias("items"), F.count("error").alias("errors"))


def replace_track(tracks: str, kind: str, items: Column) -> Column:
    """All three kinds of tracks in order, as array<struct<kind, items>>: ``kind`` with the new items, others as they were.

    Of several tracks of a kind the first counts; a kind that was lacking gets no items.
    """
    none = F.filter(items, lambda _: F.lit(False))

    def track(k: str) -> Column:
        old = F.try_element_at(F.filter(tracks, lambda t: t["kind"] == k), F.lit(1))["items"]
        return F.struct(F.lit(k).alias("kind"), F.when(F.col(kind) == k, items).otherwise(F.coalesce(old, none)).alias("items"))

    return F.array(*map(track, C.TRACK_KINDS))


def fill_kinds(typed: DataFrame) -> DataFrame:
    """Item counts of all three kinds for each timeline, also of those it lacks; items are made and dealt out once."""
    counts = typed.groupBy("clip_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in C.TRACK_KINDS))
    return counts.select("clip_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("items")) for k in C.TRACK_KINDS))))
