"""Caption files as rows: readers for .srt and .vtt, and their plain forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME = r"((?:\d+:)?\d+:\d+[.,]\d+)"
_TIMES = rf"(?m)^\s*{_TIME}\s*-->\s*{_TIME}"


def _seconds(stamp: Column) -> Column:
    """Seconds of [h:]mm:ss.mmm; a comma is a point."""
    parts = F.transform(F.reverse(F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")), lambda p: p.cast("double"))
    return F.aggregate(F.zip_with(parts, F.array(F.lit(1.0), F.lit(60.0), F.lit(3600.0)), lambda p, f: F.coalesce(p, F.lit(0.0)) * f), F.lit(0.0), lambda s, x: s + x)


def parse_captions(files: DataFrame, key: str = "vid", content: str = "content") -> DataFrame:
    """(key, index, start, end, text): the captions of each file in order, counted from 1, times in seconds.

    A caption is a block between empty lines that holds a line of two times; its text are the lines after that.
    Other blocks (a header, notes, styles) are none. Null and empty files have no captions.
    """
    lines = F.regexp_replace(F.col(content), r"\r\n?", "\n")
    blocks = F.filter(F.split(lines, r"\n[ \t]*\n+"), lambda b: b.rlike(_TIMES))
    rows = files.select(key, F.posexplode(blocks).alias("at", "block"))
    body = F.regexp_replace(F.col("block"), r"(?s)^.*?-->[^\n]*\n?", "")
    return rows.select(
        key, (F.col("at") + 1).alias("index"), F.round(_seconds(F.regexp_extract("block", _TIMES, 1)), 3).alias("start"),
        F.round(_seconds(F.regexp_extract("block", _TIMES, 2)), 3).alias("end"), F.regexp_replace(body, r"\n+$", "").alias("text"),
    )


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, start, end, text) of the caption files of one suffix at ``path``; other suffixes than .srt and .vtt are an error."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in ("srt", "vtt"):
        raise ValueError(f"captions are .srt or .vtt files, not {suffix or 'without suffix'}")
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return parse_captions(files, "path")


def upper_captions(captions: DataFrame) -> DataFrame:
    """Captions in capitals, as they are drawn."""
    return captions.withColumn("text", F.upper("text"))
