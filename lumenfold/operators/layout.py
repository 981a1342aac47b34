"""Where the words of a drawn caption stand: widths from a table of glyphs, prefix sums, the active word marked."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The most glyphs of a font's table; they become part of the plan.
MOST_GLYPHS = 65_536
#: Words whose widths a task keeps at hand.
MOST_FORMS = 65_536
BLANKS = re.compile(r"[ \t\n\r\f\v]+")
#: What is left below a caption without an anchor, in pixels.
MARGIN = 40


def glyph_widths(glyphs: DataFrame) -> dict[str, float]:
    """The advance of each sign of glyphs(sign, width); an error beyond MOST_GLYPHS."""
    found = glyphs.select("sign", F.col("width").cast("double")).distinct().limit(MOST_GLYPHS + 1).collect()
    if len(found) > MOST_GLYPHS:
        raise ValueError(f"more than {MOST_GLYPHS} glyphs")
    return {r.sign: r.width for r in found}


def caption_layout(captions: DataFrame, glyphs: dict[str, float], size: tuple[int, int], height: float, missing: float = 0.0) -> DataFrame:
    """(vid, index, at, word, x, y, width, active): the words of captions(vid, index, text, active, anchor) as they are drawn.

    A line is centred in ``size`` (width, height), with a blank between words; signs without a glyph are ``missing`` wide. Its middle
    stands at ``anchor``, down to whole pixels; without one it keeps MARGIN from the bottom. ``active`` is the place of the lit
    word, or null. Captions without words have no rows. A word's width is added up once a task while it is among its MOST_FORMS
    latest words; nothing is shuffled.
    """
    schema = captions.schema
    out = StructType([schema["vid"], schema["index"], *StructType.fromDDL("at int, word string, x double, y double, width double, active boolean")])
    arrow = to_arrow_schema(out)
    blank, unknown = glyphs.get(" ", float(missing)), float(missing)

    def added(word: str) -> float:
        total = 0.0
        for sign in word:
            total += glyphs.get(sign, unknown)
        return total

    def placed(text: str, width: Callable[[str], float]) -> Iterator[tuple[str, float, float]]:
        words = [(w, width(w)) for w in BLANKS.split(text) if w]
        total = 0.0
        for _, wide in words:
            total += wide
        x = (size[0] - (total + blank * (len(words) - 1))) / 2
        for w, wide in words:
            yield w, x, wide
            x = x + wide + blank

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = lru_cache(MOST_FORMS)(added)
        for batch in batches:
            rows, nth, word, xs, wide, lit = [], [], [], [], [], []
            for i, (text, active) in enumerate(zip(batch.column("text").to_pylist(), batch.column("active").to_pylist())):
                for at, (w, x, width_) in enumerate(placed(text or "", width)):
                    rows.append(i), nth.append(at), word.append(w), xs.append(x), wide.append(width_), lit.append(at == active)
            vid, index, y = (batch.column(c).take(pa.array(rows, pa.int64())) for c in ("vid", "index", "y"))
            yield pa.RecordBatch.from_arrays([vid, index, pa.array(nth, pa.int32()), pa.array(word, pa.string()), pa.array(xs, pa.float64()), y, pa.array(wide, pa.float64()), pa.array(lit, pa.bool_())], schema=arrow)

    y = F.when(F.col("anchor").isNull(), F.lit(float(size[1] - height - MARGIN))).otherwise((F.col("anchor") - height / 2).cast("int").cast("double"))
    return captions.select("vid", "index", "text", F.col("active").cast("bigint").alias("active"), y.alias("y")).mapInArrow(drawn, out)
