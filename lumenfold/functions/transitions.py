"""Cross-fades between two clips as the filter text that the video tool takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.constants import TRANSITIONS


def _name(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in TRANSITIONS.items() for x in pair)), kind)


def fade_fault(kind: str, duration: str) -> Column:
    """Why a fade can't be made, null if it can: a kind that isn't known, or a length that isn't above 0."""
    return F.when(_name(F.col(kind)).isNull(), F.concat(F.lit("no such fade: "), F.coalesce(kind, F.lit("null")))).when(
        F.coalesce(F.col(duration) <= 0, F.lit(True)), F.lit("a fade takes time")
    )


def cross_fade(kind: str, duration: str, offset: str) -> Column:
    """The filter of a fade of ``duration`` seconds that begins at ``offset``; null where ``fade_fault`` isn't."""
    text = F.format_string("[0:v][1:v]xfade=transition=%s:duration=%.3f:offset=%.3f[v]", _name(F.col(kind)), F.col(duration), F.col(offset))
    return F.when(fade_fault(kind, duration).isNull(), text)
