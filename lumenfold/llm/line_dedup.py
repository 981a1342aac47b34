"""Line dedup over overlapping three-line windows, with DataFrame functions only.

Every run of three consecutive lines with words is hashed; windows found more than once anywhere are looked up
again, and all lines covered by an occurrence after the first go. Overlapping and neighbouring windows merge,
because what is collected is line positions. The first occurrence is the one with the least (doc_id, row hash,
position).

Only windows that repeat meet again, and their first place comes from an aggregate with map-side combine,
so that a passage in a third of all rows makes one row a task; the lookup is a join that adaptive execution can
split. Text is shuffled once.

Defined cases: lines without a word take no part in windows and always stay. Texts with fewer than three lines
with words, null and empty texts stay as they are. Rows that repeat both id and text are one row here: they
keep or lose the same lines. A null id sorts last. Further columns are carried along; those named as results
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Workspace

LINES = 3
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _filled(lines: Column) -> Column:
    """Positions of the lines that hold a word."""
    numbered = F.transform(lines, lambda x, i: F.when(x.rlike(_HAS_WORD), i).otherwise(-1))
    return F.filter(numbered, lambda i: i >= 0)


def repeated_lines(documents: DataFrame, work: Workspace, n: int = LINES) -> DataFrame:
    """(id, row, lost): for each row that loses lines, which of its filled lines; a written table."""
    rows = documents.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("row"), F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("at", _filled(F.col("lines"))).where(F.size("at") >= n)

    def window(k: Column) -> Column:
        parts = [F.element_at("lines", F.element_at("at", k + j) + 1) for j in range(n)]
        return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *reversed(parts)).alias("h2"), k.alias("k"))

    made = F.transform(F.sequence(F.lit(1), F.size("at") - (n - 1)), window)
    spots = work.save(rows.select("id", "row", F.inline(made)), "windows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "k")
    firsts = spots.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = work.save(firsts.where(F.col("first") != F.col("last")).select("h1", "h2", "first"), "firsts")
    again = spots.join(firsts, ["h1", "h2"]).where(place != F.col("first"))
    covered = again.select("id", "row", F.explode(F.sequence(F.col("k"), F.col("k") + (n - 1))).alias("k"))
    lost = work.save(covered.groupBy("id", "row").agg(F.collect_set("k").alias("lost")), "lost")
    work.drop("windows", "firsts")
    return lost


def dedup_lines(documents: DataFrame, n: int = LINES) -> DataFrame:
    """``documents`` with repeated lines taken out of ``text``, and n_lines and n_removed (lines with words)."""
    work = Workspace(documents.sparkSession, "line-dedup")
    lost = repeated_lines(documents, work, n).select(F.col("id").alias("_id"), F.col("row").alias("_row"), "lost")
    kept = [c for c in documents.columns if c not in ("text", "n_lines", "n_removed")]
    # Lines and positions are columns below the join: inside a lambda, an expression would be made anew for each line.
    lines = F.split("text", "\n")
    rows = documents.select(
        F.struct(*kept).alias("own"), F.col("doc_id").alias("_doc"), F.xxhash64("doc_id", "text").alias("_hash"), lines.alias("lines"), _filled(lines).alias("at")
    )
    # By shuffle at every size: the lost lines grow with the table.
    joined = rows.join(lost.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row")), "left")
    gone = F.transform("lost", lambda k: F.element_at("at", k))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    text = F.when(F.col("lost").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n"))
    made = joined.select(
        "own",
        text.alias("text"),
        F.coalesce(F.size("at"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
    return made.select(*(F.col("own")[c].alias(c) for c in kept), "text", "n_lines", "n_removed")
