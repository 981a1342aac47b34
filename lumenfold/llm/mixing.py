"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies: its source's target over its source's size, in
words. Within a source the expected copies are summed up in order of (size, doc_id), one random offset is
added, and a document is emitted once for each integer that its part of the sum crosses. In that order every
stretch of sizes gets its share, so that the words taken come near the target.

The running count is found in three levels - sizes of a source, blocks of 4,096 ids of a size, rows of a
block - so that no task holds a whole source, nor all sources, and what is summed up first is counts. Ids that aren't whole numbers
are ordered by block of their hash first, and rows without an id by that of their text's.

Defined cases: a null text has size 0 and is never taken for its words; sources sort by code point with null
last; rows that repeat an id are ordered by their text's hash, and equal rows are told apart by nothing: which
of them is emitted more often doesn't show. An empty table gives an empty table. A source of size 0 has target
0 and none of its documents is emitted. Further columns are carried along; ``plan_copies`` replaces those named as results,
and ``mix`` replaces none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import WORD, Workspace

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK = 4_096


def _ranked(sizes: DataFrame, work: Workspace) -> DataFrame:
    """``sizes`` with each source's place in order of code point, null last: the place in its part of a sorted, written table after the parts before."""
    order = F.col("source").asc_nulls_last()
    parts = work.save(sizes.orderBy(order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part, and parts are few
    earlier = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.withColumn("place", place).join(earlier, "part").select("source", "source_size", (F.col("earlier") + F.col("place")).alias("rank"))


def source_targets(sizes: DataFrame, work: Workspace, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) with its target and its expected copies a document.

    Targets share the total by weight; none is above ``most`` times its source's size, and the excess goes to
    the others by weight. That is min(most * size, level * weight); the level rises with each source that it leaves
    above its cap until there are no new ones, and each round is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("bigint")
    weighed = _ranked(sizes, work).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    weighed = work.save(weighed, "weighed")
    level, full = 0.0, -1
    while True:
        capped = F.lit(False) if full < 0 else F.col("cap") < F.lit(level) * F.col("weight")
        sums = weighed.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(capped, F.col("cap"))).alias("cap"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count_if(capped).alias("full")
        ).first()
        if sums.full == full or not sums.weight:
            break
        level, full = ((sums.total or 0) - (sums.cap or 0)) / sums.weight, sums.full
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")))
    copies = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return weighed.select("source", "source_size", target.alias("target"), copies.alias("expected"))


def _offset(seed: str) -> Column:
    """A number in [0, 1) for each source, the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))


def _block(ids: T.DataType) -> Column:
    """Blocks of whole-number ids in their order; of other ids, and of rows without one, by hash."""
    by_id = F.floor(F.col("id") / BLOCK) if isinstance(ids, T.IntegralType) else F.shiftright(F.xxhash64("id"), 44)
    none = F.when(F.col("id").isNull(), F.shiftright("tie", 44))
    return F.struct(F.when(F.col("id").isNotNull(), by_id).alias("of"), none.alias("none"))


def plan_copies(documents: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``documents`` with size, source_size, target and copies: how often the mix takes each."""
    made = ["size", "source_size", "target", "copies"]
    kept = [c for c in documents.columns if c not in made]
    return _planned(documents, seed, weights, most).select(*(F.col("row")[c].alias(c) for c in kept), *made)


def _planned(documents: DataFrame, seed: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """(row, size, source_size, target, copies), where ``row`` holds all of a document's own columns."""
    rows = documents.select(F.struct("*").alias("row"), "source", F.col("doc_id").alias("id"), F.col("text").alias("text"))
    rows = rows.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))
    rows = rows.withColumn("tie", F.xxhash64("text")).drop("text")
    rows = rows.withColumn("block", _block(documents.schema["doc_id"].dataType))

    work = Workspace(documents.sparkSession, "mix")
    blocks = work.save(rows.groupBy("source", "size", "block").agg(F.count("*").alias("n")), "blocks")
    by_size = blocks.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("source", "size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("smaller"))
    earlier = Window.partitionBy("source", "size").orderBy(F.col("block.of").asc_nulls_last(), "block.none").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("lower", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    targets = source_targets(sizes, work, weights, most).withColumn("offset", _offset(seed))

    def same(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
        other = right.select(*(F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in right.columns))
        on = [left[c].eqNullSafe(other[f"_{c}"]) for c in names]
        return left.join(other, on).drop(*(f"_{c}" for c in names))

    bases = same(blocks.drop("n"), by_size, "source", "size")
    bases = same(bases, targets, "source")
    place = F.row_number().over(Window.partitionBy("source", "size", "block").orderBy(F.col("id").asc_nulls_last(), "tie"))
    placed = same(rows.withColumn("place", place), bases, "source", "size", "block")
    count = F.col("smaller") + F.col("lower") + F.col("place")
    upto = F.floor(F.col("expected") * count + F.col("offset"))
    below = F.floor(F.col("expected") * (count - 1) + F.col("offset"))
    return placed.select("row", "size", "source_size", "target", (upto - below).alias("copies"))


def mix(documents: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    planned = _planned(documents, seed, weights, most).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
