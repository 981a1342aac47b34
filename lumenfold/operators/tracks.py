"""Numeric tracks: smoothing, votes and nearest-time lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confident(faces: DataFrame, least: float = 0.3) -> DataFrame:
    return faces.where(F.col("conf") >= least)


#: Times of a stretch; the rows of one are sorted together.
STRETCH = 10_000


def smooth(faces: DataFrame, window: int = 5, stretch: float = STRETCH) -> DataFrame:
    """Centred moving mean of cx and cy over window // 2 rows to either side, confident faces only.

    A video is cut into stretches of time, and each gets the rows next to it on either side: the last of the stretches
    before and the first of those after, however empty some are. Only ends of stretches, one row each, are ordered by video.
    """
    half = window // 2
    rows = confident(faces).select("vid", "t", "cx", "cy", F.floor(F.col("t") / stretch).alias("part"))
    point = F.struct("t", "cx", "cy")
    inside = Window.partitionBy("vid", "part").orderBy("t")
    placed = rows.withColumn("first", F.row_number().over(inside)).withColumn("last", F.count("*").over(Window.partitionBy("vid", "part")) - F.col("first") + 1)
    ends = placed.where(F.least("first", "last") <= half).groupBy("vid", "part").agg(
        *(F.sort_array(F.collect_list(F.when(F.col(side) <= half, point))).alias(side) for side in ("first", "last"))
    )
    chain = Window.partitionBy("vid").orderBy("part")

    def beside(side: str, low: int, high: int) -> Column:
        return F.flatten(F.collect_list(side).over(chain.rowsBetween(low, high)))

    near = ends.select("vid", "part", F.slice(F.reverse(beside("last", -half, -1)), 1, half).alias("before"), F.slice(beside("first", 1, half), 1, half).alias("after")) if half else None
    rows = rows.withColumn("own", F.lit(True))
    if near is not None:
        halo = near.select("vid", "part", F.explode(F.concat("before", "after")).alias("p"))
        rows = rows.unionByName(halo.select("vid", "p.t", "p.cx", "p.cy", "part", F.lit(False).alias("own")))
    w = inside.rowsBetween(-half, half)
    return rows.select("vid", "t", F.avg("cx").over(w).alias("cx"), F.avg("cy").over(w).alias("cy"), "own").where("own").drop("own")


def largest_face(faces: DataFrame) -> DataFrame:
    """The largest face of each frame, the first listed of equals."""
    best = F.max_by(F.struct("cx", "cy"), F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("seq")).alias("first")))
    return faces.groupBy("vid", "t").agg(best.alias("f")).select("vid", "t", "f.*")


def ema(track: DataFrame, alpha: float = 0.3, hold: float = 2.0, stretch: float = 60.0) -> DataFrame:
    """Exponential smoothing of found faces. Without a face the last value holds, for ``hold`` seconds at most.

    Rows without a face have null cx and cy. Each value needs the last, which is a linear recurrence: over a stretch of
    ``stretch`` seconds (``hold`` at least) a value is what it would be from 0 on, plus a power of 1 - alpha times the value before the
    stretch. So each stretch is folded by itself, a video's stretches are folded in turn, and no task holds a video.
    """
    stretch = max(stretch, hold)
    rows = track.select("vid", F.col("t").cast("double").alias("t"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    rows = rows.withColumn("part", F.floor(F.col("t") / stretch))
    found = rows.where("cx is not null").groupBy("vid", "part").agg(F.sort_array(F.collect_list(F.struct("t", "cx", "cy"))).alias("all"))
    rest = F.lit(1.0 - alpha)

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        own = [F.coalesce(rest * last[c], F.lit(0.0)) + alpha * x[c] for c in ("cx", "cy")]
        new = F.struct(x["t"].alias("t"), own[0].alias("cx"), own[1].alias("cy"), (rest * F.coalesce(last["f"], F.lit(1.0))).alias("f"))
        return F.concat(done, F.array(new))

    kind = "array<struct<t: double, cx: double, cy: double, f: double>>"
    alone = found.select("vid", "part", F.element_at("all", 1).alias("first"), F.aggregate("all", F.expr(f"cast(array() as {kind})"), add).alias("alone"))
    ends = alone.select("vid", F.struct("part", "first", F.element_at("alone", -1).alias("end")).alias("p"))

    def carry(done: Column, p: Column) -> Column:
        # The first value of all counts as the one before it, so that it stays as it is.
        last = F.try_element_at(done, F.lit(-1))
        before = [F.coalesce(last["end"][c], p["first"][c]) for c in ("cx", "cy")]
        end = F.struct(p["end"]["t"].alias("t"), *((p["end"]["f"] * b + p["end"][c]).alias(c) for b, c in zip(before, ("cx", "cy"))))
        return F.concat(done, F.array(F.struct(p["part"].alias("part"), before[0].alias("x"), before[1].alias("y"), end.alias("end"))))

    chained = "array<struct<part: bigint, x: double, y: double, end: struct<t: double, cx: double, cy: double>>>"
    scan = ends.groupBy("vid").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    scan = scan.select("vid", F.inline(F.aggregate("parts", F.expr(f"cast(array() as {chained})"), carry)))
    exact = alone.join(scan.select("vid", "part", "x", "y"), ["vid", "part"]).select("vid", "part", "x", "y", F.inline("alone"))
    exact = exact.select("vid", "part", "t", (F.col("f") * F.col("x") + F.col("cx")).alias("cx"), (F.col("f") * F.col("y") + F.col("cy")).alias("cy"))
    # Rows without a face take the last value of their stretch, or of the one before it, if it isn't too old.
    missing = rows.where("cx is null").select("vid", "part", "t", *(F.lit(None).cast("double").alias(c) for c in ("cx", "cy")))
    tails = scan.select("vid", (F.col("part") + 1).alias("part"), F.col("end").alias("tail"))
    order = Window.partitionBy("vid", "part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(F.when(F.col("cx").isNotNull(), F.struct("t", "cx", "cy")), ignorenulls=True).over(order)
    both = exact.unionByName(missing).withColumn("here", here).join(tails, ["vid", "part"], "left")
    value = F.coalesce("here", "tail")
    held = both.withColumn("value", value).where(F.col("cx").isNotNull() | (F.col("t") - F.col("value.t") <= hold))
    return held.select("vid", "t", F.coalesce("cx", "value.cx").alias("cx"), F.coalesce("cy", "value.cy").alias("cy"))


def split_screen(faces: DataFrame, apart: float = 0.4, share: float = 0.5) -> DataFrame:
    """Whether more than half of a video's frames hold two confident faces far apart."""
    sure = F.col("conf") >= 0.3
    frames = faces.groupBy("vid", "t").agg(
        ((F.count_if(sure) >= 2) & (F.max(F.when(sure, F.col("cx"))) - F.min(F.when(sure, F.col("cx"))) > apart)).alias("split")
    )
    return frames.groupBy("vid").agg(F.count("*").alias("frames"), F.count_if("split").alias("split_frames"), (F.count_if("split") > share * F.count("*")).alias("is_split"))


def nearest(times: DataFrame, track: DataFrame, stretch: float = STRETCH) -> DataFrame:
    """For each (vid, t) the track point nearest in time, the earlier of two equally near.

    Both sides are merged and sorted by video and stretch of time; the last point before and the first after are window
    values of the stretch, or else the last and first points of the stretches around it. So there is no join by range, and only
    stretches, one row each, are ordered by video.
    """
    point = F.struct(F.col("t").alias("t"), "cx", "cy")
    marks = track.select("vid", "t", F.lit(0).alias("side"), point.alias("p"))
    both = marks.unionByName(times.select("vid", "t", F.lit(1).alias("side"), F.lit(None).cast(marks.schema["p"].dataType).alias("p")))
    both = both.withColumn("part", F.floor(F.col("t") / stretch))
    chain = Window.partitionBy("vid").orderBy("part")
    ends = both.groupBy("vid", "part").agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("t"))).alias("first"), F.max_by("p", F.when(F.col("p").isNotNull(), F.col("t"))).alias("last"))
    ends = ends.select(
        "vid", "part", F.last("last", ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("first", ignorenulls=True).over(chain.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    order = Window.partitionBy("vid", "part").orderBy("t", "side")
    back = F.last("p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("p", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("b", back).withColumn("a", after).where("side = 1").join(ends, ["vid", "part"])
    found = found.withColumn("b", F.coalesce("b", "earlier")).withColumn("a", F.coalesce("a", "later"))
    use_back = F.col("a").isNull() | (F.col("b").isNotNull() & (F.col("t") - F.col("b.t") <= F.col("a.t") - F.col("t")))
    return found.select("vid", "t", F.when(use_back, F.col("b")).otherwise(F.col("a")).alias("p")).select("vid", "t", F.col("p.t").alias("at"), "p.cx", "p.cy")


def crop_box(cx: str, cy: str, width: int, height: int, crop_w: int, crop_h: int) -> Column:
    """A crop around a centre in 0..1, inside the frame, in whole pixels."""

    def low(c: str, size: int, crop: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(size - crop), (F.col(c) * size).cast("int") - crop // 2))

    x, y = low(cx, width, crop_w), low(cy, height, crop_h)
    return F.struct(x.alias("x1"), y.alias("y1"), (x + crop_w).alias("x2"), (y + crop_h).alias("y2"))


def centre_crop(width: str, height: str, ratio_w: int = 320, ratio_h: int = 569) -> Column:
    """The largest centred box of a ratio."""
    w, h = F.col(width), F.col(height)
    ratio = ratio_w / ratio_h
    wide = w / h > ratio
    cw = F.when(wide, (h * ratio).cast("int")).otherwise(w)
    ch = F.when(wide, h).otherwise((w / ratio).cast("int"))
    return F.struct(F.floor((w - cw) / 2).cast("int").alias("x"), F.floor((h - ch) / 2).cast("int").alias("y"), cw.alias("w"), ch.alias("h"))
