"""Statistics of stacks of small images in long form (roi, sample, pix, v)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean(stack: DataFrame) -> DataFrame:
    """Temporal mean, truncated to a byte."""
    return stack.groupBy("roi", "pix").agg(F.avg("v").cast("int").alias("value"))


def percentile(stack: DataFrame, p: float) -> DataFrame:
    """Temporal percentile with linear interpolation."""
    return stack.groupBy("roi", "pix").agg(F.percentile("v", F.lit(p)).alias("value"))


def byte_percentile(stack: DataFrame, p: float) -> DataFrame:
    return percentile(stack, p).withColumn("value", F.floor(F.col("value") + F.lit(1e-9)).cast("int"))


def ghost_mask(stack: DataFrame, bg: DataFrame, near_max: float = 0.98, margin: float = 15) -> DataFrame:
    """Pixels whose near-maximum is brighter than the background by more than a margin."""
    top = percentile(stack, near_max).withColumnRenamed("value", "top")
    return top.join(bg, ["roi", "pix"]).select("roi", "pix", (F.col("top") - F.col("value") > margin).alias("ghost"), "top", "value")


def deghost_near_max(stack: DataFrame, bg: DataFrame, near_max: float = 0.98, margin: float = 15) -> DataFrame:
    """Ghost pixels replaced by their near-maximum."""
    g = ghost_mask(stack, bg, near_max, margin)
    return g.select("roi", "pix", F.when(F.col("ghost"), F.floor(F.col("top") + F.lit(1e-9)).cast("int")).otherwise(F.col("value")).alias("value"))


def foreground_excluded(stack: DataFrame, places: DataFrame, p: float, radius: float, side: int) -> DataFrame:
    """Percentile over the samples in which no object is within a radius of the pixel; over all
    samples where that leaves none. places: roi, sample, ox, oy."""
    px, py = F.col("pix") % side, F.floor(F.col("pix") / side)
    j = stack.join(places, ["roi", "sample"], "left")
    hit = F.coalesce((px - F.col("ox")) ** 2 + (py - F.col("oy")) ** 2 <= radius**2, F.lit(False))
    own = j.withColumn("_hit", hit).groupBy("roi", "sample", "pix", "v").agg(F.bool_or("_hit").alias("_hit"))
    return own.groupBy("roi", "pix").agg(F.coalesce(F.percentile(F.when(~F.col("_hit"), F.col("v")), F.lit(p)), F.percentile("v", F.lit(p))).alias("value"))


def difference(stack: DataFrame, bg: DataFrame, kind: str = "dark") -> DataFrame:
    """Saturating difference to the background: dark objects, bright ones, or either."""
    d = F.col("value") - F.col("v")
    d = {"dark": F.greatest(d, F.lit(0)), "bright": F.greatest(-d, F.lit(0)), "absolute": F.abs(d)}[kind]
    return stack.join(bg, ["roi", "pix"]).select("roi", "sample", "pix", d.cast("int").alias("d"))


def otsu(values: DataFrame, key: list[str], value: str) -> DataFrame:
    """Threshold of greatest variance between classes, the first on ties, from the histogram."""
    h = values.groupBy(*key, F.col(value).cast("long").alias("t")).agg(F.count("*").alias("n"))
    run, whole = Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    h = h.withColumns({"w0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("t")).over(run), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("t")).over(whole)})
    w0, w1 = F.col("w0").cast("double"), (F.col("w") - F.col("w0")).cast("double")
    gap = F.col("s0") / w0 - (F.col("s") - F.col("s0")) / w1
    h = h.withColumn("between", F.when(w1 > 0, F.round(w0 * w1 * gap * gap, 6)).otherwise(0.0))
    return h.groupBy(*key).agg(F.max(F.struct("between", (-F.col("t")).alias("m"))).alias("b")).select(*key, (-F.col("b.m")).alias("threshold"))


def drift(stack: DataFrame, bg: DataFrame, safe=None) -> DataFrame:
    """Median difference to the background of each sample, over the pixels that are safe."""
    j = stack.join(bg, ["roi", "pix"])
    d = F.col("v") - F.col("value")
    return j.groupBy("roi", "sample").agg(F.median(d if safe is None else F.when(safe, d)).alias("drift"))


def first_last(stack: DataFrame) -> DataFrame:
    """Absolute difference of the first and last sample of each pixel."""
    return stack.groupBy("roi", "pix").agg(F.abs(F.max_by("v", "sample") - F.min_by("v", "sample")).alias("value"))


def floor_level(bg: DataFrame) -> DataFrame:
    """Median of the values that are no less than the arena's median."""
    m = bg.groupBy("roi").agg(F.median("value").alias("m"))
    return bg.join(m, "roi").where("value >= m").groupBy("roi").agg(F.median("value").alias("floor"))


def spread(stack: DataFrame) -> DataFrame:
    """Distinct values and population deviation of each pixel."""
    return stack.groupBy("roi", "pix").agg(F.count_distinct("v").alias("n_unique"), F.stddev_pop("v").alias("std"))


def contrast(places: DataFrame, stack: DataFrame, bg: DataFrame, side: int, kind: str = "dark", window: int = 2) -> DataFrame:
    """places (roi, sample, x, y) with the mean difference to the background in a window around each, cut off at
    the image's edge; null outside the image. The window's pixels are listed, so that the join is by equality."""
    d = F.col("value") - F.col("v")
    d = {"dark": d, "bright": -d, "absolute": F.abs(d)}[kind]
    own = places.withColumns({"_i": F.rint("y").cast("int"), "_j": F.rint("x").cast("int")})
    held = F.col("_i").between(0, side - 1) & F.col("_j").between(0, side - 1)
    around = lambda c: F.sequence(F.greatest(F.lit(0), F.col(c) - window), F.least(F.lit(side - 1), F.col(c) + window))
    key = ["roi", "sample", "x", "y"]
    spots = own.where(held).select(*key, F.explode(around("_i")).alias("i"), around("_j").alias("js")).select(*key, "i", F.explode("js").alias("j")).select(*key, (F.col("i") * side + F.col("j")).alias("pix")).distinct()
    means = spots.join(stack, ["roi", "sample", "pix"]).join(bg, ["roi", "pix"]).groupBy(*key).agg(F.avg(d).alias("contrast"))
    return places.join(means, key, "left")


def replayed(stack: DataFrame, n: int, p: float) -> DataFrame:
    """Differences of all samples to the background of each arena's first n ones: the background is a pass of its own,
    after which all samples are read, those of the first pass too."""
    first = stack.select("roi", "sample").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("roi").orderBy("sample"))).where(F.col("_n") <= n).drop("_n")
    return difference(stack, byte_percentile(stack.join(first, ["roi", "sample"], "left_semi"), p))


def one_component(stack: DataFrame, reg: float = 1e-3) -> DataFrame:
    """roi, pix, n, mean, var, and the information criterion of a single normal component for each pixel."""
    out = stack.groupBy("roi", "pix").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    v = F.col("var") + reg
    return out.withColumn("bic", 2 * F.log("n") + F.col("n") * (F.log(2 * math.pi * v) + F.col("var") / v))


def ghost_counts(stack: DataFrame, side: int, low: float = 0.90, high: float = 0.98, margin: float = 15, share: float = 0.92) -> DataFrame:
    """roi, n_ghost: pixels of the arena's disk whose near-maximum is brighter than their low percentile, cut to a byte,
    by more than the margin. Arenas without any need no more than that percentile as background."""
    both = stack.groupBy("roi", "pix").agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("q"))
    y, x = F.floor(F.col("pix") / side) - side / 2, F.col("pix") % side - side / 2
    inside = y * y + x * x <= (share * side / 2) ** 2
    ghost = inside & (F.col("q")[1] - F.floor(F.col("q")[0] + F.lit(1e-9)) > margin)
    return both.groupBy("roi").agg(F.count_if(ghost).alias("n_ghost"))
