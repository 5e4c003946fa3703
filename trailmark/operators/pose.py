"""Keypoints: wide form, flags, rates, heatmaps, context windows, matching, label samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import keyed
from ..sources.views import NODES


def wide(pose: DataFrame, nodes: list[str] = NODES, key: list[str] | None = None) -> DataFrame:
    """A row per instance: <node>_x, _y, _score; instances without any value are dropped."""
    key = key or keyed(pose, "roi", *(["track_id"] if "track_id" in pose.columns else []), "frame")
    own = pose.where("x is not null or y is not null or score is not null")
    return own.groupBy(*key).pivot("keypoint", nodes).agg(F.first("x", True).alias("x"), F.first("y", True).alias("y"), F.first("score", True).alias("score"))


def flags(w: DataFrame, nodes: list[str] = NODES, min_score: float = 0.2, extend: float = 0.15, flip_deg: float = 120.0, key: list[str] | None = None) -> DataFrame:
    """Low confidence, missing points, swapped wings, head and tail exchanged, by the track where there are any."""
    key = key or keyed(w, "roi", *(["track_id"] if "track_id" in w.columns else []))
    no = F.lit(False)
    low = F.least(*[F.col(f"{n}_score") for n in nodes]) < min_score
    missing = no
    for n in nodes:
        missing = missing | F.col(f"{n}_x").isNull() | F.col(f"{n}_y").isNull()
    out = w.withColumns({"flag_low_conf": F.coalesce(low, no), "flag_missing": missing})
    if not set(NODES) <= set(nodes):
        return out.withColumns({"flag_wing_swap": no, "flag_headtail": no})
    fx, fy = F.col("head_x") - F.col("abdomen_x"), F.col("head_y") - F.col("abdomen_y")
    length = F.sqrt(fx * fx + fy * fy)
    out = out.withColumns({"_fx": fx, "_fy": fy, "_len": length})
    for side in ("wingL", "wingR"):
        lateral = ((F.col(f"{side}_x") - F.col("thorax_x")) * -F.col("_fy") + (F.col(f"{side}_y") - F.col("thorax_y")) * F.col("_fx")) / F.col("_len")
        judged = (F.col("_len") > 0) & (F.abs(lateral) > extend * F.col("_len")) & (F.col(f"{side}_score") >= min_score)
        out = out.withColumn(f"_{side}", F.when(judged, lateral))
    group = Window.partitionBy(*key)
    swap = no
    for side in ("wingL", "wingR"):
        usual = F.when(F.coalesce(F.median(f"_{side}").over(group), F.lit(0.0)) < 0, -1).otherwise(1)
        swap = swap | F.coalesce(F.col(f"_{side}").isNotNull() & (F.signum(f"_{side}") != usual), no)
    order = group.orderBy("frame")
    px, py, pl = (F.lag(c).over(order) for c in ("_fx", "_fy", "_len"))
    cosine = (F.col("_fx") * px + F.col("_fy") * py) / (F.col("_len") * pl)
    flip = F.coalesce((F.col("_len") > 0) & (pl > 0) & (cosine < math.cos(math.radians(flip_deg))), no)
    return out.withColumns({"flag_wing_swap": swap, "flag_headtail": flip}).drop("_fx", "_fy", "_len", "_wingL", "_wingR")


def flag_rates(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count("*").alias("n_instances"), *[F.bround(F.avg(F.col(f"flag_{f}").cast("double")), 4).alias(f"rate_{f}") for f in ("low_conf", "missing", "wing_swap", "headtail")])


def confidence(pose: DataFrame) -> DataFrame:
    return pose.groupBy(*keyed(pose, "frame"), "keypoint").agg(F.avg("score").alias("score_mean"))


def heatmap_argmax(maps: DataFrame, side: int, crop: int) -> DataFrame:
    """First position of the greatest value, at the pixel's centre in crop coordinates."""
    at = F.array_position("heat", F.array_max("heat")) - 1
    scale = crop / side
    return maps.select("vec_id", ((at % side + 0.5) * scale).alias("x"), ((F.floor(at / side) + 0.5) * scale).alias("y"), F.array_max("heat").cast("double").alias("score"))


def heatmap_centroid(maps: DataFrame, side: int, crop: int) -> DataFrame:
    """Centre of mass of the positive values; the crop's centre without any."""
    heat = F.transform("heat", lambda v: F.greatest(v.cast("double"), F.lit(0.0)))
    total = lambda weight: F.aggregate(F.transform(heat, lambda v, i: v * weight(i)), F.lit(0.0), lambda a, b: a + b)
    mass, scale = total(lambda i: F.lit(1.0)), crop / side
    centre = lambda s: F.when(mass > 0, (s / mass + 0.5) * scale).otherwise(crop / 2)
    return maps.select("vec_id", centre(total(lambda i: (i % side).cast("double"))).alias("x"), centre(total(lambda i: F.floor(i / side).cast("double"))).alias("y"), F.array_max("heat").cast("double").alias("score"))


def context_windows(labels: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Rows within k frames of each labelled frame: the range becomes an equality by listing it."""
    place = keyed(labels, "roi")
    around = labels.select(*place, F.col("frame").alias("anchor"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("frame") - k), F.col("frame") + k)).alias("frame"))
    return around.join(rows.select(*place, "frame").distinct(), [*place, "frame"])


def match_nearest(instances: DataFrame, anchors: DataFrame) -> DataFrame:
    """The nearest anchor (ties by roi) of each frame's only instance; anchors without a position never match."""
    at = keyed(instances, "frame")
    pairs = instances.join(anchors.where("ax is not null and ay is not null"), at).withColumn("dist", F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")))
    best = pairs.groupBy(*at, "inst").agg(F.min(F.struct("dist", "roi")).alias("b"))
    return best.select(*at, "inst", F.col("b.roi").alias("roi"), F.col("b.dist").alias("dist"))


def match_greedy(instances: DataFrame, anchors: DataFrame) -> DataFrame:
    """One-to-one: instances in order of `inst` take the nearest anchor still free, frame by frame."""
    at = keyed(instances, "frame")
    sides = instances.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("inst", "x", "y"))).alias("p")).join(anchors.where("ax is not null and ay is not null").groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("roi", "ax", "ay"))).alias("q")), at)
    sides = sides.select(F.struct(*at).alias("at"), "p", "q")

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for at, p, q in zip(b["at"], b["p"], b["q"], strict=True):
                free = list(q)
                for one in p:
                    if free and one["x"] is not None and one["y"] is not None:
                        d = [math.hypot(one["x"] - a["ax"], one["y"] - a["ay"]) for a in free]
                        i = d.index(min(d))
                        out.append((at, one["inst"], free.pop(i)["roi"], d[i]))
            yield pd.DataFrame(out, columns=["at", "inst", "roi", "dist"])

    return sides.mapInPandas(run, f"at {dict(sides.dtypes)['at']}, inst bigint, roi string, dist double").select("at.*", "inst", "roi", "dist")


def diversity_sample(tracks: DataFrame, n: int, key: tuple[str, ...] = ("track_id", "frame")) -> DataFrame:
    """n rows, as many of each arena, round robin over six angle and three area classes, in an order
    by hash."""
    place = keyed(tracks, "roi")
    terciles = tracks.groupBy(*place).agg(F.percentile("area", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))  # a row for each arena
    out = tracks.join(F.broadcast(terciles), place)
    per = -(-n // max(1, tracks.select(*place).distinct().count()))
    angle = F.floor(F.pmod(F.col("angle_deg"), F.lit(180.0)) / 30).cast("int")
    area = F.when(F.col("area") <= F.col("q")[0], 0).when(F.col("area") <= F.col("q")[1], 1).otherwise(2)
    digest = F.md5(F.concat_ws("|", *place, *[F.col(k).cast("string") for k in key]))
    out = out.withColumns({"_s": angle * 3 + area, "_h": digest})
    # a stratum gives as many as an arena at most: Spark keeps no more of each before it exchanges rows
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy(*place, "_s").orderBy("_h"))).where(F.col("_r") <= per)
    out = out.withColumn("_m", F.row_number().over(Window.partitionBy(*place).orderBy("_r", "_s")))
    return out.where(F.col("_m") <= per).orderBy("_m", *place).limit(n).select(*tracks.columns)


def random_sample(tracks: DataFrame, n: int, seed: int, key: tuple[str, ...] = ("roi", "track_id", "frame")) -> DataFrame:
    """n rows in an order by hash of key and seed."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keyed(tracks, *key)], F.lit(str(seed))))
    return tracks.orderBy(digest).limit(n)


def instances(predictions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Predictions (video where there are several, frame, inst, keypoint, x, y, score) in the long table of poses: each
    instance takes the arena and track of the nearest row of tracks still free in its frame. An instance's place is the mean
    of its keypoints; tracks without a position take none."""
    at = keyed(tracks, "frame")
    held = tracks.dropna(subset=["x", "y"]).select(*at, F.concat_ws("|", "roi", F.col("track_id").cast("string")).alias("roi"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.struct("roi", "track_id").alias("who"))
    places = predictions.groupBy(*at, "inst").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    own = match_greedy(places, held.drop("who")).join(held.select(*at, "roi", "who"), [*at, "roi"]).select(*at, "inst", "who.roi", "who.track_id")
    return predictions.join(own, [*at, "inst"])


def uniform_sample(tracks: DataFrame, k: int) -> DataFrame:
    from .qc import even_positions

    return even_positions(tracks, keyed(tracks, "roi"), ["frame", "track_id"], k, nearest=True)


def top_candidates(cands: DataFrame, n: int = 5, area_min: float = 10, area_max: float = 1500) -> DataFrame:
    """The n largest of each arena and frame within the area range, by event on ties."""
    w = Window.partitionBy(*keyed(cands, "roi", "frame")).orderBy(F.desc("area"), "event_id")
    return cands.where(F.col("area").between(area_min, area_max)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, n))


def reading_order(circles: DataFrame, keep: int = 4) -> DataFrame:
    """The `keep` largest circles numbered in reading order: a new row begins where y leaves the running
    mean of the row by more than the median radius. A fold over at most `keep` circles."""
    top = circles.orderBy(F.desc("r"), "cx", "cy").limit(keep)
    own = top.agg(F.sort_array(F.collect_list(F.struct("cy", "cx", "r"))).alias("c"), F.greatest(F.lit(1.0), F.median("r")).alias("gap"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<row:int,cx:double,cy:double,r:double>>)").alias("out"))

    def step(a, c):
        fresh = (a["n"] == 0) | (F.abs(c["cy"] - a["sum"] / F.greatest(a["n"], F.lit(1))) > F.col("gap"))
        row = F.when(fresh, a["row"] + 1).otherwise(a["row"])
        return F.struct(row.alias("row"), F.when(fresh, c["cy"]).otherwise(a["sum"] + c["cy"]).alias("sum"), F.when(fresh, 1).otherwise(a["n"] + 1).alias("n"), F.concat(a["out"], F.array(F.struct(row.alias("row"), c["cx"].alias("cx"), c["cy"].alias("cy"), c["r"].alias("r")))).alias("out"))

    out = own.select(F.posexplode(F.sort_array(F.aggregate("c", start, step)["out"])).alias("i", "c"))
    return out.select(F.format_string("arena_%02d", F.col("i") + 1).alias("roi"), "c.cx", "c.cy", "c.r")


def largest(parts: DataFrame, n: int, key: list[str], order: list[str]) -> DataFrame:
    """The n first rows of each group in an order, or none of a group that has fewer."""
    w = Window.partitionBy(*key)
    first = F.row_number().over(w.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order]))
    return parts.withColumns({"rank": first, "_n": F.count("*").over(w)}).where((F.col("_n") >= n) & (F.col("rank") <= n)).drop("_n")


def round_parts(parts: DataFrame, key: list[str], apart: float, radii: tuple[float, float], round_min: float = 0.65, fill_min: float = 0.55) -> DataFrame:
    """key, cx, cy, r, score (to nine places) of the parts (area, perimeter, cx, cy, r) that look like disks, best first, each at least
    `apart` from the better ones. An image's parts are few, and folded in order."""
    circle = 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))
    fill = F.col("area") / (math.pi * F.col("r") * F.col("r"))
    own = parts.where((F.col("perimeter") > 0) & F.col("r").between(*radii)).withColumns({"_c": circle, "_f": fill}).where((F.col("_c") >= round_min) & (F.col("_f") >= fill_min))
    own = own.where(F.col("area").between(math.pi * radii[0] ** 2, math.pi * radii[1] ** 2))
    best = own.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.round(F.col("_c") * F.col("_f"), 9)).alias("s"), "cx", "cy", "r"))).alias("p"))
    empty = F.expr("cast(array() as array<struct<s:double,cx:double,cy:double,r:double>>)")
    near = lambda a, b: (a["cx"] - b["cx"]) * (a["cx"] - b["cx"]) + (a["cy"] - b["cy"]) * (a["cy"] - b["cy"]) < apart * apart
    kept = F.aggregate("p", empty, lambda held, c: F.when(F.exists(held, lambda h: near(h, c)), held).otherwise(F.concat(held, F.array(c))))
    return best.select(*key, F.explode(kept).alias("k")).select(*key, "k.cx", "k.cy", "k.r", (-F.col("k.s")).alias("score"))
