"""Quality flags, reports, histograms and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bucket, has, keyed, linspace_index, small
from .trajectory import KEY, by_frame

FLAGS = ("area", "jump", "crop_oob", "multi", "low_contrast")
#: Short names in labels.
SHORT = {"area": "area", "jump": "jump", "crop_oob": "oob", "multi": "multi", "low_contrast": "lowC"}


def flags(tracks: DataFrame, width: int = 0, height: int = 0, crop_size: int = 96, area_min: float = 10, area_max: float = 1500, max_jump: float = 40.0, min_contrast: float = 10.0) -> DataFrame:
    """Five boolean flags; those whose columns are absent are false."""
    w, no = by_frame(tracks), F.lit(False)
    out = {f"flag_{f}": no for f in FLAGS}
    if has(tracks, "area"):
        out["flag_area"] = (F.col("area") < area_min) | (F.col("area") > area_max)
    out["flag_jump"] = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > max_jump
    half = crop_size / 2
    if half > 0 and width > 0 and height > 0:
        out["flag_crop_oob"] = (F.col("x") - half < 0) | (F.col("y") - half < 0) | (F.col("x") + half > width) | (F.col("y") + half > height)
    if has(tracks, "n_candidates"):
        out["flag_multi"] = F.coalesce("n_candidates", F.lit(1)) > 1
    if has(tracks, "contrast"):
        out["flag_low_contrast"] = F.col("contrast").isNotNull() & (F.col("contrast") < min_contrast)
    return tracks.withColumns({k: F.coalesce(v, no) for k, v in out.items()})


def flag_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.concat_ws(",", *[F.when(F.col(f"flag_{f}"), SHORT[f]) for f in FLAGS]))


def missing_report(tracks: DataFrame, frame_count: int | None = None) -> DataFrame:
    """Frames present, expected (by the video's last) and missing of each arena that has any."""
    own = tracks.groupBy(*keyed(tracks, "roi")).agg(F.count_distinct("frame").alias("frames_present"), F.max("frame").alias("_m"))
    expected = F.lit(frame_count).cast("long") if frame_count is not None else F.max("_m").over(Window.partitionBy(*keyed(tracks))) + 1
    out = own.withColumn("frames_expected", expected.cast("long"))
    missing = F.greatest(F.lit(0), F.col("frames_expected") - F.col("frames_present"))
    return out.withColumn("frames_missing", missing).withColumn("missing_fraction", F.when(F.col("frames_expected") > 0, F.col("frames_missing") / F.col("frames_expected")).otherwise(0.0)).drop("_m")


def summarize(df: DataFrame, rois: DataFrame | None = None, frame_count: int | None = None, low_activity: float = 0.05, edge: float = 0.9) -> DataFrame:
    """Per arena: missing report, flag counts, speed, area and contrast, share of time at the wall."""
    if rois is not None and "r" not in df.columns:
        df = df.join(small(rois.select(*keyed(rois, "roi"), "r")), keyed(rois, "roi"), "left")
    at_wall = F.coalesce(F.col("r_center_px") > 0.85 * F.col("r"), F.lit(False)) if has(df, "r_center_px", "r") else None
    aggs = [F.sum(F.col(f"flag_{f}").cast("long")).alias(f"n_{f}") for f in FLAGS]
    if has(df, "speed_mm_s"):
        aggs += [F.avg("speed_mm_s").alias("speed_mm_s_mean"), F.max("speed_mm_s").alias("speed_mm_s_max"), (F.avg("speed_mm_s") < low_activity).alias("low_activity")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in ("area", "contrast") if has(df, c)]
    if at_wall is not None:
        aggs += [F.avg(at_wall.cast("double")).alias("wall_fraction")]
    place = keyed(df, "roi")
    out = missing_report(df, frame_count).join(df.groupBy(*place).agg(*aggs), place)
    return out.withColumn("edge_pinned", F.col("wall_fraction") > edge) if at_wall is not None else out


def run_summary(summary: DataFrame) -> DataFrame:
    return summary.groupBy(*keyed(summary)).agg(F.count("*").alias("n_rois"), F.max("frames_expected").alias("n_frames"), F.sum(F.coalesce(F.col("edge_pinned"), F.lit(False)).cast("long")).alias("n_edge_pinned"), F.sum(F.coalesce(F.col("low_activity"), F.lit(False)).cast("long")).alias("n_low_activity"))


def coverage(tracks: DataFrame, bins: int = 2000) -> DataFrame:
    """Share of a video's frames seen in each of `bins` stretches of time, every bin of every arena."""
    place = keyed(tracks, "roi")
    own = tracks.select(*place, "frame").distinct()
    n = own.groupBy(*keyed(tracks)).agg((F.max("frame") + 1).alias("n")).withColumn("nb", F.least(F.col("n"), F.lit(bins)))
    # a row for each video
    among = lambda df: df.join(F.broadcast(n), "video") if "video" in place else df.crossJoin(F.broadcast(n))
    at = F.least(F.floor(F.col("frame") * F.col("nb") / F.col("n")), F.col("nb") - 1).cast("int")
    seen = among(own).groupBy(*place, at.alias("bin")).agg(F.count("*").alias("c"))
    grid = among(tracks.select(*place).distinct()).withColumn("bin", F.explode(F.expr("sequence(0, cast(nb - 1 as int))")))
    width = F.col("n") / F.col("nb")
    return grid.join(seen, [*place, "bin"], "left").select(*place, "bin", F.least(F.lit(1.0), F.coalesce("c", F.lit(0)) / width).alias("coverage"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts per arena in equal bins from its least to its largest value."""
    place, own = keyed(df, "roi"), df.where(F.col(value).isNotNull())
    ends = own.groupBy(*place).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # a row for each arena
    return own.join(F.broadcast(ends), place).groupBy(*place, bucket(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def occupancy(df: DataFrame, bins: int = 50) -> DataFrame:
    place, own = keyed(df, "roi"), df.where("x is not null and y is not null")
    ends = own.groupBy(*place).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return own.join(F.broadcast(ends), place).groupBy(*place, bucket(F.col("x"), F.col("x0"), F.col("x1"), bins).alias("bx"), bucket(F.col("y"), F.col("y0"), F.col("y1"), bins).alias("by")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def flagged(df: DataFrame) -> DataFrame:
    any_flag = F.lit(False)
    for f in FLAGS:
        any_flag = any_flag | F.col(f"flag_{f}")
    return df.where(any_flag)


def spread(df: DataFrame, k: int) -> DataFrame:
    """k rows of each video spread evenly over its rows in order of roi, track_id, frame. A row's position is
    its place in its track and the rows of the tracks before, counted in a table of tracks."""
    video, track = keyed(df), keyed(df, *KEY)
    sizes = df.groupBy(*track).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*video).orderBy(*KEY)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_base": before, "_all": F.sum("_n").over(Window.partitionBy(*video))})
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: linspace_index(i, F.col("_all"), F.lit(k)).cast("long") - F.col("_base"))
    # only the tracks that hold a position are read in order
    sizes = sizes.withColumn("_at", F.filter(spots, lambda p: (p >= 0) & (p < F.col("_n")))).where(f"_all <= {k} or size(_at) > 0")
    out = df.join(sizes.select(*track, "_all", "_at"), track).withColumn("_i", F.row_number().over(by_frame(df)) - 1)
    return out.where((F.col("_all") <= k) | F.array_contains("_at", F.col("_i").cast("long"))).select(*df.columns)


def follow(track: DataFrame, frames: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Last known centre at each frame, the first one before any, of each of `keys`: an as-of join as one window."""
    rows = track.select(*keys, "frame", F.struct("x", "y").alias("c"), F.lit(0).alias("ask")).unionByName(frames.select(*keys, "frame", F.lit(None).cast("struct<x:double,y:double>").alias("c"), F.lit(1).alias("ask")))
    w = Window.partitionBy(*keys).orderBy("frame", "ask")
    back = F.last("c", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("c", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("c", F.coalesce(back, ahead)).where("ask = 1").select(*keys, "frame", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


def trail(tracks: DataFrame, n: int) -> DataFrame:
    """Points of the last n frames before each row, and where they begin."""
    w = by_frame(tracks).rangeBetween(-n + 1, 0)
    return tracks.withColumns({"n_points": F.count("*").over(w), "first_x": F.first("x").over(w)})


def stuck(tracks: DataFrame, rois: DataFrame, n_frames: int, threshold: float = 0.8) -> DataFrame:
    """Coverage of each arena; one without any row counts as covered."""
    place = keyed(tracks, "roi")
    own = tracks.groupBy(*place).agg((F.count("*") / max(1, n_frames)).alias("coverage"))
    all_places = rois.select(*keyed(rois, "roi"))
    if "video" in place and "video" not in all_places.columns:
        all_places = F.broadcast(all_places).crossJoin(tracks.select("video").distinct())  # arenas, a few, of each video
    return all_places.join(own, place, "left").withColumn("coverage", F.coalesce("coverage", F.lit(1.0))).withColumn("is_stuck", F.col("coverage") < threshold)


def main_track(tracks: DataFrame) -> DataFrame:
    """The most frequent track of each arena, the smaller id on ties."""
    place = keyed(tracks, "roi")
    n = tracks.groupBy(*place, "track_id").agg(F.count("*").alias("n"))
    return n.groupBy(*place).agg(F.max(F.struct("n", (-F.col("track_id")).alias("t"))).alias("m")).select(*place, (-F.col("m.t")).alias("track_id"), F.col("m.n").alias("n"))


#: Frames of a stretch that is read in order when a few positions are wanted.
STRETCH = 4096


def even_positions(df: DataFrame, key: list[str], order: list[str], k: int, nearest: bool = False) -> DataFrame:
    """k rows of each group, evenly spread over its order (truncated or nearest positions). The order begins with
    the frame; stretches of frames are counted first, and only those that hold a position are read in order."""
    out = df.withColumn("_b", F.floor(F.col(order[0]) / STRETCH).cast("long"))
    sizes = out.groupBy(*key, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_base": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*key))})
    place = lambda i: F.rint(i * (F.col("_all") - 1) / (k - 1)).cast("long") if nearest else linspace_index(i, F.col("_all"), F.lit(k)).cast("long")
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: place(i) - F.col("_base"))
    sizes = sizes.withColumn("_at", F.filter(spots, lambda p: (p >= 0) & (p < F.col("_n")))).where(f"_all <= {k} or size(_at) > 0")
    out = out.join(sizes.select(*key, "_b", "_all", "_at"), [*key, "_b"]).withColumn("_i", F.row_number().over(Window.partitionBy(*key, "_b").orderBy(*order)) - 1)
    return out.where((F.col("_all") <= k) | F.array_contains("_at", F.col("_i").cast("long"))).select(*df.columns)


def flagged_frames(df: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames (of a video) in which any row has a flag, of those of `frames`."""
    on = [c for c in keyed(df, "frame") if c in frames.columns]
    return frames.join(flagged(df).select(*on).distinct(), on, "left_semi")


def draw_list(tracks: DataFrame, rois: DataFrame, ports: DataFrame, trail_frames: int = 10) -> DataFrame:
    """What an overlay draws on each frame, as rows (video, roi, frame, kind, x, y, r, text): a point for each track with
    its flags' label, where its trail begins, and the line's end at the arena's port; arenas and ports are circles
    of every frame, with null frames."""
    place = keyed(tracks, "roi")
    near = trail(flag_label(tracks), trail_frames + 1)
    near = near.join(small(ports.select(*keyed(ports, "roi"), "port_x", "port_y")), keyed(ports, "roi"), "left")
    none = F.lit(None).cast("double")
    part = lambda kind, x, y, text=None: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), none.alias("r"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    parts = F.array(part("point", F.col("x"), F.col("y"), F.col("label")), part("trail", F.col("first_x"), F.col("first_y")), part("port_line", F.col("port_x"), F.col("port_y")))
    w = by_frame(tracks).rangeBetween(-trail_frames, 0)
    near = near.withColumn("first_y", F.first("y").over(w)).withColumn("d", F.explode(parts)).where("d.x is not null").select(*place, "frame", "d.*")
    frames = F.lit(None).cast("bigint").alias("frame")
    videos = tracks.select(*place).distinct()
    circle = lambda df, kind, x, y, r, text: videos.join(F.broadcast(df), keyed(df, "roi")).select(*place, frames, F.lit(kind).alias("kind"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(r).alias("r"), text.alias("text"))
    return near.unionByName(circle(rois, "arena", "cx", "cy", "r", F.col("roi"))).unionByName(circle(ports, "port", "port_x", "port_y", "port_r", F.lit(None).cast("string")))
