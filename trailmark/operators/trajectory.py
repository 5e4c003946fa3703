"""Dedupe, gap filling, strides, kinematics and fixture distances of tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import keyed, small, unwrapped_step

KEY = ("roi", "track_id")


def by_frame(tracks: DataFrame):
    """Rows of a track of a video in order."""
    return Window.partitionBy(*keyed(tracks, *KEY)).orderBy("frame")


def dedupe(tracks: DataFrame, tiebreak: str = "x") -> DataFrame:
    """One row of each (roi, track_id, frame): the least by `tiebreak`."""
    w = Window.partitionBy(*keyed(tracks, *KEY), "frame").orderBy(tiebreak)
    return tracks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def interpolated(v: str, position: Column, w) -> Column:
    """Linear by row position, the outermost values held beyond them."""
    known = F.when(F.col(v).isNotNull(), F.struct(position.alias("p"), F.col(v).alias("v")))
    lo = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    line = lo["v"] + (hi["v"] - lo["v"]) * (position - lo["p"]) / (hi["p"] - lo["p"])
    return F.coalesce(F.col(v), F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(line))


def interpolate(tracks: DataFrame, columns: list[str]) -> DataFrame:
    """Fills nulls of `columns` in each track."""
    w = by_frame(tracks)
    out = tracks.withColumn("_p", F.row_number().over(w))
    return out.withColumns({c: interpolated(c, F.col("_p"), w) for c in columns}).drop("_p")


def resample(tracks: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """Every track at every frame of its video in `frames` (video where there are several, frame, t_s): missing
    rows are added and interpolated."""
    key = keyed(tracks, *KEY)
    heads, times = tracks.select(*key).distinct(), frames.select(*keyed(frames, "frame"), F.col("t_s").alias("_t"))
    grid = heads.join(times, "video") if "video" in key and "video" in times.columns else heads.crossJoin(times)
    out = grid.join(tracks, [*key, "frame"], "left").withColumn("t_s", F.col("_t")).drop("_t")
    return interpolate(out, columns)


def stride_rows(tracks: DataFrame, n: int) -> DataFrame:
    """Every n-th row of each track."""
    return tracks.withColumn("_n", F.row_number().over(by_frame(tracks)) - 1).where(F.col("_n") % n == 0).drop("_n")


def stride_frames(tracks: DataFrame, n: int) -> DataFrame:
    """Rows whose frame is a multiple of n."""
    return tracks.where(F.col("frame") % n == 0)


def add_center(tracks: DataFrame, rois: DataFrame, diameter_mm: float = 75.0) -> DataFrame:
    """Offsets from the arena's centre. A row of an unknown arena is an error, raised when it is read."""
    place = keyed(rois, "roi")
    j = tracks.join(small(rois.select(*place, "cx", "cy", "r", F.lit(True).alias("_known"))), place, "left")
    lost = F.raise_error(F.concat(F.lit("unknown arena "), F.coalesce("roi", F.lit("null")))).cast("double")
    j = j.withColumn("cx", F.when(F.col("_known"), F.col("cx")).otherwise(lost)).drop("_known")
    px = 2 * F.col("r") / diameter_mm
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return j.withColumns({"dx_center_px": dx, "dy_center_px": dy, "r_center_px": F.hypot(dx, dy), "r_center_mm": F.hypot(dx, dy) / px, "x_mm": dx / px, "y_mm": dy / px, "px_per_mm": px}).drop("cx", "cy")


def _step(c: str, w) -> Column:
    return F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))


def rate(v: Column, dt: Column) -> Column:
    """Per second; 0 where no time has passed."""
    return F.when(dt > 0, v / dt).otherwise(0.0)


def add_kinematics(tracks: DataFrame, rois: DataFrame, diameter_mm: float = 75.0) -> DataFrame:
    """Steps and speeds; all windows share one exchange and sort."""
    w = by_frame(tracks)
    out = add_center(tracks, rois, diameter_mm).withColumns({"dt_s": _step("t_s", w), "dx_mm": _step("x_mm", w), "dy_mm": _step("y_mm", w)})
    return out.withColumn("speed_mm_s", rate(F.hypot("dx_mm", "dy_mm"), F.col("dt_s")))


def unwrap(tracks: DataFrame, angle: str = "angle_deg") -> DataFrame:
    """Angles in radians unwrapped in each track, back in degrees, with their steps and rates."""
    w = by_frame(tracks)
    a = F.radians(F.coalesce(F.when(~F.isnan(angle), F.col(angle)), F.lit(0.0)))
    out = tracks.withColumn("_a", a).withColumn("_c", F.coalesce(unwrapped_step(F.col("_a") - F.lag("_a").over(w), math.pi), F.lit(0.0)))
    total = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("angle_unwrapped_deg", F.degrees(F.col("_a") + total))
    dt = _step("t_s", w)
    return out.withColumns({"dangle_deg": _step("angle_unwrapped_deg", w), "_dt": dt}).withColumn("ang_speed_deg_s", rate(F.col("dangle_deg"), F.col("_dt"))).drop("_a", "_c", "_dt")


def unwrap_all(tracks: DataFrame, angle: str = "angle_deg") -> DataFrame:
    """Angles unwrapped along a video's whole table in order of roi, track_id, frame: corrections within
    tracks first, then running totals over the video's tracks."""
    w, key = by_frame(tracks), keyed(tracks, *KEY)
    out = tracks.withColumn("_a", F.radians(F.coalesce(F.col(angle), F.lit(0.0))))
    out = out.withColumn("_c", F.coalesce(unwrapped_step(F.col("_a") - F.lag("_a").over(w), math.pi), F.lit(0.0)))
    heads = out.groupBy(*key).agg(F.min_by("_a", "frame").alias("first"), F.max_by("_a", "frame").alias("last"), F.sum("_c").alias("own"))
    order = Window.partitionBy(*keyed(tracks)).orderBy(*KEY)
    entry = F.coalesce(unwrapped_step(F.col("first") - F.lag("last").over(order), math.pi), F.lit(0.0))
    heads = heads.withColumn("_e", entry)
    base = F.sum(F.col("_e") + F.col("own")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
    heads = heads.select(*key, base.alias("_base"))
    total = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_t", total).join(heads, key).withColumn("angle_unwrapped_deg", F.degrees(F.col("_a") + F.col("_t") + F.col("_base"))).drop("_a", "_c", "_t", "_base")


def add_port_distance(tracks: DataFrame, ports: DataFrame, rois: DataFrame, diameter_mm: float = 75.0) -> DataFrame:
    """Distance to the arena's port; null without one, the metric one also without an arena radius."""
    at, place = keyed(ports, "roi"), keyed(rois, "roi")
    j = tracks.join(small(ports.select(*at, "port_x", "port_y")), at, "left").join(small(rois.select(*place, F.col("r").alias("_r"))), place, "left")
    px = F.hypot(F.col("x") - F.col("port_x"), F.col("y") - F.col("port_y"))
    return j.withColumns({"dist_to_port_px": px, "dist_to_port_mm": F.when(F.col("_r") > 0, px * diameter_mm / (2 * F.col("_r")))}).drop("port_x", "port_y", "_r")


def port_offsets(ports: DataFrame, rois: DataFrame) -> DataFrame:
    """Offset of each port as a share of its arena's radius, and the median port radius."""
    j = ports.join(small(rois), "roi")
    shared = ports.agg(F.median("port_r").alias("shared_r"))
    return j.crossJoin(F.broadcast(shared)).withColumn("offset_frac", F.hypot(F.col("port_x") - F.col("cx"), F.col("port_y") - F.col("cy")) / F.greatest(F.lit(1.0), F.col("r")))
