"""Coordinate systems, crops and detector scaling: column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import half_even, keyed, small, trunc_int


def scaled_to_full(v: Column, scale: float, origin: Column | float) -> Column:
    return v * scale + origin


def full_to_scaled(v: Column, scale: float, origin: Column | float) -> Column:
    return (v - origin) / scale


def roi_origin(c: Column, r: Column) -> Column:
    """Corner of an arena's box: truncated, not below 0."""
    return trunc_int(F.greatest(F.lit(0.0), c - r))


def add_roi_local(tracks: DataFrame, rois: DataFrame) -> DataFrame:
    """x_roi, y_roi; rows of unknown arenas keep full coordinates."""
    place = keyed(rois, "roi")
    origins = rois.select(*place, roi_origin(F.col("cx"), F.col("r")).alias("_x0"), roi_origin(F.col("cy"), F.col("r")).alias("_y0"))
    out = tracks.join(small(origins), place, "left")
    return out.withColumns({"x_roi": F.col("x") - F.coalesce("_x0", F.lit(0)), "y_roi": F.col("y") - F.coalesce("_y0", F.lit(0))}).drop("_x0", "_y0")


def crop_origin(c: Column, size: int) -> Column:
    return half_even(c) - size // 2


def clamped_origin(c: Column, size: int, extent: int) -> Column:
    """Origin of a crop around a place, kept inside an image where the crop fits into it."""
    return F.greatest(F.lit(0), F.least(half_even(c) - size // 2, F.lit(extent - size)))


def display_to_crop(v: Column, zoom: Column | float) -> Column:
    """A place on a magnified crop, in the crop's pixels."""
    return v / zoom


def crop_to_display(v: Column, zoom: Column | float) -> Column:
    return v * zoom


def crop_manifest(tracks: DataFrame, size: int = 96, every: int = 1, width: int | None = None, height: int | None = None) -> DataFrame:
    """Crop origins of every n-th frame, positions in the crop, whether a side lies outside."""
    x0, y0 = crop_origin(F.col("x"), size), crop_origin(F.col("y"), size)
    out = tracks.where(F.col("frame") % every == 0).withColumns({"crop_size": F.lit(size), "crop_x0_full": x0, "crop_y0_full": y0})
    beyond = (F.col("crop_x0_full") < 0) | (F.col("crop_y0_full") < 0)
    if width:
        beyond = beyond | (F.col("crop_x0_full") + size > width)
    if height:
        beyond = beyond | (F.col("crop_y0_full") + size > height)
    return out.withColumns({"x_crop": F.col("x") - F.col("crop_x0_full"), "y_crop": F.col("y") - F.col("crop_y0_full"), "out_of_bounds": F.coalesce(beyond, F.lit(False))})


def crop_geometry(rois: DataFrame, downscale: int) -> DataFrame:
    """Crop side (a multiple of twice the downscale), origin and scaled side of each arena."""
    side = trunc_int(2 * F.col("r"))
    side = side - side % (2 * downscale)
    return rois.withColumns({"crop": side, "x0": roi_origin(F.col("cx"), F.col("r")), "y0": roi_origin(F.col("cy"), F.col("r")), "scaled": (side / downscale).cast("int")})


def rescale_detection(scales: DataFrame, area_min: int = 10, area_max: int = 1500, morph_open: int = 3, morph_close: int = 5, reference: int = 2) -> DataFrame:
    """Detector parameters at a downscale, from those at the reference downscale."""
    f = F.lit(float(reference)) / F.col("downscale")
    scaled = lambda v, g: F.greatest(F.lit(1), half_even(v * g))
    return scales.withColumns({"area_min": scaled(area_min, f * f), "area_max": scaled(area_max, f * f), "morph_open": scaled(morph_open, f), "morph_close": scaled(morph_close, f)})


def ellipse_angle(cv_angle: Column) -> Column:
    return cv_angle - 90


def rescale_observation(df: DataFrame, scale: float) -> DataFrame:
    return df.withColumns({"major": F.col("major") * scale, "minor": F.col("minor") * scale, "area": F.col("area") * scale**2, "contour_n": F.lit(0)})


def seed_keypoints(tracks: DataFrame, size: int = 96) -> DataFrame:
    """First guesses of five keypoints from the ellipse, in crop coordinates within [0, size]."""
    cx, cy = F.col("x") - crop_origin(F.col("x"), size), F.col("y") - crop_origin(F.col("y"), size)
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (c != 0)
    major = F.when(ok(F.col("major")), F.col("major")).otherwise(0.4 * size)
    minor = F.when(ok(F.col("minor")), F.col("minor")).otherwise(0.2 * size)
    a = F.radians(F.coalesce("angle_deg", F.lit(0.0)))
    ux, uy = F.cos(a), F.sin(a)
    along = {"head": (0.5, 0.0), "thorax": (0.0, 0.0), "abdomen": (-0.5, 0.0), "wingL": (-0.25, 0.5), "wingR": (-0.25, -0.5)}
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(size)), v))
    points = [F.struct(F.lit(n).alias("keypoint"), clamp(cx + p * major * ux - q * minor * uy).alias("x_crop"), clamp(cy + p * major * uy + q * minor * ux).alias("y_crop")) for n, (p, q) in along.items()]
    return tracks.withColumn("_p", F.explode(F.array(*points))).select(*tracks.columns, "_p.*")


def window_of_roi(tracks: DataFrame, rois: DataFrame, pad: float = 0.06, extra: float = 120.0, floor: float = 160.0) -> DataFrame:
    """View window of each arena: its box, or the squared extent of its points with a margin."""
    place = keyed(tracks, "roi")
    span = tracks.groupBy(*place).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    side = F.greatest(F.col("b") - F.col("a"), F.col("d") - F.col("c"))
    half = F.greatest(side * (1 + 2 * pad) + 2 * extra, F.lit(floor)) / 2
    mx, my = (F.col("a") + F.col("b")) / 2, (F.col("c") + F.col("d")) / 2
    known = F.col("r").isNotNull()
    j = span.join(small(rois), keyed(rois, "roi"), "left")
    pick = lambda a, b: F.when(known, a).otherwise(b)
    return j.select(*place, pick(F.col("cx") - F.col("r"), mx - half).alias("x0"), pick(F.col("cy") - F.col("r"), my - half).alias("y0"), pick(F.col("cx") + F.col("r"), mx + half).alias("x1"), pick(F.col("cy") + F.col("r"), my + half).alias("y1"))
