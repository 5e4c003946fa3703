"""Tables of videos: what probes found, discovery among paths, pairing with timing tables, frames to sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import keyed, linspace_index
from .readers import VIDEO_SUFFIXES

PROBED = ("fps", "frame_count", "width", "height")


def metadata(videos: DataFrame) -> DataFrame:
    """Probed values; 0 means that the container doesn't say, and becomes null."""
    return videos.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in PROBED if c in videos.columns})


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a name that begins with its only dot is all stem."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(name(path), r".\.([^.]*)$", 1))


def discovered(paths: DataFrame, top: str) -> DataFrame:
    """path, name of the video files directly in the folder `top`."""
    inside = folder(F.col("path")) == F.lit(top.rstrip("/") + "/")
    return paths.where(inside & suffix(F.col("path")).isin(*VIDEO_SUFFIXES)).select("path", name(F.col("path")).alias("name"))


def paired(paths: DataFrame) -> DataFrame:
    """path and timing of each video: the path of <stem>.csv beside it, or null."""
    own = paths.select("path", folder(F.col("path")).alias("_f"), stem(F.col("path")).alias("_s"), suffix(F.col("path")).alias("_x"))
    tables = own.where("_x = 'csv'").groupBy("_f", "_s").agg(F.min("path").alias("timing"))
    return own.where(F.col("_x").isin(*VIDEO_SUFFIXES)).join(tables, ["_f", "_s"], "left").select("path", "timing")


def assets(videos: DataFrame, timing: DataFrame) -> DataFrame:
    """Each video's metadata with its timing table's rows and span; a video without one isn't an asset."""
    own = timing.groupBy("video").agg(F.count("*").alias("n_rows"), F.min("t_s").alias("first_s"), F.max("t_s").alias("last_s"))
    return metadata(videos).join(own, "video")


def status(videos: DataFrame) -> DataFrame:
    """ok and reason of each probed video (exists, opens, decodes boolean, frame_count). One that decodes but reports no
    frames was never finished, and wants indexing."""
    n = F.coalesce("frame_count", F.lit(0))
    reason = F.when(~F.col("exists"), "not found").when(~F.col("opens"), "cannot open").when((n <= 0) & F.col("decodes"), "unindexed").when(n <= 0, "0 frames")
    return videos.withColumn("reason", F.coalesce(reason, F.format_string("%d frames", n))).withColumn("ok", reason.isNull())


def spaced(videos: DataFrame, k: int) -> DataFrame:
    """video, i, frame: k frames of each video's frame_count, evenly spread, truncated, repeated where it has fewer."""
    rows = videos.where("frame_count > 0").select("video", "frame_count", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    return rows.select("video", "i", linspace_index(F.col("i"), F.col("frame_count"), F.lit(k)).alias("frame"))


def every(frames: DataFrame, n_samples: int) -> DataFrame:
    """Frames (video, frame) whose number is a multiple of the video's frames by n_samples: about as many."""
    total = frames.groupBy(*keyed(frames)).agg((F.max("frame") + 1).alias("_n"))
    out = frames.join(F.broadcast(total), "video") if "video" in frames.columns else frames.crossJoin(F.broadcast(total))
    return out.where(F.col("frame") % F.greatest(F.lit(1), F.floor(F.col("_n") / n_samples)) == 0).drop("_n")


def consecutive(frames: DataFrame) -> DataFrame:
    """For each video whether its frames follow one another, so that they need no seeking."""
    own = frames.groupBy(*keyed(frames)).agg(F.count_distinct("frame").alias("_d"), F.count("*").alias("n"), (F.max("frame") - F.min("frame") + 1).alias("_span"))
    return own.withColumn("consecutive", (F.col("_d") == F.col("n")) & (F.col("n") == F.col("_span"))).drop("_d", "_span")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of each video in order."""
    w = Window.partitionBy(*keyed(df)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def output_path(path: Column, kind: str, fmt: str = "parquet", top: str = "") -> Column:
    """<top or the video's folder>/<stem>_<kind>.<fmt>"""
    base = F.lit(top.rstrip("/") + "/") if top else folder(path)
    return F.concat(base, stem(path), F.lit(f"_{kind}.{fmt}"))


def stale(files: DataFrame, staged: DataFrame) -> DataFrame:
    """Files (path, size, mtime) whose staged copy is missing, or of another size or time."""
    return files.join(staged.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
