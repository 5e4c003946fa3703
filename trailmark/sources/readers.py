"""Sources and sinks: timing tables, tracks, directories, sidecars."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import keyed

#: Suffixes of video files.
VIDEO_SUFFIXES = ("avi", "mp4", "mov", "mkv", "m4v")
#: Columns of the recorder's timing tables.
RECORDER = {"Item2.Value.Index": "frame", "Item2.Interval.TotalMilliseconds": "dt_s"}


def timing(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """frame, t_s, dt_s from timestamps (which win) or from intervals; the recorder's interval is taken as it is."""
    for old, new in RECORDER.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    if "frame" not in df.columns:
        raise ValueError("a timing table needs a frame column")
    key = key or keyed(df)
    w = Window.partitionBy(*key).orderBy("frame")  # without videos, the table is that of one
    keep = [*key, "frame"]
    if "timestamp_s" in df.columns:
        t = F.col("timestamp_s").cast("double")
        return df.select(*keep, t.alias("t_s"), F.coalesce(t - F.lag(t).over(w), F.lit(0.0)).alias("dt_s"))
    if "dt_s" in df.columns:
        dt = F.col("dt_s").cast("double")
        return df.select(*keep, F.sum(dt).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t_s"), dt.alias("dt_s"))
    raise ValueError("a timing table needs timestamp_s or dt_s")


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    return timing(spark.read.csv(path, header=True, inferSchema=True).withColumn("frame_", F.lit(None)).drop("frame_"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Tracks or poses by suffix: CSV, else Parquet."""
    return spark.read.csv(path, header=True, inferSchema=True) if path.lower().endswith(".csv") else spark.read.parquet(path)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, name of the video files directly in a folder, in order of name."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*VIDEO_SUFFIXES)).orderBy("name")


def chosen_format(path: str, fmt: str | None = None) -> str:
    """parquet or csv: an explicit format, else the suffix, else parquet."""
    if fmt:
        if fmt not in ("parquet", "csv"):
            raise ValueError(f"unknown format {fmt!r}")
        return fmt
    return "csv" if PurePosixPath(path).suffix.lower() == ".csv" else "parquet"


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "error") -> str:
    kind = chosen_format(path, fmt)
    (df.write.mode(mode).option("header", True).csv if kind == "csv" else df.write.mode(mode).parquet)(path)
    return path


def output_path(video: str, kind: str, fmt: str = "parquet", folder: str = "") -> str:
    """<folder or the video's folder>/<stem>_<kind>.<fmt>"""
    p = PurePosixPath(video)
    return str(PurePosixPath(folder or p.parent) / f"{p.stem}_{kind}.{fmt}")


def selection(text: str, n: int) -> list[int]:
    """Indices from '1,3-5'; all if blank."""
    if not text.strip():
        return list(range(n))
    out: list[int] = []
    for part in text.split(","):
        a, _, b = part.strip().partition("-")
        for i in range(int(a), int(b or a) + 1):
            if not 1 <= i <= n:
                raise ValueError(f"{i} isn't between 1 and {n}")
            if i - 1 not in out:
                out.append(i - 1)
    return out


def sidecar(rois: DataFrame, ports: DataFrame, video: str, width: int, height: int, diameter_mm: float | None) -> DataFrame:
    """A JSON row of the arenas by name, each with its circle and its port or null; none without arenas."""
    two = lambda c: F.round(c, 2)
    port = F.when(F.col("port_x").isNotNull(), F.struct(two("port_x").alias("cx"), two("port_y").alias("cy"), two("port_r").alias("r")))
    j = rois.join(ports, "roi", "left").select("roi", F.struct(F.struct(two("cx").alias("cx"), two("cy").alias("cy"), two("r").alias("r")).alias("roi"), port.alias("port")).alias("arena"))
    one = j.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("roi", "arena")))).alias("arenas"), F.count("*").alias("n")).where("n > 0")
    return one.select(F.to_json(F.struct(F.lit(video).alias("video"), F.array(F.lit(width), F.lit(height)).alias("image_size"), F.lit(diameter_mm or None).cast("double").alias("arena_diameter_mm"), "arenas"), {"ignoreNullFields": "false"}).alias("value"))


def spaced_frames(n: int, k: int) -> list[int]:
    """k frames of n, evenly spread, truncated; repeated where n < k."""
    return [int(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)] if n else []
