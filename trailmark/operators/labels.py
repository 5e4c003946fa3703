"""Hand labels of keypoints: building, editing, the long table, and files.

A label has roi, frame, track_id, t_s, the crop's centre x and y, labeled, bad, and points, a map from
keypoint to its place in the crop.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import keyed
from . import pose
from .geometry import crop_origin, seed_keypoints

KEY = ["roi", "frame", "track_id"]
#: Keypoints that mirror each other.
PAIRS = (("wingL", "wingR"),)
_FILE = "video_path string, crop_size int, frames array<struct<roi string, frame bigint, track_id bigint, t_s double, cx double, cy double, bad_frame boolean, labeled boolean, points map<string, array<string>>>>"


def seeded(tracks: DataFrame, size: int = 96) -> DataFrame:
    """Labels with first guesses from the ellipse, none confirmed yet."""
    point = F.struct(F.col("x_crop").alias("x"), F.col("y_crop").alias("y"), F.lit(True).alias("visible"), F.lit(0.0).alias("score"))
    rows = seed_keypoints(tracks, size).groupBy(*keyed(tracks, *KEY), "t_s", "x", "y").agg(F.map_from_entries(F.collect_list(F.struct("keypoint", point))).alias("points"))
    return rows.withColumns({"labeled": F.lit(False), "bad": F.lit(False)})


def build(tracks: DataFrame, n: int, size: int = 96) -> DataFrame:
    """Labels for n diverse rows."""
    key = keyed(tracks, *KEY)
    return seeded(tracks.join(pose.diversity_sample(tracks, n).select(*key), key, "left_semi"), size)


def swap(labels: DataFrame, where: Column, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """Mirrored keypoints exchanged where the condition holds."""
    other = F.create_map(*[F.lit(x) for a, b in pairs for x in (a, b, b, a)])
    moved = F.transform_keys("points", lambda k, _: F.coalesce(other[k], k))
    return labels.withColumn("points", F.when(where, moved).otherwise(F.col("points")))


def nearest_node(labels: DataFrame, x: Column, y: Column, reach: float = 12.0) -> DataFrame:
    """The keypoint nearest to a place in the crop, null beyond reach; the first by name on ties."""
    near = F.transform(F.map_entries("points"), lambda e: F.struct(F.hypot(e["value"]["x"] - x, e["value"]["y"] - y).alias("d"), e["key"].alias("node")))
    best = F.array_min(F.filter(near, lambda e: e["d"] <= reach))
    return labels.withColumn("node", best["node"])


def manifest(labels: DataFrame, size: int = 96, only_labeled: bool = True) -> DataFrame:
    """A row for each label and keypoint, in the coordinates of frame and crop."""
    rows = labels.where("labeled and not bad") if only_labeled else labels
    key = keyed(rows, *KEY)
    rows = rows.select(*key, "t_s", "x", "y", F.explode("points").alias("keypoint", "p"))
    return rows.select(*key, "t_s", "keypoint", (F.col("p.x") + crop_origin(F.col("x"), size)).alias("x_full"), (F.col("p.y") + crop_origin(F.col("y"), size)).alias("y_full"), F.col("p.x").alias("x_crop"), F.col("p.y").alias("y_crop"), "p.visible", "p.score")


def save(labels: DataFrame, path: str | Path, skeleton: dict, video: str = "", size: int = 96) -> None:
    """One JSON document, replaced at once. Labels are made by hand; rows pass the driver one by one."""
    path = Path(path)
    part = path.with_name(path.name + ".part")
    with part.open("w", encoding="utf-8") as f:
        f.write(json.dumps({"skeleton": skeleton, "video_path": video, "crop_size": size})[:-1] + ', "frames": [')
        for i, r in enumerate(labels.orderBy(*KEY).toLocalIterator()):
            own = {"roi": r["roi"], "frame": r["frame"], "track_id": r["track_id"], "t_s": r["t_s"], "cx": r["x"], "cy": r["y"], "bad_frame": r["bad"], "labeled": r["labeled"], "points": {k: list(p) for k, p in r["points"].items()}}
            f.write((",\n" if i else "\n") + json.dumps(own))
        f.write("\n]}\n")
    os.replace(part, path)


def load(spark: SparkSession, path: str | Path) -> DataFrame:
    """Labels of a file; a point without them is visible, with score 1."""
    rows = spark.read.schema(_FILE).json(str(path), multiLine=True).select(F.explode("frames").alias("f")).select("f.*")
    part = lambda p, i, kind: F.get(p, F.lit(i)).cast(kind)
    points = F.transform_values("points", lambda _, p: F.struct(part(p, 0, "double").alias("x"), part(p, 1, "double").alias("y"), F.coalesce(part(p, 2, "boolean"), F.lit(True)).alias("visible"), F.coalesce(part(p, 3, "double"), F.lit(1.0)).alias("score")))
    return rows.select(*KEY, "t_s", F.col("cx").alias("x"), F.col("cy").alias("y"), points.alias("points"), F.coalesce("labeled", F.lit(False)).alias("labeled"), F.coalesce("bad_frame", F.lit(False)).alias("bad"))
