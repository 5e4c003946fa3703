"""Keypoints from crops by an engine: a function of (n, size, size) images that returns
places (n, k, 2) in the crop and scores (n, k)."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import keyed, small
from .geometry import roi_origin

KEY = ["roi", "track_id", "frame", "t_s"]
_FOUND = "{0}roi string, track_id bigint, frame bigint, t_s double, crop_x0_full int, crop_y0_full int, out_of_bounds boolean, keypoint string, x_crop double, y_crop double, score double"


def mock(offsets: Sequence[tuple[float, float]]) -> Callable:
    """An engine that places keypoints at fixed shares of the crop's side from its centre, with score 1."""

    def run(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = images.shape[2]
        places = side / 2 + side * np.asarray(offsets, dtype=np.float64)
        return np.broadcast_to(places, (len(images), *places.shape)), np.ones((len(images), len(places)))

    return run


def infer(crops: DataFrame, engine: Callable, names: Sequence[str], size: int, rois: DataFrame | None = None) -> DataFrame:
    """The long pose table of crops (key, crop_x0_full, crop_y0_full, out_of_bounds, pixels binary), in coordinates
    of frame, arena and crop. Arrow batches are the engine's batches. Arena coordinates are null for unknown arenas."""
    import pandas as pd

    own, k = [*keyed(crops, *KEY), "crop_x0_full", "crop_y0_full", "out_of_bounds"], len(names)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            images = np.frombuffer(b"".join(b["pixels"]), np.uint8).reshape(len(b), size, size)
            places, scores = engine(images)
            out = b[own].loc[b.index.repeat(k)].reset_index(drop=True)
            at = np.asarray(places).reshape(-1, 2)
            yield pd.concat([out, pd.DataFrame({"keypoint": list(names) * len(b), "x_crop": at[:, 0], "y_crop": at[:, 1], "score": np.asarray(scores).reshape(-1)})], axis=1)

    found = crops.select(*own, "pixels").mapInPandas(run, _FOUND.format("video string, " if "video" in own else ""))
    found = found.withColumns({"x_full": F.col("x_crop") + F.col("crop_x0_full"), "y_full": F.col("y_crop") + F.col("crop_y0_full")}).drop("crop_x0_full", "crop_y0_full")
    if rois is None:
        return found.withColumns({"x_roi": F.lit(None).cast("double"), "y_roi": F.lit(None).cast("double")})
    origins = small(rois.select("roi", roi_origin(F.col("cx"), F.col("r")).alias("_x0"), roi_origin(F.col("cy"), F.col("r")).alias("_y0")))
    return found.join(origins, "roi", "left").withColumns({"x_roi": F.col("x_full") - F.col("_x0"), "y_roi": F.col("y_full") - F.col("_y0")}).drop("_x0", "_y0")


def gate_contrast(cands: DataFrame, least: float = 0.0, darkness: float = 0.0, max_jump: float = 40.0, key: list[str] | None = None, tiebreak: str = "event_id") -> DataFrame:
    """Candidates (contrast, and the predicted place px, py) of enough contrast; with a weight for darkness, the best of
    each frame: distance in jumps less the weighted share of the frame's highest contrast."""
    known = F.col("contrast").isNotNull() & ~F.isnan("contrast")
    kept = cands.where(known & (F.col("contrast") >= least)) if least > 0 else cands
    if darkness <= 0:
        return kept
    by = Window.partitionBy(*(key or keyed(cands, "roi", "frame")))
    top = F.coalesce(F.max(F.when(known, F.col("contrast"))).over(by), F.lit(1.0))
    share = F.when(known, F.col("contrast") / F.when(top == 0, 1.0).otherwise(top)).otherwise(0.0)
    score = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) / max(1e-6, max_jump) - darkness * share
    return kept.withColumn("score", score).withColumn("_n", F.row_number().over(by.orderBy("score", tiebreak))).where("_n = 1").drop("_n")


def run(crops: DataFrame, tracks: DataFrame, engine, names: Sequence[str], size: int, rois: DataFrame | None = None) -> DataFrame:
    """By what the engine can do: one with `predict` (a function of the tracks that gives the keypoints of whole instances)
    has them matched to tracks; any other reads crops."""
    if hasattr(engine, "predict"):
        from .pose import instances

        return instances(engine.predict(tracks), tracks)
    return infer(crops, engine, names, size, rois)


def build(backend: str, names: Sequence[str]) -> Callable:
    """The engine of a backend: "mock", which places the keypoints in the crop's middle; others are not shipped."""
    if backend in ("", "mock"):
        return mock([(0.0, 0.0)] * len(names))
    raise ImportError(f"no engine {backend!r} here: pass one, a function of images or an object with predict(tracks)")


def segmenter(backend: str = "classical", engine: Callable | None = None) -> Callable:
    """What finds a port in an image, given its middle and radius: the radial edge filter, or an engine of one's own.
    Where none is given for another backend, a warning is issued and the filter serves."""
    from .kernels import find_port

    if engine is not None:
        return engine
    if backend not in ("", "classical"):
        warnings.warn(f"no port engine {backend!r} here; the classical one serves", stacklevel=2)
    return find_port
