"""Centroid linking: one step function, in batch and in streams."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import keyed


@dataclass
class Settings:
    max_jump: float = 40.0
    miss_tolerance: int = 15
    use_kalman: bool = False
    smoothing: bool = False
    centers: dict[str, tuple[float, float]] = field(default_factory=dict)


class ConstantVelocity:
    """Kalman filter of position and velocity in single precision. Both axes start alike and have the same noise, so
    that one covariance (position, both, velocity) serves the two, and an axis needs its position and velocity only."""

    Q, R, ONE = np.float32(1e-2), np.float32(1e-1), np.float32(1)

    def __init__(self, x: float, y: float):
        zero = np.float32(0)
        self.x, self.y, self.vx, self.vy = np.float32(x), np.float32(y), zero, zero
        self.a, self.b, self.c = self.ONE, zero, self.ONE

    def predict(self) -> tuple[float, float]:
        self.x, self.y = self.x + self.vx, self.y + self.vy
        ab, bc = self.a + self.b, self.b + self.c
        self.a, self.b, self.c = ab + bc + self.Q, bc, self.c + self.Q
        return float(self.x), float(self.y)

    def correct(self, x: float, y: float) -> tuple[float, float]:
        total = self.a + self.R
        k, g = self.a / total, self.b / total
        dx, dy = np.float32(x) - self.x, np.float32(y) - self.y
        self.x, self.y, self.vx, self.vy = self.x + k * dx, self.y + k * dy, self.vx + g * dx, self.vy + g * dy
        self.a, self.b, self.c = (self.ONE - k) * self.a, (self.ONE - k) * self.b, self.c - g * self.b
        return float(self.x), float(self.y)

    def state(self) -> list[float]:
        return [float(v) for v in (self.x, self.y, self.vx, self.vy, self.a, self.b, self.c)]

    @classmethod
    def of(cls, state: list[float]) -> ConstantVelocity:
        k = cls(0, 0)
        k.x, k.y, k.vx, k.vy, k.a, k.b, k.c = map(np.float32, state)
        return k


class Linker:
    """The track of one arena. step() takes a frame's candidates (x, y, area), largest first."""

    def __init__(self, settings: Settings, center: tuple[float, float] = (0.0, 0.0)):
        self.s, self.center = settings, center
        self.last: tuple[float, float] | None = None
        self.misses = 0
        self.filter: ConstantVelocity | None = None

    def seed(self, at: tuple[float, float]) -> None:
        self.last, self.misses = at, 0
        self.filter = ConstantVelocity(*at) if self.s.use_kalman else None

    def step(self, found: list[tuple[float, float, float]]) -> dict:
        """Emitted position or None, gate, prediction, whether it missed."""
        largest = max(found, key=lambda c: c[2]) if found else None
        if self.last is None:
            self.seed(largest[:2] if largest else self.center)
        at = self.filter.predict() if self.filter and not self.misses else self.last
        gate = self.s.max_jump * (1 + self.misses)
        near = min(found, key=lambda c: math.hypot(c[0] - at[0], c[1] - at[1]), default=None)
        out = {"x": None, "y": None, "gate": gate, "pred": at, "missed": True, "chosen": -1}
        if near is None or math.hypot(near[0] - at[0], near[1] - at[1]) > gate:
            self.misses += 1
            if self.misses > self.s.miss_tolerance:
                self.seed(largest[:2] if largest else self.center)
                if largest:
                    out |= {"x": largest[0], "y": largest[1], "missed": False, "chosen": found.index(largest)}
            return out
        recovering, self.misses, self.last = self.misses > 0, 0, near[:2]
        emitted = near[:2]
        if self.s.use_kalman:
            if recovering or self.filter is None:
                self.filter = ConstantVelocity(*near[:2])
            else:
                corrected = self.filter.correct(*near[:2])
                emitted = corrected if self.s.smoothing else emitted
        return out | {"x": emitted[0], "y": emitted[1], "missed": False, "chosen": found.index(near)}

    def state(self) -> tuple:
        return (*(self.last or (None, None)), self.misses, self.filter.state() if self.filter else None)

    def restore(self, lx, ly, misses, kalman) -> Linker:
        self.last, self.misses = (None if lx is None else (lx, ly)), misses
        self.filter = ConstantVelocity.of(kalman) if kalman else None
        return self


CANDIDATES = "array<struct<key:double,event_id:bigint,x:double,y:double,area:double>>"


def dense(cands: DataFrame, n_frames: int | None = None, top: int = 5) -> DataFrame:
    """(video,) roi, frame, cs: the frame's largest candidates, an empty list where there are none, so that gates
    grow over gaps; up to n_frames, or to the last frame of the video's candidates."""
    place = keyed(cands, "roi")
    own = cands.groupBy(*place, "frame").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("area")).alias("key"), "event_id", "x", "y", "area"))), 1, top).alias("cs"))
    if n_frames is None:
        last = cands.groupBy(*keyed(cands)).agg(F.max("frame").alias("_last"))
        heads = cands.select(*place).distinct()
        heads = heads.join(last, "video") if "video" in place else heads.crossJoin(F.broadcast(last))
    else:
        heads = cands.select(*place).distinct().withColumn("_last", F.lit(n_frames - 1).cast("long"))
    grid = heads.where("_last >= 0").withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last")
    return grid.join(own, [*place, "frame"], "left").select(*place, "frame", F.coalesce("cs", F.expr(f"cast(array() as {CANDIDATES})")).alias("cs"))


#: What a frame gives: the emitted place or nulls, the gate, whether it missed, the prediction, and the number of the
#: candidate chosen, the largest first from 0, or -1.
LINKED = "frame bigint, x double, y double, gate double, missed boolean, pred_x double, pred_y double, n_candidates int, chosen int"


def linked(frame: int, cs: list, r: dict) -> tuple:
    return (frame, r["x"], r["y"], r["gate"], r["missed"], *r["pred"], len(cs), r["chosen"])


def link(frames: DataFrame, settings: Settings) -> DataFrame:
    """Frames in order, an arena of a video at a time; a row per frame, with nulls where nothing was emitted."""
    place = keyed(frames, "roi")

    def run(key, pdf):
        import pandas as pd

        linker, out = Linker(settings, settings.centers.get(key[-1], (0.0, 0.0))), []
        for frame, cs in pdf.sort_values("frame")[["frame", "cs"]].itertuples(index=False):
            out.append((*key, *linked(frame, cs, linker.step([(c["x"], c["y"], c["area"]) for c in cs]))))
        return pd.DataFrame(out, columns=names)

    schema = ", ".join(f"{c} string" for c in place) + ", " + LINKED
    names = [c.split()[0] for c in schema.split(", ")]
    return frames.groupBy(*place).applyInPandas(run, schema)
