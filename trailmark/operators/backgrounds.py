"""Backgrounds of arenas from a stack of sampled images: tiers, fills, repair; arenas from one image."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels
from .kernels import components, disk, gaussian, gmm_background, gradients, harmonic_fill, otsu

INFO = "roi int, pix int, value int, tier int, method string, n_ghost_initial int, n_ghost_final int, n_stationary_filled int"


def blur_inside(img: np.ndarray, mask: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    """Blurred where the mask holds, unchanged elsewhere; every pixel counts for its neighbours."""
    return np.where(mask, np.rint(gaussian(img, sigma)), img).astype(img.dtype)


def floor_of(bg: np.ndarray, arena: np.ndarray) -> float:
    own = bg[arena] if arena.any() else bg.reshape(-1)
    return float(np.median(own[own >= np.median(own)]))


def ghosts(bg: np.ndarray, top: np.ndarray, arena: np.ndarray, margin: float) -> np.ndarray:
    return (top - bg.astype(np.float64) > margin) & arena


def deghost(bg: np.ndarray, top: np.ndarray, arena: np.ndarray, margin: float = 15, fill: str = "neighbour") -> np.ndarray:
    """Pixels far below their own near-maximum get the level of the floor around them, weighted by nearness, or,
    where no floor is in reach, the near-maximum. Fixtures have no brighter samples and stay."""
    hole = ghosts(bg, top, arena, margin)
    if not hole.any():
        return bg
    out = bg.copy()
    own = arena & ~hole
    floor = own & (bg >= np.median(bg[own]) - margin) if own.any() else own
    floor = floor if floor.any() else own
    level, reached = top, hole
    if fill == "neighbour" and floor.any():
        sigma = float(np.clip(1.5 * math.sqrt(hole.sum() / math.pi), 3.0, bg.shape[0] / 4))
        weight = gaussian(floor, sigma)
        reached = hole & (weight > 1e-3)
        level = np.where(reached, np.rint(gaussian(np.where(floor, bg, 0), sigma) / np.maximum(weight, 1e-6)), top)
    out[hole] = np.clip(level[hole], 0, 255).astype(bg.dtype)
    return out


def fill_stationary(bg: np.ndarray, arena: np.ndarray, margin: float = 15, area: tuple[int, int] = (15, 4000), spare: float = 0.0) -> tuple[np.ndarray, int]:
    """Compact parts of the arena darker than the smoothed floor around them, filled from their rim, but for a
    central disk of a share of the radius; and the number of filled pixels."""
    side = bg.shape[0]
    dark = (gaussian(bg, side / 8) - bg > margin) & arena
    if spare > 0:
        dark &= ~disk(side, spare)
    label = components(dark)
    size = np.bincount(label.reshape(-1))
    hole = ((size >= area[0]) & (size <= area[1]))[label] & dark
    return (harmonic_fill(bg, hole), int(hole.sum())) if hole.any() else (bg, 0)


def repair_stuck(bg: np.ndarray, port: tuple[float, float, float] | None = None, margin: float = 15, radius: int = 13, largest: int = 4000, mask: np.ndarray | None = None) -> tuple[np.ndarray, tuple[float, float] | None, int]:
    """(background, place of the object or None, filled pixels): the object's part filled from its rim. Without a mask
    it is the dark part that holds the darkest pixel apart from the port, or a disk about that pixel where the part is
    too large to be an object; there is none where that pixel isn't darker than the floor by the margin."""
    side = bg.shape[0]
    y, x = np.mgrid[:side, :side]
    wide = disk(side, 0.97)
    clear = lambda room: np.ones_like(wide) if port is None else (x - port[0]) ** 2 + (y - port[1]) ** 2 > (max(port[2], 0) + room) ** 2
    if mask is None:
        where, floor = wide & clear(0.06 * side), floor_of(bg, wide)
        i, j = np.unravel_index(np.argmin(np.where(where, bg.astype(np.int16), 999)), bg.shape)
        if floor - float(bg[i, j]) <= margin:
            return bg, None, 0
        label = components((floor - bg.astype(np.float64) > margin) & where)
        mask, at = label == label[i, j], (float(j), float(i))
        if mask.sum() > largest:
            mask = (x - j) ** 2 + (y - i) ** 2 <= radius**2
    else:
        at = (float(x[mask].mean()), float(y[mask].mean())) if mask.any() else None
    hole = mask & wide & clear(3)
    return (harmonic_fill(bg, hole), at, int(hole.sum())) if hole.any() else (bg, None, 0)


def adaptive(stack: np.ndarray, arena: np.ndarray | None = None, places: dict[int, tuple[float, float]] | None = None, margin: float = 15, low: float = 90, high: float = 98, radius: float = 12, fill: bool = False, spare: float = 0.0) -> tuple[np.ndarray, dict]:
    """Background and how it came about: a percentile; de-ghosted where objects dwelt; without
    samples near the object's places (by index of sample) where ghosts are left; stationary parts filled if asked."""
    arena = disk(stack.shape[1], 0.92) if arena is None else arena
    top = np.percentile(stack, high, axis=0)
    bg = np.percentile(stack, low, axis=0).astype(np.uint8)
    first, tier, method = int(ghosts(bg, top, arena, margin).sum()), 0, f"p{low:g}"
    if first:
        bg, tier, method = deghost(bg, top, arena, margin), 1, f"p{low:g}+deghost"
        if places and ghosts(bg, top, arena, margin).any():
            y, x = np.mgrid[: stack.shape[1], : stack.shape[2]]
            held = stack.astype(np.float64)
            for k, (px, py) in places.items():
                held[k][(x - px) ** 2 + (y - py) ** 2 <= radius**2] = np.nan
            never = np.isnan(held).all(axis=0)
            held[:, never] = stack[:, never]
            bg, tier, method = deghost(np.nanpercentile(held, low, axis=0).astype(np.uint8), top, arena, margin), 2, "fg_excluded+deghost"
    filled = 0
    if fill:
        bg, filled = fill_stationary(bg, arena, margin, spare=spare)
        if filled:
            tier, method = 3, method + "+fill"
    return bg, {"tier": tier, "method": method, "n_ghost_initial": first, "n_ghost_final": int(ghosts(bg, top, arena, margin).sum()), "n_stationary_filled": filled}


def model(stack: DataFrame, side: int, **settings) -> DataFrame:
    """Adaptive background of each arena from its samples (roi, sample, pix, v); a group is an
    arena's bounded number of samples."""
    import pandas as pd

    def run(pdf):
        images = pdf.sort_values(["sample", "pix"])["v"].to_numpy().reshape(-1, side, side).astype(np.uint8)
        bg, info = adaptive(images, **settings)
        return pd.DataFrame({"roi": int(pdf["roi"].iloc[0]), "pix": np.arange(side * side), "value": bg.reshape(-1).astype(int), **info})

    return stack.groupBy("roi").applyInPandas(run, INFO)


def _hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the convex hull, from the points sorted by x and y."""
    own = sorted(set(map(tuple, points.tolist())))

    def half(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return own if len(own) < 3 else half(own)[:-1] + half(own[::-1])[:-1]


def _through(*p: tuple[float, float]) -> tuple[float, float, float]:
    """The least circle with one, two or three points on its rim; of three in a line, that of the outermost."""
    if len(p) == 1:
        return (*p[0], 0.0)
    if len(p) == 3:
        (ax, ay), (bx, by), (cx, cy) = p
        d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        if d:
            b2, c2 = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
            ux, uy = ((cy - ay) * b2 - (by - ay) * c2) / d, ((bx - ax) * c2 - (cx - ax) * b2) / d
            return ax + ux, ay + uy, math.hypot(ux, uy)
        p = min(p), max(p)
    (ax, ay), (bx, by) = p
    return (ax + bx) / 2, (ay + by) / 2, math.hypot(ax - bx, ay - by) / 2


def enclosing_circle(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """The least circle around points: a point outside the circle so far lies on the rim of the next one."""
    points = _hull(np.stack([x, y], axis=1).astype(np.float64))
    out = lambda c, p: math.hypot(p[0] - c[0], p[1] - c[1]) > c[2] + 1e-9
    circle = _through(points[0])
    for i, p in enumerate(points):
        if out(circle, p):
            circle = _through(p)
            for j, q in enumerate(points[:i]):
                if out(circle, q):
                    circle = _through(p, q)
                    for r in points[:j]:
                        if out(circle, r):
                            circle = _through(p, q, r)
    return circle


def find_arenas(img: np.ndarray, expected: int | None = None, least: float = 0.01) -> list[tuple[float, float, float]]:
    """Circles around the bright parts of at least a share of the image, largest first; none
    if fewer than expected."""
    label = components(img > otsu(img))
    keys, sizes = np.unique(label[label > 0], return_counts=True)
    order = [k for k in np.argsort(-sizes, kind="stable") if sizes[k] >= least * img.size]
    if expected and len(order) < expected:
        return []
    return [enclosing_circle(*np.nonzero(label == keys[k])[::-1]) for k in order[: expected or len(order)]]


def build(stack: DataFrame, side: int, method: str = "gmm", expected: int | None = None, sigma: float = 3.0) -> DataFrame:
    """roi, pix, value of each arena's background: "mean", "p<number>" (a percentile), "gmm" or "adaptive". With
    "gmm", bright round parts are found in it and blurred inside, where `expected` is given."""
    if method == "mean":
        return pixels.mean(stack)
    if method.startswith("p"):
        return pixels.byte_percentile(stack, float(method[1:]) / 100)
    if method == "adaptive":
        return model(stack, side).select("roi", "pix", "value")
    plate = gmm_background(stack).withColumn("value", F.col("value").cast("int"))
    if expected is None or sigma <= 0:
        return plate
    images = plate.groupBy("roi").agg(F.sort_array(F.collect_list(F.struct("pix", "value"))).alias("p")).select("roi", F.col("p.value").alias("v"))

    def smooth(batches):
        import pandas as pd

        y, x = np.mgrid[:side, :side]
        for b in batches:
            for roi, v in zip(b["roi"], b["v"], strict=True):
                img, mask = np.asarray(v).reshape(side, side).astype(np.uint8), np.zeros((side, side), dtype=bool)
                for cx, cy, r in find_arenas(img, expected):
                    mask |= (x - cx) ** 2 + (y - cy) ** 2 <= r * r
                yield pd.DataFrame({"roi": roi, "pix": np.arange(side * side), "value": blur_inside(img, mask, sigma).reshape(-1).astype(int)})

    return images.mapInPandas(smooth, "roi int, pix int, value int")


def median_blur(img: np.ndarray, size: int = 9) -> np.ndarray:
    """Medians of size x size windows, the outermost pixels repeated beyond the edge; some rows at a time."""
    wide = np.pad(img, size // 2, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(wide, (size, size))
    return np.concatenate([np.median(view[i : i + 64], axis=(2, 3)) for i in range(0, len(img), 64)])


def find_circles(img: np.ndarray, expected: int = 4, radii: tuple[float, float] = (0.18, 0.30), least: float = 0.35) -> list[tuple[float, float, float]]:
    """The `expected` largest circles (cx, cy, r) of an image, radii as shares of its shorter side: strong edges vote for the
    places they may be the rim of, along their gradient to both sides; a peak is a circle if enough of its rim is edge.
    Peaks are a third of the shorter side apart at least."""
    h, w = img.shape
    side = min(h, w)
    gx, gy = gradients(median_blur(img), 1.0)
    size = np.hypot(gx, gy)
    if not size.max() > 0:
        return []
    y, x = np.nonzero(size >= 0.25 * size.max())
    ux, uy = gx[y, x] / size[y, x], gy[y, x] / size[y, x]
    low, high = int(radii[0] * side), max(int(radii[0] * side) + 1, int(radii[1] * side))
    votes = np.zeros(h * w)
    for r in range(low, high + 1):
        for sign in (-1, 1):
            i, j = np.rint(y + sign * r * uy).astype(int), np.rint(x + sign * r * ux).astype(int)
            ok = (i >= 0) & (i < h) & (j >= 0) & (j < w)
            votes += np.bincount(i[ok] * w + j[ok], minlength=h * w)
    votes, found = gaussian(votes.reshape(h, w), 1.5), []
    yy, xx = np.mgrid[:h, :w]
    while len(found) < 4 * expected:
        cy, cx = np.unravel_index(np.argmax(votes), votes.shape)
        if votes[cy, cx] <= 0:
            break
        votes[(yy - cy) ** 2 + (xx - cx) ** 2 < (side // 3) ** 2] = 0
        away = np.hypot(y - cy, x - cx)
        counts = np.bincount(np.rint(away[away <= high + 1]).astype(int), minlength=high + 2)[low : high + 1]
        r = low + int(np.argmax(counts))
        rim = np.abs(away - r) <= 1.5
        if len(np.unique((np.arctan2(y[rim] - cy, x[rim] - cx) * 36 / math.pi).astype(int))) >= least * 72:
            found.append((float(cx), float(cy), float(away[rim].mean())))
    return sorted(found, key=lambda c: -c[2])[:expected]


def arenas(bg: DataFrame, side: int, expected: int | None = None, least: float = 0.01) -> DataFrame:
    """roi, rank, cx, cy, r: the arenas found in each background."""
    images = bg.groupBy("roi").agg(F.sort_array(F.collect_list(F.struct("pix", "value"))).alias("p")).select("roi", F.col("p.value").alias("v"))

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [(roi, k, *c) for roi, v in zip(b["roi"], b["v"], strict=True) for k, c in enumerate(find_arenas(np.asarray(v).reshape(side, side).astype(np.uint8), expected, least))]
            yield pd.DataFrame(out, columns=["roi", "rank", "cx", "cy", "r"])

    return images.mapInPandas(run, "roi int, rank int, cx double, cy double, r double")
