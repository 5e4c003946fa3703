"""Image kernels against plain loops over pixels."""

import itertools
import math

import numpy as np
import pytest

from trailmark.operators import backgrounds, engine, kernels
from trailmark.plans import registry

D = "/root/testdata/sf0.001"


def mirrored(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def plain_blur(img, sigma):
    r = max(1, (round(sigma * 8 + 1) | 1) // 2)
    weight = [math.exp(-k * k / 2 / sigma**2) for k in range(-r, r + 1)]
    weight = [w / sum(weight) for w in weight]
    h, w = img.shape
    across = [[sum(weight[k + r] * img[y][mirrored(x + k, w)] for k in range(-r, r + 1)) for x in range(w)] for y in range(h)]
    return np.array([[sum(weight[k + r] * across[mirrored(y + k, h)][x] for k in range(-r, r + 1)) for x in range(w)] for y in range(h)])


def plain_parts(mask):
    h, w = mask.shape
    out, seen = [], set()
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) not in seen:
            part, stack = set(), [(y, x)]
            while stack:
                p = stack.pop()
                if p in part or not (0 <= p[0] < h and 0 <= p[1] < w) or not mask[p]:
                    continue
                part.add(p)
                stack += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            seen |= part
            out.append(part)
    return out


def plain_fill(img, hole, rounds=400):
    h, w = img.shape
    out = {(y, x): float(img[y, x]) for y in range(h) for x in range(w)}
    rim = [out[p] for p in out if p not in hole and any((p[0] + a, p[1] + b) in hole for a in range(-2, 3) for b in range(-2, 3))]
    for p in hole:
        out[p] = float(np.mean(np.array(rim, dtype=np.float32)))
    for _ in range(rounds):
        new = {p: sum(out[mirrored(p[0] + a, h), mirrored(p[1] + b, w)] for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9 for p in hole}
        out.update(new)
    return np.array([[min(255, max(0, round(out[y, x]))) for x in range(w)] for y in range(h)])


def pictures(n=12, side=14):
    rng = np.random.default_rng(5)
    for _ in range(n):
        img = rng.integers(150, 170, (side, side))
        for _ in range(rng.integers(0, 4)):
            y, x = rng.integers(0, side - 3, 2)
            img[y : y + rng.integers(1, 4), x : x + rng.integers(1, 4)] = rng.integers(20, 120)
        yield img.astype(np.uint8)


def test_blur_and_gradients():
    for img in pictures(3):
        assert np.allclose(kernels.gaussian(img, 1.2), plain_blur(img, 1.2))
        smooth = plain_blur(img, 1.2)
        gx, gy = kernels.gradients(img, 1.2)
        n = len(img)
        at = lambda y, x: smooth[mirrored(y, n), mirrored(x, n)]
        for y in range(n):
            for x in range(n):
                assert gx[y, x] == pytest.approx(sum(k * (at(y + a, x + 1) - at(y + a, x - 1)) for a, k in ((-1, 1), (0, 2), (1, 1))))
                assert gy[y, x] == pytest.approx(sum(k * (at(y + 1, x + a) - at(y - 1, x + a)) for a, k in ((-1, 1), (0, 2), (1, 1))))


def test_components_by_flooding():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.4, 0.6, 0.9):
        for shape in ((9, 13), (1, 7), (7, 1)):
            mask = rng.random(shape) < share
            label = kernels.components(mask)
            got = {frozenset(zip(*map(list, np.nonzero(label == k)))) for k in np.unique(label[label > 0])}
            assert got == {frozenset(p) for p in plain_parts(mask)} and ((label > 0) == mask).all()


def test_elements_and_morphology():
    assert kernels.ellipse_element(3).tolist() == [[False, True, False], [True, True, True], [False, True, False]]
    assert kernels.ellipse_element(5).sum() == 17 and kernels.ellipse_element(5)[0].tolist() == [False, False, True, False, False]
    mask = np.zeros((9, 9), dtype=bool)
    mask[2:7, 2:7] = True
    mask[4, 4], mask[0, 8] = False, True
    out = kernels.open_close(mask, 3, 5)
    assert out[4, 4] and not out[0, 8] and out[3, 3]


def plain_deghost(bg, top, arena, margin):
    h, w = bg.shape
    hole = {(y, x) for y in range(h) for x in range(w) if arena[y, x] and top[y, x] - float(bg[y, x]) > margin}
    if not hole:
        return bg
    own = [(y, x) for y in range(h) for x in range(w) if arena[y, x] and (y, x) not in hole]
    median = np.median([bg[p] for p in own]) if own else 0
    floor = [p for p in own if bg[p] >= median - margin] or own
    out = bg.astype(int).copy()
    sigma = min(max(1.5 * math.sqrt(len(hole) / math.pi), 3.0), h / 4)
    known, value = np.zeros((h, w)), np.zeros((h, w))
    for p in floor:
        known[p], value[p] = 1, bg[p]
    weight, total = plain_blur(known, sigma), plain_blur(value, sigma)
    for p in hole:
        level = round(total[p] / weight[p]) if floor and weight[p] > 1e-3 else int(top[p])
        out[p] = min(255, max(0, level))
    return out


def test_deghost():
    rng = np.random.default_rng(2)
    arena = kernels.disk(14, 0.92)
    for img in pictures():
        top = img + rng.integers(0, 60, img.shape)
        assert (backgrounds.deghost(img, top, arena, 30) == plain_deghost(img, top, arena, 30)).all()
        near = backgrounds.deghost(img, top, arena, 30, fill="top")
        hole = (top - img.astype(int) > 30) & arena
        assert (near[hole] == np.clip(top[hole], 0, 255)).all() and (near[~hole] == img[~hole]).all()


def test_fill_stationary():
    arena = kernels.disk(14, 0.92)
    filled = 0
    for img in pictures():
        low = plain_blur(img, 14 / 8) - img > 15
        yy, xx = np.mgrid[:14, :14]
        for spare in (0.0, 0.3):
            mask = low & arena & ((xx - 7) ** 2 + (yy - 7) ** 2 > (spare * 7) ** 2 if spare else True)
            hole = {p for part in plain_parts(mask) if 2 <= len(part) <= 12 for p in part}
            out, n = backgrounds.fill_stationary(img, arena, 15, (2, 12), spare)
            assert n == len(hole) and np.abs(out.astype(int) - (plain_fill(img, hole) if hole else img)).max() <= 1
            filled += n
    assert filled


def test_repair_stuck_plain():
    yy, xx = np.mgrid[:14, :14]
    wide = (xx - 7) ** 2 + (yy - 7) ** 2 <= (0.97 * 7) ** 2
    done = 0
    for img in pictures(20):
        own = sorted(img[wide].tolist())
        floor = np.median([v for v in own if v >= np.median(own)])
        away = (xx - 7) ** 2 + (yy - 7) ** 2 > (1 + 0.06 * 14) ** 2
        spots = [(img[y, x], y, x) for y in range(14) for x in range(14) if wide[y, x] and away[y, x]]
        v, y, x = min(spots)
        out, at, n = backgrounds.repair_stuck(img, (7, 7, 1), 15, radius=2, largest=6)
        if floor - float(v) <= 15:
            assert at is None and (out == img).all()
            continue
        part = next(p for p in plain_parts((floor - img.astype(float) > 15) & wide & away) if (y, x) in p)
        if len(part) > 6:
            part = {(a, b) for a in range(14) for b in range(14) if (a - y) ** 2 + (b - x) ** 2 <= 4}
        part = {(a, b) for a, b in part if wide[a, b] and (a - 7) ** 2 + (b - 7) ** 2 > 16}
        assert at == (None if not part else (x, y)) and n == len(part)
        if part:
            assert np.abs(out.astype(int) - plain_fill(img, part)).max() <= 1
            done += 1
    assert done


def test_radial_edge():
    rng = np.random.default_rng(3)
    img = rng.normal(150, 5, (40, 40))
    yy, xx = np.mgrid[:40, :40]
    img[(xx - 22) ** 2 + (yy - 18) ** 2 <= 9] = 60
    gx, gy = kernels.gradients(img, 1.2)
    best = None
    for r in (2.0, 3.0, 4.0):
        for y in range(14, 26):
            for x in range(14, 26):
                total = 0.0
                for a in np.linspace(0, 2 * math.pi, 36, endpoint=False):
                    c, s = float(np.cos(a)), float(np.sin(a))
                    i, j = min(39, max(0, round(y + r * s))), min(39, max(0, round(x + r * c)))
                    total += (gx[i, j] * c + gy[i, j] * s) / 36
                if best is None or total > best[0] + 1e-12:
                    best = (total, x, y, r)
    got = kernels.radial_edge(gx, gy, np.arange(14.0, 26), np.arange(14.0, 26), np.array([2.0, 3.0, 4.0]), 36)
    assert got == pytest.approx(best)
    assert kernels.find_port(img, (20, 20), 20)[:2] == pytest.approx((22, 18), abs=1.01)
    assert kernels.find_port(img, (20, 20), 7) is None and kernels.find_port(img, (33, 33), 20, off_centre=0.2) is None


def test_shrunk():
    img = np.arange(35.0).reshape(5, 7)
    got = kernels.shrunk(img, 3)
    assert got.shape == (2, 3) and got[0, 0] == img[:3, :3].mean() and got[1, 2] == img[3:, 6:].mean()


def plain_mixture(x, min_std=10.0, gain=10.0, low=120.0):
    """One pixel's background by the textbook steps."""
    n, mean, var = len(x), float(np.mean(x)), float(np.var(x))
    if len(set(x)) < 5 or math.sqrt(var) < min_std:
        return mean
    m = [float(np.percentile(x, 25)), float(np.percentile(x, 75))]
    m[1] = max(m[1], m[0] + 1)
    v, w, before = [var + 1e-3] * 2, [0.5, 0.5], None
    for _ in range(100):
        resp, ll = [], 0.0
        for value in x:
            p = [w[k] / math.sqrt(2 * math.pi * v[k]) * math.exp(-((value - m[k]) ** 2) / 2 / v[k]) for k in (0, 1)]
            ll += math.log(sum(p))
            resp.append([q / sum(p) for q in p])
        for k in (0, 1):
            nk = sum(r[k] for r in resp) + 1e-12
            m[k] = sum(r[k] * value for r, value in zip(resp, x)) / nk
            v[k] = sum(r[k] * (value - m[k]) ** 2 for r, value in zip(resp, x)) / nk + 1e-3
            w[k] = nk / n
        if before is not None and abs(ll - before) <= 1e-4:
            break
        before = ll
    one = 2 * math.log(n) + n * (math.log(2 * math.pi * (var + 1e-3)) + var / (var + 1e-3))
    return max(*m, low) if 5 * math.log(n) - 2 * ll + gain < one else mean


def test_mixture_of_single_pixels():
    rng = np.random.default_rng(9)
    kinds = 0
    for _ in range(40):
        x = rng.normal(200, 3, 60)
        if rng.random() < 0.6:
            dark = rng.random(60) < rng.uniform(0.1, 0.6)
            x[dark] = rng.normal(rng.uniform(20, 180), 6, dark.sum())
        x = np.round(x)
        got = float(kernels.mixture_background(x[:, None])[0])
        assert got == pytest.approx(plain_mixture(x.tolist()), abs=1e-3)
        kinds += got != x.mean()
    assert 5 < kinds < 40


@pytest.mark.parametrize("name", ["gmm_background", "deghost_neighbour", "stationary_fill", "stuck_repair", "radial_port", "adaptive_background"])
def test_queries_over_whole_tables(spark, name):
    """The queries without SQL, recomputed plainly from the view of stacks."""
    got = {(r.roi, r.pix): r.value for r in registry.queries()[name](spark, D).collect()} if name != "radial_port" else {r.roi: tuple(r)[1:] for r in registry.queries()[name](spark, D).collect()}
    stacks = {}
    for r in registry.views.stack(spark, D).collect():
        stacks.setdefault(r.roi, {}).setdefault(r["sample"], {})[r.pix] = r.v
    for roi, samples in stacks.items():
        x = np.array([[p[k] for k in range(64)] for _, p in sorted(samples.items())])
        images, arena = x.reshape(-1, 8, 8), kernels.disk(8, 0.92)
        level = lambda q: np.floor(np.percentile(images, q, axis=0) + 1e-9).astype(np.uint8)
        if name == "gmm_background":
            # the stop looks at the likelihood of a block of pixels: each alone may go on a little longer
            assert all(got[roi, k] == pytest.approx(plain_mixture(x[:, k].tolist()), abs=1.0) for k in range(0, 64, 7))
        elif name == "deghost_neighbour":
            want = plain_deghost(np.percentile(images, 50, axis=0).astype(np.uint8), np.percentile(images, 98, axis=0), arena, 95)
            assert [got[roi, k] for k in range(64)] == want.reshape(-1).tolist()
        elif name == "stationary_fill":
            bg = level(50)
            hole = {p for part in plain_parts((plain_blur(bg, 1) - bg > 3) & arena) if len(part) <= 30 for p in part}
            assert np.abs(np.array([got[roi, k] for k in range(64)]).reshape(8, 8) - (plain_fill(bg, hole) if hole else bg)).max() <= 1
        elif name == "stuck_repair":
            want = backgrounds.repair_stuck(level(50), (4, 4, 0.5), margin=3, largest=12, radius=2)[0]
            assert [got[roi, k] for k in range(64)] == want.reshape(-1).tolist()
        elif name == "radial_port":
            found = kernels.find_port(np.kron(level(90), np.ones((6, 6))), (24, 24), 24)
            assert (roi in got) == (found is not None) and (found is None or got[roi] == pytest.approx([round(v, 3) for v in found], abs=2e-3))
        else:
            bg, info = backgrounds.adaptive(images.astype(np.uint8), fill=True)
            assert [got[roi, k] for k in range(64)] == bg.reshape(-1).tolist()
            plain = np.percentile(images, 90, axis=0).astype(np.uint8)
            ghosts = (np.percentile(images, 98, axis=0) - plain > 15) & arena
            assert info["n_ghost_initial"] == ghosts.sum()


def plain_circle(points):
    """The least of all circles through two or three of the points that hold them all."""
    if len(points) == 1:
        return (*points[0], 0.0)
    best = None
    for n in (2, 3):
        for p in itertools.combinations(points, n):
            c = backgrounds._through(*p)
            if (best is None or c[2] < best[2] - 1e-9) and all(math.hypot(x - c[0], y - c[1]) <= c[2] + 1e-7 for x, y in points):
                best = c
    return best


def test_enclosing_circle():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 7, 12):
        for spread in (3, 30):
            for _ in range(10):
                p = rng.integers(0, spread, (n, 2))
                got = backgrounds.enclosing_circle(p[:, 0], p[:, 1])
                assert got == pytest.approx(plain_circle(sorted(set(map(tuple, p.tolist())))), abs=1e-6)


def test_arenas_over_whole_table(spark):
    got = {}
    for r in registry.queries()["find_arenas"](spark, D).collect():
        got.setdefault(r.roi, []).append((r.cx, r.cy, r.r))
    plates = {}
    for r in registry._bg(spark, D, 0.9).collect():
        plates.setdefault(r.roi, {})[r.pix] = r.value
    for roi, p in plates.items():
        img = np.array([p[k] for k in range(64)], dtype=np.uint8).reshape(8, 8)
        values = sorted(img.reshape(-1).tolist())
        between = lambda t: (lambda a, b: len(a) * len(b) * (np.mean(a) - np.mean(b)) ** 2 if a and b else 0.0)([v for v in values if v <= t], [v for v in values if v > t])
        level = max(range(256), key=lambda t: (round(between(t), 4), -t))
        want = sorted((plain_circle([(x, y) for y, x in part]) for part in plain_parts(img > level)), key=str)
        assert len(want) == len(got[roi]) and np.allclose(sorted(want), sorted(got[roi]), atol=1e-5)


def test_segmenter():
    assert engine.segmenter() is kernels.find_port and engine.segmenter("x", len) is len
    with pytest.warns(UserWarning):
        assert engine.segmenter("other") is kernels.find_port
