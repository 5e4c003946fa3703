import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmark.functions import common
from trailmark.operators import compare, geometry, kernels, linking, pixels, pose, qc, trajectory
from trailmark.sources import readers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_coordinates(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(12.5, 30.0)], "x double, y double")
    full = df.select(geometry.scaled_to_full(F.col("x"), 2, 100).alias("x"), geometry.scaled_to_full(F.col("y"), 2, 200).alias("y"))
    assert rows(full) == [(125.0, 260.0)]
    assert rows(full.select(geometry.full_to_scaled(F.col("x"), 2, 100), geometry.full_to_scaled(F.col("y"), 2, 200))) == [(12.5, 30.0)]
    rois = spark.createDataFrame([("a", 100.0, 120.0, 30.0), ("b", 300.0, 300.0, 50.0)], "roi string, cx double, cy double, r double")
    t = spark.createDataFrame([(1, "a", 75.0, 95.0), (2, "b", 260.0, 255.0), (3, "a", 100.0, 120.0), (4, "z", 7.0, 8.0)], "i int, roi string, x double, y double")
    assert rows(geometry.add_roi_local(t, rois).select("i", "x_roi", "y_roi"), "i") == [(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 30.0, 30.0), (4, 7.0, 8.0)]
    corner = spark.createDataFrame([(10.0, 30.0)], "c double, r double")
    assert rows(corner.select(geometry.roi_origin(F.col("c"), F.col("r")))) == [(0,)]


TRACK = "roi string, track_id int, frame long, x double, y double, area double"


def test_flags(spark):
    t = spark.createDataFrame([("a", 1, i, x, y, a) for i, (x, y, a) in enumerate(zip([100.0, 100.0, 100.0, 300.0, 5.0], [100.0, 100.0, 100.0, 100.0, 5.0], [50.0, 5000.0, 50.0, 50.0, 50.0]))], TRACK)
    got = rows(qc.flags(t, 400, 400, crop_size=128).select("flag_area", "flag_jump", "flag_crop_oob", "flag_multi", "frame"), "frame")
    assert [g[0] for g in got] == [False, True, False, False, False]
    assert [g[1] for g in got] == [False, False, False, True, True]
    assert [g[2] for g in got] == [False, False, False, False, True]
    assert not any(g[3] for g in got)
    c = spark.createDataFrame([("a", 1, i, 0.0, 0.0, v) for i, v in enumerate([100.0, 5.0, None])], "roi string, track_id int, frame long, x double, y double, contrast double")
    assert [r[0] for r in rows(qc.flags(c, min_contrast=20).select("flag_low_contrast", "frame"), "frame")] == [False, True, False]


def test_flag_label(spark):
    names = [f"flag_{f}" for f in qc.FLAGS]
    df = spark.createDataFrame([(0, False, True, False, True, False), (1, True, False, False, False, True), (2, *[False] * 5)], "i int, " + ", ".join(f"{n} boolean" for n in names))
    assert [r.label for r in qc.flag_label(df).orderBy("i").collect()] == ["jump,multi", "area,lowC", ""]


def test_missing(spark):
    t = spark.createDataFrame([("a", f) for f in (0, 1, 3, 4)], "roi string, frame long")
    r = qc.missing_report(t, 5).first()
    assert (r.frames_present, r.frames_expected, r.frames_missing, r.missing_fraction) == (4, 5, 1, 0.2)


def test_edge_pinned_and_low_activity(spark):
    data = [("r1", 1, f, 95.0, 0.0, 100.0) for f in range(200)] + [("r2", 1, f, 30.0, 2.0, 100.0) for f in range(200)]
    df = spark.createDataFrame(data, "roi string, track_id int, frame long, r_center_px double, speed_mm_s double, r double").withColumns({f"flag_{f}": common.F.lit(False) for f in qc.FLAGS})
    s = qc.summarize(df)
    got = {r.roi: r for r in s.collect()}
    assert got["r1"].edge_pinned and got["r1"].wall_fraction == 1.0 and got["r1"].low_activity
    assert not got["r2"].edge_pinned and not got["r2"].low_activity
    assert tuple(qc.run_summary(s).first()) == (2, 200, 1, 1)


def test_interpolation_matches_pandas(spark):
    rng = np.random.default_rng(0)
    v = np.where(rng.random(60) < 0.5, np.nan, rng.normal(size=60))
    df = spark.createDataFrame([("a", 1, i, None if math.isnan(x) else float(x)) for i, x in enumerate(v)], "roi string, track_id int, frame long, x double")
    got = [r.x for r in trajectory.interpolate(df, ["x"]).orderBy("frame").collect()]
    assert np.allclose(got, pd.Series(v).interpolate(limit_direction="both"))


def test_unwrap_matches_numpy(spark):
    rng = np.random.default_rng(1)
    angles = {k: rng.uniform(-400, 400, 40) for k in (1, 2)}
    df = spark.createDataFrame([("a", k, i, float(i), float(a)) for k, v in angles.items() for i, a in enumerate(v)], "roi string, track_id int, frame long, t_s double, angle_deg double")
    got = trajectory.unwrap(df).orderBy("track_id", "frame").toPandas()
    for k, v in angles.items():
        assert np.allclose(got[got.track_id == k].angle_unwrapped_deg, np.degrees(np.unwrap(np.radians(v))))
    both = trajectory.unwrap_all(df).orderBy("track_id", "frame").toPandas()
    assert np.allclose(both.angle_unwrapped_deg, np.degrees(np.unwrap(np.radians(np.concatenate([angles[1], angles[2]])))))


def test_port_distance(spark):
    t = spark.createDataFrame([("a", 150.0, 190.0), ("b", 1.0, 1.0)], "roi string, x double, y double")
    ports = spark.createDataFrame([("a", 150.0, 150.0, 9.0)], "roi string, port_x double, port_y double, port_r double")
    rois = spark.createDataFrame([("a", 150.0, 150.0, 100.0), ("b", 0.0, 0.0, 100.0)], "roi string, cx double, cy double, r double")
    got = rows(trajectory.add_port_distance(t, ports, rois, 100.0).select("roi", "dist_to_port_px", "dist_to_port_mm"), "roi")
    assert got == [("a", 40.0, 20.0), ("b", None, None)]


def test_timing(spark):
    dt = spark.createDataFrame([(1, 0.5), (0, 0.25)], "`Item2.Value.Index` long, `Item2.Interval.TotalMilliseconds` double")
    dt = dt.toDF("frame", "dt_s")
    assert rows(readers.timing(dt), "frame") == [(0, 0.25, 0.25), (1, 0.75, 0.5)]
    ts = spark.createDataFrame([(0, 3.0, 9.0), (1, 3.5, 9.0)], "frame long, timestamp_s double, dt_s double")
    assert rows(readers.timing(ts), "frame") == [(0, 3.0, 0.0), (1, 3.5, 0.5)]
    with pytest.raises(ValueError):
        readers.timing(dt.select("frame"))


def test_files(tmp_path, spark):
    assert [readers.chosen_format("a.csv"), readers.chosen_format("a.dat", "parquet"), readers.chosen_format("x")] == ["csv", "parquet", "parquet"]
    with pytest.raises(ValueError):
        readers.chosen_format("a", "hdf5")
    assert readers.selection("1,3-5", 6) == [0, 2, 3, 4] and readers.selection(" ", 3) == [0, 1, 2]
    for n in ("a.mp4", "b.avi", "c.MOV", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.name for r in readers.discover(spark, str(tmp_path)).collect()] == ["a.mp4", "b.avi", "c.MOV"]
    t = spark.createDataFrame([("a", 1.5)], "roi string, x double")
    readers.write_table(t, str(tmp_path / "out.csv"))
    assert rows(readers.read_table(spark, str(tmp_path / "out.csv"))) == [("a", 1.5)]
    assert readers.output_path("/v/clip.mp4", "tracks", "csv") == "/v/clip_tracks.csv"


def test_sidecar(spark):
    import json

    rois = spark.createDataFrame([("arena_02", 9.0, 9.0, 5.0), ("arena_01", 5.004, 5.0, 4.0)], "roi string, cx double, cy double, r double")
    ports = spark.createDataFrame([("arena_01", 5.126, 5.0, 1.0)], "roi string, port_x double, port_y double, port_r double")
    got = json.loads(readers.sidecar(rois, ports, "v.mp4", 200, 200, 75.0).first()[0])
    assert list(got["arenas"]) == ["arena_01", "arena_02"] and got["arenas"]["arena_02"]["port"] is None
    assert got["arenas"]["arena_01"]["port"]["cx"] == 5.13 and got["image_size"] == [200, 200]
    assert readers.sidecar(rois.limit(0), ports, "v", 1, 1, None).count() == 0


def test_reading_order(spark):
    c = spark.createDataFrame([(300.0, 90.0, 40.0), (100.0, 100.0, 40.0), (300.0, 290.0, 40.0), (100.0, 300.0, 40.0)], "cx double, cy double, r double")
    assert [(r.roi, r.cx, r.cy) for r in pose.reading_order(c).orderBy("roi").collect()] == [("arena_01", 100, 100), ("arena_02", 300, 90), ("arena_03", 100, 300), ("arena_04", 300, 290)]


def step(linker, *found):
    return linker.step(list(found))


def test_link_gate_grows():
    k = linking.Linker(linking.Settings(max_jump=20, miss_tolerance=9))
    gates = [step(k, (0, 0, 9))["gate"], step(k)["gate"], step(k)["gate"]]
    assert gates == [20, 20, 40]


def test_link_rejects_and_seeds_anew():
    k = linking.Linker(linking.Settings(max_jump=40, miss_tolerance=2))
    step(k, (50, 50, 9))
    assert step(k, (300, 300, 9))["x"] is None and k.misses == 1
    k = linking.Linker(linking.Settings(miss_tolerance=2), (5, 5))
    assert [(step(k), k.misses)[1] for _ in range(3)] == [1, 2, 0]


def test_link_reacquires():
    k = linking.Linker(linking.Settings(max_jump=10, miss_tolerance=3))
    got = [step(k, (x, 200, 9))["x"] for x in [200] * 5 + [250] * 15]
    assert all(v is not None for v in got[:5] + got[-5:])
    k = linking.Linker(linking.Settings(max_jump=10, miss_tolerance=100))
    got = [step(k, (x, 100, 9))["x"] for x in [100] * 4 + [130] * 6]
    assert got[-1] is not None and sum(v is not None for v in got[4:]) >= 3


def test_link_static_artifact_and_kalman():
    k = linking.Linker(linking.Settings(max_jump=40), (46, 46))
    step(k, (46, 46, 60))
    assert all(abs(step(k, (200, 200, 200), (46 + i, 46, 60))["x"] - 46 - i) < 1e-9 for i in range(1, 10))
    points = [(10.0, 10.0), (14.0, 10.0), (16.0, 13.0), (21.0, 12.0), (22.0, 17.0), (27.0, 16.0)]
    for smoothing in (False, True):
        k = linking.Linker(linking.Settings(use_kalman=True, smoothing=smoothing))
        worst = max(math.hypot(r["x"] - x, r["y"] - y) for x, y in points for r in [step(k, (x, y, 9))])
        assert worst > 0.3 if smoothing else worst == 0


def test_link_stream_equals_batch(spark, tmp_path):
    import json

    from trailmark.streaming.link import link_stream

    rng = np.random.default_rng(5)
    frames = [{"roi": r, "frame": f, "cs": [{"x": float(x), "y": float(y), "area": float(a)} for x, y, a in rng.uniform(0, 120, (rng.integers(0, 3), 3))]} for r in ("a", "b") for f in range(40)]
    schema = "roi string, frame long, cs array<struct<x:double,y:double,area:double>>"
    settings = linking.Settings(max_jump=40, miss_tolerance=3, centers={"a": (60, 60), "b": (60, 60)}, use_kalman=True)
    want = rows(linking.link(spark.createDataFrame([(f["roi"], f["frame"], [(c["x"], c["y"], c["area"]) for c in f["cs"]]) for f in frames], schema), settings), "roi", "frame")
    for k in range(4):
        (tmp_path / f"in{k}.json").write_text("\n".join(json.dumps(f) for f in frames if f["frame"] // 10 == k))
        import os

        os.utime(tmp_path / f"in{k}.json", (1e9 + k, 1e9 + k))
    q = link_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path)), settings).writeStream.format("memory").queryName("linked").start()
    try:
        q.processAllAvailable()
        assert rows(spark.table("linked"), "roi", "frame") == want
    finally:
        q.stop()


def test_link_stream_gaps(spark, tmp_path):
    """A gap longer than allowed begins the arena anew, without rows for the frames in it."""
    from trailmark.streaming.link import link_stream

    schema = f"roi string, frame long, cs {linking.CANDIDATES}"
    frames = [0, 1, 2, 500, 501, 504]
    spark.createDataFrame([("a", f, [(-50.0, f, 100.0 + f, 80.0, 50.0)]) for f in frames], schema).write.parquet(str(tmp_path / "in"))
    q = link_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), linking.Settings(), longest_gap=10).writeStream.format("memory").queryName("gaps").trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.table("gaps").select("frame", "missed"), "frame")
    assert got == [(0, False), (1, False), (2, False), (500, False), (501, False), (502, True), (503, True), (504, False)]


def test_pose_flags(spark):
    base = {"head": (50, 30), "thorax": (50, 50), "abdomen": (50, 70), "wingL": (30, 60), "wingR": (70, 60)}

    def table(change):
        out = []
        for f in range(8):
            own = dict(base)
            own, scores = change(f, own)
            out += [("a", f, k, None if v is None else float(v[0]), None if v is None else float(v[1]), scores.get(k, 0.9)) for k, v in own.items()]
        return spark.createDataFrame(out, "roi string, frame long, keypoint string, x double, y double, score double")

    def flagged(change, name):
        return [r.frame for r in pose.flags(pose.wide(table(change))).where(f"flag_{name}").orderBy("frame").collect()]

    same = lambda f, o: (o, {})
    assert all(not flagged(same, n) for n in ("low_conf", "missing", "wing_swap", "headtail"))
    swap = lambda f, o: (o | {"wingL": o["wingR"], "wingR": o["wingL"]} if f == 7 else o, {})
    assert flagged(swap, "wing_swap") == [7]
    flip = lambda f, o: (o | {"head": o["abdomen"], "abdomen": o["head"]} if f == 5 else o, {})
    assert 5 in flagged(flip, "headtail")
    low = lambda f, o: (o, {"head": 0.05} if f == 2 else {})
    assert flagged(low, "low_conf") == [2] and not flagged(low, "missing")
    gone = lambda f, o: (o | {"wingL": None} if f == 3 else o, {})
    assert flagged(gone, "missing") == [3]


def test_heatmaps(spark):
    heat = np.zeros((16, 16), dtype=np.float32)
    heat[4, 8] = 0.9
    df = spark.createDataFrame([(0, heat.reshape(-1).tolist())], "vec_id long, heat array<float>")
    r = pose.heatmap_argmax(df, 16, 64).first()
    assert (r.x, r.y, round(r.score, 3)) == (34.0, 18.0, 0.9)
    heat[:] = 0
    heat[7:9, 7:9] = 1
    r = pose.heatmap_centroid(spark.createDataFrame([(0, heat.reshape(-1).tolist())], "vec_id long, heat array<float>"), 16, 16).first()
    assert (r.x, r.y) == (8.0, 8.0)


def test_match_greedy(spark):
    inst = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0)], "frame long, inst long, x double, y double")
    anchors = spark.createDataFrame([(0, "p", 0.5, 0.0), (0, "q", 9.0, 0.0), (0, "n", None, None)], "frame long, roi string, ax double, ay double")
    assert [(r.inst, r.roi) for r in pose.match_greedy(inst, anchors).orderBy("inst").collect()] == [(1, "p"), (2, "q")]


def test_kernels():
    img = np.full((80, 80), 210.0)
    y, x = np.mgrid[:80, :80]
    img[(x - 40) ** 2 + (y - 40) ** 2 <= 36] = 20
    found = kernels.ellipses(kernels.open_close(210 - img > 50), 10, 1500)
    assert len(found) == 1 and math.hypot(found[0][0] - 40, found[0][1] - 40) < 3
    port = np.full((300, 300), 200.0)
    y, x = np.mgrid[:300, :300]
    port[(x - 155) ** 2 + (y - 148) ** 2 <= 64] = 40
    got = kernels.find_port(port, (150, 150), 100)
    assert math.hypot(got[0] - 155, got[1] - 148) <= 2
    assert got[2] == pytest.approx(8, abs=2) and kernels.find_port(np.full((300, 300), 200.0), (150, 150), 100) is None
    ramp = np.arange(10000).reshape(100, 100) % 251
    assert kernels.crop(ramp, 50, 50, 20)[1:] == (40, 40, False) and kernels.crop(ramp, 2, 2, 20)[1:] == (-8, -8, True)


def test_mixture_background():
    rng = np.random.default_rng(2)
    flat, mixed = rng.normal(205, 2, (80, 20)), np.where(rng.random((80, 20)) < 0.25, 30, 205) + rng.normal(0, 2, (80, 20))
    got = kernels.mixture_background(np.hstack([flat, mixed]))
    assert np.abs(got - 205).max() < 4


def test_background_drift():
    plate = np.full((60, 60), 180.0)
    frame = np.full((60, 60), 150.0)
    frame[20:26, 20:26] = 30
    state = kernels.BackgroundState(plate, np.ones((60, 60), bool), protect=8)
    bg = state.step(frame, (23, 23))
    assert abs(state.drift + 30) < 1 and abs(float(bg[0, 0]) - 150) <= 3 and bg[22, 22] - frame[22, 22] >= 100


def test_pixel_percentile_matches_numpy(spark):
    v = np.random.default_rng(3).integers(0, 256, (30, 5))
    df = spark.createDataFrame([(0, s, p, int(v[s, p])) for s in range(30) for p in range(5)], "roi int, sample long, pix int, v int")
    got = [r.value for r in pixels.percentile(df, 0.9).orderBy("pix").collect()]
    assert np.allclose(got, np.percentile(v, 90, axis=0))


def test_validation(spark):
    videos = spark.createDataFrame([("a", 10, 5, 5), ("b", None, 5, 5)], "video string, frame_count int, width int, height int")
    timing = spark.createDataFrame([("a", 0.1)] * 15, "video string, dt_s double")
    got = {r.video: r for r in compare.roll_up(compare.validation(videos, timing)).collect()}
    assert got["a"].ok and got["a"].warned == 1 and not got["b"].ok
    assert not {r.video: r for r in compare.roll_up(compare.validation(videos, timing), strict=True).collect()}["a"].ok


def test_spread_and_follow(spark):
    df = spark.createDataFrame([("a", 1, i) for i in range(101)], "roi string, track_id int, frame long")
    assert [r.frame for r in qc.spread(df, 5).orderBy("frame").collect()] == [0, 25, 50, 75, 100]
    track = spark.createDataFrame([(3, 1.0, 2.0), (5, 3.0, 4.0)], "frame long, x double, y double")
    frames = spark.createDataFrame([(i,) for i in (0, 3, 4, 9)], "frame long")
    assert rows(qc.follow(track, frames), "frame") == [(0, 1.0, 2.0), (3, 1.0, 2.0), (4, 1.0, 2.0), (9, 3.0, 4.0)]


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in common.nan_to_null(df).collect()] == [None, 1.0]


def test_whole_tracks(spark, monkeypatch):
    """The queries over all tracks, frames and anchors against brute force."""
    from trailmark.plans import registry

    at = {(f"arena_0{i % 3}", i): {f: (float(i * 7 % 11 + f % 13), float(f * i % 5)) for f in range(i % 4, 75 + i, 1 + i % 3)} for i in range(1, 12)}
    t = spark.createDataFrame([("v", r, i, f, f / 10, *p) for (r, i), own in at.items() for f, p in own.items()], "video string, roi string, track_id long, frame long, t_s double, x double, y double")
    monkeypatch.setattr(registry.views, "tracks", lambda s, d: t)
    run = lambda name, *c: {tuple(r[k] for k in c[:-1]): r[c[-1]] for r in registry.queries()[name](spark, "").collect()}
    follow = {(r, i, f): own[max((g for g in own if g <= f and g % 4), default=min((g for g in own if g % 4), default=None))][0] for (r, i), own in at.items() for f in range(max(own) + 1)}
    assert run("follow_asof", "roi", "track_id", "frame", "cx") == follow
    last = max(f for own in at.values() for f in own if f % 3 == 0)
    got = run("resample", "roi", "track_id", "frame", "x")
    assert set(got) == {(r, i, f) for (r, i), own in at.items() if any(f % 3 == 0 for f in own) for f in range(last + 1)}
    assert all(got[r, i, f] == own[f][0] for (r, i), own in at.items() for f in own if f % 3 == 0)
    here = {(r, f) for (r, _), own in at.items() for f in own}
    assert set(run("context_windows", "roi", "anchor", "frame", "frame")) == {(r, a, f) for r, a in here for f in range(a - 3, a + 4) if (r, f) in here}
    nearest = {}
    for (_, i), own in at.items():
        for f, (x, y) in own.items():
            sides = {r: [q[f] for (s, _), q in at.items() if s == r and f in q] for r, g in here if g == f}
            nearest[f, i] = min((math.hypot(x - min(p[0] for p in q), y - min(p[1] for p in q)), r) for r, q in sides.items())[1]
    assert run("match_nearest", "frame", "inst", "roi") == nearest


def test_two_videos(spark):
    """Tables of two videos give what each gives alone."""
    rows_of = lambda v, shift: [(v, "a", 1, f, f / 10.0, 100.0 + shift * f, 100.0, float((f * 50 * shift) % 180), 50.0, 1, 20.0) for f in range(30)] + [(v, "b", 2, f, f / 10.0, 300.0, 100.0 + f, 0.0, 5.0, 2, 5.0) for f in range(0, 20, shift)]
    names = "video string, roi string, track_id long, frame long, t_s double, x double, y double, angle_deg double, area double, n_candidates int, contrast double"
    both = spark.createDataFrame(rows_of("v1", 1) + rows_of("v2", 2), names)
    rois = spark.createDataFrame([("a", 100.0, 100.0, 80.0), ("b", 300.0, 100.0, 80.0)], "roi string, cx double, cy double, r double")

    def each(t):
        k = trajectory.add_kinematics(t, rois)
        cands = t.select(*[c for c in ("video", "roi", "frame") if c in t.columns], F.col("frame").alias("event_id"), "x", "y", "area")
        return {
            "kinematics": k.select(*common.keyed(k, "roi"), "track_id", "frame", "speed_mm_s"),
            "summary": qc.summarize(qc.flags(k, 400, 400), rois),
            "coverage": qc.coverage(t, 10),
            "hist": qc.histogram(t, "x", 7),
            "spread": qc.spread(t, 7).select(*common.keyed(t, "roi"), "track_id", "frame"),
            "uniform": pose.uniform_sample(t, 6).select(*common.keyed(t, "roi"), "track_id", "frame"),
            "unwrap": trajectory.unwrap_all(t).select(*common.keyed(t, "roi"), "track_id", "frame", "angle_unwrapped_deg"),
            "link": linking.link(linking.dense(cands), linking.Settings(use_kalman=True, miss_tolerance=2)),
            "stuck": qc.stuck(t, rois, 30),
        }

    whole = each(both)
    for v in ("v1", "v2"):
        alone = each(both.where(F.col("video") == v).drop("video"))
        for name, df in alone.items():
            cut = whole[name].where(F.col("video") == v).drop("video")
            as_rows = lambda x: sorted((tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in x.select(*df.columns).collect()), key=str)
            assert as_rows(cut) == as_rows(df), (v, name)


def test_unknown_arena_is_an_error(spark):
    t = spark.createDataFrame([("zz", 1, 0, 0.0, 1.0, 1.0)], "roi string, track_id long, frame long, t_s double, x double, y double")
    rois = spark.createDataFrame([("a", 100.0, 100.0, 80.0)], "roi string, cx double, cy double, r double")
    with pytest.raises(Exception, match="unknown arena zz"):
        trajectory.add_center(t, rois).collect()


def test_even_positions_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(qc, "STRETCH", 10)
    df = spark.createDataFrame([("a", f) for f in range(101)] + [("b", f) for f in range(3)], "roi string, frame long")
    got = qc.even_positions(df, ["roi"], ["frame"], 5)
    assert rows(got, "roi", "frame") == [("a", 0), ("a", 25), ("a", 50), ("a", 75), ("a", 100), ("b", 0), ("b", 1), ("b", 2)]
