"""Configuration files, raw frames, hand labels, backgrounds."""

import json
import math
import time
import tomllib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import sql
from trailmark.operators import backgrounds, compare, engine, labels, linking, qc
from trailmark.sources import config, images, readers, reports
from trailmark.sources.gray import GraySource
from trailmark.streaming import progress, sink


def test_config(tmp_path):
    path = tmp_path / "a" / "config.toml"
    assert config.load(path) == config.DEFAULTS
    path.write_text('max_jump_px = 7\noutput_dir = "a \\"b\\" é"\nunheard_of = 1\nbg_method = "old"\n', encoding="utf-8")
    got = config.load(path)
    assert got["max_jump_px"] == 7.0 and isinstance(got["max_jump_px"], float) and got["output_dir"] == 'a "b" é'
    assert "bg_method" not in path.read_text(encoding="utf-8") and config.load(path) == got
    assert config.link_settings(got, {}).max_jump == 7.0 and config.flag_settings(got)["max_jump"] == 7.0


@pytest.mark.parametrize("forced,n,want", [(6, 8, 6), (6, 3, 3), (0, 8, 3), (1, 8, 1)])
def test_concurrency(forced, n, want):
    assert config.concurrency(config.DEFAULTS | {"batch_concurrency": forced}, n, cores=12) == want


def test_chosen_rois():
    have = ["arena_01", "arena_02", "arena_03"]
    assert config.chosen_rois(have, ["arena_03,arena_01", "arena_03"]) == ["arena_03", "arena_01"]
    assert config.chosen_rois(have, []) == have
    with pytest.raises(ValueError):
        config.chosen_rois(have, ["arena_09"])


def test_gray_frames(spark, tmp_path):
    spark.dataSource.register(GraySource)
    images = np.arange(7 * 12, dtype=np.uint8).reshape(7, 12)
    (tmp_path / "a.gray").write_bytes(images.tobytes() + b"short")
    (tmp_path / "b.gray").write_bytes(b"tiny")
    (tmp_path / "c.txt").write_bytes(bytes(24))
    for uri in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/a.gray"):
        df = spark.read.format("gray").option("width", 4).option("height", 3).option("taskBytes", 30).load(uri)
        assert df.rdd.getNumPartitions() == 4
        assert [bytes(r["pixels"]) for r in df.orderBy("frame").collect()] == [x.tobytes() for x in images]


@pytest.fixture(scope="module")
def tracks(spark):
    rows = [(f"arena_0{r + 1}", 0, f, f / 10, 100.0 + 200 * r + f % 5, 100.0 + f % 7, float(13 * f % 180), 30.0 + 10 * (f % 4), 15.0, 80.0 + 100 * (f % 3)) for r in range(2) for f in range(60)]
    return spark.createDataFrame(rows, "roi string, track_id bigint, frame bigint, t_s double, x double, y double, angle_deg double, major double, minor double, area double")


def test_labels(spark, tracks, tmp_path):
    made = labels.build(tracks, 24).withColumns({"labeled": F.col("frame") % 2 == 0, "bad": F.col("frame") % 4 == 0})
    assert made.count() == 24
    path = tmp_path / "labels.json"
    labels.save(made, path, {"nodes": ["head"]})
    got = labels.load(spark, path)
    rows = lambda df: sorted(map(repr, df.select(*labels.KEY, "t_s", "x", "y", "labeled", "bad", F.array_sort(F.map_entries("points")).alias("p")).collect()))
    assert rows(got) == rows(made)
    long = labels.manifest(got)
    assert long.count() == 5 * made.where("labeled and not bad").count() and labels.manifest(got, only_labeled=False).count() == 120
    swapped = labels.swap(got, F.lit(True)).select(*labels.KEY, F.col("points.wingL").alias("l"))
    assert swapped.join(got.select(*labels.KEY, F.col("points.wingR").alias("r")), labels.KEY).where("l <> r").count() == 0
    at = labels.nearest_node(got, F.col("points.head.x") + 1, F.col("points.head.y"))
    assert {r[0] for r in at.select("node").collect()} == {"head"}
    assert labels.nearest_node(got, F.lit(-500.0), F.lit(0.0)).where("node is not null").count() == 0


def test_labels_defaults(spark, tmp_path):
    path = tmp_path / "old.json"
    path.write_text('{"frames": [{"roi": "a", "frame": 1, "track_id": 0, "cx": 5, "cy": 6.5, "points": {"head": [1, 2.5], "wingL": [3, 4, false, 0.25]}}]}')
    r = labels.load(spark, path).first()
    assert r["points"]["head"].asDict() == {"x": 1.0, "y": 2.5, "visible": True, "score": 1.0}
    assert r["points"]["wingL"].asDict() == {"x": 3.0, "y": 4.0, "visible": False, "score": 0.25} and not r["labeled"] and not r["bad"]
    path.write_text('{"frames": []}')
    assert labels.load(spark, path).count() == 0


def scene(n=100, side=100, level=200):
    return np.full((n, side, side), level, dtype=np.uint8)


def test_background_tiers():
    roaming = scene()
    for k, img in enumerate(roaming):
        img[48:52, 20 + k % 60 : 24 + k % 60] = 20
    bg, info = backgrounds.adaptive(roaming)
    assert (info["tier"], info["n_ghost_final"], info["method"]) == (0, 0, "p90") and (bg == 200).all()
    dwelling = scene()
    for k, img in enumerate(dwelling):
        if k % 12:
            img[26:34, 26:34] = 20
    bg, info = backgrounds.adaptive(dwelling)
    assert info["tier"] >= 1 and info["n_ghost_initial"] == 64 and info["n_ghost_final"] == 0 and bg.min() > 150


def test_background_never_moves():
    still = scene()
    still[:, 44:56, 44:56] = 20
    bg, info = backgrounds.adaptive(still)
    assert info["tier"] == 0 and bg[50, 50] == 20
    bg, info = backgrounds.adaptive(still, fill=True)
    assert (info["tier"], info["n_stationary_filled"]) == (3, 144) and bg.min() > 150
    assert backgrounds.adaptive(still, fill=True, spare=0.3)[0][50, 50] == 20


def test_background_fixture():
    stack = scene(level=180)
    stack[:95, 25:35, 25:35] = 30
    stack[:, 65:75, 65:75] = 25
    bg, _ = backgrounds.adaptive(stack)
    assert bg[30, 30] > 150 and bg[70, 70] < 60


def test_repair_stuck():
    y, x = np.mgrid[:200, :200]
    img = np.full((200, 200), 150, dtype=np.uint8)
    img[(x - 100) ** 2 + (y - 100) ** 2 <= 81] = 40
    img[(x - 100) ** 2 + (y - 178) ** 2 <= 121] = 60
    out, at, n = backgrounds.repair_stuck(img, (100, 100, 9))
    assert out[178, 100] > 120 and out[100, 100] < 80 and math.hypot(at[0] - 100, at[1] - 178) <= 12 and n > 300
    out, at, n = backgrounds.repair_stuck(np.full((60, 60), 150, dtype=np.uint8))
    assert (out == 150).all() and at is None and n == 0
    whole, _, n = backgrounds.repair_stuck(img, (100, 100, 9), largest=50)
    assert 0 < n <= math.pi * 13.5**2
    mask = (x - 60) ** 2 + (y - 60) ** 2 <= 25
    assert backgrounds.repair_stuck(img, mask=mask)[1:] == ((60.0, 60.0), int(mask.sum()))


def test_arenas():
    y, x = np.mgrid[:120, :240]
    img = np.full((120, 240), 30, dtype=np.uint8)
    for cx, r in ((60, 40), (180, 30)):
        img[(x - cx) ** 2 + (y - 60) ** 2 <= r * r] = 200
    img[2:5, 2:5] = 220
    got = backgrounds.find_arenas(img)
    assert np.allclose(got, [(60, 60, 40), (180, 60, 30)], atol=0.5)
    assert backgrounds.find_arenas(img, expected=3) == [] and len(backgrounds.find_arenas(img, expected=1)) == 1
    mask = (x - 60) ** 2 + (y - 60) ** 2 <= 900
    out = backgrounds.blur_inside(img, mask)
    assert (out[~mask] == img[~mask]).all() and out[60, 60] == 200


def test_engine(spark):
    crops = spark.createDataFrame([("a", 1, f, 0.1 * f, 10 + f, 20, False, bytearray([f] * 64)) for f in range(5)], "roi string, track_id bigint, frame bigint, t_s double, crop_x0_full int, crop_y0_full int, out_of_bounds boolean, pixels binary")
    rois = spark.createDataFrame([("a", 12.0, 30.0, 5.0)], "roi string, cx double, cy double, r double")
    got = engine.infer(crops, engine.mock([(0, 0), (0.25, -0.5)]), ["thorax", "head"], 8, rois).orderBy("frame", "keypoint").collect()
    assert len(got) == 10 and {r["score"] for r in got} == {1.0}
    head = got[2]
    assert (head["keypoint"], head["x_crop"], head["y_crop"], head["x_full"], head["y_full"], head["x_roi"], head["y_roi"]) == ("head", 6, 0, 17, 20, 10, -5)
    assert engine.infer(crops.limit(0), engine.mock([(0, 0)]), ["thorax"], 8).count() == 0
    brightness = lambda images: (np.zeros((len(images), 1, 2)), images.mean(axis=(1, 2))[:, None])
    assert sorted(r["score"] for r in engine.infer(crops, brightness, ["thorax"], 8).collect()) == [0, 1, 2, 3, 4]


def test_gate_contrast(spark):
    rows = [("a", 0, 1, 0.0, 0.0, 50.0), ("a", 0, 2, 30.0, 0.0, 100.0), ("a", 0, 3, 0.0, 0.0, None), ("a", 1, 4, 0.0, 0.0, float("nan"))]
    c = spark.createDataFrame(rows, "roi string, frame bigint, event_id bigint, x double, y double, contrast double").withColumns({"px": F.lit(0.0), "py": F.lit(0.0)})
    ids = lambda df: sorted(r["event_id"] for r in df.collect())
    assert ids(engine.gate_contrast(c)) == [1, 2, 3, 4] and ids(engine.gate_contrast(c, 60)) == [2] and ids(engine.gate_contrast(c, darkness=1)) == [1, 4] and ids(engine.gate_contrast(c, darkness=2)) == [2, 4]


def test_dense_without_frames(spark):
    c = spark.createDataFrame([("a", 0, 1, 0.0, 0.0, 5.0)], "roi string, frame bigint, event_id bigint, x double, y double, area double")
    assert linking.dense(c, 0).count() == 0 and linking.dense(c, 3).count() == 3


def test_stream_sink(spark, tmp_path):
    for i in range(2):
        spark.range(5 * i, 5 * i + 5).write.parquet(f"{tmp_path}/in/{i}")
    for fmt in ("parquet", "csv"):
        stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in/*")
        for _ in range(2):  # the second time there's nothing new
            sink.append(stream, f"{tmp_path}/out.{fmt}", f"{tmp_path}/c-{fmt}").awaitTermination(60)
        assert sorted(r["id"] for r in readers.read_table(spark, f"{tmp_path}/out.{fmt}").collect()) == list(range(10))


def test_reports(spark, tracks):
    summary = qc.summarize(qc.flags(tracks.withColumn("speed_mm_s", F.lit(float("nan")))))
    text = reports.qc_json(summary.withColumn("edge_pinned", F.lit(False)), qc.run_summary(summary.withColumn("edge_pinned", F.lit(False))))
    got = json.loads(text)
    assert list(got["rois"]) == ["arena_01", "arena_02"] and got["run"]["n_rois"] == 2 and got["rois"]["arena_01"]["speed_mm_s_mean"] is None
    assert reports.qc_html(text, "a<b").count("<tr>") == 3 and "a<b" not in reports.qc_html(text, "a<b")
    runs = spark.createDataFrame([("fast", 100, 2.0), ("fast", 100, 4.0)], "mode string, frames bigint, seconds double")
    assert tomllib.loads(reports.bench_toml({"commit": 'x"y'}, compare.bench_stats(runs))) == {"commit": 'x"y', "fast": {"fps_mean": 37.5, "fps_std": pytest.approx(17.67767), "ms_per_frame": pytest.approx(26.6667, abs=1e-3), "total_s": 6.0}}
    batch = spark.createDataFrame([("a", 10, 0.0, 4.0), ("b", None, 1.0, 6.0), ("c", None, 2.0, None)], "video string, rows bigint, start_s double, end_s double")
    assert reports.batch_summary(batch).first().asDict() == {"n_ok": 1, "n_total": 3, "total_rows": 10, "elapsed_s": 6.0, "left_s": 3.0}


def test_circles():
    y, x = np.mgrid[:200, :210]
    img = np.full((200, 210), 30, dtype=np.uint8)
    want = [(52, 50, 40), (155, 55, 44), (50, 150, 38), (158, 148, 42)]
    for cx, cy, r in want:
        img[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = 190
    got = backgrounds.find_circles(img)
    assert len(got) == 4 and [c[2] for c in got] == sorted((c[2] for c in got), reverse=True)
    for cx, cy, r in want:
        assert any(math.hypot(a - cx, b - cy) <= 3 and abs(c - r) <= 3 for a, b, c in got)
    assert backgrounds.find_circles(np.full((80, 80), 9, dtype=np.uint8)) == []


def test_png():
    img = np.random.default_rng(1).integers(0, 256, (7, 11)).astype(np.uint8)
    raw = images.png(img)
    assert (images.gray(raw) == img).all() and raw.startswith(b"\x89PNG") and raw.endswith(b"IEND\xaeB`\x82")


def test_progress_and_cancel(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    listener = progress.watch(spark, lambda event, payload: seen.append((event, payload)))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    q = sink.append(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    endless = stream.writeStream.format("parquet").option("path", str(tmp_path / "out2")).option("checkpointLocation", str(tmp_path / "state2")).queryName("endless").start()
    assert progress.cancel(endless) and not endless.isActive and not progress.cancel(endless)
    for _ in range(100):
        if [e for e, _ in seen].count("done") >= 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    events = [e for e, _ in seen]
    assert events[0] == "started" and "frames" in events and events.count("done") == 2
    assert next(p for e, p in seen if e == "frames")["rows"] == 5


def test_functions_of_sql(spark):
    sql.register(spark)
    img = np.full((9, 9), 200)
    img[3:5, 3:6] = 20
    spark.createDataFrame([(img.reshape(-1).tolist(), [200] * 81)], "image array<int>, bg array<int>").createOrReplaceTempView("frames_")
    got = spark.sql("SELECT rank, x, y, area FROM frames_, LATERAL blobs(image, bg, 9, 50)").collect()
    assert [tuple(r) for r in got] == [(0, 4.0, 3.5, 6.0)]
    y, x = np.mgrid[:48, :48]
    port = np.where((x - 25) ** 2 + (y - 23) ** 2 <= 9, 30, 200)
    spark.createDataFrame([(port.reshape(-1).tolist(),), ([200] * 2304,)], "image array<int>").createOrReplaceTempView("plates_")
    got = spark.sql("SELECT cx, cy FROM plates_, LATERAL find_port(image, 48)").collect()
    assert len(got) == 1 and math.hypot(got[0].cx - 25, got[0].cy - 23) <= 1.5


def test_engines(spark):
    assert engine.build("mock", ["a"])(np.zeros((2, 8, 8)))[0].tolist() == [[[4.0, 4.0]], [[4.0, 4.0]]]
    with pytest.raises(ImportError):
        engine.build("another", ["a"])


def test_built_backgrounds(spark):
    y, x = np.mgrid[:40, :40]
    plate = np.where((x - 20) ** 2 + (y - 20) ** 2 <= 225, 180, 30)
    rows = [(0, k, i, int(v)) for k in range(6) for i, v in enumerate(plate.reshape(-1))]
    stack = spark.createDataFrame(rows, "roi int, sample long, pix int, v int")
    for method in ("mean", "p90", "gmm", "adaptive"):
        got = [r.value for r in backgrounds.build(stack, 40, method).orderBy("pix").collect()]
        assert got == plate.reshape(-1).tolist(), method
    smooth = np.array([r.value for r in backgrounds.build(stack, 40, "gmm", expected=1).orderBy("pix").collect()]).reshape(40, 40)
    assert smooth[20, 20] == 180 and (smooth[plate == 30] == 30).all() and smooth[20, 34] < 180
