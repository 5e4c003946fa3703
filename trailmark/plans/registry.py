"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import clock, human_size, r6
from ..operators import backgrounds, compare, engine, geometry, kernels, labels, linking, pixels, pose, qc, trajectory
from ..sources import readers, views
from ..sources.views import with_views
from . import more

K = ["video", "roi", "track_id", "frame"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


def _kin(s: SparkSession, d: str) -> DataFrame:
    return trajectory.add_kinematics(views.tracks(s, d), views.rois(s))


def _flags(s: SparkSession, d: str) -> DataFrame:
    return qc.flags(views.tracks(s, d), 640, 520)


def _summary(s: SparkSession, d: str) -> DataFrame:
    return qc.summarize(qc.flags(_kin(s, d), 640, 520), views.rois(s))


def dedupe_tracks(s, d):
    t = views.tracks(s, d)
    return trajectory.dedupe(t.unionByName(t.where("event_id % 7 = 0").withColumn("x", F.col("x") + 1))).select(*K, "x")


def kinematics(s, d):
    return rounded(_kin(s, d), "r_center_mm", "dt_s", "dx_mm", "dy_mm", "speed_mm_s").select(*K, "r_center_mm", "dt_s", "dx_mm", "dy_mm", "speed_mm_s")


def angle_unwrap(s, d):
    out = trajectory.unwrap(views.tracks(s, d).withColumn("angle_deg", F.col("angle_deg") * 3))
    return rounded(out, "angle_unwrapped_deg", "dangle_deg", "ang_speed_deg_s").select(*K, "angle_unwrapped_deg", "dangle_deg", "ang_speed_deg_s")


def angle_unwrap_all(s, d):
    out = trajectory.unwrap_all(views.tracks(s, d).withColumn("angle_deg", F.col("angle_deg") * 3))
    return rounded(out, "angle_unwrapped_deg").select(*K, "angle_unwrapped_deg")


def roi_local(s, d):
    return geometry.add_roi_local(views.tracks(s, d), views.rois(s).where("roi <> 'arena_04'")).select(*K, "x_roi", "y_roi")


def port_distance(s, d):
    out = trajectory.add_port_distance(views.tracks(s, d), views.ports(s), views.rois(s))
    return rounded(out, "dist_to_port_px", "dist_to_port_mm").select(*K, "dist_to_port_px", "dist_to_port_mm")


def port_offsets(s, d):
    return rounded(trajectory.port_offsets(views.ports(s), views.rois(s)), "offset_frac").select("roi", "offset_frac", "shared_r")


def crop_manifest(s, d):
    return geometry.crop_manifest(views.tracks(s, d), 96, 2).select(*K, "crop_x0_full", "crop_y0_full", "x_crop", "y_crop", "out_of_bounds")


def crop_geometry(s, d):
    return geometry.crop_geometry(views.rois(s), 2).select("roi", "crop", "x0", "y0", "scaled")


def detect_rescale(s, d):
    return geometry.rescale_detection(s.createDataFrame([(1,), (2,), (4,)], "downscale int")).select("downscale", "area_min", "area_max", "morph_open", "morph_close")


def seed_keypoints(s, d):
    return rounded(geometry.seed_keypoints(views.tracks(s, d)), "x_crop", "y_crop").select(*K, "keypoint", "x_crop", "y_crop")


def roi_window(s, d):
    out = geometry.window_of_roi(views.tracks(s, d), views.rois(s).where("roi <> 'arena_04'"))
    return rounded(out, "x0", "y0", "x1", "y1")


def _timing(s, d):
    e = views.numbered(s, d)
    w = Window.partitionBy("video").orderBy("event_id")
    return e.select("video", F.col("event_id").alias("frame"), F.col("t_s").alias("timestamp_s"), F.coalesce(F.col("t_s") - F.lag("t_s").over(w), F.lit(0.5)).alias("dt_s"))


def timing_dt(s, d):
    return rounded(readers.timing(_timing(s, d).select("video", "frame", "dt_s")), "t_s", "dt_s")


def timing_timestamp(s, d):
    return rounded(readers.timing(_timing(s, d)), "t_s", "dt_s")


def _thin(s, d):
    return views.tracks(s, d).where("frame % 3 = 0")


def resample(s, d):
    """Every track at every frame up to its video's last."""
    last = _thin(s, d).groupBy("video").agg(F.max("frame").alias("last"))
    frames = last.select("video", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame")).withColumn("t_s", F.col("frame") / 10.0)
    out = trajectory.resample(_thin(s, d), frames, ["x", "y"])
    return rounded(out, "x", "y").select(*K, "t_s", "x", "y")


def interpolate(s, d):
    t = views.tracks(s, d).withColumns({"x": F.when(F.col("frame") % 3 == 0, F.col("x")), "y": F.when(F.col("frame") % 5 != 0, F.col("y"))})
    return rounded(trajectory.interpolate(t, ["x", "y"]), "x", "y").select(*K, "x", "y")


def stride_filter(s, d):
    t = views.tracks(s, d)
    a = trajectory.stride_rows(t, 4).groupBy("video", "roi").agg(F.count("*").alias("n_row"))
    b = trajectory.stride_frames(t, 4).groupBy("video", "roi").agg(F.count("*").alias("n_mod"))
    return a.join(b, ["video", "roi"])


def qc_flags(s, d):
    return _flags(s, d).select(*K, *[f"flag_{f}" for f in qc.FLAGS])


def qc_flag_label(s, d):
    return qc.flag_label(_flags(s, d)).select(*K, "label")


def missing_report(s, d):
    return rounded(qc.missing_report(views.tracks(s, d)), "missing_fraction")


def qc_summary(s, d):
    return rounded(_summary(s, d), "missing_fraction", "speed_mm_s_mean", "speed_mm_s_max", "area_mean", "contrast_mean", "wall_fraction")


def run_summary(s, d):
    return qc.run_summary(_summary(s, d))


def coverage_raster(s, d):
    return rounded(qc.coverage(views.tracks(s, d), 50), "coverage")


def hist_speed(s, d):
    return qc.histogram(rounded(_kin(s, d), "speed_mm_s"), "speed_mm_s")


def hist_area(s, d):
    return qc.histogram(views.tracks(s, d), "area")


def hist_contrast(s, d):
    return qc.histogram(views.tracks(s, d), "contrast")


def occupancy_2d(s, d):
    return qc.occupancy(views.tracks(s, d))


def candidate_counts(s, d):
    return qc.value_counts(views.tracks(s, d), "n_candidates")


def flagged_spread(s, d):
    return qc.spread(qc.flagged(_flags(s, d)).select(*K), 25)


def follow_asof(s, d):
    """Every track at all frames up to its own last one, known at frames that aren't multiples of 4 only."""
    t = views.tracks(s, d)
    frames = t.groupBy(*K[:3]).agg(F.max("frame").alias("last")).select(*K[:3], F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    return qc.follow(t.where("frame % 4 <> 0"), frames, tuple(K[:3]))


def trail_window(s, d):
    return qc.trail(views.tracks(s, d), 10).select(*K, "n_points", "first_x")


def main_track(s, d):
    return qc.main_track(views.tracks(s, d))


def compare_tracks(s, d):
    t = views.tracks(s, d)
    test = t.where("frame % 17 <> 0").withColumn("x", F.col("x") + F.col("event_id") % 5 * F.lit(0.7)).unionByName(t.where("frame % 19 = 0").withColumn("frame", F.col("frame") + 100000))
    out = compare.compare(t, test)
    return rounded(out, "pos_mean", "pos_max", "pos_std", "pos_within", "angle_mean", "angle_within")


def key_sets(s, d):
    t = views.tracks(s, d).select(*K)
    return compare.key_sets(t, t.where("frame % 17 <> 0").union(t.where("frame % 19 = 0").withColumn("frame", F.col("frame") + 100000)))


def bench_stats(s, d):
    runs = views.table(s, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("mode"), (F.col("l_quantity") * 100).alias("frames"), (F.col("l_extendedprice") / 1000).alias("seconds"))
    return rounded(compare.bench_stats(runs), "fps_mean", "fps_std", "ms_per_frame", "total_s")


def validate_rollup(s, d):
    e = views.numbered(s, d).select((F.col("event_id") % 6).alias("video"), (F.col("value") - 2).alias("dt_s")).where("video < 5")
    videos = s.range(6).select(F.col("id").alias("video"), F.when(F.col("id") != 4, 100 + 60 * F.col("id")).alias("frame_count"), F.lit(64).alias("width"), F.when(F.col("id") == 3, 0).otherwise(48).alias("height"))
    return compare.roll_up(compare.validation(videos, e))


def pose_wide(s, d):
    return rounded(pose.wide(views.pose(s, d)), *[f"{n}_{c}" for n in views.NODES for c in ("x", "y", "score")])


def _pose_flags(s, d):
    return pose.flags(pose.wide(views.pose(s, d)), min_score=0.02)


def pose_flags(s, d):
    return _pose_flags(s, d).select("video", "roi", "frame", "flag_low_conf", "flag_missing", "flag_wing_swap", "flag_headtail")


def pose_flag_rates(s, d):
    return pose.flag_rates(_pose_flags(s, d))


def pose_confidence(s, d):
    return rounded(pose.confidence(views.pose(s, d)), "score_mean")


def _heat(s, d):
    return views.table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("heat"))


def heatmap_argmax(s, d):
    return rounded(pose.heatmap_argmax(_heat(s, d), 8, 64), "score")


def heatmap_centroid(s, d):
    return rounded(pose.heatmap_centroid(_heat(s, d), 8, 64), "x", "y", "score")


def context_windows(s, d):
    """Every frame is an anchor."""
    t = views.tracks(s, d).select("video", "roi", "frame").distinct()
    return pose.context_windows(t, t, 3).select("video", "roi", "anchor", "frame")


def match_nearest(s, d):
    """All instances against the anchors of all tracks."""
    t = views.tracks(s, d)
    anchors = t.groupBy("video", "frame", "roi").agg(F.min("x").alias("ax"), F.min("y").alias("ay"))
    return rounded(pose.match_nearest(t.select("video", "frame", F.col("track_id").alias("inst"), "x", "y"), anchors), "dist")


def uniform_sample(s, d):
    return pose.uniform_sample(views.tracks(s, d), 20).select(*K)


def diversity_sample(s, d):
    return pose.diversity_sample(views.tracks(s, d), 24).select(*K)


def random_sample(s, d):
    return pose.random_sample(views.tracks(s, d), 30, 7).select(*K)


def topk_candidates(s, d):
    return pose.top_candidates(views.candidates(s, d)).select("video", "roi", "frame", "rank", "x", "y", "area")


CIRCLES = [(300.0, 90.0, 40.0), (100.0, 100.0, 41.0), (300.0, 290.0, 42.0), (100.0, 300.0, 43.0), (200.0, 200.0, 5.0)]


def reading_order(s, d):
    return pose.reading_order(s.createDataFrame(CIRCLES, "cx double, cy double, r double"))


def pixel_mean(s, d):
    return pixels.mean(views.stack(s, d))


def pixel_percentile(s, d):
    return rounded(pixels.percentile(views.stack(s, d), 0.9), "value")


def pixel_spread(s, d):
    return rounded(pixels.spread(views.stack(s, d)), "std")


def frame_diff(s, d):
    return pixels.first_last(views.stack(s, d))


def _bg(s, d, p=0.5):
    return pixels.byte_percentile(views.stack(s, d), p)


def ghost_mask(s, d):
    return pixels.ghost_mask(views.stack(s, d), _bg(s, d), margin=95).select("roi", "pix", "ghost")


def deghost_nearmax(s, d):
    return pixels.deghost_near_max(views.stack(s, d), _bg(s, d), margin=95)


def fg_excluded_bg(s, d):
    places = views.stack(s, d).select("roi", "sample").distinct().select("roi", "sample", (F.col("sample") % 8).alias("ox"), (F.col("sample") % 5).alias("oy"))
    return rounded(pixels.foreground_excluded(views.stack(s, d), places, 0.9, 2.0, 8), "value")


def bg_diff(s, d):
    return pixels.difference(views.stack(s, d), _bg(s, d, 0.9)).groupBy("roi", "sample").agg(F.sum("d").alias("total"), F.max("d").alias("top"))


def otsu_threshold(s, d):
    return pixels.otsu(views.stack(s, d), ["roi"], "v")


def drift_median(s, d):
    return pixels.drift(views.stack(s, d), _bg(s, d))


def floor_level(s, d):
    return pixels.floor_level(_bg(s, d, 0.9))


def stuck_coverage(s, d):
    return rounded(qc.stuck(views.tracks(s, d).where("roi <> 'arena_02'"), views.rois(s), 3000), "coverage")


def _linked(s, d, **kw):
    return linking.link(linking.dense(views.candidates(s, d)), linking.Settings(max_jump=40, miss_tolerance=3, centers={r[0]: (r[1], r[2]) for r in views.ROIS}, **kw))


def link_tracks(s, d):
    return _linked(s, d).where("not missed").select("video", "roi", "frame", "x", "y")


def link_trace(s, d):
    """A row for each frame, misses too: gate, prediction, candidates and the one chosen."""
    return rounded(_linked(s, d), "pred_x", "pred_y").select("video", "roi", "frame", "gate", "missed", "pred_x", "pred_y", "n_candidates", "chosen")


def link_kalman(s, d):
    return rounded(_linked(s, d, use_kalman=True, smoothing=True), "x", "y", "pred_x", "pred_y").select("video", "roi", "frame", "x", "y", "gate", "missed", "pred_x", "pred_y")


def flag_speed_rollup(s, d):
    """Speeds per arena and in all, in one pass."""
    return rounded(_kin(s, d).rollup("video", "roi").agg(F.count("*").alias("n"), F.avg("speed_mm_s").alias("mean")), "mean")


def gmm_background(s, d):
    return kernels.gmm_background(views.stack(s, d))


def adaptive_background(s, d):
    return backgrounds.model(views.stack(s, d), 8, fill=True)


def _labels(s, d):
    t = views.tracks(s, d)
    edited = t.select(*K, (F.col("event_id") % 4 != 0).alias("labeled"), (F.col("event_id") % 9 == 0).alias("bad"))
    return labels.swap(labels.seeded(t).drop("labeled", "bad").join(edited, K), F.col("frame") % 3 == 0)


def label_manifest(s, d):
    return rounded(labels.manifest(_labels(s, d)), "x_full", "y_full", "x_crop", "y_crop").select(*K, "keypoint", "x_full", "y_full", "x_crop", "y_crop", "visible")


def contrast_gate(s, d):
    t = views.tracks(s, d).select("video", "roi", F.floor(F.col("t_s") / 3600).cast("long").alias("frame"), "event_id", "x", "y", "contrast")
    seen = rounded(engine.gate_contrast(t.join(views.rois(s).select("roi", F.col("cx").alias("px"), F.col("cy").alias("py")), "roi"), 20, 0.5), "score")
    return seen.select("video", "roi", "frame", "event_id", "score")


def best_batch(s, d):
    runs = views.table(s, d, "lineitem").select((F.col("l_linenumber") * 16).alias("batch_size"), (F.col("l_quantity") * 10).alias("crops"), (F.col("l_extendedprice") / 1000).alias("seconds"))
    return rounded(compare.best_batch(runs, 10_001), "crops_per_s", "video_s")


def detection_jumps(s, d):
    return rounded(compare.jumps(views.tracks(s, d)), "jump_px").select(*K, "jump_px")


def progress_left(s, d):
    w = Window.partitionBy("user_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    updates = views.numbered(s, d).select(F.col("user_id").alias("run"), "t_s", F.sum(F.col("k") % 7).over(w).alias("done"))
    return rounded(compare.progress(updates, 1000), "s_per_frame", "left_s")


def size_texts(s, d):
    o = views.table(s, d, "orders")
    return o.select("o_orderkey", human_size(F.col("o_orderkey") * F.col("o_orderkey") * 1000 + 7).alias("size"), clock(F.col("o_orderkey") * 37).alias("clock"))


_NAMES = [
    "dedupe_tracks", "kinematics", "angle_unwrap", "angle_unwrap_all", "roi_local", "port_distance", "port_offsets", "crop_manifest", "crop_geometry", "detect_rescale", "seed_keypoints", "roi_window", "timing_dt", "timing_timestamp", "resample", "interpolate", "stride_filter",
    "qc_flags", "qc_flag_label", "missing_report", "qc_summary", "run_summary", "coverage_raster", "hist_speed", "hist_area", "hist_contrast", "occupancy_2d", "candidate_counts", "flagged_spread", "follow_asof", "trail_window", "main_track", "compare_tracks", "key_sets", "bench_stats", "validate_rollup",
    "pose_wide", "pose_flags", "pose_flag_rates", "pose_confidence", "heatmap_argmax", "heatmap_centroid", "context_windows", "match_nearest", "uniform_sample", "diversity_sample", "random_sample", "topk_candidates", "reading_order",
    "pixel_mean", "pixel_percentile", "pixel_spread", "frame_diff", "ghost_mask", "deghost_nearmax", "fg_excluded_bg", "bg_diff", "otsu_threshold", "drift_median", "floor_level", "stuck_coverage", "link_tracks", "link_trace", "link_kalman", "flag_speed_rollup", "adaptive_background", "label_manifest", "contrast_gate", "best_batch", "detection_jumps", "progress_left", "size_texts", "gmm_background",
]


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES} | more.QUERIES


def _r(c: str) -> str:
    return f"round({c}, 6) + 0.0::double"


_STEP = "coalesce({0} - lag({0}) OVER w, 0.0::double)"
_KIN = f"""c AS (SELECT t.*, r.r, 2 * r / 75.0::double AS px, x - cx AS dx, y - cy AS dy FROM tracks t JOIN rois r USING (roi)),
m AS (SELECT *, sqrt(dx * dx + dy * dy) AS r_center_px, sqrt(dx * dx + dy * dy) / px AS r_center_mm, dx / px AS x_mm, dy / px AS y_mm FROM c),
kin0 AS (SELECT *, {_STEP.format('t_s')} AS dt_s, {_STEP.format('x_mm')} AS dx_mm, {_STEP.format('y_mm')} AS dy_mm FROM m WINDOW w AS (PARTITION BY video, roi, track_id ORDER BY frame)),
kin AS (SELECT *, CASE WHEN dt_s > 0 THEN sqrt(dx_mm * dx_mm + dy_mm * dy_mm) / dt_s ELSE 0.0::double END AS speed_mm_s FROM kin0)"""
_FLAGS = """fl AS (SELECT *, coalesce(area < 10 OR area > 1500, false) AS flag_area, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) > 40, false) AS flag_jump, coalesce(x - 48 < 0 OR y - 48 < 0 OR x + 48 > 640 OR y + 48 > 520, false) AS flag_crop_oob, coalesce(n_candidates, 1) > 1 AS flag_multi, coalesce(contrast < 10, false) AS flag_low_contrast FROM {src} WINDOW w AS (PARTITION BY video, roi, track_id ORDER BY frame))"""
_MISSING = """mr AS (SELECT video, roi, count(DISTINCT frame) AS frames_present, max(max(frame)) OVER (PARTITION BY video) + 1 AS frames_expected FROM tracks GROUP BY video, roi),
miss AS (SELECT video, roi, frames_present, frames_expected, greatest(0, frames_expected - frames_present) AS frames_missing, greatest(0, frames_expected - frames_present) / frames_expected::double AS missing_fraction FROM mr)"""
_SUMMARY = f"""{_KIN}, {_FLAGS.format(src='kin')}, {_MISSING},
su AS (SELECT video, roi, sum(flag_area::int)::bigint AS n_area, sum(flag_jump::int)::bigint AS n_jump, sum(flag_crop_oob::int)::bigint AS n_crop_oob, sum(flag_multi::int)::bigint AS n_multi, sum(flag_low_contrast::int)::bigint AS n_low_contrast, avg(speed_mm_s) AS speed_mm_s_mean, max(speed_mm_s) AS speed_mm_s_max, avg(speed_mm_s) < 0.05 AS low_activity, avg(area) AS area_mean, avg(contrast) AS contrast_mean, avg(CASE WHEN r_center_px > 0.85 * r THEN 1.0::double ELSE 0.0::double END) AS wall_fraction FROM fl GROUP BY video, roi),
summary AS (SELECT miss.*, su.* EXCLUDE (video, roi), wall_fraction > 0.9 AS edge_pinned FROM miss JOIN su USING (video, roi))"""


def _hist(src: str, value: str) -> str:
    return f"ends AS (SELECT video, roi, min({value}) AS lo, max({value}) AS hi FROM {src} WHERE {value} IS NOT NULL GROUP BY video, roi) SELECT video, roi, least(floor(({value} - lo) / (hi - lo) * 50)::int, 49) AS bin, count(*) AS n FROM {src} JOIN ends USING (video, roi) WHERE {value} IS NOT NULL GROUP BY 1, 2, 3"


def _fill(v: str) -> str:
    lo, hi = f"last_value(CASE WHEN {v} IS NOT NULL THEN {{'p': p, 'v': {v}}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"first_value(CASE WHEN {v} IS NOT NULL THEN {{'p': p, 'v': {v}}} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"{lo} AS lo_{v}, {hi} AS hi_{v}"


def _filled(v: str) -> str:
    return f"{_r(f'coalesce({v}, CASE WHEN lo_{v} IS NULL THEN hi_{v}.v WHEN hi_{v} IS NULL THEN lo_{v}.v ELSE lo_{v}.v + (hi_{v}.v - lo_{v}.v) * (p - lo_{v}.p) / (hi_{v}.p - lo_{v}.p) END)')} AS {v}"


_UNWRAP = """a AS (SELECT *, radians(angle_deg * 3) AS a FROM tracks),
st AS (SELECT *, a - lag(a) OVER (PARTITION BY video, roi, track_id ORDER BY frame) AS d, t_s - lag(t_s) OVER (PARTITION BY video, roi, track_id ORDER BY frame) AS dt FROM a),
mo AS (SELECT *, (((d + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi() AS mm FROM st),
co AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < pi() THEN 0.0::double ELSE (CASE WHEN mm = -pi() AND d > 0 THEN pi() ELSE mm END) - d END AS c FROM mo)"""
_WIDE = "wide AS (SELECT video, roi, frame, " + ", ".join(f"max({c}) FILTER (WHERE keypoint = '{n}') AS {n}_{c}" for n in views.NODES for c in ("x", "y", "score")) + " FROM pose WHERE x IS NOT NULL OR y IS NOT NULL OR score IS NOT NULL GROUP BY video, roi, frame)"
_LAT = "CASE WHEN len > 0 AND abs((({s}_x - thorax_x) * -fy + ({s}_y - thorax_y) * fx) / len) > 0.15 * len AND {s}_score >= 0.02 THEN (({s}_x - thorax_x) * -fy + ({s}_y - thorax_y) * fx) / len END AS l_{s}"
_POSE = f"""{_WIDE}, ax AS (SELECT *, head_x - abdomen_x AS fx, head_y - abdomen_y AS fy, sqrt((head_x - abdomen_x) * (head_x - abdomen_x) + (head_y - abdomen_y) * (head_y - abdomen_y)) AS len FROM wide),
la AS (SELECT *, {_LAT.format(s='wingL')}, {_LAT.format(s='wingR')}, lag(fx) OVER o AS px, lag(fy) OVER o AS py, lag(len) OVER o AS pl FROM ax WINDOW o AS (PARTITION BY video, roi ORDER BY frame)),
us AS (SELECT *, CASE WHEN coalesce(median(l_wingL) OVER g, 0) < 0 THEN -1 ELSE 1 END AS ul, CASE WHEN coalesce(median(l_wingR) OVER g, 0) < 0 THEN -1 ELSE 1 END AS ur FROM la WINDOW g AS (PARTITION BY video, roi)),
pf AS (SELECT video, roi, frame, coalesce(least({', '.join(n + '_score' for n in views.NODES)}) < 0.02, false) AS flag_low_conf, ({' OR '.join(f'{n}_x IS NULL OR {n}_y IS NULL' for n in views.NODES)}) AS flag_missing, coalesce(l_wingL IS NOT NULL AND sign(l_wingL) <> ul, false) OR coalesce(l_wingR IS NOT NULL AND sign(l_wingR) <> ur, false) AS flag_wing_swap, coalesce(len > 0 AND pl > 0 AND (fx * px + fy * py) / (len * pl) < cos(radians(120.0)), false) AS flag_headtail FROM us)"""
_BG = "bg AS (SELECT roi, pix, floor(quantile_cont(v, {p}::double) + 1e-9)::int AS value FROM stack GROUP BY roi, pix)"
_TOP = "top AS (SELECT roi, pix, quantile_cont(v, 0.98::double) AS top FROM stack GROUP BY roi, pix)"
def _link(kalman: bool) -> str:
    """Linking as a recursion over frames; f is the filter in single precision: place, speed, covariance."""
    fresh = lambda x, y: "{'x': " + x + "::FLOAT, 'y': " + y + "::FLOAT, 'u': 0::FLOAT, 'v': 0::FLOAT, 'a': 1::FLOAT, 'b': 0::FLOAT, 'c': 1::FLOAT}"
    none = "NULL::STRUCT(x FLOAT, y FLOAT, u FLOAT, v FLOAT, a FLOAT, b FLOAT, c FLOAT)"
    seeded = "(SELECT g.video, g.roi, g.frame, g.cs, l.misses AS m, l.f, (40.0 * (1 + l.misses))::double AS gate, coalesce(g.cs[1].x, c.cx) AS sx, coalesce(g.cs[1].y, c.cy) AS sy, coalesce(l.lx, g.cs[1].x, c.cx) AS hx, coalesce(l.ly, g.cs[1].y, c.cy) AS hy FROM link l JOIN grid g ON g.video = l.video AND g.roi = l.roi AND g.frame = l.frame + 1 JOIN rois c ON c.roi = l.roi)"
    state, p, raw = none, none, "acc"
    pred, emit = (lambda c: f"h{c}"), (lambda c: "")
    if kalman:
        seeded = f"(SELECT *, CASE WHEN f IS NULL THEN {fresh('hx', 'hy')} ELSE f END AS h FROM {seeded})"
        p = "{'x': h.x + h.u, 'y': h.y + h.v, 'u': h.u, 'v': h.v, 'a': (h.a + h.b) + (h.b + h.c) + 0.01::FLOAT, 'b': h.b + h.c, 'c': h.c + 0.01::FLOAT}"
        gain, lift = "(p.a / (p.a + 0.1::FLOAT))", "(p.b / (p.a + 0.1::FLOAT))"
        off = lambda c: f"(cs[b].{c}::FLOAT - p.{c})"
        right = f"{{'x': p.x + {gain} * {off('x')}, 'y': p.y + {gain} * {off('y')}, 'u': p.u + {lift} * {off('x')}, 'v': p.v + {lift} * {off('y')}, 'a': (1::FLOAT - {gain}) * p.a, 'b': (1::FLOAT - {gain}) * p.b, 'c': p.c - {lift} * p.b}}"
        state = f"CASE WHEN acc AND m > 0 THEN {fresh('cs[b].x', 'cs[b].y')} WHEN acc THEN {right} WHEN reseed THEN {fresh('sx', 'sy')} ELSE p END"
        pred, raw = (lambda c: f"CASE WHEN m = 0 THEN p.{c}::double ELSE h{c} END"), "acc AND m > 0"
        emit = lambda c: f"WHEN acc THEN (p.{c} + {gain} * {off(c)})::double "
    out = lambda c: f"CASE WHEN {raw} THEN cs[b].{c} {emit(c)}WHEN reseed AND len(cs) > 0 THEN cs[1].{c} END"
    return f""", best AS (SELECT video, roi, frame, event_id, x, y, area, row_number() OVER (PARTITION BY video, roi, frame ORDER BY area DESC, event_id) AS n FROM candidates),
lists AS (SELECT video, roi, frame, list({{'x': x, 'y': y}} ORDER BY n) AS cs FROM best WHERE n <= 5 GROUP BY video, roi, frame),
cells AS (SELECT video, roi, unnest(range(0, last + 1)) AS frame FROM (SELECT DISTINCT video, roi FROM candidates) JOIN (SELECT video, max(frame) AS last FROM candidates GROUP BY video) USING (video)),
grid AS (SELECT video, roi, frame, coalesce(cs, []) AS cs FROM cells LEFT JOIN lists USING (video, roi, frame)),
link AS (SELECT video, roi, -1::bigint AS frame, NULL::double AS lx, NULL::double AS ly, 0 AS misses, {none} AS f, NULL::double AS x, NULL::double AS y, NULL::double AS gate, NULL::double AS pred_x, NULL::double AS pred_y, 0::bigint AS n_candidates, -1::bigint AS chosen FROM (SELECT DISTINCT video, roi FROM candidates)
UNION ALL SELECT video, roi, frame, CASE WHEN acc THEN cs[b].x WHEN reseed THEN sx ELSE hx END, CASE WHEN acc THEN cs[b].y WHEN reseed THEN sy ELSE hy END, CASE WHEN acc OR reseed THEN 0 ELSE m + 1 END, {state}, {out('x')}, {out('y')}, gate, px, py, len(cs), CASE WHEN acc THEN b - 1 WHEN reseed AND len(cs) > 0 THEN 0 ELSE -1 END FROM (
SELECT *, NOT acc AND m + 1 > 3 AS reseed FROM (SELECT *, coalesce(ds[b] <= gate, false) AS acc FROM (SELECT *, list_position(ds, list_min(ds)) AS b FROM (
SELECT *, list_transform(cs, lambda q: sqrt((q.x - px) * (q.x - px) + (q.y - py) * (q.y - py))) AS ds FROM (SELECT *, {pred('x')} AS px, {pred('y')} AS py FROM (SELECT *, {p} AS p FROM {seeded})))))))"""


def oracle_sql() -> dict[str, str]:
    k = "video, roi, track_id, frame"
    trunc0 = lambda c: f"trunc(greatest(0.0::double, {c}))::int"
    origin = lambda c: f"(round_even({c}, 0)::int - 48)"
    sql = {
        "dedupe_tracks": with_views("tracks", f"SELECT {k}, min(x) AS x FROM (SELECT {k}, x FROM tracks UNION ALL SELECT {k}, x + 1 FROM tracks WHERE event_id % 7 = 0) GROUP BY {k}"),
        "kinematics": with_views("tracks rois", f", {_KIN} SELECT {k}, " + ", ".join(f"{_r(c)} AS {c}" for c in ("r_center_mm", "dt_s", "dx_mm", "dy_mm", "speed_mm_s")) + " FROM kin"),
        "angle_unwrap": with_views("tracks", f", {_UNWRAP}, un AS (SELECT *, degrees(a + sum(c) OVER (PARTITION BY video, roi, track_id ORDER BY frame)) AS u FROM co), s2 AS (SELECT *, coalesce(u - lag(u) OVER (PARTITION BY video, roi, track_id ORDER BY frame), 0) AS du FROM un) SELECT {k}, {_r('u')} AS angle_unwrapped_deg, {_r('du')} AS dangle_deg, {_r('CASE WHEN dt > 0 THEN du / dt ELSE 0.0::double END')} AS ang_speed_deg_s FROM s2"),
        "angle_unwrap_all": with_views("tracks", f", a AS (SELECT *, radians(angle_deg * 3) AS a FROM tracks), st AS (SELECT *, a - lag(a) OVER (PARTITION BY video ORDER BY {k}) AS d FROM a), mo AS (SELECT *, (((d + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi() AS mm FROM st), co AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < pi() THEN 0.0::double ELSE (CASE WHEN mm = -pi() AND d > 0 THEN pi() ELSE mm END) - d END AS c FROM mo) SELECT {k}, {_r(f'degrees(a + sum(c) OVER (PARTITION BY video ORDER BY {k}))')} AS angle_unwrapped_deg FROM co"),
        "roi_local": with_views("tracks rois", f"SELECT {k}, x - coalesce({trunc0('cx - r')}, 0) AS x_roi, y - coalesce({trunc0('cy - r')}, 0) AS y_roi FROM tracks LEFT JOIN (SELECT * FROM rois WHERE roi <> 'arena_04') USING (roi)"),
        "port_distance": with_views("tracks rois ports", f"SELECT {k}, {_r('sqrt((x - port_x) * (x - port_x) + (y - port_y) * (y - port_y))')} AS dist_to_port_px, {_r('CASE WHEN r > 0 THEN sqrt((x - port_x) * (x - port_x) + (y - port_y) * (y - port_y)) * 75 / (2 * r) END')} AS dist_to_port_mm FROM tracks LEFT JOIN ports USING (roi) LEFT JOIN rois USING (roi)"),
        "port_offsets": with_views("rois ports", f"SELECT roi, {_r('sqrt((port_x - cx) * (port_x - cx) + (port_y - cy) * (port_y - cy)) / greatest(1.0::double, r)')} AS offset_frac, (SELECT median(port_r) FROM ports) AS shared_r FROM ports JOIN rois USING (roi)"),
        "crop_manifest": with_views("tracks", f"SELECT {k}, {origin('x')} AS crop_x0_full, {origin('y')} AS crop_y0_full, x - {origin('x')} AS x_crop, y - {origin('y')} AS y_crop, {origin('x')} < 0 OR {origin('y')} < 0 AS out_of_bounds FROM tracks WHERE frame % 2 = 0"),
        "crop_geometry": with_views("rois", f", c AS (SELECT *, trunc(2 * r)::int - trunc(2 * r)::int % 4 AS crop FROM rois) SELECT roi, crop, {trunc0('cx - r')} AS x0, {trunc0('cy - r')} AS y0, crop // 2 AS scaled FROM c"),
        "detect_rescale": "SELECT downscale, " + ", ".join(f"greatest(1, round_even({v}::double * f{' * f' if n.startswith('area') else ''}, 0)::int) AS {n}" for n, v in (("area_min", 10), ("area_max", 1500), ("morph_open", 3), ("morph_close", 5))) + " FROM (SELECT d AS downscale, 2.0::double / d AS f FROM (VALUES (1), (2), (4)) t(d))",
        "seed_keypoints": with_views("tracks", f", s AS (SELECT *, x - {origin('x')} AS cx, y - {origin('y')} AS cy, cos(radians(angle_deg)) AS ux, sin(radians(angle_deg)) AS uy FROM tracks) SELECT {k}, keypoint, {_r('greatest(0.0::double, least(96.0::double, cx + p * major * ux - q * minor * uy))')} AS x_crop, {_r('greatest(0.0::double, least(96.0::double, cy + p * major * uy + q * minor * ux))')} AS y_crop FROM s, (VALUES ('head', 0.5::double, 0.0::double), ('thorax', 0.0, 0.0), ('abdomen', -0.5, 0.0), ('wingL', -0.25, 0.5), ('wingR', -0.25, -0.5)) n(keypoint, p, q)"),
        "roi_window": with_views("tracks rois", f", e AS (SELECT video, roi, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, greatest(greatest(max(x) - min(x), max(y) - min(y)) * 1.12 + 240, 160.0::double) / 2 AS h FROM tracks GROUP BY video, roi) SELECT video, roi, {_r('coalesce(cx - r, mx - h)')} AS x0, {_r('coalesce(cy - r, my - h)')} AS y0, {_r('coalesce(cx + r, mx + h)')} AS x1, {_r('coalesce(cy + r, my + h)')} AS y1 FROM e LEFT JOIN (SELECT * FROM rois WHERE roi <> 'arena_04') USING (roi)"),
        "timing_dt": with_views("ev", f", t AS (SELECT video, event_id AS frame, coalesce(t_s - lag(t_s) OVER (PARTITION BY video ORDER BY event_id), 0.5::double) AS dt_s FROM ev) SELECT video, frame, {_r('sum(dt_s) OVER (PARTITION BY video ORDER BY frame)')} AS t_s, {_r('dt_s')} AS dt_s FROM t"),
        "timing_timestamp": with_views("ev", f"SELECT video, event_id AS frame, {_r('t_s')} AS t_s, {_r('coalesce(t_s - lag(t_s) OVER (PARTITION BY video ORDER BY event_id), 0.0::double)')} AS dt_s FROM ev"),
        "resample": with_views("tracks", f", l AS (SELECT video, unnest(range(0, max(frame) + 1)) AS f FROM tracks WHERE frame % 3 = 0 GROUP BY video), g AS (SELECT video, roi, track_id, f::bigint AS frame, f / 10.0::double AS t_s FROM (SELECT DISTINCT video, roi, track_id FROM tracks WHERE frame % 3 = 0) JOIN l USING (video)), j AS (SELECT g.*, x, y, row_number() OVER (PARTITION BY g.video, g.roi, g.track_id ORDER BY g.frame) AS p FROM g LEFT JOIN (SELECT * FROM tracks WHERE frame % 3 = 0) t USING ({k})), n AS (SELECT *, {_fill('x')}, {_fill('y')} FROM j WINDOW w AS (PARTITION BY video, roi, track_id ORDER BY frame)) SELECT {k}, t_s, {_filled('x')}, {_filled('y')} FROM n"),
        "interpolate": with_views("tracks", f", j AS (SELECT {k}, CASE WHEN frame % 3 = 0 THEN x END AS x, CASE WHEN frame % 5 <> 0 THEN y END AS y, row_number() OVER (PARTITION BY video, roi, track_id ORDER BY frame) AS p FROM tracks), n AS (SELECT *, {_fill('x')}, {_fill('y')} FROM j WINDOW w AS (PARTITION BY video, roi, track_id ORDER BY frame)) SELECT {k}, {_filled('x')}, {_filled('y')} FROM n"),
        "stride_filter": with_views("tracks", ", n AS (SELECT *, row_number() OVER (PARTITION BY video, roi, track_id ORDER BY frame) - 1 AS i FROM tracks) SELECT video, roi, count(*) FILTER (WHERE i % 4 = 0) AS n_row, count(*) FILTER (WHERE frame % 4 = 0) AS n_mod FROM n GROUP BY video, roi"),
        "qc_flags": with_views("tracks", f", {_FLAGS.format(src='tracks')} SELECT {k}, flag_area, flag_jump, flag_crop_oob, flag_multi, flag_low_contrast FROM fl"),
        "qc_flag_label": with_views("tracks", f", {_FLAGS.format(src='tracks')} SELECT {k}, concat_ws(',', CASE WHEN flag_area THEN 'area' END, CASE WHEN flag_jump THEN 'jump' END, CASE WHEN flag_crop_oob THEN 'oob' END, CASE WHEN flag_multi THEN 'multi' END, CASE WHEN flag_low_contrast THEN 'lowC' END) AS label FROM fl"),
        "missing_report": with_views("tracks", f", {_MISSING} SELECT * REPLACE ({_r('missing_fraction')} AS missing_fraction) FROM miss"),
        "qc_summary": with_views("tracks rois", f", {_SUMMARY} SELECT * REPLACE ({', '.join(f'{_r(c)} AS {c}' for c in ('missing_fraction', 'speed_mm_s_mean', 'speed_mm_s_max', 'area_mean', 'contrast_mean', 'wall_fraction'))}) FROM summary"),
        "run_summary": with_views("tracks rois", f", {_SUMMARY} SELECT video, count(*) AS n_rois, max(frames_expected) AS n_frames, sum(edge_pinned::int)::bigint AS n_edge_pinned, sum(low_activity::int)::bigint AS n_low_activity FROM summary GROUP BY video"),
        "coverage_raster": with_views("tracks", f", n AS (SELECT video, max(frame) + 1 AS n, least(max(frame) + 1, 50) AS nb FROM tracks GROUP BY video), g AS (SELECT video, roi, b::int AS bin, n, nb FROM (SELECT DISTINCT video, roi FROM tracks) JOIN n USING (video), range(50) q(b) WHERE b < nb), c AS (SELECT video, roi, least(floor(frame * nb / n::double), nb - 1)::int AS bin, count(*) AS c FROM (SELECT DISTINCT video, roi, frame FROM tracks) JOIN n USING (video) GROUP BY 1, 2, 3) SELECT video, roi, bin, {_r('least(1.0::double, coalesce(c, 0) / (n / nb::double))')} AS coverage FROM g LEFT JOIN c USING (video, roi, bin)"),
        "hist_speed": with_views("tracks rois", f", {_KIN}, ks AS (SELECT video, roi, {_r('speed_mm_s')} AS s FROM kin), {_hist('ks', 's')}"),
        "hist_area": with_views("tracks", f", {_hist('tracks', 'area')}"),
        "hist_contrast": with_views("tracks", f", {_hist('tracks', 'contrast')}"),
        "occupancy_2d": with_views("tracks", ", e AS (SELECT video, roi, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM tracks GROUP BY video, roi) SELECT video, roi, least(floor((x - x0) / (x1 - x0) * 50)::int, 49) AS bx, least(floor((y - y0) / (y1 - y0) * 50)::int, 49) AS by, count(*) AS n FROM tracks JOIN e USING (video, roi) GROUP BY 1, 2, 3, 4"),
        "candidate_counts": with_views("tracks", "SELECT n_candidates, count(*) AS n FROM tracks GROUP BY 1"),
        "flagged_spread": with_views("tracks", f", {_FLAGS.format(src='tracks')}, o AS (SELECT {k}, row_number() OVER (PARTITION BY video ORDER BY {k}) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM fl WHERE flag_area OR flag_jump OR flag_crop_oob OR flag_multi OR flag_low_contrast) SELECT {k} FROM o WHERE n <= 25 OR list_contains([trunc(q * (n - 1) / 24.0::double)::bigint for q in range(25)], i)"),
        "follow_asof": with_views("tracks", ", t AS (SELECT * FROM tracks WHERE frame % 4 <> 0), a AS (SELECT video, roi, track_id, unnest(range(0, max(frame) + 1)) AS frame FROM tracks GROUP BY video, roi, track_id), f AS (SELECT video, roi, track_id, arg_min(x, frame) AS x0, arg_min(y, frame) AS y0 FROM t GROUP BY video, roi, track_id) SELECT a.video, a.roi, a.track_id, a.frame, coalesce(t.x, x0) AS cx, coalesce(t.y, y0) AS cy FROM a ASOF LEFT JOIN t ON a.video = t.video AND a.roi = t.roi AND a.track_id = t.track_id AND a.frame >= t.frame LEFT JOIN f ON a.video = f.video AND a.roi = f.roi AND a.track_id = f.track_id"),
        "trail_window": with_views("tracks", f"SELECT {k}, count(*) OVER w AS n_points, first_value(x) OVER w AS first_x FROM tracks WINDOW w AS (PARTITION BY video, roi, track_id ORDER BY frame RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)"),
        "main_track": with_views("tracks", ", n AS (SELECT video, roi, track_id, count(*) AS n FROM tracks GROUP BY 1, 2, 3) SELECT video, roi, track_id, n FROM n QUALIFY row_number() OVER (PARTITION BY video, roi ORDER BY n DESC, track_id) = 1"),
        "compare_tracks": with_views("tracks", f", te AS (SELECT {k}, x + event_id % 5 * 0.7::double AS x, y, angle_deg FROM tracks WHERE frame % 17 <> 0 UNION ALL SELECT video, roi, track_id, frame + 100000, x, y, angle_deg FROM tracks WHERE frame % 19 = 0), j AS (SELECT a.roi AS ra, b.roi AS rb, CASE WHEN a.roi IS NOT NULL AND b.roi IS NOT NULL THEN sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) END AS pos, CASE WHEN a.roi IS NOT NULL AND b.roi IS NOT NULL THEN least(abs(a.angle_deg - b.angle_deg) % 360, 360 - abs(a.angle_deg - b.angle_deg) % 360) END AS ang FROM tracks a FULL JOIN te b ON a.video = b.video AND a.roi = b.roi AND a.track_id = b.track_id AND a.frame = b.frame) SELECT count(ra) AS n_reference, count(rb) AS n_test, count(pos) AS n_common, count(*) FILTER (WHERE rb IS NULL) AS n_only_reference, count(*) FILTER (WHERE ra IS NULL) AS n_only_test, {_r('avg(pos)')} AS pos_mean, {_r('max(pos)')} AS pos_max, {_r('stddev_pop(pos)')} AS pos_std, {_r('avg((pos <= 2)::int)')} AS pos_within, {_r('avg(ang)')} AS angle_mean, {_r('avg((ang <= 10)::int)')} AS angle_within FROM j"),
        "key_sets": with_views("tracks", f", t AS (SELECT {k} FROM tracks), u AS (SELECT {k} FROM tracks WHERE frame % 17 <> 0 UNION ALL SELECT video, roi, track_id, frame + 100000 FROM tracks WHERE frame % 19 = 0) SELECT 'common' AS part, count(*) AS n FROM (SELECT * FROM t INTERSECT SELECT * FROM u) UNION ALL SELECT 'only_reference', count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM u) UNION ALL SELECT 'only_test', count(*) FROM (SELECT * FROM u EXCEPT ALL SELECT * FROM t)"),
        "bench_stats": f"SELECT mode, {_r('avg(f)')} AS fps_mean, {_r('coalesce(stddev_samp(f), 0.0::double)')} AS fps_std, {_r('1000 / avg(f)')} AS ms_per_frame, {_r('sum(s)')} AS total_s FROM (SELECT l_returnflag || l_linestatus AS mode, l_quantity * 100 / (l_extendedprice / 1000) AS f, l_extendedprice / 1000 AS s FROM lineitem) GROUP BY 1",
        "validate_rollup": with_views("ev", ", t AS (SELECT event_id % 6 AS video, count(*) AS n, count(*) FILTER (WHERE value - 2 < 0) AS neg FROM ev WHERE event_id % 6 < 5 GROUP BY 1), v AS (SELECT i::bigint AS video, CASE WHEN i <> 4 THEN 100 + 60 * i END AS fc, CASE WHEN i = 3 THEN 0 ELSE 48 END AS h FROM range(6) q(i)), c AS (SELECT video, (coalesce(fc, 0) <= 0)::int + (n IS NULL)::int AS failed, (h <= 0)::int + coalesce((neg > 0)::int, 0) + coalesce((n <> fc)::int, 0) AS warned, coalesce(neg, 0) AS n_neg_dt FROM v LEFT JOIN t USING (video)) SELECT video, failed = 0 AS ok, failed::bigint AS failed, warned::bigint AS warned, n_neg_dt FROM c"),
        "pose_wide": with_views("pose", f", {_WIDE} SELECT video, roi, frame, " + ", ".join(f"{_r(f'{n}_{c}')} AS {n}_{c}" for n in views.NODES for c in ("x", "y", "score")) + " FROM wide"),
        "pose_flags": with_views("pose", f", {_POSE} SELECT * FROM pf"),
        "pose_flag_rates": with_views("pose", f", {_POSE} SELECT count(*) AS n_instances, " + ", ".join(f"round_even(avg(flag_{f}::int), 4) AS rate_{f}" for f in ("low_conf", "missing", "wing_swap", "headtail")) + " FROM pf"),
        "pose_confidence": with_views("pose", f"SELECT video, frame, keypoint, {_r('avg(score)')} AS score_mean FROM pose GROUP BY 1, 2, 3"),
        "heatmap_argmax": f"SELECT vec_id, ((list_position(embedding, list_max(embedding)) - 1) % 8 + 0.5::double) * 8 AS x, ((list_position(embedding, list_max(embedding)) - 1) // 8 + 0.5::double) * 8 AS y, {_r('list_max(embedding)::double')} AS score FROM embeddings",
        "heatmap_centroid": f", h AS (SELECT vec_id, greatest(unnest(embedding)::double, 0) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT vec_id, sum(v) AS m, sum(v * (i % 8)) AS sx, sum(v * (i // 8)) AS sy FROM h GROUP BY 1) SELECT vec_id, {_r('CASE WHEN m > 0 THEN (sx / m + 0.5) * 8 ELSE 32.0::double END')} AS x, {_r('CASE WHEN m > 0 THEN (sy / m + 0.5) * 8 ELSE 32.0::double END')} AS y, {_r('list_max(embedding)::double')} AS score FROM s JOIN embeddings USING (vec_id)".replace(", h AS", "WITH h AS", 1),
        "context_windows": with_views("tracks", ", t AS (SELECT DISTINCT video, roi, frame FROM tracks) SELECT a.video, a.roi, a.frame AS anchor, b.frame FROM t a JOIN t b ON a.video = b.video AND a.roi = b.roi AND b.frame BETWEEN a.frame - 3 AND a.frame + 3"),
        "match_nearest": with_views("tracks", f", i AS (SELECT video, frame, track_id AS inst, x, y FROM tracks), a AS (SELECT video, frame, roi, min(x) AS ax, min(y) AS ay FROM tracks GROUP BY 1, 2, 3), p AS (SELECT i.video, i.frame, inst, roi, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) AS dist FROM i JOIN a ON i.video = a.video AND i.frame = a.frame) SELECT video, frame, inst, roi, {_r('dist')} AS dist FROM p QUALIFY row_number() OVER (PARTITION BY video, frame, inst ORDER BY dist, roi) = 1"),
        "uniform_sample": with_views("tracks", f", o AS (SELECT {k}, row_number() OVER (PARTITION BY video, roi ORDER BY frame, track_id) - 1 AS i, count(*) OVER (PARTITION BY video, roi) AS n FROM tracks) SELECT DISTINCT {k} FROM o, range(20) r(q) WHERE n <= 20 OR i = round_even(q * (n - 1) / 19.0::double, 0)"),
        "diversity_sample": with_views("tracks", f", t AS (SELECT video, roi, quantile_cont(area, 1 / 3.0::double) AS q1, quantile_cont(area, 2 / 3.0::double) AS q2 FROM tracks GROUP BY video, roi), s AS (SELECT {k}, floor((((angle_deg % 180) + 180) % 180) / 30)::int * 3 + CASE WHEN area <= q1 THEN 0 WHEN area <= q2 THEN 1 ELSE 2 END AS s, md5(video || '|' || roi || '|' || track_id || '|' || frame) AS h FROM tracks JOIN t USING (video, roi)), r AS (SELECT *, row_number() OVER (PARTITION BY video, roi, s ORDER BY h) AS r FROM s), m AS (SELECT *, row_number() OVER (PARTITION BY video, roi ORDER BY r, s) AS m FROM r) SELECT {k} FROM (SELECT * FROM m WHERE m <= ceil(24 / (SELECT count(DISTINCT (video, roi)) FROM tracks)::double) ORDER BY m, video, roi LIMIT 24)"),
        "random_sample": with_views("tracks", f"SELECT {k} FROM (SELECT * FROM tracks ORDER BY md5(video || '|' || roi || '|' || track_id || '|' || frame || '|7') LIMIT 30)"),
        "topk_candidates": with_views("candidates", "SELECT video, roi, frame, row_number() OVER (PARTITION BY video, roi, frame ORDER BY area DESC, event_id)::int AS rank, x, y, area FROM candidates WHERE area BETWEEN 10 AND 1500 QUALIFY rank <= 5"),
        "reading_order": "SELECT * FROM (VALUES ('arena_01', 100.0::double, 100.0::double, 41.0::double), ('arena_02', 300.0, 90.0, 40.0), ('arena_03', 100.0, 300.0, 43.0), ('arena_04', 300.0, 290.0, 42.0)) t(roi, cx, cy, r)",
        "pixel_mean": with_views("stack", "SELECT roi, pix, trunc(avg(v))::int AS value FROM stack GROUP BY 1, 2"),
        "pixel_percentile": with_views("stack", f"SELECT roi, pix, {_r('quantile_cont(v, 0.9::double)')} AS value FROM stack GROUP BY 1, 2"),
        "pixel_spread": with_views("stack", f"SELECT roi, pix, count(DISTINCT v) AS n_unique, {_r('stddev_pop(v)')} AS std FROM stack GROUP BY 1, 2"),
        "frame_diff": with_views("stack", "SELECT roi, pix, abs(arg_max(v, sample) - arg_min(v, sample)) AS value FROM stack GROUP BY 1, 2"),
        "ghost_mask": with_views("stack", f", {_BG.format(p=0.5)}, {_TOP} SELECT roi, pix, top - value > 95 AS ghost FROM top JOIN bg USING (roi, pix)"),
        "deghost_nearmax": with_views("stack", f", {_BG.format(p=0.5)}, {_TOP} SELECT roi, pix, CASE WHEN top - value > 95 THEN floor(top + 1e-9)::int ELSE value END AS value FROM top JOIN bg USING (roi, pix)"),
        "fg_excluded_bg": with_views("stack", f", m AS (SELECT *, (pix % 8 - sample % 8) * (pix % 8 - sample % 8) + (pix // 8 - sample % 5) * (pix // 8 - sample % 5) <= 4 AS hit FROM stack) SELECT roi, pix, {_r('coalesce(quantile_cont(v, 0.9::double) FILTER (WHERE NOT hit), quantile_cont(v, 0.9::double))')} AS value FROM m GROUP BY 1, 2"),
        "bg_diff": with_views("stack", f", {_BG.format(p=0.9)} SELECT roi, sample, sum(greatest(value - v, 0))::bigint AS total, max(greatest(value - v, 0)) AS top FROM stack JOIN bg USING (roi, pix) GROUP BY 1, 2"),
        "otsu_threshold": with_views("stack", ", h AS (SELECT roi, v::bigint AS t, count(*) AS n FROM stack GROUP BY 1, 2), c AS (SELECT roi, t, sum(n) OVER r AS w0, sum(n * t) OVER r AS s0, sum(n) OVER a AS w, sum(n * t) OVER a AS s FROM h WINDOW r AS (PARTITION BY roi ORDER BY t), a AS (PARTITION BY roi)), b AS (SELECT roi, t, CASE WHEN w > w0 THEN round(w0::double * (w - w0)::double * (s0 / w0::double - (s - s0) / (w - w0)::double) * (s0 / w0::double - (s - s0) / (w - w0)::double), 6) ELSE 0.0::double END AS b FROM c) SELECT roi, t AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY roi ORDER BY b DESC, t) = 1"),
        "drift_median": with_views("stack", f", {_BG.format(p=0.5)} SELECT roi, sample, median(v - value)::double AS drift FROM stack JOIN bg USING (roi, pix) GROUP BY 1, 2"),
        "floor_level": with_views("stack", f", {_BG.format(p=0.9)}, m AS (SELECT roi, median(value) AS m FROM bg GROUP BY 1) SELECT roi, median(value)::double AS floor FROM bg JOIN m USING (roi) WHERE value >= m GROUP BY 1"),
        "stuck_coverage": with_views("tracks rois", f", c AS (SELECT video, roi, count(*) / 3000.0::double AS c FROM tracks WHERE roi <> 'arena_02' GROUP BY 1, 2) SELECT video, roi, {_r('coalesce(c, 1.0::double)')} AS coverage, coalesce(c, 1.0::double) < 0.8 AS is_stuck FROM rois CROSS JOIN (SELECT DISTINCT video FROM tracks WHERE roi <> 'arena_02') LEFT JOIN c USING (video, roi)"),
        "link_tracks": with_views("candidates rois", f"{_link(False)} SELECT video, roi, frame, x, y FROM link WHERE frame >= 0 AND x IS NOT NULL", recursive=True),
        "link_trace": with_views("candidates rois", f"{_link(False)} SELECT video, roi, frame, gate, x IS NULL AS missed, {_r('pred_x')} AS pred_x, {_r('pred_y')} AS pred_y, n_candidates::int AS n_candidates, chosen::int AS chosen FROM link WHERE frame >= 0", recursive=True),
        "link_kalman": with_views("candidates rois", f"{_link(True)} SELECT video, roi, frame, {_r('x')} AS x, {_r('y')} AS y, gate, x IS NULL AS missed, {_r('pred_x')} AS pred_x, {_r('pred_y')} AS pred_y FROM link WHERE frame >= 0", recursive=True),
        "flag_speed_rollup": with_views("tracks rois", f", {_KIN} SELECT video, roi, count(*) AS n, {_r('avg(speed_mm_s)')} AS mean FROM kin GROUP BY ROLLUP (video, roi)"),
    }
    other = "CASE WHEN frame % 3 = 0 AND keypoint = 'wingL' THEN 'wingR' WHEN frame % 3 = 0 AND keypoint = 'wingR' THEN 'wingL' ELSE keypoint END"
    sql |= {
        "label_manifest": with_views("tracks", f"SELECT {k}, {other} AS keypoint, {_r('x_crop + ' + origin('x'))} AS x_full, {_r('y_crop + ' + origin('y'))} AS y_full, x_crop, y_crop, true AS visible FROM ({sql['seed_keypoints']}) s JOIN tracks t USING (video, roi, track_id, frame) WHERE event_id % 4 <> 0 AND event_id % 9 <> 0"),
        "contrast_gate": with_views("tracks rois", f", c AS (SELECT video, roi, floor(t_s / 3600)::bigint AS frame, event_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / 40 AS d, contrast FROM tracks JOIN rois USING (roi) WHERE contrast >= 20), s AS (SELECT *, d - 0.5::double * contrast / max(contrast) OVER (PARTITION BY video, roi, frame) AS s FROM c) SELECT video, roi, frame, event_id, {_r('s')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY video, roi, frame ORDER BY s, event_id) = 1"),
        "best_batch": f"SELECT batch_size, {_r('c')} AS crops_per_s, {_r('ceil(10001 / batch_size::double) * batch_size / c')} AS video_s, c = max(c) OVER () AS best FROM (SELECT l_linenumber * 16 AS batch_size, sum(l_quantity * 10) / sum(l_extendedprice / 1000) AS c FROM lineitem GROUP BY 1)",
        "detection_jumps": with_views("tracks", f"SELECT {k}, {_r('sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w))')} AS jump_px FROM tracks WINDOW w AS (PARTITION BY video, roi, track_id ORDER BY frame)"),
        "progress_left": with_views("ev", f", u AS (SELECT user_id AS run, t_s, sum(k % 7) OVER (PARTITION BY user_id ORDER BY frame)::bigint AS done FROM ev), m AS (SELECT run, done, min(t_s) AS t FROM u GROUP BY 1, 2), p AS (SELECT run, done, (t - lag(t) OVER w) / (done - lag(done) OVER w) AS v FROM m WINDOW w AS (PARTITION BY run ORDER BY done)), i AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY done) AS i FROM p WHERE v > 0), l AS (SELECT run, count(*)::int AS n_steps, max(done) AS done, list_reduce(list({{'a': CASE WHEN i < 10 THEN 0.15::double ELSE 0.05::double END, 'v': v}} ORDER BY i), lambda e, q: {{'a': q.a, 'v': e.v + q.a * (q.v - e.v)}}) AS e FROM i GROUP BY run) SELECT run, n_steps, done, {_r('CASE WHEN n_steps >= 10 THEN e.v END')} AS s_per_frame, {_r('greatest(0, 1000 - done) * CASE WHEN n_steps >= 10 THEN e.v END')} AS left_s FROM l"),
        "size_texts": "SELECT o_orderkey, CASE WHEN n >= 1099511627776 THEN printf('%.1f TB', n / 1099511627776.0::double) WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0::double) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::double) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::double) ELSE printf('%d B', n) END AS size, CASE WHEN c >= 3600 THEN printf('%d:%02d:%02d', c // 3600, c % 3600 // 60, c % 60) ELSE printf('%d:%02d', c // 60, c % 60) END AS clock FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 1000 + 7 AS n, o_orderkey * 37 AS c FROM orders)",
    }
    return sql | more.SQL | {"link_stream": sql["link_tracks"], "link_stream_kalman": sql["link_kalman"]}
