"""Further queries, each beside its SQL."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from ..functions.common import hex_rgb, palette_index, r6, text_colour
from ..operators import backgrounds, compare, engine, geometry, kernels, labels, linking, pixels, pose, qc
from ..sources import images, readers, reports, videos, views, work
from ..sources.views import with_views
from ..streaming import link, sink

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = ["video", "roi", "track_id", "frame"]


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: str) -> str:
    return f"round({c}, 6) + 0.0::double"


def _round(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


# videos

_VIDEOS = "v AS (SELECT s_suppkey AS video, s_suppkey % 4 * 15 AS fps, s_suppkey % 7 * 40 AS frame_count, s_suppkey % 5 * 100 AS width, s_suppkey % 3 * 90 AS height, s_suppkey % 11 <> 0 AS \"exists\", s_suppkey % 13 <> 0 AS opens, s_suppkey % 6 <> 0 AS first_ok, s_suppkey % 9 <> 0 AS last_ok FROM supplier), ti AS (SELECT c_custkey % (SELECT count(*) FROM supplier) AS video, c_acctbal / 100 AS t_s, c_acctbal + 900 AS dt_s FROM customer)"


def _videos(s, d):
    k = F.col("s_suppkey")
    return views.table(s, d, "supplier").select(k.alias("video"), (k % 4 * 15).alias("fps"), (k % 7 * 40).alias("frame_count"), (k % 5 * 100).alias("width"), (k % 3 * 90).alias("height"), (k % 11 != 0).alias("exists"), (k % 13 != 0).alias("opens"), (k % 6 != 0).alias("first_ok"), (k % 9 != 0).alias("last_ok"))


def _video_timing(s, d):
    n = views.table(s, d, "supplier").count()
    return views.table(s, d, "customer").select((F.col("c_custkey") % n).alias("video"), (F.col("c_acctbal") / 100).alias("t_s"), (F.col("c_acctbal") + 900).alias("dt_s"))


@query(f"WITH {_VIDEOS} SELECT video, nullif(fps, 0)::double AS fps, nullif(frame_count, 0)::double AS frame_count, nullif(width, 0)::double AS width, nullif(height, 0)::double AS height FROM v")
def video_metadata(s, d):
    v = videos.metadata(_videos(s, d).select("video", "fps", "frame_count", "width", "height"))
    return v.withColumns({c: F.col(c).cast("double") for c in videos.PROBED})


@query(f"WITH {_VIDEOS} SELECT video, nullif(fps, 0)::double AS fps, nullif(frame_count, 0)::double AS frame_count, n_rows, first_s, last_s FROM v JOIN (SELECT video, count(*) AS n_rows, {_r('min(t_s)')} AS first_s, {_r('max(t_s)')} AS last_s FROM ti GROUP BY 1) USING (video)")
def video_assets(s, d):
    return _round(videos.assets(_videos(s, d), _video_timing(s, d)), "first_s", "last_s").select("video", F.col("fps").cast("double").alias("fps"), F.col("frame_count").cast("double").alias("frame_count"), "n_rows", "first_s", "last_s")


@query(f"WITH {_VIDEOS} SELECT video, CASE WHEN NOT \"exists\" THEN 'not found' WHEN NOT opens THEN 'cannot open' WHEN frame_count <= 0 AND first_ok THEN 'unindexed' WHEN frame_count <= 0 THEN '0 frames' ELSE frame_count || ' frames' END AS reason, \"exists\" AND opens AND frame_count > 0 AS ok FROM v")
def video_status(s, d):
    return videos.status(_videos(s, d).withColumnRenamed("first_ok", "decodes")).select("video", "reason", "ok")


_CHECKS = f"""WITH {_VIDEOS}, t AS (SELECT video, count(*) AS n, count(*) FILTER (WHERE dt_s < 0) AS neg FROM ti GROUP BY 1), c AS (SELECT v.*, t.n, t.neg, "exists" AND opens AS here FROM v LEFT JOIN t USING (video)),
st AS (SELECT video, 'exists' AS "check", CASE WHEN "exists" THEN 'pass' ELSE 'fail' END AS status FROM c UNION ALL SELECT video, 'opens', CASE WHEN opens THEN 'pass' ELSE 'fail' END FROM c WHERE "exists" UNION ALL SELECT video, 'frames', CASE WHEN frame_count > 0 THEN 'pass' ELSE 'fail' END FROM c WHERE here UNION ALL SELECT video, 'size', CASE WHEN width > 0 AND height > 0 THEN 'pass' ELSE 'warn' END FROM c WHERE here UNION ALL SELECT video, 'first_frame', CASE WHEN first_ok THEN 'pass' ELSE 'fail' END FROM c WHERE here UNION ALL SELECT video, 'last_frame', CASE WHEN last_ok THEN 'pass' ELSE 'warn' END FROM c WHERE here AND first_ok AND frame_count > 1 UNION ALL SELECT video, 'timing_exists', CASE WHEN n IS NOT NULL THEN 'pass' ELSE 'fail' END FROM c UNION ALL SELECT video, 'timing_rows', 'pass' FROM c WHERE n IS NOT NULL UNION ALL SELECT video, 'timing_monotonic', CASE WHEN neg = 0 THEN 'pass' ELSE 'warn' END FROM c WHERE n IS NOT NULL UNION ALL SELECT video, 'count_match', CASE WHEN n = frame_count THEN 'pass' ELSE 'warn' END FROM c WHERE here AND frame_count > 0 AND n IS NOT NULL)"""


@query(f'{_CHECKS} SELECT video, "check", status FROM st')
def validation_checks(s, d):
    return compare.validation(_videos(s, d), _video_timing(s, d)).select("video", "check", "status")


@query(f"{_CHECKS} SELECT video, count(*) FILTER (WHERE status <> 'pass') = 0 AS ok, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'warn') AS warned FROM st GROUP BY video")
def validation_strict(s, d):
    return compare.roll_up(compare.validation(_videos(s, d), _video_timing(s, d)), strict=True).select("video", "ok", "failed", "warned")


_PATHS = "p AS (SELECT '/data/' || CASE WHEN n_regionkey = 2 THEN 'deep/' ELSE '' END || replace(n_name, ' ', '.') || CASE n_nationkey % 6 WHEN 0 THEN '.MP4' WHEN 1 THEN '.avi' WHEN 2 THEN '.txt' WHEN 3 THEN '.mkv' WHEN 4 THEN '' ELSE '.m4v' END AS path FROM nation UNION ALL SELECT '/data/' || CASE WHEN n_regionkey = 2 THEN 'deep/' ELSE '' END || replace(n_name, ' ', '.') || '.csv' FROM nation WHERE n_nationkey % 4 <> 0)"


def _paths(s, d):
    n = views.table(s, d, "nation")
    base = F.concat(F.lit("/data/"), F.when(F.col("n_regionkey") == 2, "deep/").otherwise(""), F.replace("n_name", F.lit(" "), F.lit(".")))
    own = F.element_at(F.array(*[F.lit(x) for x in (".MP4", ".avi", ".txt", ".mkv", "", ".m4v")]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return n.select(F.concat(base, own).alias("path")).union(n.where("n_nationkey % 4 <> 0").select(F.concat(base, F.lit(".csv"))))


_VIDEO = r"regexp_matches(lower(path), '[^/]\.(avi|mp4|mov|mkv|m4v)$')"


@query(f"WITH {_PATHS} SELECT path, replace(path, '/data/', '') AS name FROM p WHERE {_VIDEO} AND NOT contains(path, 'deep/')")
def discover_videos(s, d):
    return videos.discovered(_paths(s, d), "/data")


@query(f"WITH {_PATHS} SELECT a.path, b.path AS timing FROM p a LEFT JOIN p b ON b.path = regexp_replace(a.path, '\\.[^./]*$', '.csv') WHERE regexp_matches(lower(a.path), '[^/]\\.(avi|mp4|mov|mkv|m4v)$')")
def pair_timing(s, d):
    return videos.paired(_paths(s, d))


@query(f"WITH {_VIDEOS} SELECT video, i::int AS i, trunc(i * (frame_count - 1) / 99.0::double)::int AS frame FROM v, range(100) q(i) WHERE frame_count > 0")
def spaced_frames(s, d):
    return videos.spaced(_videos(s, d), 100)


@query(with_views("tracks", ", f AS (SELECT DISTINCT video, frame FROM tracks), n AS (SELECT video, greatest(1, (max(frame) + 1) // 25) AS k FROM f GROUP BY 1) SELECT video, frame FROM f JOIN n USING (video) WHERE frame % k = 0"))
def every_frames(s, d):
    return videos.every(views.tracks(s, d).select("video", "frame").distinct(), 25)


@query(with_views("tracks", ", f AS (SELECT DISTINCT video, frame FROM tracks WHERE video = 'video_1' OR frame % 7 <> 3) SELECT video, count(*) AS n, coalesce(count(*) = max(frame) - min(frame) + 1, false) AS consecutive FROM f GROUP BY 1"))
def consecutive_frames(s, d):
    return videos.consecutive(views.tracks(s, d).where("video = 'video_1' or frame % 7 <> 3").select("video", "frame").distinct())


@query(with_views("ev", "SELECT video, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY video ORDER BY event_id) <= 200"))
def timing_head(s, d):
    return videos.head(views.numbered(s, d).select("video", "event_id"), 200, "event_id")


# rows

@query("SELECT p_partkey, (p_size - 90)::double AS angle_deg, p_size * 2.0::double AS major, p_retailprice * 4 AS area, 0 AS contour_n, (p_size * 2.5 + 40)::double AS x_full, ((p_size * 2.5 + 40) - 40) / 2.5::double AS x_scaled, (p_size * 3.0)::double AS x_display, p_size::double AS x_crop FROM part")
def row_forms(s, d):
    p = views.table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("area"))
    out = geometry.rescale_observation(p.withColumns({"major": F.col("size"), "minor": F.col("size")}), 2.0).withColumn("x_full", geometry.scaled_to_full(F.col("size"), 2.5, 40.0))
    return out.select("p_partkey", geometry.ellipse_angle(F.col("size")).alias("angle_deg"), "major", "area", "contour_n", "x_full", geometry.full_to_scaled(F.col("x_full"), 2.5, 40.0).alias("x_scaled"), geometry.crop_to_display(F.col("size"), 3.0).alias("x_display"), geometry.display_to_crop(geometry.crop_to_display(F.col("size"), 3.0), 3.0).alias("x_crop"))


@query("WITH c AS (SELECT DISTINCT printf('#%02x%02x%02x', o_orderkey % 256, o_custkey % 256, (o_orderkey * 7) % 256) AS colour, o_orderkey % 256 AS r, o_custkey % 256 AS g, (o_orderkey * 7) % 256 AS b FROM orders) SELECT colour, r::int AS r, g::int AS g, b::int AS b, CASE WHEN 0.299::double * r + 0.587::double * g + 0.114::double * b > 140 THEN '#000000' ELSE '#ffffff' END AS text_colour FROM c")
def colours(s, d):
    o = views.table(s, d, "orders").select(F.format_string("#%02x%02x%02x", F.col("o_orderkey") % 256, F.col("o_custkey") % 256, F.col("o_orderkey") * 7 % 256).alias("colour")).distinct()
    return o.withColumn("c", hex_rgb(F.col("colour"))).select("colour", "c.r", "c.g", "c.b", text_colour(F.col("colour")).alias("text_colour"))


@query("SELECT n_name, ((row_number() OVER (ORDER BY n_name) - 1) % 8)::int AS colour FROM (SELECT DISTINCT n_name FROM nation)")
def palette(s, d):
    return palette_index(views.table(s, d, "nation"), "n_name", 8)


@query(with_views("tracks", ", c AS (SELECT video, roi, track_id, frame, x, y FROM tracks) SELECT video, roi, track_id, frame, greatest(0, least(round_even(x, 0)::int - 100, 440)) AS x0, greatest(0, least(round_even(y, 0)::int - 100, 320)) AS y0 FROM c"))
def follow_windows(s, d):
    t = views.tracks(s, d)
    f = qc.follow(t, t.select(*K), tuple(K[:3]))
    return f.select(*K, geometry.clamped_origin(F.col("cx"), 200, 640).alias("x0"), geometry.clamped_origin(F.col("cy"), 200, 520).alias("y0"))


_TRACK_CROPS = "round_even({0}, 0)::int - 4"


@query(with_views("tracks rois", f", o AS (SELECT t.*, {_TRACK_CROPS.format('x')} AS x0, {_TRACK_CROPS.format('y')} AS y0, CASE WHEN cx IS NOT NULL THEN trunc(greatest(0.0::double, cx - r))::int END AS rx, CASE WHEN cy IS NOT NULL THEN trunc(greatest(0.0::double, cy - r))::int END AS ry FROM tracks t LEFT JOIN (SELECT * FROM rois WHERE roi <> 'arena_04') USING (roi)) SELECT video, roi, track_id, frame, keypoint, 4 + 8 * p AS x_crop, 4 + 8 * q AS y_crop, 1.0::double AS score, x0 + 4 + 8 * p AS x_full, y0 + 4 + 8 * q AS y_full, x0 + 4 + 8 * p - rx AS x_roi, y0 + 4 + 8 * q - ry AS y_roi FROM o, (VALUES ('head', 0.25::double, 0.0::double), ('thorax', 0.0, 0.0), ('abdomen', -0.25, 0.125)) n(keypoint, p, q)"))
def infer_mock(s, d):
    """Keypoints of crops by the engine that places them at fixed shares of the crop."""
    t = geometry.crop_manifest(views.tracks(s, d), 8).withColumn("pixels", F.repeat(F.lit("x"), 64).cast("binary"))
    out = engine.infer(t, engine.mock([(0.25, 0.0), (0.0, 0.0), (-0.25, 0.125)]), ["head", "thorax", "abdomen"], 8, views.rois(s).where("roi <> 'arena_04'"))
    return out.select(*K, "keypoint", "x_crop", "y_crop", "score", "x_full", "y_full", "x_roi", "y_roi")


_GREEDY = """, a0 AS (SELECT video, frame, roi, min(x) AS ax, min(y) AS ay FROM tracks WHERE event_id % 2 = 0 GROUP BY 1, 2, 3), a AS (SELECT video, frame, list({'roi': roi, 'ax': ax, 'ay': ay} ORDER BY roi) AS q FROM a0 GROUP BY 1, 2),
i AS (SELECT video, frame, track_id AS inst, x, y, row_number() OVER (PARTITION BY video, frame ORDER BY track_id) AS n FROM tracks WHERE event_id % 2 = 1),
g AS (SELECT video, frame, 0::bigint AS n, q AS free, NULL::bigint AS inst, NULL::varchar AS roi, NULL::double AS dist FROM a
UNION ALL SELECT video, frame, n, CASE WHEN b IS NULL THEN free ELSE free[:b - 1] || free[b + 1:] END, inst, free[b].roi, ds[b] FROM (SELECT *, list_position(ds, list_min(ds)) AS b FROM (SELECT i.video, i.frame, i.n, i.inst, g.free, list_transform(g.free, lambda q: sqrt((i.x - q.ax) * (i.x - q.ax) + (i.y - q.ay) * (i.y - q.ay))) AS ds FROM g JOIN i ON i.video = g.video AND i.frame = g.frame AND i.n = g.n + 1)))"""


@query(with_views("tracks", f"{_GREEDY} SELECT video, frame, inst, roi, {_r('dist')} AS dist FROM g WHERE roi IS NOT NULL", recursive=True))
def match_greedy(s, d):
    """One-to-one: instances in order of track take the nearest anchor still free."""
    t = views.tracks(s, d)
    anchors = t.where("event_id % 2 = 0").groupBy("video", "frame", "roi").agg(F.min("x").alias("ax"), F.min("y").alias("ay"))
    return _round(pose.match_greedy(t.where("event_id % 2 = 1").select("video", "frame", F.col("track_id").alias("inst"), "x", "y"), anchors), "dist")


@query(with_views("tracks", "SELECT video, roi, track_id, frame, track_id * 10 AS inst FROM tracks"))
def predicted_instances(s, d):
    """Instances predicted a little beside each track of frames with one track each find their own track."""
    t = views.tracks(s, d).withColumn("frame", F.col("track_id") * 100_000 + F.col("frame"))
    at = F.array(*[F.struct(F.lit(n).alias("keypoint"), F.lit(dx).alias("dx")) for n, dx in (("head", 1.5), ("abdomen", -0.5))])
    predict = lambda t: t.select("video", "frame", (F.col("track_id") * 10).alias("inst"), F.explode(at).alias("p"), "x", "y").select("video", "frame", "inst", "p.keypoint", (F.col("x") + F.col("p.dx")).alias("x"), "y", F.lit(0.5).alias("score"))
    out = engine.run(None, t, SimpleNamespace(predict=predict), ["head", "abdomen"], 8).where("keypoint = 'head'")
    return out.select("video", "roi", "track_id", (F.col("frame") % 100_000).alias("frame"), "inst")


@query(with_views("tracks", "SELECT video, roi, track_id, frame FROM tracks WHERE roi IN ('arena_01', 'arena_03')"))
def named_arenas(s, d):
    return compare.named(views.tracks(s, d), " arena_03, arena_01,,arena_03").select(*K)


@query("SELECT DISTINCT 'arena_0' || (n_nationkey % 7 + 1) AS roi FROM nation WHERE n_nationkey % 7 > 3")
def unknown_arenas(s, d):
    asked = views.table(s, d, "nation").select(F.concat(F.lit("arena_0"), (F.col("n_nationkey") % 7 + 1).cast("string")).alias("roi"))
    return compare.unknown_names(asked, views.rois(s))


@query(with_views("tracks", ", t AS (SELECT video, roi, track_id, frame, CASE WHEN event_id % 3 <> 0 AND roi <> 'arena_02' THEN x END AS x, y FROM tracks) SELECT video, roi, track_id, frame, x FROM t WHERE x IS NOT NULL OR roi = 'arena_02'"))
def placed_rows(s, d):
    t = views.tracks(s, d).withColumn("x", F.when((F.col("event_id") % 3 != 0) & (F.col("roi") != "arena_02"), F.col("x")))
    return compare.placed(t, ["video", "roi"]).select(*K, "x")


@query(with_views("tracks", ", fl AS (SELECT *, coalesce(area < 10 OR area > 1500, false) OR coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) > 40, false) OR coalesce(x - 48 < 0 OR y - 48 < 0 OR x + 48 > 640 OR y + 48 > 520, false) OR n_candidates > 1 OR coalesce(contrast < 10, false) AS f FROM tracks WINDOW w AS (PARTITION BY video, roi, track_id ORDER BY frame)) SELECT DISTINCT video, frame FROM fl WHERE f"))
def flagged_frames(s, d):
    t = views.tracks(s, d)
    return qc.flagged_frames(qc.flags(t, 640, 520), t.select("video", "frame").distinct())


@query(with_views("tracks", ", n AS (SELECT video, roi, track_id, frame, row_number() OVER (PARTITION BY video ORDER BY frame, roi, track_id) - 1 AS place FROM tracks) SELECT video, roi, track_id, frame, place // 64 AS batch, place % 64 AS slot FROM n"))
def crop_batches(s, d):
    return compare.batches(views.tracks(s, d).select(*K), 64)


@query(with_views("tracks", "SELECT video, roi, track_id, frame, CASE WHEN roi = 'arena_01' THEN x END AS x, CASE WHEN roi <> 'arena_01' THEN y END AS y FROM tracks"))
def concat_arenas(s, d):
    t = views.tracks(s, d)
    return compare.concat([t.where("roi = 'arena_01'").select(*K, "x"), t.where("roi <> 'arena_01'").select("y", *K)])


@query(f"WITH w AS (SELECT l_returnflag AS stage, l_suppkey % 5 AS worker, sum(l_extendedprice / 1000) AS s FROM lineitem GROUP BY 1, 2) SELECT stage, {_r('avg(s)')} AS mean_s, {_r('max(s)')} AS wall_s, count(*) AS workers, {_r('18003 / max(s)')} AS frames_per_s FROM w GROUP BY 1")
def stage_stats(s, d):
    work = views.table(s, d, "lineitem").select(F.col("l_returnflag").alias("stage"), (F.col("l_suppkey") % 5).alias("worker"), (F.col("l_extendedprice") / 1000).alias("seconds"))
    return _round(compare.stage_stats(work, 18_003), "mean_s", "wall_s", "frames_per_s")


@query(f"WITH b AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS n, o_orderkey * 1.5 AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 1.5 + 7 END AS z FROM orders) SELECT count(n) AS n_ok, count(*) AS n_total, coalesce(sum(n), 0)::bigint AS total_rows, {_r('max(z) - min(a)')} AS elapsed_s, {_r('(max(z) - min(a)) * (count(*) - count(z)) / count(z)')} AS left_s FROM b")
def batch_summary(s, d):
    k = F.col("o_orderkey")
    runs = views.table(s, d, "orders").select(k.alias("video"), F.when(k % 9 != 0, F.col("o_custkey")).alias("rows"), (k * 1.5).alias("start_s"), F.when(k % 5 != 0, k * 1.5 + 7).alias("end_s"))
    return _round(reports.batch_summary(runs), "elapsed_s", "left_s")


@query(with_views("rois ports", "SELECT '{\"video\":\"a.mp4\",\"image_size\":[640,520],\"arena_diameter_mm\":75.0,\"arenas\":{' || string_agg('\"' || roi || '\":{\"roi\":{\"cx\":' || cx || ',\"cy\":' || cy || ',\"r\":' || r || '},\"port\":' || coalesce('{\"cx\":' || port_x || ',\"cy\":' || port_y || ',\"r\":' || port_r || '}', 'null') || '}', ',' ORDER BY roi) || '}}' AS value FROM rois LEFT JOIN ports USING (roi)"))
def sidecar(s, d):
    return readers.sidecar(views.rois(s), views.ports(s), "a.mp4", 640, 520, 75.0)


_FL = "fl AS (SELECT *, concat_ws(',', CASE WHEN area < 10 OR area > 1500 THEN 'area' END, CASE WHEN sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) > 40 THEN 'jump' END, CASE WHEN x - 48 < 0 OR y - 48 < 0 OR x + 48 > 640 OR y + 48 > 520 THEN 'oob' END, CASE WHEN n_candidates > 1 THEN 'multi' END, CASE WHEN contrast < 10 THEN 'lowC' END) AS label, first_value(x) OVER t AS fx, first_value(y) OVER t AS fy FROM tracks WINDOW w AS (PARTITION BY video, roi, track_id ORDER BY frame), t AS (PARTITION BY video, roi, track_id ORDER BY frame RANGE BETWEEN 10 PRECEDING AND CURRENT ROW))"


@query(with_views("tracks rois ports", f", {_FL}, vr AS (SELECT DISTINCT video, roi FROM tracks) SELECT video, roi, frame, 'point' AS kind, x, y, NULL::double AS r, label AS text FROM fl UNION ALL SELECT video, roi, frame, 'trail', fx, fy, NULL, NULL FROM fl UNION ALL SELECT video, roi, frame, 'port_line', port_x, port_y, NULL, NULL FROM fl JOIN ports USING (roi) UNION ALL SELECT video, roi, -1, 'arena', cx, cy, r, roi FROM vr JOIN rois USING (roi) UNION ALL SELECT video, roi, -1, 'port', port_x, port_y, port_r, NULL FROM vr JOIN ports USING (roi)"))
def draw_list(s, d):
    return qc.draw_list(qc.flags(views.tracks(s, d), 640, 520), views.rois(s), views.ports(s), 10).withColumn("frame", F.coalesce("frame", F.lit(-1).cast("bigint")))


# images

def _bg(s, d, p):
    return pixels.byte_percentile(views.stack(s, d), p)


_BG = "bg AS (SELECT roi, pix, floor(quantile_cont(v, {p}::double) + 1e-9)::int AS value FROM stack GROUP BY roi, pix)"
_SPOTS = "pl AS (SELECT DISTINCT roi, sample, sample % 19 / 2.0::double - 1 AS x, sample % 17 / 2.0::double AS y FROM stack)"


def _spots(s, d):
    return views.stack(s, d).select("roi", "sample").distinct().withColumns({"x": F.col("sample") % 19 / 2.0 - 1, "y": F.col("sample") % 17 / 2.0})


def _contrast(kind: str) -> str:
    d = {"dark": "value - v", "bright": "v - value", "absolute": "abs(value - v)"}[kind]
    return with_views("stack", f", {_BG.format(p=0.9)}, {_SPOTS}, q AS (SELECT roi, sample, x, y, round_even(x, 0)::int AS j, round_even(y, 0)::int AS i FROM pl), c AS (SELECT q.roi, q.sample, avg({d}) AS contrast FROM q JOIN stack s ON s.roi = q.roi AND s.sample = q.sample AND s.pix // 8 BETWEEN q.i - 2 AND q.i + 2 AND s.pix % 8 BETWEEN q.j - 2 AND q.j + 2 JOIN bg ON bg.roi = s.roi AND bg.pix = s.pix WHERE q.i BETWEEN 0 AND 7 AND q.j BETWEEN 0 AND 7 GROUP BY 1, 2) SELECT roi, sample, x, y, {_r('contrast')} AS contrast FROM pl LEFT JOIN c USING (roi, sample)")


@query(_contrast("dark"))
def contrast_5x5(s, d):
    return _round(pixels.contrast(_spots(s, d), views.stack(s, d), _bg(s, d, 0.9), 8), "contrast")


@query(_contrast("absolute"))
def contrast_5x5_absolute(s, d):
    return _round(pixels.contrast(_spots(s, d), views.stack(s, d), _bg(s, d, 0.9), 8, "absolute"), "contrast")


@query(with_views("stack", f", {_BG.format(p=0.5)}, dk AS (SELECT roi, sample, pix, value - v AS d FROM stack JOIN bg USING (roi, pix)) SELECT roi, sample, 'bright' AS kind, sum(greatest(-d, 0))::bigint AS total FROM dk GROUP BY 1, 2 UNION ALL SELECT roi, sample, 'absolute', sum(abs(d))::bigint FROM dk GROUP BY 1, 2"))
def bg_diff_kinds(s, d):
    bg, stack = _bg(s, d, 0.5), views.stack(s, d)
    return compare.concat([pixels.difference(stack, bg, k).groupBy("roi", "sample").agg(F.lit(k).alias("kind"), F.sum("d").alias("total")) for k in ("bright", "absolute")])


def _cross(m: str, value: str, other: str) -> str:
    """A list of 64 after each pixel and its four neighbours are joined by OR, or AND, `other` beyond the edge."""
    near = [f"{m}[i + 1]", f"CASE WHEN i % 8 > 0 THEN {m}[i] ELSE {other} END", f"CASE WHEN i % 8 < 7 THEN {m}[i + 2] ELSE {other} END", f"CASE WHEN i > 7 THEN {m}[i - 7] ELSE {other} END", f"CASE WHEN i < 56 THEN {m}[i + 9] ELSE {other} END"]
    return f"[({f' {value} '.join(near)}) for i in range(64)]"


def _blobs(kind: str, threshold: str, opening: bool, top: int, area_max: int) -> str:
    d = {"dark": "greatest(value - v, 0)", "absolute": "abs(value - v)"}[kind]
    opened = f"SELECT *, {_cross('e', 'OR', 'false')} AS o FROM (SELECT *, {_cross('m', 'AND', 'true')} AS e FROM ms)" if opening else "SELECT *, m AS o FROM ms"
    otsu = "" if threshold != "otsu" else """, h AS (SELECT roi, sample, d AS t, count(*) AS n FROM df GROUP BY 1, 2, 3), cu AS (SELECT roi, sample, t, sum(n) OVER r AS w0, sum(n * t) OVER r AS s0, sum(n) OVER a AS w, sum(n * t) OVER a AS s FROM h WINDOW r AS (PARTITION BY roi, sample ORDER BY t), a AS (PARTITION BY roi, sample)), th AS (SELECT roi, sample, t FROM (SELECT *, CASE WHEN w > w0 THEN round((s::double * w0 - s0::double * w) * (s::double * w0 - s0::double * w) / (w0::double * (w - w0)), 6) ELSE 0.0::double END AS b FROM cu) QUALIFY row_number() OVER (PARTITION BY roi, sample ORDER BY b DESC, t) = 1)"""
    mask = f"SELECT roi, sample, list(d > {threshold} ORDER BY pix) AS m FROM df GROUP BY roi, sample" if not otsu else "SELECT roi, sample, list(d > t ORDER BY pix) AS m FROM df JOIN th USING (roi, sample) GROUP BY roi, sample"
    return with_views("stack", f""", {_BG.format(p=0.9)}, df AS (SELECT roi, sample, pix, v, value, CASE WHEN (pix % 8 - 4) * (pix % 8 - 4) + (pix // 8 - 4) * (pix // 8 - 4) <= 16 THEN {d} ELSE 0 END AS d FROM stack JOIN bg USING (roi, pix)){otsu}, ms AS ({mask}),
cl AS (SELECT roi, sample, {_cross('g', 'AND', 'true')} AS c FROM (SELECT *, {_cross('o', 'OR', 'false')} AS g FROM ({opened}))),
px AS (SELECT roi, sample, p FROM (SELECT roi, sample, unnest(c) AS c, generate_subscripts(c, 1) - 1 AS p FROM cl) WHERE c),
re AS (SELECT roi, sample, p AS src, p FROM px UNION SELECT re.roi, re.sample, re.src, px.p FROM re JOIN px ON px.roi = re.roi AND px.sample = re.sample AND abs(px.p % 8 - re.p % 8) <= 1 AND abs(px.p // 8 - re.p // 8) <= 1),
la AS (SELECT roi, sample, src AS p, min(p) AS k FROM re GROUP BY 1, 2, 3),
mo AS (SELECT roi, sample, k, count(*) AS area, avg(p % 8) AS x, avg(p // 8) AS y, avg((p % 8) * (p % 8)) AS xx, avg((p // 8) * (p // 8)) AS yy, avg((p % 8) * (p // 8)) AS xy FROM la GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 1 AND {area_max}),
co AS (SELECT *, xx - x * x + 1 / 12.0::double AS cxx, yy - y * y + 1 / 12.0::double AS cyy, xy - x * y AS cxy FROM mo WHERE (round_even(x, 0) - 4) * (round_even(x, 0) - 4) + (round_even(y, 0) - 4) * (round_even(y, 0) - 4) <= 16),
ra AS (SELECT *, row_number() OVER (PARTITION BY roi, sample ORDER BY area DESC, y, x) - 1 AS rank FROM co QUALIFY rank < {top})
SELECT roi, sample, rank::int AS rank, round(x, 4) + 0.0::double AS x, round(y, 4) + 0.0::double AS y, area::double AS area, round(4 * sqrt((cxx + cyy) / 2 + sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy)), 4) + 0.0::double AS major, round((SELECT avg({d.replace('greatest(value - v, 0)', 'value - v')}) FROM df WHERE df.roi = ra.roi AND df.sample = ra.sample AND abs(pix % 8 - round_even(x, 0)) <= 2 AND abs(pix // 8 - round_even(y, 0)) <= 2), 4) + 0.0::double AS contrast FROM ra""", recursive=True)


def _rounded_blobs(df):
    four = lambda c: (F.round(c, 4) + F.lit(0.0)).alias(c)
    return df.select("roi", "sample", "rank", four("x"), four("y"), "area", four("major"), four("contrast"))


@query(_blobs("dark", "60", False, 5, 1500))
def detect_blobs(s, d):
    return _rounded_blobs(kernels.detect(views.stack(s, d), _bg(s, d, 0.9), 8))


@query(_blobs("absolute", "otsu", True, 2, 40))
def detect_otsu(s, d):
    return _rounded_blobs(kernels.detect(views.stack(s, d), _bg(s, d, 0.9), 8, "otsu", area_max=40, opening=3, kind="absolute", top=2))


@query(with_views("stack", f", {_BG.format(p=0.5)}, {_SPOTS.replace('/ 2.0::double - 1', '* 1.0::double / 2 - 1')} SELECT s.roi, s.sample, {_r('coalesce(median(v - value) FILTER (WHERE (s.pix % 8 - 4) * (s.pix % 8 - 4) + (s.pix // 8 - 4) * (s.pix // 8 - 4) <= 16 AND (s.pix % 8 - round_even(x, 0)) * (s.pix % 8 - round_even(x, 0)) + (s.pix // 8 - round_even(y, 0)) * (s.pix // 8 - round_even(y, 0)) > 4), 0.0::double)')} AS drift FROM stack s JOIN bg ON bg.roi = s.roi AND bg.pix = s.pix JOIN pl ON pl.roi = s.roi AND pl.sample = s.sample GROUP BY 1, 2"))
def background_drift(s, d):
    places = _spots(s, d).withColumnsRenamed({"x": "ox", "y": "oy"})
    return _round(kernels.follow_background(views.stack(s, d), _bg(s, d, 0.5), places, 8, protect=2.0), "drift").select("roi", "sample", "drift")


@query(with_views("stack", ", pl AS (SELECT DISTINCT roi, sample, sample % 9 AS x, sample % 7 AS y FROM stack), o AS (SELECT roi, sample, x - 2 AS x0, y - 2 AS y0 FROM pl), md AS (SELECT roi, sample, trunc(median(v))::int AS m FROM stack GROUP BY 1, 2), c AS (SELECT o.*, i, j FROM o, range(4) a(i), range(4) b(j)), g AS (SELECT c.roi, c.sample, x0, y0, x0 < 0 OR y0 < 0 OR x0 + 4 > 8 OR y0 + 4 > 8 AS beyond, list(coalesce(s.v, m) ORDER BY i, j) AS v FROM c JOIN md ON md.roi = c.roi AND md.sample = c.sample LEFT JOIN stack s ON s.roi = c.roi AND s.sample = c.sample AND y0 + i BETWEEN 0 AND 7 AND x0 + j BETWEEN 0 AND 7 AND s.pix = (y0 + i) * 8 + x0 + j GROUP BY ALL) SELECT roi, sample, x0::int AS x0, y0::int AS y0, beyond AS out_of_bounds, array_to_string(v, ',') AS v FROM g"))
def crop_images(s, d):
    places = views.stack(s, d).select("roi", "sample").distinct().withColumns({"ox": F.col("sample") % 9, "oy": F.col("sample") % 7})
    return kernels.crops(views.stack(s, d), places, 8, 4).withColumn("v", F.array_join("v", ","))


@query(with_views("stack", f", {_BG.format(p=0.5)}, b AS (SELECT roi, pix, trunc(avg(v))::int AS value FROM stack GROUP BY 1, 2) SELECT roi, pix, 'mean' AS method, value FROM b UNION ALL SELECT roi, pix, 'p50', value FROM bg"))
def build_backgrounds(s, d):
    stack = views.stack(s, d)
    return compare.concat([backgrounds.build(stack, 8, m).select("roi", "pix", F.lit(m).alias("method"), "value") for m in ("mean", "p50")])


def _large(s, d, times: int = 6):
    """Backgrounds with each pixel as a block: images large enough for the port's search."""
    bg, side = _bg(s, d, 0.9), 8 * times
    own = F.explode(F.sequence(F.lit(0), F.lit(times * times - 1)))
    p = bg.withColumn("q", own)
    y, x = F.floor(F.col("pix") / 8) * times + F.floor(F.col("q") / times), F.col("pix") % 8 * times + F.col("q") % times
    return p.select("roi", (y * side + x).cast("int").alias("pix"), "value")


@query()
def radial_port(s, d):
    """Brute force in the tests."""
    return kernels.ports_from_stack(_large(s, d), 48)


def _repaired(s, d, fix):
    images = _bg(s, d, 0.5).groupBy("roi").agg(F.sort_array(F.collect_list(F.struct("pix", "value"))).alias("p")).select("roi", F.col("p.value").alias("v"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for roi, v in zip(b["roi"], b["v"], strict=True):
                out = fix(np.asarray(v).reshape(8, 8).astype(np.uint8))
                yield pd.DataFrame({"roi": roi, "pix": range(64), "value": out.reshape(-1).astype(int)})

    return images.mapInPandas(run, "roi int, pix int, value int")


@query()
def stationary_fill(s, d):
    """Brute force in the tests."""
    return _repaired(s, d, lambda img: backgrounds.fill_stationary(img, kernels.disk(8, 0.92), margin=3, area=(1, 30))[0])


@query()
def stuck_repair(s, d):
    """Brute force in the tests."""
    return _repaired(s, d, lambda img: backgrounds.repair_stuck(img, (4, 4, 0.5), margin=3, largest=12, radius=2)[0])


@query()
def deghost_neighbour(s, d):
    """Backgrounds at the median, whose ghosts take the floor around them. Brute force in the tests."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        images = pdf.sort_values(["sample", "pix"])["v"].to_numpy().reshape(-1, 8, 8)
        top, bg = np.percentile(images, 98, axis=0), np.percentile(images, 50, axis=0).astype(np.uint8)
        out = backgrounds.deghost(bg, top, kernels.disk(8, 0.92), margin=95)
        return pd.DataFrame({"roi": int(pdf["roi"].iloc[0]), "pix": range(64), "value": out.reshape(-1).astype(int)})

    return views.stack(s, d).groupBy("roi").applyInPandas(run, "roi int, pix int, value int")


# written and read again

@query(with_views("tracks", "SELECT 'parquet' AS fmt, video, roi, track_id, frame, x, y FROM tracks UNION ALL SELECT 'csv', video, roi, track_id, frame, x, y FROM tracks"))
def stored_tracks(s, d):
    """Tracks written and read in both formats."""
    t, top = views.tracks(s, d).select(*K, "x", "y"), work.new_folder(s, "stored")
    parts = []
    for fmt in ("parquet", "csv"):
        path = readers.write_table(t, readers.output_path(f"{top}/run.mp4", "tracks", fmt))
        parts.append(readers.read_table(s, path).select(F.lit(fmt).alias("fmt"), "video", "roi", *[F.col(c).cast("bigint").alias(c) for c in ("track_id", "frame")], "x", "y"))
    return compare.concat(parts)


@query(with_views("tracks", "SELECT video, roi, track_id, frame, x FROM tracks WHERE frame % 2 = 0"))
def appended_stream(s, d):
    """A stream of tracks appended to a table, in two runs of which the second finds new rows only."""
    top, t = work.new_folder(s, "appended"), views.tracks(s, d).where("frame % 2 = 0").select(*K, "x")
    for part in (t.where("track_id % 2 = 0"), t.where("track_id % 2 = 1")):
        part.write.mode("append").parquet(f"{top}/in")
        sink.append(s.readStream.schema(t.schema).parquet(f"{top}/in"), f"{top}/out", f"{top}/state").awaitTermination()
    return s.read.schema(t.schema).parquet(f"{top}/out")


def _streamed(s, d, **kw):
    """Linking as a stream of two batches."""
    top, frames = work.new_folder(s, "linked"), linking.dense(views.candidates(s, d))
    settings = linking.Settings(max_jump=40, miss_tolerance=3, centers={r[0]: (r[1], r[2]) for r in views.ROIS}, **kw)
    half = F.col("frame") < 700
    for part in (frames.where(half), frames.where(~half)):
        part.write.mode("append").parquet(f"{top}/in")
        stream = link.link_stream(s.readStream.schema(frames.schema).parquet(f"{top}/in"), settings)
        sink.append(stream, f"{top}/out", f"{top}/state").awaitTermination()
    return s.read.parquet(f"{top}/out")


@query()
def link_stream(s, d):
    """Its SQL is that of link_tracks, added in registry."""
    return _streamed(s, d).where("not missed").select("video", "roi", "frame", "x", "y")


@query()
def link_stream_kalman(s, d):
    """Its SQL is that of link_kalman, added in registry."""
    return _round(_streamed(s, d, use_kalman=True, smoothing=True), "x", "y", "pred_x", "pred_y").select("video", "roi", "frame", "x", "y", "gate", "missed", "pred_x", "pred_y")


@query(with_views("stack", "SELECT roi, (row_number() OVER (PARTITION BY roi ORDER BY sample) - 1)::bigint AS frame, sum(v)::bigint AS total, max(v) AS top FROM stack GROUP BY roi, sample"))
def gray_frames(s, d):
    """Images written as raw gray files, an arena's in one, and read through the data source."""
    from ..sources.gray import GraySource

    top = work.new_folder(s, "gray")
    images = views.stack(s, d).groupBy("roi", "sample").agg(F.sort_array(F.collect_list(F.struct("pix", "v"))).alias("p"))
    raw = images.select("roi", "sample", F.transform("p", lambda q: q["v"]).alias("v"))

    def write(pdf):
        import numpy as np
        import pandas as pd
        from pyarrow import fs

        own = pdf.sort_values("sample")
        system, path = fs.FileSystem.from_uri(top if "://" in top else "file://" + top)
        system.create_dir(path)
        name = f"{path}/arena-{int(own['roi'].iloc[0]):04d}.gray"
        with system.open_output_stream(name) as f:
            for v in own["v"]:
                f.write(np.asarray(v, dtype=np.uint8).tobytes())
        return pd.DataFrame({"name": [name], "n": [len(own)]})

    raw.groupBy("roi").applyInPandas(write, "name string, n int").collect()  # a row for each arena
    s.dataSource.register(GraySource)
    frames = s.read.format("gray").option("width", 8).option("height", 8).load(top)
    value = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.hex(F.substring("pixels", i, 1)), 16, 10).cast("int"))
    out = frames.select(F.regexp_extract("path", r"arena-(\d+)\.gray", 1).cast("int").alias("roi"), "frame", value.alias("v"))
    return out.select("roi", "frame", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"), F.array_max("v").alias("top"))


@query(with_views("stack", ", pl AS (SELECT DISTINCT roi, sample, sample % 9 AS x, sample % 7 AS y FROM stack), md AS (SELECT roi, sample, trunc(median(v))::int AS m FROM stack GROUP BY 1, 2), c AS (SELECT pl.*, i, j FROM pl, range(4) a(i), range(4) b(j)) SELECT c.roi, c.sample, lpad(c.roi::varchar, 6, '0') || '_' || lpad(c.sample::varchar, 6, '0') || '.png' AS name, sum(coalesce(s.v, m))::bigint AS total FROM c JOIN md ON md.roi = c.roi AND md.sample = c.sample LEFT JOIN stack s ON s.roi = c.roi AND s.sample = c.sample AND y - 2 + i BETWEEN 0 AND 7 AND x - 2 + j BETWEEN 0 AND 7 AND s.pix = (y - 2 + i) * 8 + x - 2 + j GROUP BY 1, 2, 3"))
def exported_crops(s, d):
    """Crops written as PNG with their manifest, and decoded again."""
    top = work.new_folder(s, "crops")
    places = views.stack(s, d).select("roi", "sample").distinct().withColumns({"ox": F.col("sample") % 9, "oy": F.col("sample") % 7})
    manifest = images.export_crops(kernels.crops(views.stack(s, d), places, 8, 4), 4, top)

    def decode(batches):
        for b in batches:
            yield b[["name"]].assign(total=[int(images.gray(x).sum()) for x in b["png"]])

    totals = s.read.parquet(f"{top}/crops").select("name", "png").mapInPandas(decode, "name string, total bigint")
    return manifest.select("roi", "sample", "name").join(totals, "name")


@query(with_views("tracks", "SELECT roi, video, track_id, frame, 'head' AS keypoint, true AS visible FROM tracks QUALIFY row_number() OVER (PARTITION BY video, roi ORDER BY frame, track_id) = 1"))
def label_file(s, d):
    """Hand labels of each arena's first row, saved as a document and loaded again."""
    import json
    import os
    import tempfile

    t = views.tracks(s, d)
    first = t.groupBy("video", "roi").agg(F.min_by("track_id", F.struct("frame", "track_id")).alias("track_id"), F.min("frame").alias("frame"))
    made = labels.seeded(t.join(first, K, "left_semi")).withColumn("labeled", F.lit(True))
    out = []
    for r in sorted(made.select("video").distinct().collect()):  # a document for each video
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "labels.json")
            labels.save(made.where(F.col("video") == r[0]), path, {"nodes": views.NODES}, r[0])
            with open(path, encoding="utf-8") as f:
                text = json.load(f)
            rows = [(r[0], x["roi"], x["track_id"], x["frame"], k, bool(p[2])) for x in text["frames"] for k, p in x["points"].items()]
            out.append(s.createDataFrame(rows, "video string, roi string, track_id bigint, frame bigint, keypoint string, visible boolean"))
    return compare.concat(out).where("keypoint = 'head'")


@query(f"WITH {_PATHS} SELECT path, regexp_replace(path, '[^/]*$', '') || regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') || '_pose.csv' AS own, '/out/' || regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') || '_tracks.parquet' AS other FROM p")
def output_paths(s, d):
    p = F.col("path")
    return _paths(s, d).select("path", videos.output_path(p, "pose", "csv").alias("own"), videos.output_path(p, "tracks", top="/out").alias("other"))


# parts, plates

_PARTS = "q AS (SELECT p_brand AS img, p_partkey % 37 * 7.0::double AS cx, p_size * 4.0::double AS cy, 20 + p_partkey % 13 * 3.0::double AS r, p_partkey % 11 AS a, p_partkey % 7 AS b FROM part), pa AS (SELECT img, cx, cy, r, 3.141592653589793::double * r * r * (0.4 + a * 0.06)::double AS area, 6.283185307179586::double * r * (0.9 + b * 0.06)::double AS perimeter FROM q)"


def _parts(s, d):
    import math

    k = F.col("p_partkey")
    q = views.table(s, d, "part").select(F.col("p_brand").alias("img"), (k % 37 * 7.0).alias("cx"), (F.col("p_size") * 4.0).alias("cy"), (20 + k % 13 * 3.0).alias("r"), (k % 11).alias("a"), (k % 7).alias("b"))
    r = F.col("r")
    return q.select("img", "cx", "cy", "r", (F.lit(math.pi) * r * r * (F.lit(0.4) + F.col("a") * 0.06)).alias("area"), (F.lit(2 * math.pi) * r * (F.lit(0.9) + F.col("b") * 0.06)).alias("perimeter"))


@query(f"WITH {_PARTS}, ok AS (SELECT *, round(4 * 3.141592653589793::double * area / (perimeter * perimeter) * (area / (3.141592653589793::double * r * r)), 9) AS score FROM pa WHERE r BETWEEN 22 AND 60 AND 4 * 3.141592653589793::double * area / (perimeter * perimeter) >= 0.65 AND area / (3.141592653589793::double * r * r) >= 0.55 AND area BETWEEN 3.141592653589793::double * 484 AND 3.141592653589793::double * 3600), l AS (SELECT img, list_reduce(list([{{'cx': cx, 'cy': cy, 'r': r, 's': score}}] ORDER BY score DESC, cx, cy, r), lambda a, x: CASE WHEN len(list_filter(a, lambda h: (h.cx - x[1].cx) * (h.cx - x[1].cx) + (h.cy - x[1].cy) * (h.cy - x[1].cy) < 6400)) > 0 THEN a ELSE list_concat(a, x) END) AS k FROM ok GROUP BY img) SELECT img, u.cx AS cx, u.cy AS cy, u.r AS r, {_r('u.s')} AS score FROM (SELECT img, unnest(k) AS u FROM l)")
def round_parts(s, d):
    return _round(pose.round_parts(_parts(s, d), ["img"], 80.0, (22.0, 60.0)), "score")


@query(f"WITH {_PARTS} SELECT img, cx, cy, area::bigint AS area, row_number() OVER (PARTITION BY img ORDER BY area::bigint DESC, cx, cy)::int AS rank FROM pa WHERE cx > 30 QUALIFY rank <= 4 AND count(*) OVER (PARTITION BY img) >= 4")
def largest_parts(s, d):
    p = _parts(s, d).where("cx > 30").withColumn("area", F.rint("area").cast("bigint"))
    return pose.largest(p, 4, ["img"], ["-area", "cx", "cy"]).select("img", "cx", "cy", "area", "rank")


@query(with_views("stack", f", f AS (SELECT roi, sample FROM (SELECT DISTINCT roi, sample FROM stack) QUALIFY row_number() OVER (PARTITION BY roi ORDER BY sample) <= 20), b AS (SELECT roi, pix, floor(quantile_cont(v, 0.9::double) + 1e-9)::int AS value FROM stack JOIN f USING (roi, sample) GROUP BY 1, 2) SELECT roi, sample, sum(greatest(value - v, 0))::bigint AS total FROM stack JOIN b USING (roi, pix) GROUP BY 1, 2"))
def replayed_background(s, d):
    return pixels.replayed(views.stack(s, d), 20, 0.9).groupBy("roi", "sample").agg(F.sum("d").alias("total"))


@query(with_views("stack", f", m AS (SELECT roi, pix, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM stack GROUP BY 1, 2) SELECT roi, pix, n, {_r('mean')} AS mean, {_r('var')} AS var, {_r('2 * ln(n) + n * (ln(2 * pi() * (var + 1e-3)) + var / (var + 1e-3))')} AS bic FROM m"))
def pixel_bic(s, d):
    return _round(pixels.one_component(views.stack(s, d)), "mean", "var", "bic")


_GHOSTS = "g AS (SELECT roi, pix, floor(quantile_cont(v, 0.9::double) + 1e-9) AS bg, quantile_cont(v, 0.98::double) AS top FROM stack GROUP BY 1, 2), gc AS (SELECT roi, count(*) FILTER (WHERE (pix % 8 - 4) * (pix % 8 - 4) + (pix // 8 - 4) * (pix // 8 - 4) <= (0.92 * 4) * (0.92 * 4) AND top - bg > 15) AS n_ghost FROM g GROUP BY 1)"


@query(with_views("stack", f", {_GHOSTS} SELECT * FROM gc"))
def ghost_counts(s, d):
    return pixels.ghost_counts(views.stack(s, d), 8)


@query(with_views("stack", f", {_GHOSTS} SELECT '{{' || string_agg('\"' || roi || '\":{{\"n_ghost\":' || n_ghost || ',\"clean\":' || (n_ghost = 0) || '}}', ',' ORDER BY roi::varchar) || '}}' AS value FROM gc"))
def background_flags(s, d):
    return images.flags_json(pixels.ghost_counts(views.stack(s, d), 8).withColumn("clean", F.col("n_ghost") == 0))


@query("WITH o AS (SELECT 'inscribed' AS mask, 20 AS h, 32 AS w, 16.0::double AS cx, 10.0::double AS cy, 10.0::double AS r UNION ALL SELECT 'arena', 24, 24, 12, 12, 0.92 * 12 UNION ALL SELECT 'wide', 24, 24, 12, 12, 0.97 * 12 UNION ALL SELECT 'roi', 30, 40, 13.5, 17.25, 8.5 UNION ALL SELECT 'scaled', 30, 40, 6.75, 8.625, 4.25) SELECT mask, y::int AS y, count(*)::int AS n, min(x)::int AS first FROM o, range(40) a(x), range(40) b(y) WHERE x < w AND y < h AND (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r GROUP BY 1, 2")
def arena_masks(s, d):
    """Rows of the arena's masks: how many pixels, and the first."""
    made = {"inscribed": kernels.inscribed(20, 32), "arena": kernels.disk(24, 0.92), "wide": kernels.disk(24, 0.97), "roi": kernels.roi_mask(30, 40, 13.5, 17.25, 8.5), "scaled": kernels.roi_mask(30, 40, 13.5, 17.25, 8.5, 2)}
    rows = [(k, y, int(row.sum()), int(row.argmax())) for k, m in made.items() for y, row in enumerate(m) if row.any()]
    return s.createDataFrame(rows, "mask string, y int, n int, first int")


@query(with_views("stack", ", bx AS (SELECT * FROM (VALUES ('a', 0, 0, 4), ('b', 3, 2, 5), ('c', 4, 4, 4)) t(name, x0, y0, size)), px AS (SELECT name, roi, sample, (pix // 8 - y0) // 2 AS i, (pix % 8 - x0) // 2 AS j, v FROM stack, bx WHERE sample % 3 = 0 AND pix % 8 BETWEEN x0 AND x0 + size - 1 AND pix // 8 BETWEEN y0 AND y0 + size - 1), m AS (SELECT name, roi, sample, i, j, round_even(avg(v), 0)::int AS v FROM px GROUP BY ALL) SELECT name, roi, sample, string_agg(v::varchar, ',' ORDER BY i, j) AS v FROM m GROUP BY 1, 2, 3"))
def fan_out(s, d):
    boxes = s.createDataFrame([("a", 0, 0, 4), ("b", 3, 2, 5), ("c", 4, 4, 4)], "name string, x0 int, y0 int, size int")
    return kernels.fan_out(views.stack(s, d), boxes, 8, 2, 3).withColumn("v", F.array_join("v", ","))


@query("SELECT s_name AS path, s_suppkey AS size, s_nationkey AS mtime FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 5 = 0")
def stale_files(s, d):
    f = views.table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("path"), F.col("s_suppkey").alias("size"), F.col("s_nationkey").alias("mtime"))
    k = F.col("s_suppkey")
    staged = f.where(k % 3 != 0).withColumns({"size": F.when(k % 7 == 0, F.col("size") + 1).otherwise(F.col("size")), "mtime": F.when(k % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime"))})
    return videos.stale(f, staged).select("path", "size", "mtime")


@query()
def find_arenas(s, d):
    """Brute force in the tests."""
    return _round(backgrounds.arenas(_bg(s, d, 0.9), 8), "cx", "cy", "r")
