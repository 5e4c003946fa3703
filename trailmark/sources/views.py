"""Trajectory tables as deterministic views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arenas and fixtures of the views.
ROIS = [("arena_01", 250.0, 350.0, 180.0), ("arena_02", 300.0, 360.0, 180.0), ("arena_03", 120.0, 340.0, 150.0), ("arena_04", 280.0, 400.0, 200.0)]
PORTS = [("arena_01", 251.0, 352.0, 15.0), ("arena_02", 310.0, 355.0, 17.0), ("arena_03", 118.0, 338.0, 13.0)]
NODES = ["head", "thorax", "abdomen", "wingL", "wingR"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with seconds since the first day, the number in props, and the frame per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("video_"), (F.floor(F.col("user_id") / 4) % 2 + 1).cast("string")).alias("video"),
        "event_id", "user_id", "value", "event_type",
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(1e6)).alias("t_s"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.row_number().over(w) - 1).cast("long").alias("frame"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return numbered(spark, sf_dir).where("event_type <> 'error'").select(
        "video",
        F.concat(F.lit("arena_0"), (F.col("user_id") % 4 + 1).cast("string")).alias("roi"),
        F.col("user_id").alias("track_id"), "event_id", "frame", "t_s",
        (F.lit(100.0) + F.col("value")).alias("x"), (F.lit(200) + 3 * F.col("k")).cast("double").alias("y"),
        ((e * 37) % 180 - 90).cast("double").alias("angle_deg"),
        (8 + e % 9).cast("double").alias("major"), (4 + e % 5).cast("double").alias("minor"),
        (F.lit(20.0) * F.col("value")).alias("area"), (1 + e % 3).alias("n_candidates"),
        F.when(e % 11 != 0, F.col("k").cast("double")).alias("contrast"),
    )


def rois(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT roi, double(cx) AS cx, double(cy) AS cy, double(r) AS r FROM VALUES {', '.join(map(str, ROIS))} AS t(roi, cx, cy, r)")


def ports(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT roi, double(x) AS port_x, double(y) AS port_y, double(r) AS port_r FROM VALUES {', '.join(map(str, PORTS))} AS t(roi, x, y, r)")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by arena and hour."""
    return tracks(spark, sf_dir).select("video", "roi", F.floor(F.col("t_s") / 3600).cast("long").alias("frame"), "event_id", "x", "y", "area")


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of 8 x 8 images: roi, sample, pix, v."""
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(F.lit(128.0) + F.lit(400.0) * F.col("e").cast("double")))).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("roi"), F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("pix", "e")).select("roi", "sample", "pix", v.alias("v"))


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: roi, frame, keypoint, x, y, score; one point is missing where vec_id % 13 = 0."""
    video = F.concat(F.lit("video_"), (F.col("vec_id") % 2 + 1).cast("string"))
    w = Window.partitionBy("label", video).orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").select("vec_id", video.alias("video"), F.col("label").alias("roi"), "embedding", (F.row_number().over(w) - 1).cast("long").alias("frame"))
    at = lambda i: F.element_at("embedding", i + 1).cast("double")
    points = F.array(*[F.struct(F.lit(n).alias("keypoint"), F.when((F.col("vec_id") % 13 != 0) | (F.lit(i) != 3), 100 * at(2 * i)).alias("x"), F.when((F.col("vec_id") % 13 != 0) | (F.lit(i) != 3), 100 * at(2 * i + 1)).alias("y"), F.abs(at(10 + i)).alias("score")) for i, n in enumerate(NODES)])
    return e.select("video", "roi", "frame", F.explode(points).alias("p")).select("video", "roi", "frame", "p.keypoint", "p.x", "p.y", "p.score")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::double" for v in r) + ")" for r in rows)


#: The same views as common table expressions.
SQL = {
    "ev": "SELECT 'video_' || (user_id // 4 % 2 + 1) AS video, event_id, user_id, value, event_type, (epoch_us(ts) - 1704067200000000) / 1000000.0::double AS t_s, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events",
    "tracks": "SELECT video, 'arena_0' || (user_id % 4 + 1) AS roi, user_id AS track_id, event_id, frame, t_s, 100.0::double + value AS x, (200 + 3 * k)::double AS y, ((event_id * 37) % 180 - 90)::double AS angle_deg, (8 + event_id % 9)::double AS major, (4 + event_id % 5)::double AS minor, 20.0::double * value AS area, 1 + event_id % 3 AS n_candidates, CASE WHEN event_id % 11 <> 0 THEN k::double END AS contrast FROM ev WHERE event_type <> 'error'",
    "rois": f"SELECT * FROM (VALUES {_values(ROIS)}) t(roi, cx, cy, r)",
    "ports": f"SELECT * FROM (VALUES {_values(PORTS)}) t(roi, port_x, port_y, port_r)",
    "candidates": "SELECT video, roi, floor(t_s / 3600)::bigint AS frame, event_id, x, y, area FROM tracks",
    "stack": "SELECT roi, sample, pix, least(255.0::double, greatest(0.0::double, round_even(128.0::double + 400.0::double * e::double, 0)))::int AS v FROM (SELECT label AS roi, vec_id AS sample, unnest(embedding) AS e, (generate_subscripts(embedding, 1) - 1)::int AS pix FROM embeddings)",
    "pose": "SELECT video, roi, frame, keypoint, CASE WHEN vec_id % 13 <> 0 OR i <> 3 THEN 100 * embedding[2 * i + 1]::double END AS x, CASE WHEN vec_id % 13 <> 0 OR i <> 3 THEN 100 * embedding[2 * i + 2]::double END AS y, abs(embedding[11 + i]::double) AS score FROM (SELECT vec_id, 'video_' || (vec_id % 2 + 1) AS video, label AS roi, embedding, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS frame FROM embeddings), (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NODES)) + ") n(i, keypoint)",
}
_NEEDS = {"tracks": ["ev"], "candidates": ["tracks"]}


def with_views(names: str, query: str, recursive: bool = False) -> str:
    """The query behind the views it names and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + ("" if query.startswith(",") else " ") + query
