"""Comparison of trajectories, benchmark figures, validation roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import keyed

KEY = ["roi", "track_id", "frame"]


def compare(reference: DataFrame, test: DataFrame, position_px: float = 2.0, angle_deg: float = 10.0) -> DataFrame:
    """One row: counts of common and single rows, position and angle errors."""
    key = keyed(reference, *KEY)
    a = reference.select(*key, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("angle_deg").alias("aa"), F.lit(True).alias("in_ref"))
    b = test.select(*key, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("angle_deg").alias("ba"), F.lit(True).alias("in_test"))
    j = a.join(b, key, "full_outer")
    both = F.col("in_ref") & F.col("in_test")
    d = F.pmod(F.abs(F.col("aa") - F.col("ba")), F.lit(360.0))
    j = j.withColumns({"pos": F.when(both, F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))), "ang": F.when(both, F.least(d, 360 - d))})
    return j.agg(
        F.count("in_ref").alias("n_reference"), F.count("in_test").alias("n_test"), F.count(F.when(both, 1)).alias("n_common"),
        F.count(F.when(F.col("in_test").isNull(), 1)).alias("n_only_reference"), F.count(F.when(F.col("in_ref").isNull(), 1)).alias("n_only_test"),
        F.avg("pos").alias("pos_mean"), F.max("pos").alias("pos_max"), F.stddev_pop("pos").alias("pos_std"),
        F.avg((F.col("pos") <= position_px).cast("double")).alias("pos_within"), F.avg("ang").alias("angle_mean"), F.avg((F.col("ang") <= angle_deg).cast("double")).alias("angle_within"),
    )


def bench_stats(runs: DataFrame) -> DataFrame:
    """Frames per second over runs (mode, frames, seconds): mean, sample deviation, ms a frame."""
    fps = F.col("frames") / F.col("seconds")
    return runs.groupBy("mode").agg(F.avg(fps).alias("fps_mean"), F.coalesce(F.stddev_samp(fps), F.lit(0.0)).alias("fps_std"), (1000 / F.avg(fps)).alias("ms_per_frame"), F.sum("seconds").alias("total_s"))


def best_batch(runs: DataFrame, video_crops: int) -> DataFrame:
    """Crops per second of each batch size, the time of a whole video, the fastest of all."""
    rate = runs.groupBy("batch_size").agg((F.sum("crops") / F.sum("seconds")).alias("crops_per_s"))
    return rate.withColumn("video_s", F.ceil(F.lit(video_crops) / F.col("batch_size")) * F.col("batch_size") / F.col("crops_per_s")).crossJoin(F.broadcast(rate.agg(F.max("crops_per_s").alias("_top")))).withColumn("best", F.col("crops_per_s") == F.col("_top")).drop("_top")


def validation(videos: DataFrame, timing: DataFrame) -> DataFrame:
    """Checks of each video: whether it exists, opens, has frames and a size, its first and last frame decode (where the
    table has these columns), its timing table is there, has rows and runs forward, with as many rows as frames. A
    check that can't be made, as what it needs failed before, is left out."""
    t = timing.groupBy("video").agg(F.count("dt_s").alias("n_rows"), F.count_if(F.col("dt_s") < 0).alias("n_neg_dt"))
    j = videos.join(t, "video", "left")
    status = lambda ok, bad="fail": F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise(bad)
    has = lambda c: F.col(c) if c in videos.columns else F.lit(True)
    here, n = has("exists") & has("opens"), F.coalesce("frame_count", F.lit(0))
    rows = F.coalesce("n_rows", F.lit(0))
    checks = {
        "exists": status(has("exists")) if "exists" in videos.columns else None,
        "opens": F.when(has("exists"), status(has("opens"))) if "opens" in videos.columns else None,
        "frames": F.when(here, status(n > 0)),
        "size": F.when(here, status((F.col("width") > 0) & (F.col("height") > 0), "warn")),
        "first_frame": F.when(here, status(has("first_ok"))) if "first_ok" in videos.columns else None,
        "last_frame": F.when(here & has("first_ok") & (n > 1), status(has("last_ok"), "warn")) if "last_ok" in videos.columns else None,
        "timing_exists": status(F.col("n_rows").isNotNull()),
        "timing_rows": F.when(F.col("n_rows").isNotNull(), status(rows > 0)),
        "timing_monotonic": F.when(rows > 0, status(F.col("n_neg_dt") == 0, "warn")),
        "count_match": F.when(here & (n > 0) & (rows > 0), status(rows == n, "warn")),
    }
    made = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items() if v is not None])
    return j.select("video", F.coalesce("n_neg_dt", F.lit(0)).alias("n_neg_dt"), F.explode(F.filter(made, lambda c: c["status"].isNotNull())).alias("c")).select("video", "n_neg_dt", "c.check", "c.status")


def roll_up(checks: DataFrame, strict: bool = False) -> DataFrame:
    failed, warned = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "warn")
    ok = (failed == 0) & (warned == 0) if strict else failed == 0
    return checks.groupBy("video").agg(ok.alias("ok"), failed.alias("failed"), warned.alias("warned"), F.max("n_neg_dt").alias("n_neg_dt"))


def jumps(tracks: DataFrame) -> DataFrame:
    """Distance of each row from the previous one of its track; null for the first."""
    w = Window.partitionBy(*keyed(tracks, "roi", "track_id")).orderBy("frame")
    return tracks.withColumn("jump_px", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))


def progress(updates: DataFrame, total: int, alpha: float = 0.05, warmup: int = 10) -> DataFrame:
    """From updates (run, t_s, done): smoothed seconds a frame and seconds left of each run, null before as many
    steps as the warm-up has. Updates without progress count for nothing; a run's are few, and folded in order."""
    w = Window.partitionBy("run").orderBy("done")
    steps = updates.groupBy("run", "done").agg(F.min("t_s").alias("t_s"))
    pace = (F.col("t_s") - F.lag("t_s").over(w)) / (F.col("done") - F.lag("done").over(w))
    steps = steps.withColumn("v", pace).where("v > 0").withColumn("i", F.row_number().over(w))
    fold = F.aggregate("s", F.lit(None).cast("double"), lambda e, s: F.coalesce(e + F.when(s["i"] < warmup, min(0.3, 3 * alpha)).otherwise(alpha) * (s["v"] - e), s["v"]))
    runs = steps.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"), F.max("done").alias("done"))
    ready = F.size("s") >= warmup
    return runs.select("run", F.size("s").alias("n_steps"), "done", F.when(ready, fold).alias("s_per_frame")).withColumn("left_s", F.greatest(F.lit(0), F.lit(total) - F.col("done")) * F.col("s_per_frame"))


def concat(parts: list[DataFrame]) -> DataFrame:
    """Tables of several arenas as one; columns that one lacks are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def key_sets(reference: DataFrame, test: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Counts of the keys that both tables hold, and of those that one holds alone."""
    key = key or keyed(reference, *KEY)
    a, b = reference.select(*key), test.select(*key)
    parts = {"common": a.intersect(b), "only_reference": a.exceptAll(b), "only_test": b.exceptAll(a)}
    return concat([v.agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k, v in parts.items()])


def stage_stats(work: DataFrame, frames: int) -> DataFrame:
    """Stages of work (stage, worker, seconds): mean and greatest time of a worker, and frames a second as if all
    workers ran side by side, so that the slowest sets the pace."""
    own = work.groupBy("stage", "worker").agg(F.sum("seconds").alias("s"))
    return own.groupBy("stage").agg(F.avg("s").alias("mean_s"), F.max("s").alias("wall_s"), F.count("*").alias("workers")).withColumn("frames_per_s", F.when(F.col("wall_s") > 0, frames / F.col("wall_s")).otherwise(0.0))


def unknown_names(asked: DataFrame, have: DataFrame) -> DataFrame:
    """Names that are asked for but aren't there."""
    return asked.select("roi").distinct().join(have.select("roi"), "roi", "left_anti")


def named(df: DataFrame, names: str) -> DataFrame:
    """Rows of the arenas in a comma-separated list; of all where it is blank."""
    own = [n.strip() for n in names.split(",") if n.strip()]
    return df.where(F.col("roi").isin(*own)) if own else df


def placed(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with a place; groups without any keep theirs."""
    here = F.col("x").isNotNull() & F.col("y").isNotNull()
    none = df.groupBy(*by).agg(F.bool_or(here).alias("_any")).where("not _any").select(*by)
    return df.where(here).unionByName(df.join(none, by, "left_semi"))


def batches(df: DataFrame, size: int) -> DataFrame:
    """Rows of a video numbered in batches of `size`, in order of frame, roi and track; the last may be smaller. Frames
    are counted first, so that no task reads a whole video in order."""
    video, at = keyed(df), keyed(df, "frame")
    counts = df.groupBy(*at).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*video).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*at).orderBy("roi", "track_id")) - 1
    out = df.join(counts.withColumn("_base", before).drop("_n"), at).withColumn("_at", F.col("_base") + place)
    return out.withColumns({"batch": F.floor(F.col("_at") / size), "slot": F.col("_at") % size}).drop("_base", "_at")
