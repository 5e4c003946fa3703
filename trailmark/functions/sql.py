"""Kernels as functions of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="rank int, x double, y double, angle_deg double, major double, minor double, area double")
class Blobs:
    """blobs(image, background, side, threshold): the dark parts of an array of side x side values."""

    def eval(self, image, background, side: int, threshold: float):
        import numpy as np

        from trailmark.operators import kernels

        v, bg = (np.asarray(a).reshape(side, side) for a in (image, background))
        mask = kernels.background_difference(v, bg) > threshold
        for rank, e in enumerate(kernels.ellipses(mask, 1, side * side)):
            yield rank, *map(float, e)


@udtf(returnType="cx double, cy double, r double, conf double, offset_frac double")
class Port:
    """find_port(image, side): the dark disk near the middle of an array of side x side values, or no row."""

    def eval(self, image, side: int):
        import numpy as np

        from trailmark.operators import kernels

        if found := kernels.find_port(np.asarray(image).reshape(side, side), (side / 2, side / 2), side / 2):
            yield tuple(map(float, found))


def register(spark: SparkSession) -> None:
    spark.udtf.register("blobs", Blobs)
    spark.udtf.register("find_port", Port)
