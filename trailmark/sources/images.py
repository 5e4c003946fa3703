"""Gray images as PNG, and tables of them: crops with their manifest, differences of first and last frames."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_START = b"\x89PNG\r\n\x1a\n"


def png(img: np.ndarray) -> bytes:
    """An image of bytes, without filters."""
    h, w = img.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.hstack([np.zeros((h, 1), dtype=np.uint8), img.astype(np.uint8)]).tobytes()
    return _START + part(b"IHDR", struct.pack(">2I5B", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def gray(data: bytes) -> np.ndarray:
    """The image of a gray PNG of bytes without filters, as png() writes it."""
    at, body, w, h = len(_START), b"", 0, 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            w, h = struct.unpack_from(">2I", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w + 1)[:, 1:]


def as_png(images: DataFrame, side: int, pixels: str = "v") -> DataFrame:
    """images with `png` binary instead of their array of side x side values."""
    keep = [c for c in images.columns if c != pixels]
    schema = ", ".join(f"`{c}` {t}" for c, t in images.dtypes if c != pixels) + ", png binary"

    def run(batches):
        for b in batches:
            yield b[keep].assign(png=[png(np.asarray(v).reshape(side, side)) for v in b[pixels]])

    return images.mapInPandas(run, schema)


def export_crops(crops: DataFrame, side: int, path: str) -> DataFrame:
    """Writes crops (with `v`) as PNG rows and a manifest without them; returns the manifest. A crop's name is made of
    its keys."""
    keys = [F.lpad(F.col(c).cast("string"), 6, "0") if t in ("int", "bigint") else F.col(c) for c, t in crops.dtypes if c in ("video", "roi", "track_id", "frame", "sample")]
    named = crops.withColumn("name", F.concat(F.concat_ws("_", *keys), F.lit(".png")))
    as_png(named, side).write.parquet(f"{path}/crops")
    named.drop("v").write.parquet(f"{path}/manifest")
    return crops.sparkSession.read.parquet(f"{path}/manifest")


def flags_json(info: DataFrame) -> DataFrame:
    """One JSON row {roi: {...}} of tables with a row for each arena."""
    rest = [c for c in info.columns if c != "roi"]
    entries = F.sort_array(F.collect_list(F.struct(F.col("roi").cast("string").alias("k"), F.struct(*rest).alias("v"))))
    return info.agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("value"))
