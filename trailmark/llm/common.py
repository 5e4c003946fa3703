"""Shared helpers of the text operators: row packing, shared work tables, hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the largest table that is broadcast after a count, by the width of its rows.
BROADCAST_BYTES = 16 << 20

#: Bits of a Bloom filter for a key, the number of keys up to which it grows, and its blocks.
BITS_A_KEY, KEYS_AT_MOST, BLOCKS = 16, 1 << 26, 512

_MADE: list[tuple[SparkSession, str]] = []


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and, where Spark knows the setting, in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def small(df: DataFrame, rows_bytes: int | None = None) -> DataFrame:
    """df, broadcast where its rows by their types' widths (or rows_bytes, as measured) are few enough; it
    should have been written before, as its rows are counted."""
    if rows_bytes is None:
        wide = {"bigint": 8, "int": 4, "boolean": 1, "string": 48}
        rows_bytes = df.count() * (32 + sum(wide.get(kind, 48) for _, kind in df.dtypes))
    return F.broadcast(df) if rows_bytes <= BROADCAST_BYTES else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is
    unset and Spark runs in one process, as in tests, a temporary one set here."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trailmark-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = held.get()
    return top


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/trailmark/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Removes the files of materialized frames that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/trailmark/" in folder:
                drop_path(df.sparkSession, folder)


def _clean() -> None:
    for spark, path in _MADE:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row struct<all columns>, text string): operators pass `row` through untouched, so extra
    columns cannot clash with theirs. A null text counts as empty."""
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
    )


def unpack(df: DataFrame, columns: list[str], made: list[str]) -> DataFrame:
    """row.* and the operator's own columns; an input column of the same name gives way."""
    taken = {m.lower() for m in made}
    keep = [F.col(f"row.`{c}`").alias(c) for c in columns if c.lower() not in taken]
    return df.select(*keep, *made)


def doc_key(docs: DataFrame) -> DataFrame:
    """docs with k1, k2: rows that agree in doc_id and text are one document."""
    return docs.withColumns({
        "k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))),
        "k2": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
    })


class Words:
    """The white-space words of a batch of texts: `distinct` words, `at` the number of each word in them,
    `ends` of the texts. A text's edges may hold words of no characters."""

    def __init__(self, texts: pa.Array):
        held = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        found = held.flatten().dictionary_encode()
        self.distinct: list[str] = found.dictionary.to_pylist()
        self.at = found.indices.to_numpy()
        self.ends = np.cumsum(held.value_lengths().to_numpy().astype(np.int64))

    def texts(self, values: np.ndarray):
        """Each text's values, of values by distinct word."""
        start, got = 0, values[self.at]
        for end in self.ends.tolist():
            yield got[start:end]
            start = end


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * M1
        x = x ^ (x >> np.uint64(27))
        x = x * M2
        return x ^ (x >> np.uint64(31))


def highest(df: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """At most n rows, those of highest (positive) value: whole classes of an eighth of a power of two,
    from a histogram of a few hundred rows, so that no sort or surplus reaches the driver."""
    df = materialize(df.withColumn("_class", F.floor(F.log2(value) * 8)), name)
    total, cut = 0, None
    for r in sorted(df.groupBy("_class").count().collect(), key=lambda r: -r["_class"]):
        total += r["count"]
        if total > n:
            break
        cut = r["_class"]
    return df.where(F.col("_class") >= cut if cut is not None else F.lit(False)).drop("_class")


class Bloom:
    """A Bloom filter of 64-bit keys in blocks, a block for the keys of equal highest bits. Its size follows from the
    number of keys, up to a bound; about one in 200 other keys passes, beyond the bound more."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def width(keys: int) -> int:
        """Bits of a block, a power of two."""
        return 1 << max(10, min(keys, KEYS_AT_MOST) * BITS_A_KEY // BLOCKS - 1).bit_length()

    @staticmethod
    def places(h: np.ndarray, width: int) -> list[np.ndarray]:
        """A key's bits in its block."""
        m = mix64(h)
        return [((m >> np.uint64(21 * k)) & np.uint64(width - 1)).astype(np.int64) for k in range(3)]

    def inside(self, h: np.ndarray) -> np.ndarray:
        width = len(self.bits) * 8 // BLOCKS
        base = (h >> np.uint64(55)).astype(np.int64) * width
        out = np.ones(len(h), dtype=bool)
        for p in self.places(h, width):
            at = base + p
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    @classmethod
    def of(cls, keys: DataFrame) -> Bloom:
        """The filter of a table's only column, bigint; the table should have been written before."""
        width, name = cls.width(keys.count()), keys.columns[0]

        def fill(batches):
            block: dict[int, np.ndarray] = {}
            for b in batches:
                h = b.column(0).to_numpy().view(np.uint64)
                own = (h >> np.uint64(55)).astype(np.int64)
                for k in np.unique(own).tolist():
                    bits = block.setdefault(k, np.zeros(width // 8, dtype=np.uint8))
                    for at in cls.places(h[own == k], width):
                        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield pa.record_batch([pa.array(list(block), pa.int32()), pa.array([x.tobytes() for x in block.values()], pa.binary())], ["block", "bits"])

        # a block is filled in one task: the driver gets each byte of the filter once
        filled = keys.repartition(F.shiftrightunsigned(name, 55)).mapInArrow(fill, "block int, bits binary")
        bits = np.zeros((BLOCKS, width // 8), dtype=np.uint8)
        for r in filled.toLocalIterator():
            bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits.reshape(-1))
