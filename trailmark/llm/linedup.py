"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines chooses where a chunk of lines ends, so that
boundaries move with the lines whatever stands before them. Chunks of several lines that occur again
anywhere are removed, but for the first occurrence in order of document. A repeated passage seldom
begins and ends at boundaries: at its edges, and where it holds no whole chunk, the smallest chunks (a
line that says enough alone, or two neighbouring lines that hold anything, with the blank ones between)
are judged in the same way, so that it goes line by line up to its edges. Equal hashes count only after
their bytes have been compared; bytes that differ under equal hashes are compared among themselves.

Null text: stays null, no lines. Rows that agree in doc_id and text are one document and keep the same
lines. A shorter line that repeats without a neighbour, and blank lines at the edge of a passage, stay.
Empty table: empty result. Extra columns are passed through; n_chars, where there, becomes that of the
kept text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A chunk ends after one in MODULUS pairs of lines.
MODULUS = 4
#: A line of so many words, or characters where words aren't set apart, is a smallest chunk of its own.
MIN_WORDS, MIN_CHARS = 8, 40
#: Bytes of chunks in an Arrow batch.
BATCH = 16 << 20


def boundaries(lines: list[str]) -> list[int]:
    """Lines after which a chunk ends: the rolling hash over the last two lines' hashes says so."""
    out, before = [], 0
    for i, line in enumerate(lines):
        own = xxhash.xxh3_64_intdigest(line)
        rolled = (before * 0x9E3779B97F4A7C15 + own) & 0xFFFFFFFFFFFFFFFF
        if (rolled ^ rolled >> 32) * 0xBF58476D1CE4E5B9 >> 40 & 0xFFFF < 0x10000 // MODULUS:
            out.append(i)
        before = own
    return out


def large_chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of chunks with three lines or more that hold anything."""
    out, start = [], 0
    for end in [*boundaries(lines), len(lines) - 1]:
        if end + 1 - start > 2 and sum(bool(x.strip()) for x in lines[start : end + 1]) > 2:
            out.append((start, end + 1))
        start = end + 1
    return out


def small_chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last). Two long neighbours are covered by their own chunks."""
    out, before = [], None
    for i, line in enumerate(lines):
        held = line.strip()
        if held:
            long = len(held) >= MIN_CHARS or len(held.split()) >= MIN_WORDS
            if before and not (long and before == (i - 1, True)):
                out.append((before[0], i + 1))
            if long:
                out.append((i, i + 1))
            before = i, long
    return out


def chunks(text: str) -> list[tuple[int, int]]:
    lines = text.split("\n")
    return large_chunks(lines) + small_chunks(lines)


NAMES = ["h", "h2", "k1", "k2", "at", "n", "lo", "hi", "chunk"]
TYPES = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()]
SCHEMA = "h bigint, h2 bigint, k1 bigint, k2 bigint, at int, n int, lo int, hi int"


def _batches(batches, bits: int, wanted: common.Bloom | None = None):
    """Arrow columns of the texts' chunks: hash, document, lines, bytes from lo to hi, and the bytes themselves; of those
    whose hash may be wanted only."""
    cols, size = [[] for _ in NAMES], 0

    def out():
        made = [pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)]
        for c in cols:
            c.clear()
        if wanted is None:
            return pa.record_batch(made[:-1], NAMES[:-1])
        keep = pa.array(wanted.inside(made[0].to_numpy().view(np.uint64)))
        return pa.record_batch([c.filter(keep) for c in made], NAMES)

    for b in batches:
        for k1, k2, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lines = text.split("\n")
            raw, starts = text.encode(), [0]
            for x in lines:
                starts.append(starts[-1] + (len(x) if x.isascii() else len(x.encode())) + 1)
            for a, z in large_chunks(lines) + small_chunks(lines):
                lo, hi = starts[a], starts[z] - 1
                part = raw[lo:hi]
                h = xxhash.xxh3_128_intdigest(part) & (1 << bits) - 1
                for c, v in zip(cols, ((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), k1, k2, a, z - a, lo, hi, part), strict=True):
                    c.append(v)
                size += len(part) + 100
                if size > BATCH:
                    yield out()
                    size = 0
    yield out()


def kept_ranges(cut: list[tuple[int, int, int, int]]) -> tuple[list[dict], int]:
    """(byte ranges that stay when the chunks (at, n, lo, hi) go, removed lines). The last range may
    begin beyond the text: then nothing is left there."""
    out, line, byte, removed = [], 0, 0, 0
    for at, n, lo, hi in sorted(cut):
        if at + n <= line:
            continue
        if at > line:
            out.append({"a": byte, "n": lo - 1 - byte})
        removed += at + n - max(at, line)
        line, byte = at + n, hi + 1
    out.append({"a": byte, "n": 2**31 - 1})
    return out, removed


def repeats(keyed: DataFrame, bits: int = 128) -> DataFrame:
    """k1, k2, at, n, lo, hi: the chunks that repeat an earlier one."""
    source = keyed.where(F.col("text").isNotNull()).select("k1", "k2", "text")
    found = source.mapInArrow(lambda batches: _batches(batches, bits), SCHEMA)
    again = common.materialize(found.groupBy("h", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h", "h2"), "repeated")
    held = keyed.sparkSession.sparkContext.broadcast(common.Bloom.of(again.select("h")).bits)
    # texts are read again rather than sent; chunks that occur once never leave their task but for a few
    found = source.mapInArrow(lambda batches: _batches(batches, bits, common.Bloom(held.value)), SCHEMA + ", chunk binary")
    found = common.materialize(found.join(common.small(again), ["h", "h2"], "left_semi"), "chunks")
    # grouping by the bytes compares them; partial sums keep hot chunks to a row for each task
    same = found.groupBy("h", "h2", "chunk").agg(F.min(F.struct("k1", "k2", "at")).alias("first"), F.count("*").alias("c")).drop("chunk")
    first = same.groupBy("h", "h2").agg(F.min("first").alias("first"), F.sum("c").alias("c"), F.count("*").alias("kinds")).where("c > 1")
    first = common.materialize(first, "first-chunks")
    one, clash = first.where("kinds = 1").select("h", "h2", "first"), first.where("kinds > 1").select("h", "h2")
    spans = ["k1", "k2", "at", "n", "lo", "hi"]
    cut = found.join(common.small(one), ["h", "h2"]).where(F.struct("k1", "k2", "at") != F.col("first")).select(*spans)
    if not clash.isEmpty():  # bytes that differ under equal hashes
        least = F.min(F.struct("k1", "k2", "at")).over(Window.partitionBy("h", "h2", "chunk"))
        cut = cut.union(found.join(clash, ["h", "h2"]).withColumn("first", least).where(F.struct("k1", "k2", "at") != F.col("first")).select(*spans))
    return cut


def _cut(docs: DataFrame, bits: int) -> tuple[DataFrame, dict]:
    """Rows with n_lines and n_removed, and the columns of docs by name, with the kept text."""
    common.tune(docs.sparkSession)

    def merged(batches):
        for b in batches:
            got = [kept_ranges([(w["at"], w["n"], w["lo"], w["hi"]) for w in cut]) for cut in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([r for r, _ in got], pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())]))), pa.array([n for _, n in got], pa.int64())], ["k1", "k2", "ranges", "removed"])

    cut = repeats(common.doc_key(docs.select("doc_id", "text")), bits)
    cut = cut.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n", "lo", "hi")).alias("cut"))
    cut = cut.mapInArrow(merged, "k1 bigint, k2 bigint, ranges array<struct<a: int, n: int>>, removed bigint")
    rows = common.doc_key(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).select("row", "k1", "k2")
    joined = rows.join(cut, ["k1", "k2"], "left").withColumns({
        "n_removed": F.coalesce("removed", F.lit(0)),
        "n_lines": F.when(F.col("row.text") == "", 0).otherwise(F.coalesce(F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))).cast("long"),
    })
    # ranges begin and end at line ends, so that each is a text
    raw = F.col("row.text").cast("binary")
    stays = F.filter("ranges", lambda r: r["a"] <= F.octet_length("row.text"))
    kept = F.array_join(F.transform(stays, lambda r: F.substring(raw, r["a"] + 1, r["n"]).cast("string")), "\n")
    text = F.when(F.col("n_removed") > 0, kept).otherwise(F.col("row.text"))
    cols = {c: F.col(f"row.`{c}`").alias(c) for c in docs.columns} | {"text": text.alias("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return joined, cols


def dedup(docs: DataFrame, bits: int = 128) -> DataFrame:
    """docs with the kept text, and n_lines, n_removed (lines) bigint; columns of docs named so give way. Chunks are
    grouped by a hash of so many bits before their bytes are compared."""
    joined, cols = _cut(docs, bits)
    return joined.select(*[v for c, v in cols.items() if c.lower() not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def clean(docs: DataFrame) -> DataFrame:
    """docs with the kept text, all their columns and no others."""
    joined, cols = _cut(docs, 128)
    return joined.select(*cols.values())


def op6_linedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines, digest of the kept text (null: empty)."""
    out = dedup(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
