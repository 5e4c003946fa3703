"""Benchmark decontamination by spaced seeds.

Fixed masks over the words of both sides ignore selected positions, so that a replaced word spoils
few of the windows around it. A Bloom filter of fixed size over the benchmark's seed hashes goes
to every task; the training positions that pass it are joined with the seeds on the hash, and each hit's
diagonal is verified on the words around it: the best aligned stretch must be long enough and agree
in most of its words.

Words are those between white space, case folded, without outer punctuation. An overlap has half of the
item's words at least, and 8 at least, but needn't have more than 50 (or all words of a shorter item). Null or
empty texts and items, and items of fewer than five words: no hits. Null item_id: no hits. Null doc_id: no
row in `overlaps`; `clean` judges the row by its text. Items that share an item_id, and documents that
share a doc_id, are each compared with their own text. Repeated rows: one result. Empty
tables: empty result. Extra columns are ignored (in `clean` passed through).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .imatch import Terms

#: Fixed masks: 1 counts, 0 is ignored.
MASKS = ("11111", "1101011", "11010011", "110010101")
BITS = 1 << 26
#: Words around a hit that are verified on either side.
REACH = 100
MIN_WORDS, MIN_SHARE, ENOUGH_WORDS, MIN_MATCH = 8, 0.5, 50, 0.8

_OFFSETS = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
_ODD = common.mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def seeds(h: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the counted positions of each window."""
    off = _OFFSETS[mask]
    n = len(h) - off[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        s = np.full(n, _ODD[60 + mask], dtype=np.uint64)
        for j, o in enumerate(off):
            s += h[o : o + n] * _ODD[j + 8 * mask]
        s ^= s >> np.uint64(32)
        return s * _ODD[59]


def _probes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (s & np.uint64(BITS - 1)).astype(np.int64), (s >> np.uint64(38)).astype(np.int64)


def bloom(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for p in _probes(keys):
        np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
    return bits


def passes(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Positions whose seed may be the benchmark's."""
    a, b = _probes(s)
    at = np.flatnonzero(bits[a >> 3] >> (a & 7).astype(np.uint8) & 1)
    b = b[at]
    return at[(bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)]


def verify(x: np.ndarray, y: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(start in x, length, equal words) of the best stretch on a diagonal: equal words count for it
    and others against it, so that MIN_MATCH of them must be equal."""
    lo, hi = max(0, diagonal), min(len(x), diagonal + len(y))
    if hi <= lo:
        return None
    same = x[lo:hi] == y[lo - diagonal : hi - diagonal]
    gain = np.where(same, 1 - MIN_MATCH, -MIN_MATCH)
    total = np.concatenate([[0.0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    # the longest stretch that still agrees enough, ending and starting with equal words
    ok = np.flatnonzero(total >= total[start] - 1e-9)
    end = max(end, int(ok[-1])) if len(ok) else end
    while end > start and not same[end - 1]:
        end -= 1
    back = np.flatnonzero(total[: start + 1] <= total[end] + 1e-9)
    start = int(back[0]) if len(back) else start
    while start < end and not same[start]:
        start += 1
    n = end - start
    need = min(len(y), max(MIN_WORDS, min(ENOUGH_WORDS, int(np.ceil(MIN_SHARE * len(y))))))
    equal = int(same[start:end].sum())
    return (lo + start, n, equal) if n >= need and equal >= MIN_MATCH * n - 1e-9 else None


def _verified(docs: DataFrame, items: DataFrame) -> DataFrame:
    """k1, k2 (common.doc_key), item_id, start, n_words, n_equal: the best verified overlap of each document
    with each item that has a hit. Items are told apart by id and text."""
    spark = docs.sparkSession
    common.tune(spark)
    item_type = dict(items.dtypes)["item_id"]
    own = items.where("item_id is not null and text is not null").select("item_id", F.xxhash64("text").alias("it"), "text").distinct()

    def plant(batches):
        terms = Terms()
        for b in batches:
            key, item, it, at = [], [], [], []
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), terms.texts(b.column(2)), strict=True):
                for m in range(len(MASKS)):
                    s = seeds(h, m)
                    key.append(s.view(np.int64)), item.extend([i] * len(s)), it.extend([t] * len(s)), at.append(np.arange(len(s)))
            yield pa.record_batch([pa.array(np.concatenate(key) if key else [], pa.int64()), pa.array(item, b.schema.field(0).type), pa.array(it, pa.int64()), pa.array(np.concatenate(at) if at else [], pa.int32())], ["key", "item_id", "it", "q"])

    planted = common.materialize(own.mapInArrow(plant, f"key bigint, item_id {item_type}, it bigint, q int").distinct(), "seeds")

    def filters(batches):  # a task's filter; a fixed size each
        bits = np.zeros(BITS // 8, dtype=np.uint8)
        for b in batches:
            bits |= bloom(b.column(0).to_numpy().view(np.uint64))
        yield pa.record_batch([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for r in planted.select("key").distinct().coalesce(4).mapInArrow(filters, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    held = spark.sparkContext.broadcast(bits)

    def scan(batches):
        """A row for each region: the words within REACH of hits, and the hits."""
        terms, bits = Terms(), held.value
        for b in batches:
            hs = terms.texts(b.column(2))
            ends = np.cumsum([len(h) for h in hs])
            whole = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
            at, key = [], []
            for m in range(len(MASKS)):
                s = seeds(whole, m)
                p = passes(bits, s)
                d = np.searchsorted(ends, p, side="right")
                p = p[p + _OFFSETS[m][-1] < ends[d]] if len(p) else p
                at.append(p), key.append(s[p])
            at, key = np.concatenate(at), np.concatenate(key)
            order = np.argsort(at, kind="stable")
            at, key = at[order], key[order]
            doc = np.searchsorted(ends, at, side="right")
            out: list[list] = [[], [], [], [], []]
            first = 0
            for k in range(1, len(at) + 1):
                if k < len(at) and doc[k] == doc[k - 1] and at[k] - at[k - 1] <= REACH:
                    continue
                d = int(doc[k - 1])
                base = int(ends[d]) - len(hs[d])
                lo, hi = max(base, int(at[first]) - REACH), min(int(ends[d]), int(at[k - 1]) + REACH)
                out[0].append(d), out[1].append(lo - base), out[2].append(whole[lo:hi].tobytes())
                out[3].append(key[first:k].view(np.int64).tolist()), out[4].append((at[first:k] - lo).tolist())
                first = k
            own = pa.array(out[0], pa.int64())
            yield pa.record_batch([b.column(0).take(own), b.column(1).take(own), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int32()))], ["k1", "k2", "base", "words", "keys", "ats"])

    regions = common.doc_key(docs.where("text is not null").select("doc_id", "text")).select("k1", "k2", "text")
    regions = regions.mapInArrow(scan, "k1 bigint, k2 bigint, base int, words binary, keys array<bigint>, ats array<int>")
    regions = common.materialize(regions, "regions")
    hits = regions.select("k1", "k2", "base", F.explode(F.arrays_zip("keys", "ats")).alias("hit")).select("k1", "k2", "base", F.col("hit.keys").alias("key"), F.col("hit.ats").alias("at"))
    pairs = hits.join(planted, "key").groupBy("k1", "k2", "base", "item_id", "it").agg(F.collect_set(F.col("at") - F.col("q")).alias("diagonals"))

    def known(batches):
        terms = Terms()
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([h.tobytes() for h in terms.texts(b.column(2))], pa.binary())], ["item_id", "it", "item"])

    item_words = own.mapInArrow(known, f"item_id {item_type}, it bigint, item binary")
    found = regions.select("k1", "k2", "base", "words").dropDuplicates(["k1", "k2", "base"])
    checked = pairs.join(found, ["k1", "k2", "base"]).join(item_words, ["item_id", "it"]).select("k1", "k2", "item_id", "base", "words", "item", "diagonals")

    def check(batches):
        for b in batches:
            at, out = [], []
            for k, (base, x, y, ds) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3, 7)), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                best = max((v for d in ds if (v := verify(x, y, d))), key=lambda v: (v[2], -v[0]), default=None)
                if best:
                    at.append(k), out.append((base + best[0], best[1], best[2]))
            at = pa.array(at, pa.int64())
            yield pa.record_batch([*(b.column(i).take(at) for i in range(3)), *(pa.array([o[i] for o in out], pa.int32()) for i in range(3))], ["k1", "k2", "item_id", "start", "n_words", "n_equal"])

    return checked.mapInArrow(check, f"k1 bigint, k2 bigint, item_id {item_type}, start int, n_words int, n_equal int")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, n_equal: the best verified overlap of each pair of ids."""
    got = _verified(docs.where("doc_id is not null"), items).withColumn("doc_id", F.col("k1").cast(dict(docs.dtypes)["doc_id"]))
    return got.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("s"), "n_words")).alias("b")).select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.n_equal").alias("n_equal"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that overlap an item; rows without doc_id are judged by their texts."""
    bad = common.materialize(_verified(docs, items).select("k1", "k2").distinct(), "contaminated")
    rows = common.doc_key(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).select("row", "k1", "k2")
    return rows.join(common.small(bad), ["k1", "k2"], "left_anti").select("row.*")


def op3_decontam(spark, sf_dir: str) -> DataFrame:
    """Every document and item that overlap."""
    return overlaps(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
