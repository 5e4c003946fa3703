"""Minimax contiguous partition of documents into shards.

Equal texts are atomic: a text's hash gives its slot on a ring of `ring` ordered atomic groups.
The group sizes (a bounded table, `ring` numbers at most) reach the driver, which binary-searches
the smallest capacity that a greedy left-to-right filling can meet. Of the cuts that keep to it those are
taken that are most even beside single large groups, so that no shard is left over. With more than `ring`
texts the capacity is the least for the groups.

Null text: size 1, as an empty one. Null doc_id: kept as null. Repeated rows: each gets a slot.
Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Ordered atomic groups at most; texts in one group stay together.
RING = 1 << 18


def greedy(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Starts of the shards under greedy filling, or None if `shards` don't suffice."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    starts, at, n = [], 0, len(sizes)
    while at < n:
        if len(starts) == shards:
            return None
        starts.append(at)
        end = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        if end == at:
            return None
        at = end
    return starts


def least_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity that greedy filling can meet."""
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """First group of each shard. A shard of one group may have any size, so that a large group doesn't leave the others
    uneven: the others' largest is the least possible, and then the smallest shard the largest possible (both
    by halving; which cuts can be reached follows from running counts)."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)

    def reach(floor: int, cap: int) -> list[np.ndarray] | None:
        """For each number of shards, which cuts they can end at."""
        first, last = np.searchsorted(total, total - cap, side="left"), np.searchsorted(total, total - floor, side="right")
        alone = np.concatenate([[False], sizes >= floor])
        now = np.zeros(n + 1, dtype=bool)
        now[0] = True
        out = [now]
        for _ in range(shards):
            held = np.concatenate([[0], np.cumsum(out[-1])])
            out.append((held[np.maximum(last, first)] > held[first]) | (alone & np.concatenate([[False], out[-1][:-1]])))
        return out if out[-1][n] else None

    low, high = 0, int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if reach(0, mid) else (mid + 1, high)
    cap, low, high, best = low, 0, int(sizes.sum()) // shards, reach(0, low)
    while low < high:
        mid = (low + high + 1) // 2
        if got := reach(mid, cap):
            low, best = mid, got
        else:
            high = mid - 1
    cuts, end = [], n
    for k in range(shards, 0, -1):
        a = np.searchsorted(total, total[end] - cap, side="left")
        at = a + np.flatnonzero(best[k - 1][a : np.searchsorted(total, total[end] - low, side="right")])
        if not len(at):
            at = np.array([end - 1])
        end = int(at[np.argmin(np.abs(total[end] - total[at] - (low + cap) / 2))])
        cuts.append(end)
    return cuts[::-1]


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, first group of each shard; equal ones where a shard is empty)."""
    if not len(sizes):
        return 0, []
    sizes = np.asarray(sizes, dtype=np.int64)
    capacity = least_capacity(sizes, shards)
    return capacity, even_cuts(sizes, shards)


def partition(docs: DataFrame, shards: int = 16, ring: int = RING) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: sizes per shard near equal, the largest as small as
    contiguous cuts of the ordered groups allow; slots count from 0 without gaps in each shard."""
    spark = docs.sparkSession
    common.tune(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    ).withColumn("grp", F.pmod("h", F.lit(ring)).cast("int"))
    rows = common.materialize(rows, "sizes")
    got = rows.groupBy("grp").agg(F.sum("size").alias("size")).toArrow()
    grp, size = got.column("grp").to_numpy(), got.column("size").to_numpy()
    order = np.argsort(grp)
    grp, size = grp[order], size[order]
    _, starts = minimax_cuts(size, shards)
    cuts = [int(grp[s]) if s < len(grp) else ring for s in starts]
    shard = F.lit(0)
    for k, c in enumerate(cuts[1:], 1):
        shard = F.when(F.col("grp") >= c, k).otherwise(shard)

    def number(batches):
        seen = [0] * shards
        part = None
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in batches:
            s = b.column(b.schema.get_field_index("shard")).to_numpy()
            at = np.empty(len(s), dtype=np.int64)
            for k in np.unique(s):
                own = np.flatnonzero(s == k)
                at[own] = seen[k] + np.arange(len(own))
                seen[k] += len(own)
            yield pa.record_batch([*b.columns, pa.array(at), pa.array(np.full(len(s), part, dtype=np.int32))], [*b.schema.names, "at", "part"])

    dealt = rows.withColumn("shard", shard).repartitionByRange("grp", "h", "doc_id").sortWithinPartitions("grp", "h", "doc_id").select("doc_id", "size", "text_crc32", "shard")
    id_type = dict(docs.dtypes)["doc_id"]
    dealt = common.materialize(dealt.mapInArrow(number, f"doc_id {id_type}, size bigint, text_crc32 bigint, shard int, at bigint, part int"), "dealt")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("part", "shard").agg(F.count("*").alias("n")).select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return dealt.join(base, ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: law `bytes`, shards 0 to 15."""
    out = partition(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
