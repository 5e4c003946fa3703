"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; equal sets are one class of copies with one
representative. In each of `runs` independent runs a set follows, from each node, the tokens whose
hash under the node's path falls below 1 / (threshold * size), so that sets above the threshold share
a child at every depth with a fixed probability. Buckets of depth 2 with at most `bucket` sets are
compared whole; larger ones are split further down to depth 4, unless their sets are so alike that a split
would leave most pairs together. What is large then is compared in blocks: each set has its home, the largest
of its buckets, and sets of two homes, or of one, are compared once, whatever number of buckets they share.
Buckets of the same members are compared once, and a pair counts only in the first
unit that holds both, so that links are counted without listing them. The number of runs follows from the
target recall.

Null or empty text, or one without words: no shingles; copies of the same text are still one class.
Fewer than five words: one shingle of all words. Null doc_id: a document like others, class_id null if
the whole class has none. Repeated rows: copies of each other. Rows of one doc_id with different texts are
documents of their own. Empty table: empty result. Extra columns are ignored (in `representatives` passed
through).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .imatch import Terms

WORDS, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.999
DEPTH, DEEPEST, BUCKET = 2, 4, 256
#: Sets in a block of what is compared in blocks.
TILE = 1024
#: About so many sets tell whether a large bucket is split: not if a pair shares ALIKE children or more on average.
PROBES, ALIKE = 32, 0.5
_ODD = common.mix64(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def runs_needed(threshold: float = THRESHOLD, target: float = TARGET_RECALL, depth: int = DEEPEST) -> int:
    """Of a pair at the threshold t, the larger set of size n, at least t n tokens are shared (just so many where one
    set holds the other), and each is chosen by both with probability 1/(t n): Poisson-many common children with
    a mean of one at least, at each depth, down to the deepest."""
    mean, found = 1.0, 1.0
    for _ in range(depth):
        found = 1 - math.exp(-mean * found)
    return math.ceil(math.log(1 - target) / math.log(1 - found))


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of five words in a row, of the words' hashes."""
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    with np.errstate(over="ignore"):
        s = np.zeros(n, dtype=np.uint64)
        for j in range(min(WORDS, len(h))):
            s += h[j : j + n] * _ODD[j]
    return np.unique(common.mix64(s + np.uint64(min(WORDS, len(h)))))


def set_key(s: np.ndarray, text: str) -> bytes:
    return hashlib.blake2b(s.tobytes() if len(s) else b"\x00" + text.encode(), digest_size=12).digest()


def children(s: np.ndarray, paths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the node, path of the child) of the tokens chosen at each node: multiply-shift hashing by
    the node's path, of mixed tokens."""
    bound = np.uint64(min(min(1.0, 1 / (threshold * len(s))) * 2.0**64, 2.0**64 - 2049))
    node, child = [], []
    width = max(1, (1 << 18) // max(1, len(paths)))
    with np.errstate(over="ignore"):
        for k in range(0, len(s), width):
            part = s[k : k + width]
            i, j = np.nonzero(part[None, :] * (paths | np.uint64(1))[:, None] <= bound)
            node.append(i), child.append(common.mix64(part[j] ^ paths[i]))
    return np.concatenate(node), np.concatenate(child)


def roots(runs: int) -> np.ndarray:
    return common.mix64(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def paths_of(s: np.ndarray, runs: int, threshold: float, depth: int = DEPTH) -> np.ndarray:
    """Sorted paths of a set at a depth, in all runs."""
    level = roots(runs)
    for _ in range(depth):
        level = np.unique(children(s, level, threshold)[1])
    return level


def _set_rows(docs: DataFrame, runs: int, threshold: float) -> DataFrame:
    """doc_id, k2, key, n and the paths of depth DEPTH of each document."""

    def run(batches):
        terms, seen = Terms(), {}
        for b in batches:
            keys, sizes, paths = [], [], []
            for t, h in zip(b.column(1).to_pylist(), terms.texts(b.column(1)), strict=True):
                s = shingles(h)
                key = set_key(s, t)
                own = seen.get(key)
                if own is None:
                    own = paths_of(s, runs, threshold).view(np.int64) if len(s) else np.zeros(0, np.int64)
                    if len(seen) < 20_000:
                        seen[key] = own
                keys.append(key), sizes.append(len(s)), paths.append(own)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in paths])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(paths) if paths else [], pa.int64()))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists], ["doc_id", "k2", "key", "n", "paths"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, k2 bigint, key binary, n int, paths array<bigint>")


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """key, set binary of the representatives (doc_id as k1) that are needed."""

    def run(batches):
        terms = Terms()
        for b in batches:
            keys, sets = [], []
            for t, h in zip(b.column(0).to_pylist(), terms.texts(b.column(0)), strict=True):
                s = shingles(h)
                keys.append(set_key(s, t)), sets.append(s.tobytes())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "set"])

    few = common.small(needed.select("k1").distinct())
    rows = docs.withColumn("k1", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62)))).join(few, "k1", "left_semi").select("text")
    return rows.mapInArrow(run, "key binary, set binary").join(needed.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def _deeper(threshold: float):
    """Paths below large buckets, at all depths that may be needed."""

    def run(batches):
        for b in batches:
            key, depth, parent, path = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for k, raw, tops in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                level = np.unique(np.array(tops, dtype=np.int64).view(np.uint64))
                for d in range(DEPTH + 1, DEEPEST + 1):
                    node, child = children(s, level, threshold)
                    child, first = np.unique(child, return_index=True)
                    key += [k] * len(child)
                    depth += [d] * len(child)
                    parent.append(level[node[first]]), path.append(child)
                    level = child
            as_long = lambda x: pa.array(np.concatenate(x).view(np.int64))
            yield pa.record_batch([pa.array(key, pa.binary()), pa.array(depth, pa.int32()), as_long(parent), as_long(path)], ["key", "depth", "parent", "path"])

    return run


def similar(sets: list[np.ndarray], left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < left <= j, or i < j if left is 0) with a Jaccard similarity of at least
    threshold."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if m <= 6:
        a, b = [], []
        for i in range(left or m):
            for j in range(left or i + 1, m):
                if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]) - 1e-9:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9:
                        a.append(i), b.append(j)
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    both = overlaps(sets, left)
    rows, cols = sizes[: left or m, None], sizes[None, left:]
    a, b = np.nonzero(both >= threshold * (rows + cols - both) - 1e-6)
    b = b + left
    return (a, b) if left else (a[a < b], b[a < b])


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Number of common tokens of the first `left` sets (0: all) with the others. Tokens of one set only don't
    count; the others go in blocks of columns."""
    m = len(sets)
    token = np.concatenate(sets)
    member = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, count = np.unique(token, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, member = number[column[keep]], member[keep]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    both = np.zeros((left or m, m - left), dtype=np.float32)
    width = 4096
    for c in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [c, c + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[member[lo:hi], column[lo:hi] - c] = 1
        both += (x[:left] if left else x) @ x[left:].T
    return both


def _alike(threshold: float):
    """Paths of the buckets of which two sets share ALIKE children or more on average; a bucket's rows are neighbours."""

    def alike(sets):
        if len(sets) < 2:
            return False
        sizes = np.array([len(s) for s in sets])
        shared = overlaps(sets, 0) / (threshold * np.maximum(sizes[:, None], sizes[None, :]))
        return shared[~np.eye(len(sets), dtype=bool)].mean() >= ALIKE

    def run(batches):
        current, sets = None, []
        for b in batches:
            found = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path != current:
                    if alike(sets):
                        found.append(current)
                    current, sets = path, []
                sets.append(np.frombuffer(raw, np.uint64))
            yield pa.record_batch([pa.array(found, pa.int64())], ["path"])
        yield pa.record_batch([pa.array([current] if alike(sets) else [], pa.int64())], ["path"])

    return run


def _first_common(path: int, held: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs have no common bucket before `path`."""
    before = [h[h < path] for h in held]
    if not any(map(len, before)):
        return np.ones(len(a), dtype=bool)
    values, at = np.unique(np.concatenate(before), return_inverse=True)
    out = np.ones(len(a), dtype=bool)
    member = np.repeat(np.arange(len(held)), [len(x) for x in before])
    for c in range(0, len(values), 4096):
        own = (at >= c) & (at < c + 4096)
        x = np.zeros((len(held), min(4096, len(values) - c)), dtype=bool)
        x[member[own], at[own] - c] = True
        for i in range(0, len(a), 16384):
            out[i : i + 16384] &= ~(x[a[i : i + 16384]] & x[b[i : i + 16384]]).any(axis=1)
    return out


def _compare(threshold: float):
    """Buckets, each in a row of neighbouring rows: key, links (weighted by copies), root."""

    def solve(path, two, rows, out):
        # in a block of two tiles the first tile's rows come first
        keys = [r[0] for r in rows]
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        left = sum(not r[4] for r in rows) if two else 0
        if two and left == len(rows):
            return
        a, b = similar(sets, left, threshold)
        if not len(a):
            return
        new = _first_common(path, [np.array(r[3], dtype=np.int64) for r in rows], a, b)
        copies = np.array([r[1] for r in rows], dtype=np.int64)
        links = np.zeros(len(rows), dtype=np.int64)
        np.add.at(links, a[new], copies[b[new]])
        np.add.at(links, b[new], copies[a[new]])
        root = np.arange(len(rows))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
        touched = np.unique(np.concatenate([a, b]))
        for i in touched.tolist():
            out.append((keys[i], int(links[i]), keys[find(i)]))

    def run(batches):
        current, rows, out = None, [], []
        for b in batches:
            for unit in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if unit[:3] != current:
                    if len(rows) > 1:
                        solve(current[0], current[1] != current[2], rows, out)
                    current, rows = unit[:3], []
                rows.append((unit[4], unit[5], unit[6], unit[7], unit[3]))
            yield _links(out)
            out.clear()
        if len(rows) > 1:
            solve(current[0], current[1] != current[2], rows, out)
        yield _links(out)

    return run


def _links(out: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["key", "links", "root"])


def _blocks(big: DataFrame) -> DataFrame:
    """path, t1, t2, second, key of the large buckets (path, key, c). A set's home is the largest of its buckets; the
    sets of one home are a unit, and those of two homes that meet in a bucket are a unit of two sides. Units of one
    home come before all others, as sets of one side are not compared in units of two."""
    home = big.groupBy("key").agg(F.max(F.struct("c", "path"))["path"].alias("home"))
    homes = common.materialize(big.select("path", "key").join(common.materialize(home, "home"), "key"), "homes")
    there = common.materialize(homes.groupBy("path").agg(F.collect_set("home").alias("there")), "homes-there")
    others = F.array_distinct(F.flatten(F.collect_list("there")))
    sides = homes.join(there, "path").groupBy("key", "home").agg(others.alias("others"))
    sides = sides.select("key", F.explode("others").alias("other"), "home")
    sides = sides.select("key", F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"), (F.col("home") > F.col("other")).alias("second"))
    sides = common.materialize(sides, "sides")
    tiles = lambda second: F.ceil(F.count(F.when(F.col("second") == F.lit(second), 1)) / TILE).cast("int")
    sizes = common.materialize(sides.groupBy("a", "b").agg(tiles(False).alias("left"), tiles(True).alias("right")), "unit-sizes")
    one = F.col("a") == F.col("b")
    dealt = sides.join(sizes, ["a", "b"]).withColumn("tile", F.pmod(F.xxhash64("key", "a", "b"), F.when(F.col("second"), F.col("right")).otherwise(F.col("left"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(one | F.col("second"), F.col("left")).otherwise(F.col("right")) - 1)))
    first = F.when(one, F.least("tile", "other")).otherwise(F.when(F.col("second"), F.col("other")).otherwise(F.col("tile")))
    then = F.when(one, F.greatest("tile", "other")).otherwise(F.col("left") + F.when(F.col("second"), F.col("tile")).otherwise(F.col("other")))
    unit = F.when(one, F.shiftright("a", 2) - F.lit(2**62)).otherwise(F.shiftright(F.xxhash64("a", "b"), 2))
    return dealt.select(unit.alias("path"), first.alias("t1"), then.alias("t2"), F.when(one, F.col("tile") > F.col("other")).otherwise(F.col("second")).alias("second"), "key")


def components(edges: DataFrame) -> DataFrame:
    """key, label (the smallest key of its component) from edges (key, root), by alternating
    large-star and small-star steps; each step's rows are at most the edges."""
    # edges run from the larger key u to the smaller v
    e = edges.where("key != root").select(F.greatest("key", "root").alias("u"), F.least("key", "root").alias("v")).distinct()
    e = common.materialize(e, "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = common.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.materialize(large, "large")
        low = common.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        done, e = e, common.materialize(small, "edges")
        common.discard(done)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("key"), F.col("v").alias("label")).union(e.select("v", "v").distinct())


def join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the near-duplicates' component), n_links (other
    documents at least `threshold` similar, copies included), n_copies (documents of equal set)."""
    return _classes(docs, threshold, target).select("doc_id", "class_id", "n_links", "n_copies")


def _classes(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """join() with k2 (the text's hash) and label (the component, also where class_id is null)."""
    spark = docs.sparkSession
    common.tune(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k2"))
    runs = runs_needed(threshold, target)
    rows = common.materialize(_set_rows(docs, runs, threshold), "paths")
    reps = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("paths").alias("paths"))
    reps = common.materialize(reps.select("key", "rep", F.coalesce(F.col("rep").cast("long"), F.lit(-(2**62))).alias("k1"), "copies", "paths"), "representatives")
    wide, rows = rows, common.materialize(rows.select("doc_id", "k2", "key"), "keys")
    common.discard(wide)
    steps = reps.select("key", F.explode("paths").alias("path"))
    # aggregates are written before they are joined back: Spark splits hot keys between plain exchanges only
    counts = common.materialize(steps.groupBy("path").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    held = common.materialize(steps.join(counts, "path"), "buckets")
    small = held.where(F.col("c") <= BUCKET).select("path", "key")
    large = held.where(F.col("c") > BUCKET)
    big = None
    if not large.isEmpty():
        sets = common.materialize(_sets(docs, large.select("key").distinct().join(reps.select("key", "k1"), "key")), "sets")
        # a few sets only tell whether a bucket is split or compared as it is; all its sets go on either way
        probes = large.where(F.pmod(F.xxhash64("key"), F.ceil(F.col("c") / PROBES)) == 0).select("path", "key").join(sets, "key").select("path", "set")
        alike = probes.repartition("path").sortWithinPartitions("path").mapInArrow(_alike(threshold), "path bigint")
        alike = common.materialize(alike, "alike")
        big = large.join(alike, "path", "left_semi").select("path", "key", "c")
        split = large.join(alike, "path", "left_anti")
        tops = split.groupBy("key").agg(F.collect_list("path").alias("tops"))
        deep = common.materialize(tops.join(sets, "key").select("key", "set", "tops").mapInArrow(_deeper(threshold), "key binary, depth int, parent bigint, path bigint"), "deeper")
        sizes = deep.groupBy("path").agg(F.count_distinct("key").alias("c")).where("c > 1")
        sizes = common.materialize(sizes, "sizes")
        parents = sizes.where(F.col("c") > BUCKET).select(F.col("path").alias("parent")).union(split.select(F.col("path").alias("parent")).distinct())
        leaves = deep.join(parents, "parent", "left_semi").join(sizes, "path").where((F.col("c") <= BUCKET) | (F.col("depth") == DEEPEST)).select("path", "key", "c").distinct()
        leaves = common.materialize(leaves, "leaves")
        small = small.union(leaves.where(F.col("c") <= BUCKET).select("path", "key"))
        big = common.materialize(big.union(leaves.where(F.col("c") > BUCKET)), "large")
    # buckets of the same members are one
    members = small.groupBy("path").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    once = members.groupBy("keys").agg(F.min("path").alias("path")).select((F.shiftright("path", 2) + F.lit(2**62)).alias("path"), F.lit(0).alias("t1"), F.lit(0).alias("t2"), F.lit(False).alias("second"), F.explode("keys").alias("key"))
    units = common.materialize(once if big is None or big.isEmpty() else once.unionByName(_blocks(big)), "units")
    common.discard(held, *([sets, deep, leaves, big] if big is not None else []))
    paths = units.groupBy("key").agg(F.array_sort(F.collect_set("path")).alias("held")).join(reps.select("key", "k1", "copies"), "key")
    paths = common.materialize(paths, "held")
    sets = _sets(docs, paths)
    full = units.join(paths.join(sets, "key").select("key", "copies", "set", "held"), "key").select("path", "t1", "t2", "second", "key", "copies", "set", "held")
    links = full.repartition("path", "t1", "t2").sortWithinPartitions("path", "t1", "t2", "second").mapInArrow(_compare(threshold), "key binary, links bigint, root binary")
    links = common.materialize(links, "links")
    label = components(links.select("key", "root"))
    total = links.groupBy("key").agg(F.sum("links").alias("links"))
    of_key = reps.select("key", "rep", "copies").join(total, "key", "left").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    of_key = common.materialize(of_key, "labelled")
    least = common.materialize(of_key.groupBy("label").agg(F.min("rep").alias("class_id")), "least")
    of_key = common.materialize(of_key.join(least, "label").select("key", "label", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")), "classes")
    return rows.join(of_key, "key").select("doc_id", "k2", "label", "class_id", "n_links", "n_copies")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs of each class: that of smallest doc_id (null: last), then of smallest hash of the text.
    Of rows that agree in both, one stays."""
    last = F.lit(2**63 - 1)
    rows = _classes(docs).select(F.coalesce(F.col("doc_id").cast("long"), last).alias("k1"), "k2", "label")
    rows = common.materialize(rows.groupBy("label", "k1", "k2").agg(F.count("*").alias("n")), "near-duplicates")
    first = common.materialize(rows.groupBy("label").agg(F.min(F.struct("k1", "k2")).alias("first")), "firsts")
    rows = common.materialize(rows.join(first, "label").select("k1", "k2", "n", (F.struct("k1", "k2") == F.col("first")).alias("stays")), "chosen")
    gone, twice = rows.where("not stays").select("k1", "k2"), rows.where("stays and n > 1").select("k1", "k2")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), last).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"))
    kept = keyed.join(common.small(gone), ["k1", "k2"], "left_anti")
    if not twice.isEmpty():
        twice = common.small(twice)
        repeated = keyed.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        kept = kept.join(twice, ["k1", "k2"], "left_anti").unionByName(repeated)
    return kept.select("row.*")


def op7_cpjoin(spark, sf_dir: str) -> DataFrame:
    """Every document with its class and the number of its links."""
    return join(common.read_table(spark, sf_dir, "documents"))
