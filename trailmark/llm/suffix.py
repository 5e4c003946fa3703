"""Repeated substrings by deep-shallow suffix sorting.

Bytes covered by a string of LENGTH bytes that starts anywhere else are removed. Every window of
LENGTH bytes elects the position of its least GRAM-byte hash (leftmost on ties), a choice that
depends on its content alone, so equal windows elect equal anchors; a document has about two
anchors in LENGTH bytes. Anchors whose gram occurs once need nothing more. Where all anchors of a gram
elected the same bytes around them, all their windows repeat. The suffixes at the remaining anchors are sorted,
gram by gram: multikey quicksort to a shallow depth, then a blind trie for groups with
longer common prefixes. Within each interval of common prefix length the texts before the
anchors are sorted in the same way; the common extents to both sides give the windows that repeat. Grams with very
many surroundings are dealt by parts of their windows before they are sorted.

Null text: as empty, nothing removed. Texts under LENGTH bytes: nothing removed. Rows that agree in
doc_id and text count as copies of each other. Null doc_id: kept. Empty table: empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 400, 64
#: Texts are read in pieces of so many bytes; the windows of a piece begin in it.
PIECE = 1 << 20
#: Depth of the multikey quicksort, in bytes; its keys have eight.
SHALLOW = GRAM + 64
#: Grams with more distinct surroundings are dealt by parts of WIDTH windows, by the bytes that those have in common.
HOT, WIDTH = 1500, 6
#: Surroundings with more rows are salted, by a salt for each quarter as many; the most frequent ones up to a number that is
#: broadcast.
HEAVY, HEAVY_KINDS = 4096, 50_000

_TOP = PIECE + LENGTH + GRAM
_B = 0x9E3779B97F4A7C15 | 1
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 to the 64."""
    if not _tables:
        with np.errstate(over="ignore"):
            inverse = pow(_B, -1, 1 << 64)
            for base in (_B, inverse):
                p = np.full(_TOP + 1, np.uint64(base))
                p[0] = 1
                _tables.append(np.multiply.accumulate(p))
    return _tables


def elect(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window start, last window start, gram hash) of a piece of text."""
    n = len(raw)
    if n < length:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64)
    up, down = _powers()
    with np.errstate(over="ignore"):
        b = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * up[:n])])
        h = common.mix64((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    w = length - gram + 1
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    m = -(-len(key) // w) * w
    blocks = np.concatenate([key, np.full(m - len(key), np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - length + 1
    at = (np.minimum(tail[:starts], head[w - 1 : w - 1 + starts]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [starts]]) - 1
    at = at[first]
    return at, first, last, h[at]


def pieces(raw: bytes) -> list[tuple[int, bytes]]:
    return [(i, raw[i : i + PIECE + LENGTH - 1]) for i in range(0, max(1, len(raw) - LENGTH + 1), PIECE)]


def _anchors(batches):
    """A row for each anchor: gram, surroundings (hash of the bytes of its windows and the place of
    the anchor in them), document, anchor, windows."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = text.encode()
            for base, piece in pieces(raw):
                at, lo, hi, g = elect(piece)
                if not len(at):
                    continue
                around = np.empty(len(at), dtype=np.int64)
                for i, (p, s, e) in enumerate(zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)):
                    around[i] = int.from_bytes(hashlib.blake2b(piece[s : e + LENGTH], digest_size=8, salt=(p - s).to_bytes(2, "little")).digest(), "little", signed=True)
                out[0].append(g.view(np.int64)), out[1].append(around)
                out[2].append(np.full(len(at), k1)), out[3].append(np.full(len(at), k2))
                out[4].append(at + base), out[5].append(at - lo), out[6].append(hi - lo)
        kinds = [pa.int64()] * 5 + [pa.int16()] * 2
        yield pa.record_batch([pa.array(np.concatenate(c).astype(k.to_pandas_dtype()) if c else [], k) for c, k in zip(out, kinds, strict=True)], ["g", "c", "k1", "k2", "p", "before", "span"])


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie(strings: list[bytes], own: list[int]) -> list[int]:
    """Order of strings with a long common prefix. Inner nodes [depth, {byte: child}] hold branching
    depths only: a search compares branching bytes, then one leaf's text finds the place to enter."""
    root: list | int = own[0]
    for i in own[1:]:
        s, node, at = strings[i], root, []
        while isinstance(node, list):
            at.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1][c] if c in node[1] else next(iter(node[1].values()))
        leaf = strings[node]
        d = lcp(s, leaf)
        if d == len(s) == len(leaf):
            d += 1  # equal: side by side under their end
        mine, theirs = (s[d] if d < len(s) else -1), (leaf[d] if d < len(leaf) else -1)
        parent = None
        for x in at:
            if x[0] >= d:
                break
            parent = x
        key = None if parent is None else (s[parent[0]] if parent[0] < len(s) else -1)
        below = root if parent is None else parent[1].get(key)
        if isinstance(below, list) and below[0] == d:
            below[1][(mine, i) if mine in below[1] and d > len(s) else mine] = i
            continue
        new = [d, {theirs: below, mine: i}] if mine != theirs else [d, {theirs: below, (theirs, i): i}]
        if parent is None:
            root = new
        else:
            parent[1][key] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            order = sorted(node[1].items(), key=lambda x: x[0] if isinstance(x[0], tuple) else (x[0], -1), reverse=True)
            stack += [child for _, child in order]
        else:
            out.append(node)
    return out


def deep_shallow(strings: list[bytes], depth: int, shallow: int) -> list[int]:
    """Order of the strings, which agree before `depth`."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), depth)]
    while stack:
        own, d = stack.pop()
        if len(own) < 2:
            out += own
            continue
        if d >= shallow:
            out += blind_trie(strings, own)
            continue
        pivot = strings[own[len(own) // 2]][d : d + 8]
        less, same, more = [], [], []
        for i in own:
            k = strings[i][d : d + 8]
            (less if k < pivot else same if k == pivot else more).append(i)
        stack += [(more, d), (same, d + 8 if len(pivot) == 8 else shallow), (less, d)]
    return out


def intervals(strings: list[bytes], order: list[int]) -> list[tuple[int, int, int]]:
    """(common prefix, from, to) of the maximal intervals of the order with that common prefix."""
    heights = [lcp(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
    out, stack = [], []
    for k, h in enumerate([*heights, -1]):
        start = k
        while stack and stack[-1][0] > h:
            height, start = stack.pop()
            out.append((height, start, k))
        if h >= 0 and (not stack or stack[-1][0] < h):
            stack.append((h, start))
    return out


def repeated_offsets(rows: list[tuple[bytes, int]], length: int = LENGTH, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """For texts with the anchor at a place each: the offsets (anchor less window start) of windows that
    also occur at another, as intervals."""
    ahead = [t[p:] for t, p in rows]
    behind = [t[:p][::-1] for t, p in rows]
    order = deep_shallow(ahead, 0, SHALLOW)
    rank = [0] * len(rows)
    for k, i in enumerate(deep_shallow(behind, 0, 64)):
        rank[i] = k
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    for r, a, b in intervals(ahead, order):
        if r + length - gram < length:
            continue  # no window can hold the anchor and reach far enough before it
        own = sorted(order[a : b + 1], key=rank.__getitem__)
        best = [0] * len(own)
        for k in range(len(own) - 1):
            both = lcp(behind[own[k]], behind[own[k + 1]])
            best[k], best[k + 1] = max(best[k], both), both
        for i, left in zip(own, best, strict=True):
            if left + r >= length:
                out[i].append((length - min(r, length), left))
    return out


def _solve(batches):
    """Starts of repeated windows (from, to) of texts around anchors; rows of a gram are neighbours."""
    current, rows = None, []
    out: list[list] = [[], [], [], []]

    def solve():
        if len(rows) < 2:
            return
        for (k1, k2, p, single, _, before, span), got in zip(rows, repeated_offsets([(r[4], r[5]) for r in rows]), strict=True):
            if not single:
                continue
            for a, b in got:
                a, b = max(a, before - span), min(b, before)
                if a <= b:
                    out[0].append(k1), out[1].append(k2), out[2].append(p - b), out[3].append(p - a)

    def batch():
        x = pa.record_batch([pa.array(c, pa.int64()) for c in out], ["k1", "k2", "a", "b"])
        for c in out:
            c.clear()
        return x

    for b in batches:
        for g, *row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if g != current:
                solve()
                current, rows = g, []
            rows.append(row)
        yield batch()
    solve()
    yield batch()


def _parts(width: int):
    """A row for each part of `width` windows of the anchors: hash of the bytes that the part's windows have in common,
    and of all their bytes."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for k1, k2, text, anchors in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                for a in anchors:
                    p, before, span = a["p"], a["before"], a["span"]
                    for q in range((before - span) // width, before // width + 1):
                        lo, hi = max(q * width, before - span), min((q + 1) * width - 1, before)
                        core = raw[p - q * width : p + LENGTH - min((q + 1) * width - 1, LENGTH - GRAM)]
                        row = xxhash.xxh3_64_intdigest(core, q), xxhash.xxh3_64_intdigest(raw[p - hi : p - lo + LENGTH], hi), k1, k2, p, hi, hi - lo, a["single"]
                        for c, x in zip(out, row, strict=True):
                            c.append(x)
            hashes = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in out[:2]]
            yield pa.record_batch([*hashes, *(pa.array(c, pa.int64()) for c in out[2:5]), *(pa.array(c, pa.int32()) for c in out[5:7]), pa.array(out[7], pa.bool_())], ["g", "c", "k1", "k2", "p", "before", "span", "single"])

    return run


def _texts(batches):
    """The bytes around anchors."""
    for b in batches:
        out: list[list] = [[] for _ in range(8)]
        for k1, k2, text, anchors in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            raw = text.encode()
            for a in anchors:
                p, before, span = a["p"], a["before"], a["span"]
                for c, x in zip(out, (a["g"], k1, k2, p, a["single"], raw[p - before : p - before + span + LENGTH], before, span), strict=True):
                    c.append(x)
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary(), pa.int32(), pa.int32()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["g", "k1", "k2", "p", "single", "around", "before", "span"])


def repeated_starts(keyed: DataFrame) -> DataFrame:
    """k1, k2, a, b: starts a to b of windows that occur elsewhere too."""
    rows = common.materialize(keyed.select("k1", "k2", "text").mapInArrow(_anchors, "g bigint, c bigint, k1 bigint, k2 bigint, p bigint, before smallint, span smallint"), "anchors")
    # aggregates are written before they are joined back: Spark splits hot keys between plain exchanges only
    grams = common.materialize(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("n > 1").select("g", (F.col("c1") != F.col("c2")).alias("mixed")), "grams")
    found = common.materialize(rows.join(grams, "g"), "repeated-grams")
    mixed = found.where("mixed")
    kinds = mixed.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "p")).alias("first"))
    kinds = common.materialize(kinds, "surroundings")
    hot = kinds.groupBy("g").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("g", F.lit(True).alias("hot"))
    common.discard(rows, grams)
    # surroundings with very many rows are dealt by salts; those are few, and their number is bounded
    heavy = F.broadcast(common.highest(kinds.where(F.col("n") > HEAVY).select("g", "c", "n"), "n", HEAVY_KINDS, "heavy").select("g", "c", F.ceil(4 * F.col("n") / HEAVY).cast("int").alias("salts")))
    salted = lambda df, salt: df.join(heavy, ["g", "c"], "left").withColumn("salt", salt)
    twice = salted(kinds.where("n > 1").select("g", "c"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).select("g", "c", "salt")
    among = salted(mixed, F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("k1", "p"), F.col("salts")).cast("int")).otherwise(0))
    whole = found.where("not mixed").select("k1", "k2", "p", "before", "span").union(among.join(twice, ["g", "c", "salt"], "left_semi").select("k1", "k2", "p", "before", "span"))
    first = kinds.join(hot, "g", "left").select("g", "c", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), F.col("first.p").alias("p"), (F.col("n") == 1).alias("single"), F.coalesce("hot", F.lit(False)).alias("hot"))
    sent = mixed.select("g", "c", "k1", "k2", "p", "before", "span").distinct().join(first, ["g", "c", "k1", "k2", "p"])
    def beside(anchors, name):
        """Texts with the anchors that are wanted of them. All columns go along, so that the texts' exchange is the one
        that `dedup` needs again; rows that agree in k1 and k2 have the same text, and what they say twice counts once."""
        own = anchors.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "p", "before", "span", "single")).alias("anchors"))
        return keyed.join(common.materialize(own, name), ["k1", "k2"]).select("k1", "k2", "text", "anchors", "doc_id")

    start = F.col("p") - F.col("before")
    spans = lambda df: df.select("k1", "k2", start.alias("a"), (start + F.col("span")).alias("b"))
    sent, out, width = common.materialize(sent, "anchors-sent"), spans(whole), WIDTH
    sorts = [sent.where("not hot")]
    while not sent.where("hot").isEmpty():
        # the same again, part by part: parts of the same bytes repeat, and of those that have more in common one of each
        # kind is sorted; where these are very many, as at the edges of a passage, the parts are single windows
        parts = common.materialize(beside(sent.where("hot"), "sent").mapInArrow(_parts(width), "g bigint, c bigint, k1 bigint, k2 bigint, p bigint, before int, span int, single boolean"), "parts")
        kinds = common.materialize(parts.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "p", "before", "span", "single")).alias("first")), "part-kinds")
        out = out.union(spans(parts.where("single").join(kinds.where("n > 1").select("g", "c"), ["g", "c"], "left_semi")))
        sizes = common.materialize(kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed-parts")
        sent = kinds.join(sizes, "g").select("g", "first.k1", "first.k2", "first.p", "first.before", "first.span", (F.col("first.single") & (F.col("n") == 1)).alias("single"), (F.col("kinds") > HOT).alias("hot"))
        sent, width = common.materialize(sent, "anchors-sent"), 1  # windows alone have all bytes in common
        sorts.append(sent.where("not hot"))
    columns = ["k1", "k2", "g", "p", "before", "span", "single"]
    wanted = sorts[0].select(*columns)
    for more in sorts[1:]:
        wanted = wanted.unionByName(more.select(*columns))
    texts = beside(wanted, "sent").mapInArrow(_texts, "g bigint, k1 bigint, k2 bigint, p bigint, single boolean, around binary, before int, span int")
    solved = texts.repartition("g").sortWithinPartitions("g").mapInArrow(_solve, "k1 bigint, k2 bigint, a bigint, b bigint")
    return out.union(solved)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary of each document."""
    spark = docs.sparkSession
    common.tune(spark)
    keyed = common.doc_key(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    spans = repeated_starts(keyed).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            size, gone, runs, kept = [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode()
                removed = count = 0
                if spans:
                    parts, at = [], 0
                    end = start = -1
                    for a, z in sorted((s["a"], s["b"] + LENGTH) for s in spans):
                        if a > end:
                            if end >= 0:
                                parts.append(raw[at:start])
                                at, removed, count = end, removed + end - start, count + 1
                            start, end = a, z
                        else:
                            end = max(end, z)
                    parts.append(raw[at:start])
                    parts.append(raw[end:])
                    removed, count = removed + end - start, count + 1
                    raw_kept = b"".join(parts)
                else:
                    raw_kept = raw
                size.append(len(raw)), gone.append(removed), runs.append(count), kept.append(raw_kept)
            yield pa.record_batch([b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op8_suffix(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    out = dedup(common.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"))
