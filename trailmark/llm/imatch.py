"""Document fingerprints: I-Match over randomised lexicons.

Terms (white-space words, case folded, without outer punctuation) get their exact document frequency
over all documents. Terms within the band of inverse document frequency are kept, sorted and distinct,
and hashed once for each of 40 randomised lexicon subsets, from the whole lexicon to a 256th of it.
Tasks know the band by a Bloom filter whose size follows from the counted number of its terms: about one in
200 terms outside passes; with more than common.KEYS_AT_MOST terms in the band more do, as the filter
doesn't grow further.

Null or empty text: its terms are none, the text itself is hashed instead; so too if a text has
no letters or digits. No term in the band: all its terms count. Null doc_id: sorts first. Repeated
rows: each its own row, ordered by text; all rows of one doc_id meet in one task. One row only: it is
its own next. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The band of document frequency: in two documents and a millionth of all at least, and in one of twenty at most.
MIN_DOCS, MIN_SHARE, MAX_SHARE = 2, 1e-6, 0.05
#: (share of the lexicon in 1/256, subsets).
LEVELS = ((256, 1), (64, 7), (16, 8), (4, 12), (1, 12))
SUBSETS = sum(n for _, n in LEVELS)
#: A level's matches count as a likeness from so many subsets with terms.
LEAST = 4
CACHE = 500_000
#: Distinct terms that a task counts before it passes them on.
HELD = 1 << 21

_BOUND = np.array([s for s, n in LEVELS for _ in range(n)], dtype=np.uint16)
_EDGES = np.cumsum([0, *(n for _, n in LEVELS)])
_SEEDS = common.mix64(np.arange(1, SUBSETS // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ENDS = common.mix64(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Terms(dict):
    """64-bit hash of a raw word's term, 0 for none; remembers."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        t = word.casefold()
        a, b = 0, len(t)
        while a < b and not t[a].isalnum():
            a += 1
        while b > a and not t[b - 1].isalnum():
            b -= 1
        h = self[word] = (xxhash.xxh3_64_intdigest(t[a:b]) or 1) if a < b else 0
        return h

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's term hashes in their order, without those of words that have none."""
        words = common.Words(texts)
        known = np.fromiter(map(self.__getitem__, words.distinct), dtype=np.uint64, count=len(words.distinct))
        if (known != 0).all():
            return list(words.texts(known))
        return [h[h != 0] for h in words.texts(known)]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def frequencies(docs: DataFrame) -> DataFrame:
    """(term bigint, n bigint): documents of each term; term 0 stands for all documents."""

    def count(batches):
        terms, held, size, total = Terms(), [], 0, 0

        def out(h, n):
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["term", "n"])

        for b in batches:
            total += b.num_rows
            own = [np.unique(h) for h in terms.texts(b.column(0))]
            h, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.append((h, n)), (size := size + len(h))
            if size > HELD:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out(*held[0])
                    held, size = [], 0
        yield out(*_merged(held))
        yield out(np.zeros(1, np.uint64), np.array([total]))

    return docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> common.Bloom:
    """The terms in the band, from the document frequencies of all documents."""
    common.tune(docs.sparkSession)
    df = common.materialize(frequencies(docs), "document-frequency")
    total = (df.where("term = 0").agg(F.sum("n")).first() or [0])[0] or 0
    kept = df.where((F.col("term") != 0) & (F.col("n") >= max(min_docs, min_share * total)) & (F.col("n") <= max(min_docs, max_share * total))).select("term")
    band = common.Bloom.of(kept)
    common.discard(df)
    return band


def subsets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each subset of the lexicon whether a sorted set of terms has any in it, and the hash of those."""
    some, total = np.zeros(SUBSETS, dtype=bool), _ENDS.copy()
    for i in range(0, len(h), 8192):
        part = h[i : i + 8192]
        drawn = common.mix64(part[None, :] ^ _SEEDS[:, None]).view(np.uint8).reshape(len(_SEEDS), len(part), 8)
        keep = drawn.transpose(0, 2, 1).reshape(SUBSETS, len(part)) < _BOUND[:, None]
        some |= keep.any(axis=1)
        total += np.where(keep, common.mix64(part + np.uint64(0x9E3779B97F4A7C15)), np.uint64(0)).sum(axis=1, dtype=np.uint64)
    return some, (common.mix64(total) >> np.uint64(32)).astype(np.uint32)


def fingerprints_of(texts: list[str], terms: Terms, band: common.Bloom) -> list[tuple[np.ndarray, np.ndarray]]:
    """subsets() of each text's terms."""
    words = common.Words(pa.array(texts, pa.string()))
    known = np.fromiter(map(terms.__getitem__, words.distinct), dtype=np.uint64, count=len(words.distinct))
    inside = band.inside(known) & (known != 0)
    out = []
    for text, h, kept in zip(texts, words.texts(known), words.texts(inside), strict=True):
        if kept.any():
            h = h[kept]
        elif not (h != 0).any():
            h = np.array([xxhash.xxh3_64_intdigest(text)], dtype=np.uint64)
        else:
            h = h[h != 0]
        out.append(subsets(np.unique(h)))
    return out


def hexadecimal(f: tuple[np.ndarray, np.ndarray]) -> str:
    """Eight hexadecimal digits for each subset, eight hyphens for a subset without terms."""
    raw = f[1].astype(">u4").tobytes().hex()
    if f[0].all():
        return raw
    return "".join(raw[8 * k : 8 * k + 8] if x else "--------" for k, x in enumerate(f[0].tolist()))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints; else the best level's share of equal hashes among subsets with
    terms. Sparse subsets hold about one term, so that their share estimates the overlap."""
    same = (a[0] == b[0]) & ((a[1] == b[1]) | ~a[0])
    if same.all():
        return 1.0
    some = a[0] | b[0]
    n = np.add.reduceat(some.astype(np.int64), _EDGES[:-1])
    equal = np.add.reduceat((same & some).astype(np.int64), _EDGES[:-1])
    best = max((e / m for e, m in zip(equal.tolist(), n.tolist(), strict=True) if m >= LEAST), default=0.0)
    return best if best else int(equal.sum()) / max(1, int(n.sum()))


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, part, own: sorted by part, doc_id within partitions; a part ends with a row that
    is not its own: the first document of the next part (after the last: of the first)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ids = docs.select(key.alias("key"))
    bounds = ids.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    # among the bounds in two steps: some of them first, then those between two of these
    listed = lambda x: F.from_json(F.lit(json.dumps(x)), "array<bigint>")
    below = lambda x: F.size(F.filter(x, lambda b: b <= F.col("key")))
    step = max(1, round(len(bounds) ** 0.5))
    start = F.greatest(F.lit(0), below(listed(bounds[::step])) - 1) * step
    part = start + below(F.slice(listed(bounds), start + 1, step)) if bounds else F.lit(0)
    found = ids.withColumn("part", part).groupBy("part").agg(F.min("key").alias("first")).orderBy("part").collect()
    if not found:
        return docs.select("doc_id", "text", F.lit(0).alias("part"), F.lit(True).alias("own"), F.lit(0).cast("long").alias("key"))
    before = F.create_map(*[F.lit(x) for i, r in enumerate(found) for x in (r["first"], found[i - 1]["part"])])
    firsts = [r["first"] for r in found]
    rows = docs.select("doc_id", "text", key.alias("key"), F.lit(True).alias("own")).withColumn("part", part)
    spark = docs.sparkSession
    # a number for each part that hashing deals to a partition of its own
    dealt = {r["p"]: r["id"] for r in spark.range(20 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).collect()}
    place = F.element_at(F.from_json(F.lit(json.dumps([dealt.get(p, p) for p in range(parts)])), "array<bigint>"), F.col("part") + 1)
    tails = docs.select("doc_id", "text", key.alias("key"), F.lit(False).alias("own")).where(F.col("key").isin(firsts)).withColumn("part", before[F.col("key")])
    return rows.unionByName(tails).withColumn("place", place).repartition(parts, "place").sortWithinPartitions("part", F.desc("own"), "key", "text").select("doc_id", "text", "part", "own", "key")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    band = spark.sparkContext.broadcast(lexicon(docs).bits)
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        terms, inside = Terms(), common.Bloom(band.value)
        held, part = None, None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for b in batches:
            pairs = []
            rows = []
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if row[2] != part:
                    part, held = row[2], None
                if held is None and not row[3]:
                    continue  # further rows with the next part's first doc_id
                rows.append(row)
                if held is not None:
                    pairs.append((held, len(rows) - 1))
                held = [row[0], row[1], len(rows) - 1, None] if row[3] else None
            own = fingerprints_of([r[1] for r in rows], terms, inside)
            edited = [edit(a[1], rows[k][1]) for a, k in pairs]
            changed = fingerprints_of(edited, terms, inside)
            out: list[list] = [[] for _ in names]
            for (a, k), e, fe in zip(pairs, edited, changed, strict=True):
                fa, fb = own[a[2]] if a[3] is None else a[3], own[k]
                for c, x in zip(out, (a[0], len(a[1]), hashlib.sha256(e.encode()).hexdigest(), hexadecimal(fa), hexadecimal(fe), likeness(fa, fe), likeness(fa, fb)), strict=True):
                    c.append(x)
            if held is not None and held[3] is None:
                held[3] = own[held[2]]  # the next batch needs the fingerprint only
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    schema = f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, parts).mapInArrow(run, schema)


def op1_imatch(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return fingerprints(common.read_table(spark, sf_dir, "documents"))
