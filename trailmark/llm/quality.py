"""Quality classifier: random-indexing word vectors and a two-layer network.

Words (and the marks at their edges, and whether they are upper case) fall into a fixed number of
slots. Each slot has a sparse random index vector; its word vector is the sum of the index vectors of
its neighbours, and its own, over all texts. A document is the weighted mean and the spread of its
word vectors; a two-layer network in numpy, trained on a bounded sample of labelled rows, gives
a logit that a temperature calibrates.

Null or empty text: pooled to zeros. Null or missing labels: not learnt from; without labels of
both kinds every score is the share of label 1. Repeated rows: equal scores. Empty table: empty
result. Extra columns are passed through.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .toxicity import held_out, labelled

SLOTS, DIM, NONZERO, REACH = 1 << 15, 64, 2, 2
#: Labelled rows learnt from at most: the documented bound.
SAMPLE = 20_000
HIDDEN, EPOCHS = 32, 30
CACHE = 500_000
BLOCK = 512
#: No slot; slots that are added up together.
NONE, GATHER = SLOTS, 2_000_000

_rng = np.random.default_rng(7)
_POS = _rng.integers(0, DIM, size=(SLOTS, NONZERO))
_SIGN = _rng.choice([-1.0, 1.0], size=(SLOTS, NONZERO))
_PLACE = 2 * _POS + (_SIGN < 0)


class Slots(dict):
    """A raw word's (slot of the word, slot of its marks or NONE, slot of its shape or NONE); remembers."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        a, b = 0, len(word)
        while a < b and not word[a].isalnum():
            a += 1
        while b > a and not word[b - 1].isalnum():
            b -= 1
        core, marks = word[a:b], word[:a] + " " + word[b:]
        slot = lambda s: zlib.crc32(s.encode()) % SLOTS
        self[word] = got = (slot(core.lower()) if core else NONE, slot("m" + marks) if len(marks) > 1 else NONE, slot("\x00upper") if len(core) > 1 and core.isupper() else NONE)
        return got

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's slots in their order."""
        if len(self) > CACHE:
            self.clear()
        words = common.Words(texts)
        table = np.fromiter(itertools.chain.from_iterable(map(self.__getitem__, words.distinct)), dtype=np.uint16, count=3 * len(words.distinct)).reshape(-1, 3)
        return [got[got != NONE] for got in (x.reshape(-1) for x in words.texts(table))]


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(vectors SLOTS x DIM of unit length about the mean, counts of slots) from all texts."""
    common.tune(docs.sparkSession)

    def gather(batches):
        slots = Slots()
        total, n = np.zeros(SLOTS * DIM), np.zeros(SLOTS, dtype=np.int64)
        gap, parts, size = np.full(REACH, NONE, dtype=np.uint16), [], 0

        def add_up():
            """A word's neighbours are counted, and each sort of pair adds its index vector once. Gaps
            between texts are slots past the last, which are cut off."""
            s = np.concatenate(parts).astype(np.int64)
            parts.clear()
            n[:] += np.bincount(s, minlength=SLOTS + 1)[:SLOTS]
            for lag in range(1, REACH + 1):
                x, y = s[:-lag], s[lag:]
                both = (x != NONE) & (y != NONE)
                x, y = x[both], y[both]
                for k in range(NONZERO):
                    for own, other in ((x, y), (y, x)):
                        # the sign is the lowest bit of the place, so that whole numbers are counted
                        got = np.bincount(own * (2 * DIM) + _PLACE[other, k], minlength=2 * SLOTS * DIM)
                        total[:] += got[0::2]
                        total[:] -= got[1::2]

        for b in batches:
            for x in slots.texts(b.column(0)):
                if len(x):
                    parts += [x, gap]
                    size += len(x) + REACH
            if size > GATHER:
                add_up()
                size = 0
        if parts:
            add_up()
        rows = np.flatnonzero(np.bincount(np.flatnonzero(n) // BLOCK, minlength=SLOTS // BLOCK))
        whole = np.hstack([total.reshape(SLOTS, DIM), n[:, None]]).astype(np.float32)
        for k in rows:
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zlib.compress(whole[k * BLOCK : (k + 1) * BLOCK].tobytes(), 1)], pa.binary())], ["block", "sums"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(raw), np.float32).astype(np.float64)
                held[k] = held[k] + x if k in held else x
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "sums"])

    schema = "block int, sums binary"
    # sums of a block run through one task one after another: its memory is one block's
    got = docs.select("text").mapInArrow(gather, schema).repartition("block").mapInArrow(add, schema).collect()
    whole = np.zeros((SLOTS, DIM + 1))
    for r in got:
        whole[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"]).reshape(BLOCK, DIM + 1)
    vectors, n = whole[:, :DIM], whole[:, DIM]
    for k in range(NONZERO):  # a word's own index vector, as often as it has neighbours
        vectors[np.arange(SLOTS), _POS[:, k]] += 2 * REACH * n * _SIGN[:, k]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    if n.sum():
        vectors -= (vectors * n[:, None]).sum(axis=0) / n.sum()
    return vectors.astype(np.float32), n


def pool(slots: np.ndarray, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean, weighted mean and spread of the word vectors, and the length."""
    n = len(slots)
    if not n:
        return np.zeros(3 * DIM + 2, dtype=np.float32)
    slots = np.sort(slots, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
    own = slots[first]
    count = np.diff(np.append(first, n)).astype(np.float32)
    sums, square = np.zeros((2, DIM), dtype=np.float64), np.zeros(DIM, dtype=np.float64)
    for i in range(0, len(own), 4096):
        v, c = vectors[own[i : i + 4096]], count[i : i + 4096]
        sums += np.stack([c, c * weight[own[i : i + 4096]]]) @ v
        square += c @ np.square(v)
    return np.concatenate([sums[0] / n, sums[1] / n, np.sqrt(square / n), [np.log1p(n), len(own) / n]]).astype(np.float32)


class Network:
    """Two layers: tanh, then a logit; inputs standardised; probabilities by a temperature."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(11)
        order = rng.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(EPOCHS):
            for batch in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
                a, b = z[batch], y[batch]
                h = np.tanh(a @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - b) / len(batch)
                back = np.outer(d, w[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] -= 3e-3 * (0.5 ** (epoch // 10)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if len(held):
            logits = self.logits(x[held])
            grid = np.exp(np.linspace(-1.5, 1.5, 61))
            loss = [np.logaddexp(0, -(2 * y[held] - 1) * logits / g).mean() for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


class Constant:
    def __init__(self, p: float):
        self.p = p

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(vectors, weights of slots, model)."""
    spark = docs.sparkSession
    vectors, n = word_vectors(docs)
    weight = (1e-3 / (1e-3 + n / max(1.0, n.sum()))).astype(np.float32)
    held = spark.sparkContext.broadcast((vectors, weight))

    def pooled(batches):
        slots = Slots()
        for b in batches:
            x = [pool(s, *held.value).tobytes() for s in slots.texts(b.column(0))]
            yield pa.record_batch([pa.array(x, pa.binary()), b.column(1)], ["x", "y"])

    got = labelled(docs, labels, "quality", sample).select("text", "y").mapInArrow(pooled, "x binary, y int").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    if len(y) < 10 or y.min() == y.max():
        return vectors, weight, Constant(float(y.mean()) if len(y) else 0.5)
    order = np.argsort(np.array([zlib.crc32(v) for v in got.column("x").to_pylist()]), kind="stable")
    x = np.stack([np.frombuffer(v, np.float32) for v in got.column("x").to_pylist()])[order].astype(np.float64)
    return vectors, weight, Network().fit(x, y[order])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """docs with score double and predicted int."""
    spark = docs.sparkSession
    common.tune(spark)
    held = spark.sparkContext.broadcast(train(docs, labels, sample))
    packed = common.pack(docs)
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        vectors, weight, model = held.value
        slots = Slots()
        for b in batches:
            x = np.stack([pool(s, vectors, weight) for s in slots.texts(b.column(1))]) if b.num_rows else np.zeros((0, 3 * DIM + 2))
            p = model.predict(x.astype(np.float64))
            yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    return common.unpack(packed.mapInArrow(run, schema), docs.columns, ["score", "predicted"])


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document scored, learnt from the rows not held out."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, common.read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
