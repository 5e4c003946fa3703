"""Toxicity: noisy-channel deobfuscation before scoring.

A character trigram model is counted over all texts. Words that look disguised (leetspeak, marks
inside, repetitions, letters set apart) become character lattices, which a Viterbi search decodes
under the model; the restored words are scored by log odds of words and word beginnings, learnt
from a bounded sample of labelled rows, and the strongest words of a document give a calibrated
probability.

Null or empty text: scored as a text without words. Null or missing labels: not learnt from; no
labels of both kinds: every score is the share of toxic labels. Repeated rows: equal scores. Empty
table: empty result. Extra columns are passed through.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows learnt from (drawn by a hash of doc_id): the documented bound.
SAMPLE = 40_000
#: Features of the model at most.
FEATURES = 50_000
#: A word's beginning may weigh so much less than the word.
TELLING = 0.25
#: Features that a task holds at most before it passes them on.
COUNTED = 500_000
CACHE = 300_000
#: Letters that leetspeak characters stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "¡": "i", "£": "l"}
SYMBOLS = 60
#: Marks that may stand before and after a word; those after it stand for no letter.
OPENING, CLOSING = "\"'([{<«„“‘¿", ".,;:?\"')]}>»“”’!#%&*~^_=-"
#: Longer words are decoded in windows of SPAN characters that overlap by half.
SPAN = 64
#: Windows of letters set apart: a longer word is found by its beginning.
LONGEST = 24
#: A character three times or more, letters or marks; such repeats in a row; a letter twice.
REPEATED, LEADING, DOUBLED = re.compile(r"(.)\1{2,}", re.S), re.compile(r"(?:(.)\1{2,})+", re.S), re.compile(r"([^\W\d_])\1")
#: What sets words apart inside a white-space word: any mark, marks but for those of leetspeak, marks but for digits, @ and $.
INNER = [re.compile(x) for x in (r"[\W\d_]+", "[^\\w" + re.escape("".join(LEET)) + "]+|_+", r"[^\w@$€£]+|_+")]


def _symbols() -> np.ndarray:
    """Symbol of each code point under 0x180: 1-26 a-z, 27-58 the letters of Latin-1, 59 other
    letters, 0 the rest. Beyond it: 59."""
    table = np.zeros(0x181, dtype=np.int64)
    for c in range(0x180):
        ch = chr(c)
        if "a" <= ch <= "z":
            table[c] = c - 96
        elif 0xDF <= c <= 0xFF and ch.isalpha():
            table[c] = 27 + c - 0xDF
        elif ch.isalpha():
            table[c] = 59
    table[0x180] = 59
    return table


def symbol(ch: str) -> int:
    return int(_TABLE[min(ord(ch), 0x180)])


_TABLE = _symbols()


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all character trigrams of all texts, lower case, words bounded by 0."""
    common.tune(docs.sparkSession)

    def count(batches):
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for b in batches:
            text = " " + "  ".join(x for x in b.column(0).to_pylist() if x).lower() + " "
            for i in range(0, len(text), 1 << 20):  # overlapping by the two symbols before
                s = _TABLE[np.minimum(np.frombuffer(text[max(0, i - 2) : i + (1 << 20)].encode("utf-32-le"), np.uint32), 0x180)]
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["gram", "n"])

    got = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3, dtype=np.int64)
    out[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs -log p(c | a, b), trigrams smoothed by bigrams and letters."""
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    p3 = (n3 + 2 * p2) / (n3.sum(axis=2, keepdims=True) + 2)
    return -np.log(p3).astype(np.float32)


class Restorer:
    """Words to what they may stand for."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.reshape(-1).tolist()

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each character what it may stand for ('' for nothing), and the cost."""
        out = []
        for i, c in enumerate(word):
            if c.isalpha():
                ways = [(c, 0.0)]
                if i and word[i - 1] == c:
                    ways.append(("", 0.7 if i > 1 and word[i - 2] == c else 3.0))
            else:
                ways = [("", 1.0)] + [(x, 1.5) for x in LEET.get(c, "")]
            out.append(ways)
        return out

    def decode(self, word: str, best: int = 3) -> list[str]:
        """The cheapest readings: Viterbi over the last two letters."""
        costs = self.costs
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for ways in self.lattice(word):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in states.items():
                base = (a * SYMBOLS + b) * SYMBOLS
                for ch, extra in ways:
                    if ch:
                        s = symbol(ch)
                        key, now = (b, s), cost + extra + costs[base + s]
                    else:
                        key, now = (a, b), cost + extra + 2.0
                    if key not in after or now < after[key][0]:
                        after[key] = (now, text + ch)
            states = after
        ends = sorted((cost + costs[(a * SYMBOLS + b) * SYMBOLS], text) for (a, b), (cost, text) in states.items())
        return [t for _, t in ends[:best] if t]

    def lettered(self, word: str) -> list[str]:
        """The readings of a word of letters: each doubled letter once or twice, by the lattice where
        there are more than four."""
        at = [m.start() for m in DOUBLED.finditer(word)]
        if not at:
            return [word]
        if len(at) > 4:
            return [word, DOUBLED.sub(r"\1", word), *self.decode_long(word)]
        ends = [0, *(i + 1 for i in at), len(word)]
        pieces = [word[i:j] for i, j in itertools.pairwise(ends)]
        return ["".join([pieces[0], *(x[k:] for x, k in zip(pieces[1:], skip, strict=True))]) for skip in itertools.product((0, 1), repeat=len(at))]

    def decode_long(self, word: str) -> list[str]:
        return [t for i in range(0, max(1, len(word) - SPAN // 2), SPAN // 2) for t in self.decode(word[i : i + SPAN])]

    def words(self, raw: str) -> list[str]:
        """The readings of a white-space word and of its parts: itself where nothing is disguised."""
        lower = raw.lower()
        out = self.read(REPEATED.sub(r"\1\1", lower))
        if m := REPEATED.match(lower):  # what leading repeats hide
            for end in {m.end(), LEADING.match(lower).end()}:
                out += self.read(REPEATED.sub(r"\1\1", lower[end:]))
        return out

    def read(self, w: str) -> list[str]:
        w = w.lstrip(OPENING)
        core = w.rstrip(CLOSING)
        if core.isalpha():
            return self.lettered(core)
        out = self.marked(core)
        return out + self.decode_long(w) if len(core) < len(w) and out else out

    def marked(self, core: str) -> list[str]:
        letters = "".join(c for c in core if c.isalpha())
        if not letters and len(core) < 4:
            return []
        out = self.lettered(letters) if letters else []
        parts = {core} | {x for inner in INNER for x in inner.split(core) if len(x) > 2}
        for part in parts:
            if part.isalpha():
                out += self.lettered(part)
            elif part is core or any(c.isalpha() for c in part) or len(part) > 3:
                out += self.decode_long(part)
                if part != core:
                    out += self.lettered("".join(c for c in part if c.isalpha()))
        return [x for x in out if x]


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in (4, 5, 6) if len(word) >= k)]


def spaced(words: list[str]) -> Iterator[str]:
    """Runs of three or more single characters, joined, and each window in them: a run may hold several words."""
    for single, run in itertools.groupby(words, lambda w: len(w) == 1):
        if single:
            run = "".join(run)
            if len(run) > 2:
                yield run
                for i in range(len(run) - 2):
                    for n in range(3, min(LONGEST, len(run) - i) + 1):
                        yield run[i : i + n]


def beginning(word: str) -> str:
    """The first four letters without repeats: those of every reading of a word of letters."""
    return "".join(c for c, _ in itertools.groupby(word[:12]))[:4]


class Weights(dict):
    """The weight of a raw word; remembers."""

    def __init__(self, restorer: Restorer, model: dict[str, float]):
        super().__init__()
        self.restorer, self.model = restorer, model
        #: What a word of letters must begin with for any feature of the model; of features that have fewer letters,
        #: words are met by words of just these, beginnings by any word that begins so.
        starts = [(f[0], beginning(f[1:])) for f in model]
        self.begin = {x for _, x in starts if len(x) == 4}
        self.brief = {x for kind, x in starts if len(x) < 4 and kind == "="}
        self.stubs = {x for kind, x in starts if len(x) < 4 and kind == "^"}

    def __missing__(self, raw: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        w = self[raw] = self.weigh(raw)
        return w

    def weigh(self, raw: str) -> float:
        core = raw.lower().lstrip(OPENING).rstrip(CLOSING)
        get = self.model.get
        doubled = DOUBLED.search(core)
        if core.isalpha() and not (doubled and REPEATED.search(core)):
            start = beginning(core) if doubled else core[:4]
            if not (start in self.begin or (len(start) < 4 and start in self.brief) or (self.stubs and any(start[:k] in self.stubs for k in (1, 2, 3)))):
                return 0.0
            if not doubled:
                return max(get(f, 0.0) for f in features(core))
        return max((get(f, 0.0) for word in self.restorer.words(raw) for f in features(word)), default=0.0)

    def summaries(self, texts: pa.Array) -> list[float]:
        """For each text its strongest weight; the second and the number of strong ones count a tenth, so that
        one strong word is enough."""
        words = common.Words(texts)
        weight = np.fromiter(map(self.__getitem__, words.distinct), dtype=np.float64, count=len(words.distinct))
        found: dict[int, dict[str, float]] = {}
        hits = np.flatnonzero(weight[words.at] > 0.5)
        for doc, k in zip(np.searchsorted(words.ends, hits, side="right").tolist(), words.at[hits].tolist(), strict=True):
            found.setdefault(doc, {})[words.distinct[k]] = weight[k]
        for doc, own in apart(words):
            for x in spaced(own):
                if (w := self[x]) > 0.5:
                    found.setdefault(doc, {})[x] = w
        out = [0.0] * len(words.ends)
        for doc, strong in found.items():
            got = sorted(strong.values(), reverse=True)
            out[doc] = sum(got[:1]) + 0.1 * sum(got[1:2]) + 0.1 * math.log1p(sum(w > 2 for w in got))
        return out


def apart(words: common.Words) -> Iterator[tuple[int, list[str]]]:
    """(text, single characters) of each run of three or more single characters in a text."""
    single = np.fromiter(map(len, words.distinct), dtype=np.int64, count=len(words.distinct))[words.at] == 1
    edge = np.zeros(len(single) + 1, dtype=bool)  # where a text begins
    edge[np.minimum(words.ends, len(single))] = True
    edge[0] = True
    start = np.flatnonzero(single & (edge[:-1] | ~np.concatenate([[False], single[:-1]])))
    after = single & (edge[1:] | ~np.concatenate([single[1:], [False]]))
    end = np.flatnonzero(after) + 1
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        if b - a > 2:
            yield int(np.searchsorted(words.ends, a, side="right")), [words.distinct[k] for k in words.at[a:b].tolist()]


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, text, y of about `sample` labelled rows at most to learn from, drawn by hash."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    ids = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, sample / max(1, own.count()))
    ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * np.append(w[:-1], 0)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]) * 1.0
        w -= np.linalg.solve(h, g)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, float], np.ndarray]:
    """(costs of the language model, weights of features, calibration)."""
    spark = docs.sparkSession
    costs = language_model(trigram_counts(docs))
    held = spark.sparkContext.broadcast(costs)
    rows = common.materialize(labelled(docs, labels, "toxic", sample), "toxic-sample").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0)

    def count(batches):
        """Documents of each kind that have a feature. Sums are passed on, and a text's features counted, before
        there are too many of them: a text of very many letters set apart counts some of its features more than once."""
        restorer, cache, total = Restorer(held.value), {}, {}

        def of(raw):
            fs = cache.get(raw)
            if fs is None:
                if len(cache) > 100_000:
                    cache.clear()
                fs = cache[raw] = tuple({f for w in restorer.words(raw) for f in features(w)})
            return fs

        def add(found, y):
            for f in found:
                c = total.get(f)
                if c is None:
                    c = total[f] = [0, 0]
                c[y] += 1
            found.clear()

        def out():
            batch = pa.record_batch([pa.array(list(total), pa.string()), pa.array([c[1] for c in total.values()], pa.int64()), pa.array([c[0] for c in total.values()], pa.int64())], ["f", "t", "c"])
            total.clear()
            return batch

        for b in batches:
            words = common.Words(b.column(0))
            runs: dict[int, list[list[str]]] = {}
            for doc, own in apart(words):
                runs.setdefault(doc, []).append(own)
            start, found = 0, set()
            for doc, (end, y) in enumerate(zip(words.ends.tolist(), b.column(1).to_pylist(), strict=True)):
                raws = (words.distinct[k] for k in np.unique(words.at[start:end]).tolist())
                for raw in itertools.chain(raws, *map(spaced, runs.get(doc, ()))):
                    found.update(of(raw))
                    if len(found) > COUNTED:
                        add(found, y)
                        if len(total) > COUNTED:
                            yield out()
                add(found, y)
                start = end
            if len(total) > COUNTED:
                yield out()
        yield out()

    sizes = {r["y"]: r["n"] for r in rows.where("not half").groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1)) - 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    got = rows.where("not half").select("text", "y").mapInArrow(count, "f string, t bigint, c bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 3").withColumn("w", odds).where("w > 0.5").select("f", "w")
    got = common.materialize(got, "toxic-odds")
    # a beginning must tell as much as the words it was learnt from, else it stands for other words too
    whole = got.where(F.col("f").startswith("=")).select(F.explode(F.array(*[F.concat(F.lit("^"), F.substring("f", 2, k)) for k in (4, 5, 6)])).alias("f"), F.col("w").alias("own"))
    whole = whole.groupBy("f").agg(F.max("own").alias("own"))
    got = got.join(whole, "f", "left").where(F.col("f").startswith("=") | F.col("own").isNull() | (F.col("w") >= F.col("own") - TELLING)).select("f", "w")
    model = {r["f"]: r["w"] for r in common.highest(got, "w", FEATURES, "toxic-features").collect()}
    model_held = spark.sparkContext.broadcast(model)

    def summarise(batches):
        weights = Weights(Restorer(held.value), model_held.value)
        for b in batches:
            yield pa.record_batch([pa.array(weights.summaries(b.column(0)), pa.float64()), b.column(1)], ["x", "y"])

    fit = rows.where("half").select("text", "y").mapInArrow(summarise, "x double, y int").toArrow()
    y = fit.column("y").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        return costs, model, np.array([0.0, math.log(share / (1 - share))])
    return costs, model, logistic(fit.column("x").to_numpy().reshape(-1, 1), y)


def _scored(docs: DataFrame, labels: DataFrame, sample: int, threshold: float) -> DataFrame:
    """row, score, predicted."""
    spark = docs.sparkSession
    common.tune(spark)
    held = spark.sparkContext.broadcast(train(docs, labels, sample))
    packed = common.pack(docs)
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        costs, model, w = held.value
        weights = Weights(Restorer(costs), model)
        for b in batches:
            x = np.array(weights.summaries(b.column(1))).reshape(-1, 1)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    return packed.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """docs with score double and predicted int."""
    return common.unpack(_scored(docs, labels, sample, threshold), docs.columns, ["score", "predicted"])


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """docs without those predicted toxic; all their columns stay."""
    return _scored(docs, labels, sample, threshold).where("predicted = 0").select("row.*")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document scored, learnt from the rows not held out."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, common.read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
