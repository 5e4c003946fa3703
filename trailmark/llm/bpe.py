"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The frequent words (pre-tokens) of the whole corpus are encoded once and compiled into a minimal
acyclic automaton with shared suffixes. Counts on its edges turn a word into its rank, which
addresses its ids in a flat pool. Workers memory-map the compiled lexicon; words it doesn't hold
are merged exactly by rank.

Null text: as empty text, no ids. Empty table: empty result. Repeated rows: one result each. Other
columns are passed through, those named like an output give way.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the compiled lexicon; others are merged.
LEXICON_WORDS = 65_536
#: Words and pieces that a worker remembers before it starts anew.
CACHE, CACHE_PIECES = 500_000, 300_000
NONE = 1 << 29
MARKS = frozenset(".,;:!?")
#: Pieces of letters, with one common mark at their end or none; letters of other scripts go the longer way.
PLAIN = r"^(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{400}-\x{481}]+)(?P<mark>[.,;:!?]?)$"


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files, by the published rule."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def simple(piece: str) -> tuple[str, str] | None:
    """(word, mark) of a piece of letters, with one common mark at its end or none; None for others."""
    if piece.isalpha():
        return piece, ""
    if piece[-1:] in MARKS and piece[:-1].isalpha():
        return piece[:-1], piece[-1]
    return None


class Vocabulary:
    """Ids of bytes, merges (left, right) -> (rank, id), bytes of ids, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        at = byte_chars()
        raw = {k: bytes(at[c] for c in k) for k in j["model"]["vocab"]}
        ids = j["model"]["vocab"]
        self.of_byte = [0] * 256
        self.bytes_of: dict[int, bytes] = {}
        for k, i in ids.items():
            self.bytes_of[i] = raw[k]
            if len(raw[k]) == 1:
                self.of_byte[raw[k][0]] = i
        #: Pair (left << 20 | right) to rank; the id that each rank makes; ranks of pairs of single bytes.
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(j["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault(ids[a] << 20 | ids[b], rank)
            self.made.append(ids[a + b])
        self.of_two = [[self.merges.get(a << 20 | b, NONE) for b in self.of_byte] for a in self.of_byte]
        self.added = {t["content"]: t["id"] for t in j.get("added_tokens") or []}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one pre-token: the pair of lowest rank first, from the left."""
        of, two, get, made = self.of_byte, self.of_two, self.merges.get, self.made
        ids = [of[b] for b in word]
        pairs = [two[a][b] for a, b in zip(word, word[1:], strict=False)]
        while pairs and (low := min(pairs)) != NONE:
            i = pairs.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | new, NONE)
            if i < len(pairs):
                pairs[i] = get(new << 20 | ids[i + 1], NONE)
        return ids


class Merger:
    """Exact BPE of many words at once: in each turn every word merges its pair of lowest rank, the first
    from the left, in matrices of words of like length."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.byte = np.array(vocabulary.of_byte, dtype=np.int32)
        self.two = np.array(vocabulary.of_two, dtype=np.int32).reshape(-1)
        self.made = np.array([*vocabulary.made, 0], dtype=np.int32)
        # ranks of pairs in a table of open addresses: a few probes find a pair or a gap
        self.bits = max(4, (4 * len(vocabulary.merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        key = np.fromiter(vocabulary.merges.keys(), dtype=np.int64, count=len(vocabulary.merges))
        rank = np.fromiter(vocabulary.merges.values(), dtype=np.int32, count=len(key))
        at, self.probes = self._slot(key), 0
        while len(key):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[slot], self.ranks[slot] = key[put], rank[put]
            left = np.ones(len(key), dtype=bool)
            left[put] = False
            key, rank, at = key[left], rank[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (common.mix64(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at, out = self._slot(key), np.full(len(key), NONE, dtype=np.int32)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (held >= 0)
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
            if not len(open_):
                break
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        for k in range(0, len(order), 4096):
            own = order[k : k + 4096]
            if sizes[own[-1]] > 64:
                for i in own.tolist():
                    got = self.v.merge(words[i])
                    out[i] = struct.pack(f"<{len(got)}I", *got)
            elif len(own := own[sizes[own] > 0]):
                for i, ids in zip(own.tolist(), self._matrix([words[i] for i in own.tolist()], sizes[own]), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, words: list[bytes], size: np.ndarray) -> list[bytes]:
        m, width = len(words), int(size.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        inside = np.arange(width) < size[:, None]
        ids, pairs = self.byte[raw], np.full((m, width), NONE, dtype=np.int32)
        pairs[:, :-1] = np.where(inside[:, 1:], self.two[(raw[:, :-1].astype(np.int64) << 8) | raw[:, 1:]], NONE)
        done, rest, column = np.zeros((m, width), dtype="<u4"), np.arange(m), np.arange(width)
        left = size.copy()
        while len(rest):
            at = pairs.argmin(axis=1)
            low = pairs[np.arange(len(rest)), at]
            end = low == NONE
            if end.any():
                done[rest[end]] = ids[end]
                go = ~end
                rest, ids, pairs, at, low = rest[go], ids[go], pairs[go], at[go], low[go]
                if not len(rest):
                    break
            rows = np.arange(len(rest))
            ids[rows, at] = self.made[low]
            # what stands behind the merged pair moves on by one
            ids[:, :-1] = np.where(column[:-1] > at[:, None], ids[:, 1:], ids[:, :-1])
            pairs[:, :-1] = np.where(column[:-1] > at[:, None], pairs[:, 1:], pairs[:, :-1])
            pairs[:, -1] = NONE
            left[rest] -= 1
            new = ids[rows, at]
            before = np.flatnonzero(at > 0)
            pairs[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], new[before])
            pairs[rows, at] = NONE
            after = np.flatnonzero(at + 1 < left[rest])
            pairs[after, at[after]] = self.rank(new[after], ids[after, at[after] + 1])
        return [x[:n].tobytes() for x, n in zip(done, left.tolist(), strict=True)]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic automaton of the words (built in sorted order, equal right parts shared),
    edges sorted by state, each with the number of words that sort before it; then the ids."""
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    order = sorted(words)
    path: list[list] = [[False, []]]
    before = b""
    for w in order:
        k = 0
        while k < min(len(w), len(before)) and w[k] == before[k]:
            k += 1
        for i in range(len(before), k, -1):
            done = path.pop()
            path[-1][1].append((before[i - 1], freeze(done)))
        for _ in w[k:]:
            path.append([False, []])
        path[-1][0] = True
        before = w
    for i in range(len(before), 0, -1):
        done = path.pop()
        path[-1][1].append((before[i - 1], freeze(done)))
    root = freeze(path[0])
    counts = []
    for final, edges in frozen:  # children are frozen first
        counts.append(final + sum(counts[t] for _, t in edges))
    first, labels, targets, skips, finals = [0], bytearray(), [], [], bytearray()
    for final, edges in frozen:
        n = int(final)
        for label, t in edges:
            labels.append(label)
            targets.append(t)
            skips.append(n)
            n += counts[t]
        first.append(len(labels))
        finals.append(final)
    offsets = np.cumsum([0] + [len(words[w]) for w in order], dtype=np.uint32)
    pool = np.array([i for w in order for i in words[w]], dtype="<u4")
    parts = [np.array(first, "<u4").tobytes(), np.array(targets, "<u4").tobytes(), np.array(skips, "<u4").tobytes(), offsets.astype("<u4").tobytes(), pool.tobytes(), bytes(finals), bytes(labels)]
    return struct.pack("<4sI7I", b"MATL", root, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon in memory that is mapped from a file."""

    def __init__(self, data: bytes):
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            os.write(fd, data) if len(data) < 1 << 30 else os.fdopen(os.dup(fd), "wb").write(data)
            self.map = mmap.mmap(fd, len(data), access=mmap.ACCESS_READ)
        finally:
            os.close(fd)
            os.unlink(path)
        _, self.root, *sizes = struct.unpack_from("<4sI7I", self.map)
        at, spans = 36, []
        for n in sizes:
            spans.append((at, at + n))
            at += n
        view = memoryview(self.map)
        self.first, self.target, self.skip, self.offset = (view[a:b].cast("I") for a, b in spans[:4])
        self.pool, self.final, self.labels = spans[4][0], view[slice(*spans[5])], spans[6][0]

        # an edge's key: its state and label, sorted
        states = np.frombuffer(self.map, "<u4", len(self.first), spans[0][0])
        labels = np.frombuffer(self.map, np.uint8, spans[6][1] - spans[6][0], spans[6][0])
        self.keys = (np.repeat(np.arange(len(states) - 1, dtype=np.int64), np.diff(states.astype(np.int64))) << 8) | labels
        self.targets, self.skips = (np.frombuffer(self.map, "<u4", len(labels), spans[k][0]) for k in (1, 2))
        self.finals = np.frombuffer(self.map, np.uint8, len(states) - 1, spans[5][0])

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """get() of many words, a byte of all of them at a time."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys):
            return out
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        raw = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero(size > 0)
        state, rank, i = np.full(len(live), self.root, dtype=np.int64), np.zeros(len(live), dtype=np.int64), 0
        while len(live):
            key = state << 8 | raw[start[live] + i]
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = self.keys[e] == key
            live, e = live[go], e[go]
            state, rank = self.targets[e].astype(np.int64), rank[go] + self.skips[e]
            i += 1
            end = size[live] == i
            found = end & (self.finals[state] > 0)
            for k, r in zip(live[found].tolist(), rank[found].tolist(), strict=True):
                out[k] = self.map[self.pool + 4 * self.offset[r] : self.pool + 4 * self.offset[r + 1]]
            live, state, rank = live[~end], state[~end], rank[~end]
        return out

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word as little-endian unsigned 32-bit integers."""
        state, rank, find, at, first = self.root, 0, self.map.find, self.labels, self.first
        for i in range(len(word)):
            e = find(word[i : i + 1], at + first[state], at + first[state + 1]) - at
            if e < 0:
                return None
            rank += self.skip[e]
            state = self.target[e]
        if not self.final[state]:
            return None
        return self.map[self.pool + 4 * self.offset[rank] : self.pool + 4 * self.offset[rank + 1]]


class Encoder:
    """Batches of texts to ids and back. Pieces between single spaces are independent of what surrounds them:
    a batch's distinct pieces are looked up once. Texts with other runs of white space at a piece's edge, and
    those with added tokens, are split whole."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.v, self.lexicon, self.merger = vocabulary, lexicon, Merger(vocabulary)
        self.split = regex.compile(SPLIT).findall
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}
        top = max(vocabulary.bytes_of) + 1
        self.table = pa.array([vocabulary.bytes_of.get(i, b"") for i in range(top)], pa.binary())

    def learn(self, words: list[str]) -> None:
        """Ids of words that aren't known yet: from the lexicon, or merged together."""
        if len(self.words) >= CACHE:
            self.words.clear()
        rest = [w for w in dict.fromkeys(words) if w not in self.words]
        raws = [w.encode() for w in rest]
        held = self.lexicon.get_all(raws)
        own = [i for i, ids in enumerate(held) if ids is None]
        for i, ids in zip(own, self.merger.merge([raws[i] for i in own]), strict=True):
            held[i] = ids
        self.words.update(zip(rest, held, strict=True))

    def wholes(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        out = []
        for i in range(0, len(split), 256):
            self.learn([w for s in split[i : i + 256] for w in s])
            out += [b"".join(map(self.words.__getitem__, s)) for s in split[i : i + 256]]
        return out

    def resolve(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces that stand behind a space; null for those that white space must be read around."""
        plain = pc.extract_regex(pieces, PLAIN)
        word = pc.binary_join_element_wise(" ", plain.field("word"), "").dictionary_encode()
        mark = plain.field("mark").dictionary_encode()
        names, marks = word.dictionary.to_pylist(), mark.dictionary.to_pylist()
        self.learn([*names, *filter(None, marks)])
        ids = [pa.array([self.words[x] if x else b"" for x in own], pa.binary()).take(of.indices) for own, of in ((names, word), (marks, mark))]
        out = pc.binary_join_element_wise(*ids, b"")
        other = pc.is_null(plain)
        rest = pieces.filter(other).to_pylist()
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        parts = {}
        for p in rest:
            if p not in self.pieces:
                if not p or p[0].isspace() or p[-1].isspace():
                    self.pieces[p] = None
                else:
                    parts[p] = self.split(" " + p)
        self.learn([w for s in parts.values() for w in s])
        known = self.words.__getitem__
        for p, s in parts.items():
            self.pieces[p] = b"".join(map(known, s))
        return pc.replace_with_mask(out, other, pa.array([self.pieces[p] for p in rest], pa.binary()))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends of each text's)."""
        texts = pc.fill_null(texts, "")
        held = pc.split_pattern(texts, " ")
        found = held.flatten().dictionary_encode()
        at = found.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(held.value_lengths().to_numpy().astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]])
        ids = self.resolve(found.dictionary)
        # a text's first piece stands behind no space, its last is followed by none
        heads = found.dictionary.take(pa.array(at[starts])).to_pylist()
        odd = pc.is_null(ids).to_numpy(zero_copy_only=False)[at]
        odd[starts] = [(not h or h[-1].isspace()) and e - s > 1 for h, s, e in zip(heads, starts.tolist(), ends.tolist(), strict=True)]
        whole = np.add.reduceat(odd, starts) > 0 if len(starts) else np.zeros(0, bool)
        if self.added is not None:
            for a in self.v.added:
                whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(whole)
        number = np.empty(len(starts), dtype=np.int64)
        more: list[bytes] = []
        if len(rows):
            # a text read whole is one entry; its other pieces are empty
            of = np.repeat(np.arange(len(starts)), ends - starts)
            at = np.where(whole[of], len(ids), at)
            more = [b"", *(self.encode(t.as_py()) for t in texts.take(pa.array(rows)))]
            number[rows] = len(ids) + 1 + np.arange(len(rows))
        rows = np.flatnonzero(~whole)
        number[rows] = len(ids) + len(more) + np.arange(len(rows))
        more += self.wholes([heads[i] for i in rows.tolist()])
        at[starts] = number
        got = pa.concat_arrays([ids.cast(pa.large_binary()), pa.array(more, pa.large_binary())]).take(pa.array(at))
        _, offsets, data = got.buffers()
        offsets = np.frombuffer(offsets, np.int64)[got.offset : got.offset + len(got) + 1]
        flat = np.frombuffer(data, "<u4") if data is not None else np.zeros(0, "<u4")
        return flat[offsets[0] // 4 : offsets[-1] // 4], (offsets[ends] - offsets[0]) // 4

    def plain(self, text: str) -> bytes:
        return self.wholes([text])[0] if text else b""

    def encode(self, text: str) -> bytes:
        if self.added is None or not any(a in text for a in self.v.added):
            return self.plain(text)
        return b"".join(struct.pack("<I", self.v.added[s]) if s in self.v.added else self.plain(s) for s in self.added.split(text))

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str] | pa.Array:
        """The texts of ids that end at `ends`: the tokens' bytes side by side."""
        got = self.table.take(pa.array(ids))
        _, offsets, data = got.buffers()
        offsets = np.frombuffer(offsets, np.int32)[got.offset : got.offset + len(got) + 1]
        bounds = offsets[np.concatenate([[0], ends])]
        raw = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), data if data is not None else pa.py_buffer(b"")])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    def decode(self, ids: bytes) -> str:
        x = np.frombuffer(ids, "<u4")
        return self.decode_all(x, np.array([len(x)]))[0].as_py()


_HELD: dict[str, Encoder] = {}


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all pre-tokens of all texts, pre-aggregated in each task."""

    def count(batches):
        split, held, size = regex.compile(SPLIT).findall, [], 0

        def add(values, n):
            held.append(pa.table({"piece": values, "n": n}))

        def out():
            """Pieces to words; those of a head (marked by a first 0) stand behind no space."""
            words: Counter = Counter()
            whole = pa.concat_tables(held).group_by("piece").aggregate([("n", "sum")])
            held.clear()
            for p, n in zip(whole.column("piece").to_pylist(), whole.column("n_sum").to_pylist(), strict=True):
                if not n:
                    continue
                if p[:1] == "\0":
                    for w in split(p[1:]):
                        words[w] += n
                elif own := simple(p):
                    words[" " + own[0]] += n
                    if own[1]:
                        words[own[1]] += n
                else:
                    for w in split(" " + p):
                        words[w] += n
            return pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            pieces = pc.split_pattern(b.column(0), " ")
            # heads are counted with their mark, and taken out of the others
            heads = pc.value_counts(pc.list_element(pieces, 0))
            counts = pc.value_counts(pieces.flatten())
            add(counts.field("values"), counts.field("counts"))
            add(heads.field("values"), pc.negate(heads.field("counts")))
            add(pc.binary_join_element_wise("\0", heads.field("values"), ""), heads.field("counts"))
            size += len(counts) + 2 * len(heads)
            if size > 2_000_000:
                yield out()
                size = 0
        if held:
            yield out()

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """At most `size` words, the most frequent of the whole corpus, compiled."""
    top = common.highest(word_counts(docs, text), "n", size, "word-counts").select("word").collect()
    return compile_lexicon({w: vocabulary.merge(w) for r in top if (w := r.word.encode())})


def encode(docs: DataFrame, vocab_path: str, lexicon_words: int = LEXICON_WORDS, lexicon: bytes | None = None) -> DataFrame:
    """docs with n_tokens bigint, ids binary (little-endian unsigned 32-bit), decoded string."""
    spark = docs.sparkSession
    common.tune(spark)
    vocabulary = Vocabulary(vocab_path)
    held = spark.sparkContext.broadcast((vocabulary, lexicon if lexicon is not None else build_lexicon(docs, vocabulary, lexicon_words)))
    packed = common.pack(docs)
    key = uuid.uuid4().hex
    schema = T.StructType([packed.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        enc = _HELD.get(key)
        if enc is None:
            _HELD.clear()
            enc = _HELD[key] = Encoder(held.value[0], Lexicon(held.value[1]))
        for b in batches:
            ids, ends = enc.encode_all(b.column(1))
            bounds = np.concatenate([[0], ends])
            packed_ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((4 * bounds).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.record_batch([b.column(0), pa.array(np.diff(bounds)), packed_ids, enc.decode_all(ids, ends)], ["row", "n_tokens", "ids", "decoded"])

    return common.unpack(packed.mapInArrow(run, schema), docs.columns, ["n_tokens", "ids", "decoded"])


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of ids and of the decoded text of every document."""
    import public_tokenizers

    out = encode(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
