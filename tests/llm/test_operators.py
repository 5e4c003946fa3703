import base64
import collections
import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest

from trailmark.llm import bpe, common, cpjoin, decontam, imatch, linedup, quality, sharding, suffix, toxicity, warc

from .conftest import SCHEMA, WORDS, doc, prose

P = pytest.importorskip("public_tokenizers")
VOCAB = P.path("byte_bpe_50k.json")


def sha(b):
    return hashlib.sha256(b).hexdigest()


# 1


def test_imatch(odd, odd_rows, empty):
    got = imatch.fingerprints(odd).collect()
    assert len(got) == len(odd_rows)
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows))
    want = collections.Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        q = len(a[2]) // 4
        want[(a[1] if a[0] else None, len(a[2]), sha((a[2][: len(a[2]) - q] + b[2][:q]).encode()))] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    text = collections.defaultdict(set)
    for r in got:
        if r.doc_id in (46, 47):
            text["same"].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(text["same"]) == 1
    assert imatch.fingerprints(empty).count() == 0


def test_imatch_likeness():
    rnd = random.Random(0)
    terms, band = imatch.Terms(), common.Bloom(np.full(common.BLOCKS * 2, 255, np.uint8))
    words = [f"w{i}" for i in range(5000)]
    near, far = [], []
    for _ in range(60):
        a = rnd.sample(words, 200)
        b = a[:150] + rnd.sample(words, 50)
        fa, fb, fc = imatch.fingerprints_of([" ".join(x) for x in (a, b, rnd.sample(words, 200))], terms, band)
        near.append(imatch.likeness(fa, fb)), far.append(imatch.likeness(fa, fc))
    assert np.mean(near) > 0.35 and np.mean(far) < 0.15


def test_imatch_band(spark):
    docs = spark.createDataFrame([(i, "the " + ("common " if i % 2 else "") + f"pair{i // 2} only{i}") for i in range(100)], "doc_id long, text string")
    band, terms = imatch.lexicon(docs), imatch.Terms()
    inside = lambda *w: band.inside(np.array([terms[x] for x in w], dtype=np.uint64))
    assert inside(*(f"pair{i}" for i in range(50))).all() and not inside("the", "common").any()
    assert inside(*(f"only{i}" for i in range(100))).sum() <= 5


def test_imatch_band_of_many_terms(spark):
    """Terms of one document stay out of the band however many there are."""
    docs = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 2000), i -> concat('w', id, 'x', i)), 'pair' || (id div 2)) as text")
    band, terms = imatch.lexicon(docs), imatch.Terms()
    assert band.inside(np.array([terms[f"pair{i}"] for i in range(200)], dtype=np.uint64)).all()
    rare = np.array([terms[f"w{i}x{j}"] for i in range(400) for j in range(1, 2001, 50)], dtype=np.uint64)
    assert band.inside(rare).mean() < 0.02


def test_imatch_independent(spark, odd_rows):
    """Fingerprints and likenesses, recomputed term by term."""
    docs = spark.createDataFrame([(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 20_000], "doc_id long, text string")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    terms, band = imatch.Terms(), imatch.lexicon(docs)

    def one(text):
        own = sorted({terms[w] for w in text.split()} - {0}) or None
        if own:
            kept = [h for h in own if band.inside(np.array([h], dtype=np.uint64))[0]]
            own = kept or own
        else:
            own = [imatch.xxhash.xxh3_64_intdigest(text)]
        out = []
        for k in range(imatch.SUBSETS):
            total, some = int(imatch._ENDS[k]), False
            for h in own:
                drawn = int(common.mix64(np.array([h], dtype=np.uint64) ^ imatch._SEEDS[k // 8])[0]).to_bytes(8, "little")[k % 8]
                if drawn < imatch._BOUND[k]:
                    some = True
                    total = (total + int(common.mix64(np.array([(h + 0x9E3779B97F4A7C15) % 2**64], dtype=np.uint64))[0])) % 2**64
            out.append(f"{int(common.mix64(np.array([total], dtype=np.uint64))[0]) >> 32:08x}" if some else "--------")
        return out

    def like(a, b):
        if a == b:
            return 1.0
        shares, all_same, all_some = [], 0, 0
        for lo, hi in itertools.pairwise(imatch._EDGES.tolist()):
            pairs = [(x, y) for x, y in zip(a[lo:hi], b[lo:hi]) if (x, y) != ("--------", "--------")]
            same = sum(x == y for x, y in pairs)
            all_same, all_some = all_same + same, all_some + len(pairs)
            if len(pairs) >= imatch.LEAST:
                shares.append(same / len(pairs))
        return max(shares, default=0) or all_same / max(1, all_some)

    order = sorted(((r[0] is not None, r[0] or 0, r[1]) for r in rows))
    want = collections.Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        q = len(a[2]) // 4
        fa, fe, fb = one(a[2]), one(a[2][: len(a[2]) - q] + b[2][:q]), one(b[2])
        want[(a[1] if a[0] else None, "".join(fa), "".join(fe), round(like(fa, fe), 9), round(like(fa, fb), 9))] += 1
    got = imatch.fingerprints(docs, parts=5).collect()
    assert collections.Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


# 2, 5


def labelled(spark, n=400):
    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        toxic, good = rnd.random() < 0.3, rnd.random() < 0.7
        words = prose(rnd, 60).split()
        if toxic:
            for w in rnd.sample(["grubbish", "snarkle", "blighter"], 2):
                words.insert(rnd.randrange(60), w)
        if not good:
            words = [w + "%%%" if rnd.random() < 0.4 else w for w in words]
        docs.append((i, " ".join(words))), labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (5000, None, None)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers(spark, kind, odd, odd_rows, empty):
    docs, df, labels, raw = labelled(spark)
    score = toxicity.score if kind == "toxic" else quality.score
    got = {r.doc_id: r for r in score(df, labels).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = {i: (t if kind == "toxic" else q) for i, q, t in raw}
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.9
    out = score(odd, labels)
    assert out.count() == len(odd_rows) and {"text", "row", "k1"} <= set(out.columns)
    assert all(0 <= r.score <= 1 for r in out.select("score").collect())
    assert score(empty, labels).count() == 0
    none = labels.where("false")
    assert len({r.score for r in score(df, none).select("score").collect()}) == 1


def test_deobfuscation(spark):
    docs, df, labels, _ = labelled(spark)
    bad = ["gr0bbish sn@rkle", "s n a r k l e", "bl1ghter here", "snarrrrkle", "b.l.i.g.h.t.e.r", "sn4rkl3"]
    clean = ["kanari tovon 123", "a b 7", "mirila!! reteS"]
    test = spark.createDataFrame([(9000 + i, "kanan torin " + t) for i, t in enumerate(bad + clean)], "doc_id long, text string")
    got = {r.doc_id - 9000: r.predicted for r in toxicity.score(df.unionByName(test), labels).where("doc_id >= 9000").collect()}
    print([(b, got[i]) for i, b in enumerate(bad + clean)])
    assert sum(got[i] for i in range(len(bad))) >= len(bad) - 1 and not any(got[len(bad) + i] for i in range(len(clean)))
    kept = toxicity.clean(df.unionByName(test), labels)
    assert kept.columns == ["doc_id", "text"]


def test_deobfuscation_whole(spark):
    """Letters set apart in runs of any length, doubled letters, words between marks, long words."""
    docs, df, labels, _ = labelled(spark)
    bad = ["a s n a r k l e", "a b l i g h t e r o", "k a n s n a r k l e t o", "ssnnaarrkkllee", "snaarkle", "grubbiish", "gruubbiish", "bblliigghhtteerr"]
    bad += ["s" * 70 + "n@rkle", "z" * 70 + "snarkle", "kanan,snarkle", "kanan/sn4rkl3/torin", "-." * 40 + "sn@rkle", "kanan." * 20 + "bl1ghter"]
    clean = ["kkaannaarrii", "a k a n a r i", "kanan,torin", "t" * 70 + "orin", "kanan." * 20 + "torin"]
    test = spark.createDataFrame([(9000 + i, "kanan torin " + t) for i, t in enumerate(bad + clean)], "doc_id long, text string")
    got = {r.doc_id - 9000: r.predicted for r in toxicity.score(df.unionByName(test), labels).where("doc_id >= 9000").collect()}
    assert {t: got[i] for i, t in enumerate(bad + clean)} == dict.fromkeys(bad, 1) | dict.fromkeys(clean, 0)


def test_deobfuscation_readings():
    r = toxicity.Restorer(toxicity.language_model(np.ones(toxicity.SYMBOLS**3)))
    assert "idiot" in r.words("iiddiioott") and "stupid" in r.words("stuupid") and "asshole" in r.words("asshoolee")
    assert "idiot" in toxicity.spaced("a i d i o t".split()) and list(toxicity.spaced("a b cd e".split())) == []


def test_decoding_is_exhaustive():
    """The cheapest reading of short words among all paths through the lattice."""
    rnd = random.Random(8)
    counts = np.zeros(toxicity.SYMBOLS**3, dtype=np.int64)
    for w in WORDS * 3:
        s = [0, 0, *map(toxicity.symbol, w), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    costs = toxicity.language_model(counts)
    r, flat = toxicity.Restorer(costs), costs.reshape(-1).tolist()
    for _ in range(200):
        word = "".join(rnd.choice("kanrtovi013@$!..aa") for _ in range(rnd.randrange(1, 7)))
        best = {}
        for path in itertools.product(*r.lattice(word)):
            a = b = 0
            cost = 0.0
            for ch, extra in path:
                if ch:
                    s = toxicity.symbol(ch)
                    cost += extra + flat[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + s]
                    a, b = b, s
                else:
                    cost += extra + 2.0
            text = "".join(c for c, _ in path)
            cost += flat[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS]
            best[text] = min(best.get(text, math.inf), cost)
        least = min(best.values())
        got = r.decode(word, best=1)
        assert (not got and best[""] == pytest.approx(least)) or best[got[0]] == pytest.approx(least), word


def test_letters_set_apart():
    """Runs of single characters inside texts, whatever stands at the texts' edges."""
    texts = ["a b c word d e", " x y z", "q w", "", None, "p q r s\n", "t"]
    got = [(d, "".join(x)) for d, x in toxicity.apart(common.Words(imatch.pa.array(texts, imatch.pa.string())))]
    assert got == [(0, "abc"), (1, "xyz"), (5, "pqrs")]


def test_quality_vectors(spark):
    """Word vectors and pooling by plain sums over neighbours."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice([*WORDS[:12], "Kana,", "MIRI", "%%", "ka-na"]) for _ in range(rnd.randrange(0, 30))) for _ in range(40)] + [None, "", "\n"]
    vectors, n = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    slots, total, count = quality.Slots(), np.zeros((quality.SLOTS, quality.DIM)), np.zeros(quality.SLOTS)
    lists = [[x for w in (t or "").split() for x in slots[w] if x != quality.NONE] for t in texts]
    for s in lists:
        for i, x in enumerate(s):
            count[x] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(s):
                    for k in range(quality.NONZERO):
                        total[x, quality._POS[s[j], k]] += quality._SIGN[s[j], k]
            for k in range(quality.NONZERO):
                total[x, quality._POS[x, k]] += 2 * quality.REACH * quality._SIGN[x, k]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    want = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
    want -= (want * count[:, None]).sum(axis=0) / count.sum()
    assert (n == count).all() and np.allclose(vectors, want, atol=1e-6)
    weight = np.random.default_rng(0).random(quality.SLOTS).astype(np.float32)
    for s in lists:
        own = np.array(s, dtype=np.uint16)
        got = quality.pool(own, vectors, weight)
        if s:
            v = vectors[s].astype(float)
            plain = [v.mean(axis=0), (v * weight[s][:, None]).mean(axis=0), np.sqrt((v * v).mean(axis=0)), [math.log1p(len(s)), len(set(s)) / len(s)]]
            assert np.allclose(got, np.concatenate(plain), atol=1e-5)
        else:
            assert not got.any()


# 3


def test_decontam(spark, odd, empty):
    rnd = random.Random(2)
    items = [prose(rnd, 30) for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (None, "x y z"), (91, "too short"), (92, "")], "item_id long, text string")
    rows, want = [], set()
    for i in range(150):
        body = prose(rnd, 80).split()
        if i % 3 == 0:
            k = rnd.randrange(20)
            passage = items[k].split()
            for p in rnd.sample(range(30), 4 if i % 2 else 0):  # substitutions
                passage[p] = "zzz"
            at = rnd.randrange(len(body))
            body[at:at] = passage
            want.add((i, k))
        rows.append((i, " ".join(body).upper() if i % 5 == 0 else " ".join(body)))
    rows += [rows[0], (None, items[0]), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.overlaps(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == want and len(got) == len(pairs)
    kept = {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert kept == {i for i, _ in rows if i is not None and i not in {d for d, _ in want}}  # None holds an item whole
    assert decontam.overlaps(empty, bench).count() == 0 and decontam.overlaps(odd, bench.where("false")).count() == 0
    assert decontam.clean(odd, bench).columns == odd.columns


def test_decontam_clashing_ids(spark):
    """Items that share an id, and documents that share one, are judged by their own texts."""
    rnd = random.Random(3)
    x, y, z = (prose(rnd, 30) for _ in range(3))
    bench = spark.createDataFrame([(1, x), (1, y), (2, z), (2, z)], "item_id long, text string")
    far = [prose(rnd, 60) for _ in range(3)]
    rows = [(10, x), (11, y), (12, far[0]), (12, far[1] + " " + z), (None, "a b c " + y), (None, far[2]), (13, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()) == [(10, 1), (11, 1), (12, 2)]
    assert sorted((r.doc_id or 0, r.text or "") for r in decontam.clean(docs, bench).collect()) == sorted([(12, far[0]), (0, far[2]), (13, "")])


def test_decontam_all_windows(spark):
    """Against every placement of every item on every document: each word at each shift."""
    rnd = random.Random(21)
    items = [prose(rnd, rnd.randrange(5, 70)).split() for _ in range(12)]
    rows = []
    for i in range(60):
        body = prose(rnd, rnd.randrange(1, 90)).split()
        it = list(rnd.choice(items))
        a = rnd.randrange(len(it))
        part = it[a : a + rnd.randrange(1, len(it) + 1)]
        for p in rnd.sample(range(len(part)), len(part) // rnd.choice([6, 12, 100])):
            part[p] = "other"
        at = rnd.randrange(len(body) + 1)
        body[at:at] = part
        rows.append((i, " ".join(body)))
    terms = imatch.Terms()
    number = lambda ws: np.array([terms[w] for w in ws], dtype=np.uint64)
    must, may = set(), set()
    for i, text in rows:
        x = number(text.split())
        for k, it in enumerate(items):
            y = number(it)
            got = [v for d in range(-len(y), len(x)) if (v := decontam.verify(x, y, d))]
            if got:
                may.add((i, k))
                if any(v[2] == v[1] for v in got):  # without replaced words every mask hits
                    must.add((i, k))
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(it)) for k, it in enumerate(items)], "item_id long, text string")).collect()}
    assert must and must <= got <= may and len(got) >= 0.95 * len(may)


# 4


def test_warc(spark, tmp_path, empty):
    m = "WARC/1.1\r\n"
    html = ["a", "a", None, "", m + "x", m + m, m + "Content-Length: 3\r\n\r\nabc\r\n\r\n" + m + "Content-Length: 2\r\n\r\nab\r\n\r\ntail", "é" * 500 + m + "q" * 900, m[:6], "x\r\n\r\n", ("z" * 700 + m) * 15 + "end"]
    rows = [(i + 20 * k, "u", h if k == 0 or h is None else h + str(k) * (k * 7), 1) for k in range(12) for i, h in enumerate(html)]
    df = spark.createDataFrame(rows + [(None, None, "without id", 1), (rows[0][0], "u", "a", 1)], "page_id long, url string, html string, digest int").repartition(3)
    pages = {i: h or "" for i, _, h, _ in rows}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for k, size in enumerate(("128m", "3k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        path = str(tmp_path / f"w{k}")
        warc.write_archives(df, path)
        got = warc.read_archives(spark, path).collect()
        assert len(got) == len(rows) + 2
        for r in got:
            if r.page_id is None:
                assert r.payload_bytes == 10 and r.kind == "response"
                continue
            raw = pages[r.page_id].encode()
            assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert (r.kind, r.refers_to) == (("response", None) if first[pages[r.page_id]] == r.page_id else ("revisit", first[pages[r.page_id]]))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    none = str(tmp_path / "none")
    warc.write_archives(df.where("false"), none)
    assert warc.read_archives(spark, none).count() == 0


# 6


@pytest.mark.parametrize("bits", [128, 3])
def test_linedup(odd, odd_rows, empty, bits):
    """Each chunk but for its first occurrence, by its bytes; with three bits, hashes clash."""
    where = collections.defaultdict(set)
    place = {(r[0], r[1]): (r.k1, r.k2) for r in common.doc_key(odd.select("doc_id", "text")).collect()}
    for r in odd_rows:
        lines = (r[1] or "").split("\n")
        for a, z in linedup.chunks(r[1] or ""):
            where["\n".join(lines[a:z])].add((*place[(r[0], r[1])], a))
    want = collections.Counter()
    for r in odd_rows:
        text, gone = r[1], set()
        if text:
            lines = text.split("\n")
            for a, z in linedup.chunks(text):
                if (*place[(r[0], r[1])], a) != min(where["\n".join(lines[a:z])]):
                    gone |= set(range(a, z))
            text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want[(r[0], text, len(gone))] += 1
    out = linedup.dedup(odd, bits)
    got = out.collect()
    assert collections.Counter((r.doc_id, r.text, r.n_removed) for r in got) == want and sum(r.n_removed for r in got) > 0
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert linedup.dedup(empty).count() == 0 and set(odd.columns) <= set(out.columns)


def test_linedup_chunks_move_with_lines():
    """Chunks are of the lines' own making: what stands before a passage moves no boundary beyond its first line."""
    rnd = random.Random(3)
    shared = [prose(rnd, 6) for _ in range(200)]
    before = [prose(rnd, 6) for _ in range(7)]
    inside = {(a - 7, z - 7) for a, z in linedup.large_chunks(before + shared) if a > 7}
    own = {(a, z) for a, z in linedup.large_chunks(shared) if a > 1}
    assert len(own) > 20 and len(own ^ inside) <= 1


def test_linedup_shift(spark):
    rnd = random.Random(1)
    shared = [prose(rnd, 8) for _ in range(60)]
    a = "\n".join(shared)
    b = "\n".join([prose(rnd, 5), *shared, prose(rnd, 4)])
    got = {r.doc_id: r for r in linedup.dedup(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 40


@pytest.mark.parametrize("words", [10, 3])
def test_linedup_passages(spark, words):
    """Passages of 1 to 8 lines between foreign lines go whole, wherever they stand; foreign lines stay."""
    rnd = random.Random(6)
    rows, want = [], {}
    for n in range(1 if words > 8 else 2, 9):
        for j in range(6):
            passage = [f"passage {n} {j} {i} " + prose(rnd, words - 3) if words > 3 else f"p{n}{j}{i} {prose(rnd, 2)}" for i in range(n)]
            for copy in range(3):
                around = [f"foreign {n} {j} {copy} {i} " + prose(rnd, rnd.randrange(1, 9)) for i in range(9)]
                at = rnd.randrange(1, 8)
                i = len(rows)
                rows.append((i, "\n".join([*around[:at], *passage, *around[at:]])))
                want[i] = "\n".join(around) if copy else rows[-1][1]
    got = {r.doc_id: r for r in linedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: r.text for i, r in got.items()} == want


def test_linedup_blank_lines(spark):
    a = "a line of its own\n\n\nand another one\n" + "x" * 50 + "\n\n" + "y" * 50
    got = {r.doc_id: r for r in linedup.dedup(spark.createDataFrame([(1, a), (2, "foreign\n" + a + "\nforeign too")], "doc_id long, text string")).collect()}
    assert got[1].text == a and got[2].text == "foreign\nforeign too" and got[2].n_removed == 7


# 7


def brute_links(rows, threshold=0.8):
    terms = imatch.Terms()
    sets = []
    for r in rows:
        h = np.array([x for w in (r[1] or "").split() if (x := terms[w])], dtype=np.uint64)
        s = set(cpjoin.shingles(h).tolist())
        sets.append(s or {("text", r[1] or "")})
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return collections.Counter((rows[i][0], least.get(find(i)), links[i]) for i in range(n))


@pytest.mark.parametrize("bucket", [256, 3])
def test_cpjoin(spark, odd_rows, empty, bucket, monkeypatch):
    monkeypatch.setattr(cpjoin, "BUCKET", bucket)
    monkeypatch.setattr(cpjoin, "TILE", bucket)
    rnd = random.Random(6)
    base = prose(rnd, 150).split()
    rows = list(odd_rows)
    for i in range(25):
        w = list(base)
        for p in rnd.sample(range(150), i % 4):
            w[p] = f"new{i}"
        rows.append(doc(1000 + i, " ".join(w)))
    got = cpjoin.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows)
    assert cpjoin.join(empty).count() == 0


def test_cpjoin_large_groups(spark, monkeypatch):
    """Of sets in large groups a few rows each are made, whatever number of buckets they share; no link is lost, also
    between groups that overlap."""
    monkeypatch.setattr(cpjoin, "BUCKET", 8)
    monkeypatch.setattr(cpjoin, "TILE", 16)
    made, write = {}, common.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    rnd = random.Random(11)
    base, long, other = prose(rnd, 150).split(), prose(rnd, 400).split(), prose(rnd, 150).split()
    rows = []
    for i in range(90):
        w = list(base)
        for p in rnd.sample(range(150), i % 4):
            w[p] = f"new{i}"
        rows.append(doc(i, " ".join(w)))
    near = len({r[1] for r in rows})
    monkeypatch.setattr(common, "materialize", counted)
    got = cpjoin.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows)
    assert made.get("deeper", 0) <= 8 * near and made["units"] <= 3 * near * -(-near // 16)
    rows += [doc(200 + i, " ".join(long[3 * i : 3 * i + 150])) for i in range(60)]  # each like its neighbours only
    rows += [doc(300 + i, " ".join(other[:60] + [f"own{i}x{j}" for j in range(100)])) for i in range(40)]  # a passage in common
    got = cpjoin.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows)


@pytest.mark.parametrize("depth", [cpjoin.DEPTH, cpjoin.DEEPEST])
def test_cpjoin_recall(depth):
    assert cpjoin.runs_needed(target=0.99) < cpjoin.runs_needed(target=0.9999)
    rnd = np.random.default_rng(0)
    found = 0
    for _ in range(200):  # pairs just above the threshold
        a = rnd.integers(0, 2**63, 180).astype(np.uint64)
        b = np.concatenate([a[:160], rnd.integers(0, 2**63, 20).astype(np.uint64)])
        paths = [set(cpjoin.paths_of(np.sort(s), cpjoin.runs_needed(), 0.8, depth).tolist()) for s in (a, b)]
        found += bool(paths[0] & paths[1])
    assert found >= 197


def test_representatives_of_clashing_rows(spark):
    """Rows of one doc_id with different texts are told apart; of equal rows one stays."""
    rnd = random.Random(4)
    a, b, c = prose(rnd, 40), prose(rnd, 40), prose(rnd, 40)
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (None, a, 4), (None, c, 5), (None, c, 5), (6, None, 7), (7, "", 8), (8, b + " more", 9), (3, a, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in cpjoin.representatives(df).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (-1, c), (6, None)], key=str)
    assert cpjoin.representatives(df).columns == df.columns and cpjoin.representatives(df.where("false")).count() == 0


# 8


def brute_repeats(texts, length=400):
    raws = [t.encode() for t in texts]
    count = collections.Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = collections.Counter()
    for r in raws:
        cut = np.zeros(len(r), bool)
        for s in range(len(r) - length + 1):
            if count[r[s : s + length]] > 1:
                cut[s : s + length] = True
        starts = np.diff(np.concatenate([[0], cut.astype(int)])) == 1
        out[(len(r), int(cut.sum()), int(starts.sum()), sha(bytes(np.frombuffer(r, np.uint8)[~cut])))] += 1
    return out


@pytest.mark.parametrize(("hot", "heavy"), [(1500, 4096), (2, 4096), (3, 2)])
def test_suffix(spark, odd_rows, empty, hot, heavy, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "HEAVY", heavy)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0 if hot == 2 else common.BROADCAST_BYTES)
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abc \n é") for _ in range(900)) for _ in range(3)]
    texts = [r[1] or "" for r in odd_rows if len(r[1] or "") < 20_000]
    for i in range(60):
        x = rnd.choice(base)
        texts.append([x, x[100:600] + "zz" + x[300:], "q" * rnd.randrange(380, 900), x[: rnd.randrange(395, 410)] + str(i), ("abcd" * 200)[: rnd.randrange(100, 800)], str(i) + x[50:500] + rnd.choice(base)[200:650]][rnd.randrange(6)])
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffix.dedup(docs).collect()
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got) == brute_repeats(texts)
    assert suffix.dedup(empty).count() == 0


def test_suffix_long_texts(spark):
    """Texts of several pieces, with repeats across the pieces' edges."""
    rnd = random.Random(5)
    own = "".join(rnd.choice("abcdefgh ") for _ in range(2_300_000))
    edge = suffix.PIECE - 350
    texts = [own, "other|" + own[edge : edge + 900] + "|tail", own[2_000_000:2_000_399], own[5000:5400] + "|" + own[5001:5401]]
    got = {r.doc_id: r for r in suffix.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans) for i in range(4)] == [(len(own), 1301, 2), (911, 900, 1), (399, 0, 0), (801, 800, 2)]
    assert bytes(got[1].kept) == b"other||tail" and bytes(got[0].kept).decode() == own[:5000] + own[5401:edge] + own[edge + 900 :]


def test_suffix_sort():
    rnd = random.Random(8)
    for _ in range(100):
        s = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(30))) for _ in range(20)]
        s += [rnd.choice(s) + bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(60))) for _ in range(8)]
        for shallow in (0, 8, 16):
            assert [s[i] for i in suffix.deep_shallow(s, 0, shallow)] == sorted(s)


def test_suffix_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1000)
    rnd = random.Random(5)
    x = prose(rnd, 700)
    texts = [x, x[500:3000], prose(rnd, 500)]
    raws = [t.encode() for t in texts]
    assert [p for r in raws for p in suffix.pieces(r)][0][1] == raws[0][:1399]


# 9


def test_bpe(odd, odd_rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    got = bpe.encode(odd, VOCAB, lexicon_words=200)
    want = collections.Counter()
    for r in odd_rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got.collect()) == want
    assert {"score", "row", "part"} <= set(got.columns)
    assert bpe.encode(empty, VOCAB).count() == 0


def test_bpe_random_texts():
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(VOCAB), bpe.Vocabulary(VOCAB)
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: v.merge(w) for w in (b" the", b" of", b"in", b" in", b" ing", b" thing", b"ing")}))
    assert lexicon.get(b" thi") is None and lexicon.get(b" things") is None and lexicon.get(b" the") == struct.pack("<I", v.merge(b" the")[0])
    e, rnd = bpe.Encoder(v, lexicon), random.Random(1)
    parts = [*"ab'st re  \n\t\r  12é中ß!?.,:;\x1c\x1d\x85 　​Ⅷ²", "<|endoftext|>", "'ll", "\U0001f600", "é", " the", " thing"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(s), "<u4").tolist() == ids and e.decode(e.encode(s)) == t.decode(ids, skip_special_tokens=False)


def test_lexicon_shares_suffixes():
    words = {w.encode(): [i] for i, w in enumerate(sorted({a + b for a in WORDS for b in ("ing", "ed", "s")}))}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert all(lexicon.get(w) == struct.pack("<I", i[0]) for w, i in words.items())
    assert len(lexicon.final) < sum(map(len, words)) / 10


# 10


def test_minimax_is_least():
    rnd = random.Random(7)
    for _ in range(60):
        sizes, k = [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 12))], rnd.randrange(1, 5)
        capacity, cuts = sharding.minimax_cuts(np.array(sizes), k)

        def least(at, left):
            if left == 1:
                return sum(sizes[at:])
            return min((max(sum(sizes[at:e]), least(e, left - 1)) for e in range(at, len(sizes) + 1)), default=0)

        assert capacity == least(0, k) and len(cuts) == k
        ways = [list(zip((0, *c), (*c, len(sizes)))) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1)]
        size = lambda w: [sum(sizes[a:b]) for a, b in w]
        others = lambda w: max((sum(sizes[a:b]) for a, b in w if b - a > 1), default=0)
        ways = [w for w in ways if max(size(w)) <= capacity]
        even = min(map(others, ways))
        own = list(zip(cuts, [*cuts[1:], len(sizes)]))
        assert cuts[0] == 0 and max(size(own)) == capacity and others(own) <= even
        assert min(size(own)) == max(min(size(w)) for w in ways if others(w) <= even)


def test_shards_near_equal(spark):
    """Sizes are near equal; beside a text with a third of all bytes the others share the rest evenly."""
    rows = [(i, "x" * (200 + i % 50)) for i in range(4000)]
    for hot in (0, 2000):
        df = spark.createDataFrame([(i, f"{i} {t}") for i, t in rows] + [(10_000 + i, "h" * 224) for i in range(hot)], "doc_id long, text string")
        sizes = collections.Counter()
        for r in sharding.partition(df).collect():
            sizes[r.shard] += r["size"]
        rest = sorted(sizes.values())[: 15 if hot else 16]
        assert len(sizes) == 16 and min(rest) > (0.9 if hot else 0.95) * max(rest)


def test_sharding(odd, odd_rows, empty):
    got = sharding.partition(odd, shards=4).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    shards, place = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        shards[r.shard].append(r.slot)
        place[(r["size"], r.text_crc32)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(p) == 1 for p in place.values())
    assert sharding.partition(empty).count() == 0


# all


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(12)
    docs, _, labels, raw = labelled(spark)
    bench = [prose(rnd, 25) for _ in range(5)]
    toxic = {i for i, _, t in raw if t}
    rows = [doc(i, t) for i, t in docs]
    rows.append(doc(700, prose(rnd, 40) + " " + bench[2] + " " + prose(rnd, 40)))
    near = prose(rnd, 120)
    rows += [doc(701, near), doc(702, near + " end"), doc(703, near)]
    lines = "\n".join(prose(rnd, 9) for _ in range(40))
    rows += [doc(704, lines), doc(705, prose(rnd, 50) + "\n" + lines + "\n" + prose(rnd, 60)), doc(706, None), doc(707, "")]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe"]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert 700 not in out and 701 in out and 702 not in out
    assert len(toxic & set(out)) <= 0.1 * len(toxic)
    clean = {i for i, _ in docs} - toxic
    assert len(clean & set(out)) >= 0.97 * len(clean)
    assert len(out[705].text) < 0.6 * len(rows[-3][1]) and out[704].text == lines
    # a copy loses its lines; of the texts without words the first stays
    assert out[703].text == "" and 706 not in out and 707 not in out
    for r in list(out.values())[:50]:
        assert r.n_tokens == len(r.ids) // 4 and r.decoded_sha256 == sha((r.text or "").encode())


def test_pipeline_odd_tables(spark, tmp_path, odd, odd_rows, empty):
    """Null ids and texts, repeated rows, extra columns; an empty table."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, 1, i % 5 // 4) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, odd_rows[3][1]), (1, odd_rows[5][1]), (None, "x"), (2, None)], "item_id long, text string")
    more = lambda df: df.selectExpr("*", "1 as n_lines", "'x' as n_removed", "2 as ids", "3 as n_tokens", "'y' as ids_sha256", "4 as _text", "5 as cut")
    for k, df in enumerate((more(odd), more(empty))):
        d = str(tmp_path / str(k))
        df.write.parquet(f"{d}/documents.parquet"), labels.write.parquet(f"{d}/labels.parquet"), bench.write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        assert set(df.columns) <= set(out.columns) | {"decoded"} and len(set(out.columns)) == len(out.columns)
        assert out.where("n_lines <> 1 or n_removed <> 'x' or cut <> 5").count() == 0
        rows = out.collect()
        if k:
            assert not rows
        else:
            ids = [r.doc_id for r in rows]
            assert len(rows) > 20 and ids.count(46) == 1 and 3 not in ids and 5 not in ids
            assert sum(not (r.text or "").strip("!? ") for r in rows) <= 4


def test_materialize(spark):
    df = spark.createDataFrame([(1, 2.0)], "a long, b double")
    assert [tuple(r) for r in common.materialize(df, "x").collect()] == [(1, 2.0)]
    many = spark.createDataFrame([(i,) for i in range(1, 2000)], "n long")
    assert 0 < common.highest(many, "n", 300, "t").count() <= 300
