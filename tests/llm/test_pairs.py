"""Operators 11 to 13 against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkledger.llm import common, negatives, queries, simhash, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 11


def plain_negatives(rows, every=100, moved=7, k=5, n=10, least=30, most=90):
    """rows: (id, label, vector); one row an id."""
    own = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i % moved == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for a, la, va in own:
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in own if i != a)  # zip: what is missing is zero
        for p, pid, _ in [x for x in s if x[2] == la][:k]:
            fit = [x for x in s if x[2] != la and least * -p <= 100 * -x[0] <= most * -p][:n]
            out += [(a, pid, r + 1, i, -p, -x) for r, (x, i, _) in enumerate(fit)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label) for i, label, v in rows], VECTORS)


def test_op11_equals_brute_force(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = rows_of(queries.op11_hard_negatives(spark, SF))
    assert got == plain_negatives(rows) != []


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_op11_of_clusters_of_all_lengths(spark, spread, monkeypatch):
    """Close clusters, where lists prune, over many buckets and several blocks."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    rows = [(i, int(rng.integers(3)), [float(np.float32(x)) for x in (base[i % 6] + spread * rng.normal(size=16)) * rng.lognormal(0, 1)]) for i in range(900)]
    monkeypatch.setattr(negatives, "ANCHORS", 40)
    seen = []
    plain = negatives.Search.candidates

    def counted(self, who, need, m, lists):
        for c in plain(self, who, need, m, lists):
            seen.append(None if c is None else len(c) / len(m))
            yield c

    got = rows_of(negatives.hard_negatives(vectors(spark, rows).repartition(6), every=9))
    assert got == plain_negatives(rows, every=9)
    # the same buckets, here, to see what the lists prune
    m = np.floor(256 * np.array([v for _, _, v in rows]))
    by = np.argsort(-negatives.squares(m))
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    low = np.full((100, 1), -(1 << 60))
    find = negatives.Search(ids[:100], labels[:100], m[:100], low, -low, 5, True)
    monkeypatch.setattr(negatives.Search, "candidates", counted)
    for part in np.array_split(by, 12):
        own, entries = m[part], np.array(list(zip(ids[part], labels[part], strict=True)), negatives.ENTRY)
        find.bucket(float(np.sqrt(negatives.squares(own).max())), entries, own, np.argsort(negatives.directions(own), axis=0, kind="stable").T)
    assert spread > 0.1 or sum(x is not None and x < 0.5 for x in seen) > 5


def test_op11_hostile_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [0.0, 0.0]), (3, 1, []), (4, 2, [0.5]), (5, 2, [0.5, 0.5, 9.0]), (7, 1, [0.5, 0.25]), (8, None, [1.0]), (None, 1, [1.0, 1.0]), (9, 2, None), (10, 2, [None, 1.0]), (11, 1, [nan, 1.0]), (12, 2, [-inf, 1.0]), (100, 9, [0.25, 0.25]), (200, 2, [-0.3, 0.1]), (14, 9, [0.5, 0.25])]
    rows += [(i, 3, [0.5, 0.25]) for i in range(21, 41)]  # ties
    want = plain_negatives(rows)
    assert rows_of(negatives.hard_negatives(vectors(spark, rows))) == want != []
    clash = vectors(spark, rows).withColumns({c: F.lit("x") for c in ("id", "v", "n", "slot", "score", "anchor", "rank", "rows", "block", "size")})
    assert rows_of(negatives.hard_negatives(clash)) == want
    twice = vectors(spark, rows + [(0, 1, [9.0, 9.0]), (0, 1, [1.0, 0.5]), (4, 2, [0.5])])
    assert rows_of(negatives.hard_negatives(twice)) == want  # the least row of an id stays
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(1, 1, [1.0])])).count() == 0


def test_op11_large_components(spark):
    rows = [(0, 0, [3e5, 1.0]), (1, 1, [3e5, 2.0]), (2, 2, [1.5e5, 3.0]), (3, 2, [2e5, 4.0])]  # beyond what doubles add up exactly
    assert rows_of(negatives.hard_negatives(spark.createDataFrame([(i, v, x) for i, x, v in rows], "vec_id long, embedding array<double>, label int"))) == plain_negatives(rows) != []
    with pytest.raises(Exception, match="beyond 2\\^62"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e9, 1.0], 1), (1, [1e9, 1.0], 1)], "vec_id long, embedding array<double>, label int")).count()


# 12


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, most=3):
    """ids, fps: lists; the smallest id of each row's component."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps_ = np.array(fps, np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps_[k + 1 :] ^ fps_[k]) <= most) + k + 1:
            a, b = find(ids[k]), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op12_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in common.documents(spark, SF).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(list(fps), list(fps.values()))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op12_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(set(want.values())) < len(want)


def spread_fingerprints(n, seed):
    """Random ones, chains a few bits apart, and a dense ball."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        out.append(x)
    ball = rng.getrandbits(64)
    out += [ball ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)]
    return sorted(set(out) | {0, (1 << 64) - 1, 1 << 63})


@pytest.mark.parametrize("large", [1 << 17, 3])
@pytest.mark.parametrize("most", [0, 1, 3])
def test_op12_trie_join_finds_all(spark, large, most):
    """All components of fingerprints, also where Spark goes deeper into nodes of over three."""
    fps = spread_fingerprints(150 if large < 100 else 600, most)
    common.ship(spark)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(rows, most, large).collect()]
    want = plain_components(fps, fps, most)
    assert all(want[a] == want[b] for a, b in links)
    label = {x: x for x in fps}
    for a, b in sorted(links):  # joined outright
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {k: new if v == old else v for k, v in label.items()}
    assert label == want
    if large < 100 and most:
        member = rows.selectExpr("fp", "0 AS turn").withColumn("key", F.col("fp"))
        assert simhash.node_pairs(member, most, large).agg(F.max("depth")).first()[0] > 16


@given(st.lists(st.integers(0, (1 << 20) - 1), min_size=1, max_size=60, unique=True), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_op12_walk(low, most):
    """One node of fingerprints that share their first 16 bits and differ in the rest: what its schedule of errors allows is joined, no more than is linked."""
    keys = np.sort(np.array([x << 14 for x in low], np.uint64))
    at = np.array([0])
    label = simhash.walk(keys, (at, at + len(keys), at, at + len(keys), at * 0), 16, most, np.arange(len(keys)))
    want = plain_components(list(range(len(keys))), keys.tolist(), most)
    assert all(want[i] == want[int(x)] for i, x in enumerate(label))
    for i in range(len(keys)):
        for j in range(i):
            x = int(keys[i]) ^ int(keys[j])
            if all((x >> (48 - 16 * k)).bit_count() <= most * (k + 1) // 4 for k in range(4)):
                assert label[i] == label[j]


def test_op12_long_texts_and_cut_lists(monkeypatch):
    texts = ["a", "", "One two\tTHREE\x0bfour é\x85x", "w " * 5000, "x y z"]
    want = [plain_fingerprint(t) for t in texts]
    assert simhash.majority([simhash.hashes(t.encode(), 3, 42) for t in texts]).tolist() == want
    monkeypatch.setattr(simhash.cut_lists, "__defaults__", (7,))
    assert simhash.majority([simhash.hashes(t.encode(), 3, 42) for t in texts]).tolist() == want


def test_op12_hostile_rows(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(1, a), (1, b), (2, b), (3, None), (4, ""), (5, " \n"), (None, a), (None, None), (6, a), (6, a)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = rows_of(simhash.near_duplicates(docs))
    fp = lambda t: f"{plain_fingerprint(t):016x}"
    root = {1: 1, 2: 1, 6: 1, 3: 3, 4: 3, 5: 3, None: None}
    assert got == sorted([(i, fp(t), root[i]) for i, t in rows], key=repr)
    assert rows_of(simhash.near_duplicates(docs.withColumns({c: F.lit("x") for c in ("id", "fp", "turn", "key", "p", "root", "component_id")}))) == got
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="bits"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


# 13


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(rows, least=7, often=2, times=10, every=31):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.encode().lower().decode()
            if i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= often}
    by = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by[w[:k] + "\n" + w[k + 1 :]].add(w)
            by[w[:k] + w[k + 1 :]].add(w)
        by[w].add(w)
    near = defaultdict(set)
    for group in by.values():
        for w in group:
            near[w] |= {v for v in group if one_edit(w, v)}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        if top is not None and n[top] >= times * n[w]:
            form[w] = top
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def test_op13_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.documents(spark, SF).collect()]
    got = rows_of(queries.op13_spelling_variants(spark, SF))
    assert got == plain_variants(rows) and any(r[1] for r in got)


@pytest.mark.parametrize("most", [0, 3, 256])
def test_op13_of_crowded_words(spark, most):
    """Words that share halves, with all kinds of edits; keys are cut to the last letter, to a few pairs, and hardly."""
    rng = random.Random(most)
    base = ["abcdefgh", "aaaaaaaa", "interest", "ÿÀé×÷abc", "ababababababa"]
    words = set(base)
    for _ in range(400):
        w = list(rng.choice(base if rng.random() < 0.7 else sorted(words)))
        for _ in range(1):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choices("abcdeé÷", k=rng.randint(0, 2))
        words.add("".join(w))
    rows = [(i, w.upper().lower() and " ".join([w] * rng.choice([1, 2, 3, 30, 400]))) for i, w in enumerate(sorted(words))]
    rows += [(900, "Capital CAPITAL capital capitÀl capitàl"), (901, "x" * 5000), (902, "x" * 5000), (903, "x" * 5001), (904, "x" * 5001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(spelling.variants(docs, most=most))
    assert got == plain_variants(rows)
    assert len([r for r in got if r[4] > 3]) > 30 and any(r[2] != r[1] for r in got if r[1])


def test_op13_hostile_rows(spark):
    rows = [(1, None), (2, ""), (3, "1 2 3"), (None, "Nameless nameless namelesss namelesss"), (4, "nameless " * 40), (4, "nameless " * 40), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_variants(rows)
    assert rows_of(spelling.variants(docs)) == want and len(want) >= 2
    assert rows_of(spelling.variants(docs.withColumns({c: F.lit("x") for c in ("id", "word", "n", "key", "a", "b", "short", "gap", "long", "hot", "form", "root")}))) == want
    assert spelling.variants(docs.limit(0)).count() == 0


def test_op13_hands_on_its_counts(spark, monkeypatch):
    """Counts given out in parts are added up."""
    import pyarrow as pa

    monkeypatch.setattr(spelling, "HELD", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4], pa.int64()), pa.array([b"wordone wordtwo wordthree", b"wordone wordone", None, b"wordtwo"])], names=["id", "text"])
    out = [b.to_pydict() for b in spelling._words(iter([batch]), 7, 1 << 40)]
    n = Counter()
    for b in out:
        for w, k in zip(b["word"], b["n"], strict=True):
            n[w] += k
    assert len(out) == 2 and n == {"wordone": 3, "wordtwo": 2, "wordthree": 1}
