import collections
import hashlib
import json
import pathlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkledger.llm import common, langid, license_texts, licenses, media, minhash, packing, quality, sampling, suffix_dedup, token_store, warc
from sparkledger.llm.tokens import END_ID, Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(5)
WORDS = ["".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(rnd.randint(2, 9))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(rnd.choice(WORDS) + ("." if rnd.random() < 0.1 else "") for _ in range(n)) + "."


def odd_docs() -> list[tuple]:
    """Nulls, empty and long texts, repeats, near copies, shared passages, odd white space."""
    base, shared = prose(300), prose(70)
    rows = [None, "", " ", "\n\n", "a", "one two three", "one two three four five", "one  two\n three", "é ▁ x　y \x00 z\U0001f600"]
    rows += [base, base, base + " more words here", "start now " + base, prose(120) + " " + shared + " " + prose(90), shared, "x " + shared + " y", "z" * 450, "ab" * 300, prose(6000), "<|endoftext|> end", prose(40) + "\n" + "menu | home | about\n" + prose(30)]
    words = base.split(" ")
    for k in range(40):  # a chain of edits
        words[k * 7] = f"w{k}"
        rows.append(" ".join(words))
    return [(i, t, "en", "s", None) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(odd_docs(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


ENC = Encoder()


@given(st.text(alphabet=st.sampled_from(" \n\t　\x85\x1cabE'sé1½_-.!#▁中😀"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_words_equal_the_library(text):
    texts = [text, None, "und so weiter, " + text, text + text]
    ids, bounds = ENC.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [ids_of(t or "").tolist() for t in texts]


def test_other_pre_tokens_are_left_to_the_library(tmp_path):
    from sparkledger.llm.tokens import vocabulary

    asks = json.loads(pathlib.Path(vocabulary()).read_text())
    asks["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(asks))
    other = Encoder(str(tmp_path / "other.json"))
    assert ENC.by_words and not other.by_words
    ids, bounds = other.encode(pa.array(["one two", None, ""]))
    assert ids.tolist() == [*ENC.whole(" one two").tolist(), END_ID, END_ID, END_ID] and bounds.tolist() == [0, 3, 4, 5]


def test_runs_of_texts():
    texts = [None, prose(50), "", prose(3000), prose(5), " x"]
    got = [ids[x:y].tolist() for _, _, ids, bounds in ENC.runs(pa.array(texts), most=400) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [ids_of(t or "").tolist() for t in texts]
    assert list(ENC.runs(pa.array([], pa.string()))) == []


def ids_of(text: str) -> np.ndarray:
    return np.append(np.array(ENC.library.encode(text, add_special_tokens=False).ids, "<u4"), np.uint32(END_ID))


# 1


def test_sampling_is_lossless_and_reproducible(spark, docs, rows):
    one = {r["doc_id"]: r["piece_ids"] for r in sampling.encode(docs).collect()}
    two = {r["doc_id"]: r["piece_ids"] for r in sampling.encode(docs.repartition(7)).collect()}
    assert one == two and one[0] is None and one[1] == []
    assert one != {r["doc_id"]: r["piece_ids"] for r in sampling.encode(docs, seed=2).collect()}
    back = {r["doc_id"]: r["text"] for r in sampling.decode_column(sampling.encode(docs)).collect()}
    assert {k: v or "" for k, v in back.items()} == rows and back[0] is None
    crc = {r["doc_id"]: r["decoded_crc32"] for r in sampling.encode(docs, digest=True).collect()}
    assert all(crc[i] == zlib.crc32(t.encode()) for i, t in rows.items() if i)


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_any_text_decodes_to_itself(text):
    v = sampling.pieces(None, 1.0, 1e-5)
    text = text.encode(errors="ignore").decode()
    assert sampling.decode(v, sampling.sample(v, [text], np.array([3], np.uint64))[0]) == text


def test_draws_follow_the_lattice():
    """Shares of the segmentations of a word against the product of their weights, by listing all."""
    v = sampling.pieces(None, 1.0, 1e-5)
    word = " other"
    weight = {i: float(np.exp(w)) for i, w in zip(v.id.tolist(), v.log_weight.tolist(), strict=True)}
    by_text = {v.raw[i].decode(): i for i in v.id.tolist()}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in by_text:
                for rest in ways(s[k:]):
                    yield (by_text[s[:k]], *rest)

    want = {w: float(np.prod([weight[i] for i in w])) for w in ways(word)}
    total = sum(want.values())
    n = 20000
    got = collections.Counter(tuple(x.tolist()) for x in sampling.sample(v, [word] * n, common.mix(np.arange(n, dtype=np.uint64))))
    assert set(got) <= set(want)
    for w, p in want.items():
        assert abs(got[w] / n - p / total) < 5 * (p / total / n) ** 0.5 + 1e-3


# 2


def test_packing(docs, rows):
    got = packing.pack(docs).toPandas()
    for i, part in got.groupby("doc_id"):
        ids, part = ids_of(rows[i]), part.sort_values("piece")
        assert part["piece"].tolist() == list(range(len(part))) and part["length"].sum() == len(ids)
        assert (part["length"].iloc[1:] == 1024).all() and part["start"].tolist() == np.cumsum([0, *part["length"][:-1]]).tolist()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(part["start"], part["length"], strict=True)] == part["ids_crc32"].tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == np.cumsum([0, *s["length"][:-1]]).tolist() and s["length"].sum() <= 1024
    assert set(got["doc_id"]) == set(rows)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_equals_best_fit_document_by_document(counts):
    slots = packing.plan(counts, 30)
    rooms = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(30 - n)
    used = collections.defaultdict(list)
    for length, _, k, first, each, offset in slots:
        for j in range(k):
            used[first + j // each].append((offset + j % each * length, length))
    assert len(used) == len(rooms)
    assert sorted(n for s in used.values() for _, n in s) == sorted(n for n, c in counts.items() for _ in range(c))
    for s in used.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s[:-1], s[1:], strict=True)) and s[0][0] == 0 and sum(s[-1]) <= 30


# 3


def exact_components(rows):
    sets = {}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in rows:
        for j in rows:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in rows}


def test_near_duplicates(docs, rows):
    want = exact_components(rows)
    for block in (512, 4):  # small blocks: step 3 over pairs of blocks
        minhash.BLOCK, before = block, minhash.BLOCK
        try:
            got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
        finally:
            minhash.BLOCK = before
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
        assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def block_of(found, head=None, block=None):
    import pandas as pd

    head = head or minhash.SKETCH
    heads = [s[: max(head, minhash.prefix(len(s), 75) + 1)].tobytes() for s in found]
    return pd.DataFrame({"id": range(len(found)), "comp": range(len(found)), "block": block if block is not None else 0, "head": heads, "n": [len(s) for s in found]})


def test_blocks_join_components():
    from sparkledger.llm.shingles import sets

    found = sets([t for _, t, *_ in odd_docs()[-40:]])
    links = minhash._near((1, 0, 0), block_of(found), 75)
    assert len(links) <= 39
    assert all(minhash.similar(found[a], found[b], 75) for a, b in links.to_numpy())


@pytest.mark.parametrize("head", [1024, 8])
@pytest.mark.parametrize("seed", range(4))
def test_blocks_lose_no_link(head, seed, monkeypatch):
    """Sets around the threshold, a third of them exactly at it: the links of one block, and of two, join what similar sets join.

    With heads of 8 hashes most sets are larger than their heads."""
    monkeypatch.setattr(minhash, "SKETCH", head)
    rng = np.random.default_rng(seed)
    passage, found = rng.integers(0, 1 << 63, 30, np.uint64), []
    for _ in range(14):
        n = int(rng.integers(1, 60)) * 7
        whole = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, np.uint64), passage[: int(rng.integers(0, 30))]]))
        found.append(whole)
        for _ in range(4):
            part = rng.permutation(whole)[: max(1, len(whole) * 6 // 7 + int(rng.integers(-1, 2)))]
            found.append(np.sort(part))
            other = rng.permutation(whole)[: len(part)]
            found.append(np.unique(np.concatenate([other, rng.integers(0, 1 << 63, int(rng.integers(0, 3)), np.uint64)])))
    exact = {(i, j) for i in range(len(found)) for j in range(i + 1, len(found)) if minhash.similar(found[i], found[j], 75)}
    for block in (None, np.arange(len(found)) % 2):
        pairs = [minhash._near((1, left, right), block_of(found, head, block), 75).to_numpy().tolist() for left, right in (((0, 0),) if block is None else ((0, 0), (1, 1), (0, 1)))]
        root = list(range(len(found)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in (p for part in pairs for p in part if tuple(p) in exact):  # what heads can't decide is confirmed on the sets
            root[max(find(i), find(j))] = min(find(i), find(j))
        assert all(find(i) == find(j) for i, j in exact) and len(exact) > 30
        assert head < 1024 or {tuple(p) for part in pairs for p in part} <= exact


def test_large_sets_are_ruled_out_by_what_they_must_have():
    """Sets beyond their heads that share a passage only are not sent on; those that are similar are."""
    rng = np.random.default_rng(9)
    shared = rng.integers(0, 1 << 63, 900, np.uint64)
    found = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 9000, np.uint64)])) for _ in range(12)]
    found.append(np.sort(rng.permutation(found[0])[:9000]))
    assert minhash._near((1, 0, 0), block_of(found), 75).to_numpy().tolist() == [[0, 12]]


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (prose(60) for _ in range(3))
    rows = [(5, a), (5, b), (1, a), (2, b), (7, c), (7, c), (7, ""), (8, c), (None, a), (None, None), (9, None), (9, c)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    got = {(r["doc_id"], r["n_shingles"] > 0): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert {k: v[0] for k, v in got.items() if k[0] and k[1]} == {(5, True): 1, (1, True): 1, (2, True): 1, (7, True): 7, (8, True): 7, (9, True): 7}
    assert got[None, True] == got[None, False] == (None, True) and minhash.near_duplicates(docs).count() == len(rows)


def test_meetings_of_large_buckets(spark):
    """All pairs across components meet once; what lies in the largest component is not dealt out again and again."""
    minhash.BLOCK, before = 50, minhash.BLOCK
    try:
        for outside, n in ((7, 600), (130, 500), (400, 400)):
            rest = spark.range(n).select(F.lit(9).alias("bucket"), "id", F.when(F.col("id") < outside, F.col("id")).otherwise(-1).alias("comp"))
            met = minhash.meetings(rest).toPandas()
            pairs = collections.Counter()
            for (left, right), part in met.groupby(["left", "right"]):
                x, y = (part[part["block"] == k][["id", "comp"]].to_numpy().tolist() for k in (left, right))
                pairs.update((min(a, b), max(a, b)) for a, c in x for b, d in y if c != d and (left != right or a < b))
            assert set(pairs.values()) == {1} and len(pairs) == outside * (outside - 1) // 2 + outside * (n - outside)
            assert len(met) <= n + outside + 2 * outside * n / 50 + outside * (n > outside)
    finally:
        minhash.BLOCK = before
    assert minhash.meetings(spark.range(5000).select(F.lit(1).alias("bucket"), "id", F.when(F.col("id") < 10, F.col("id")).otherwise(-1).alias("comp"))).count() < 5200


def test_signature_is_unbiased():
    rng = np.random.default_rng(1)
    est = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 400, np.uint64)
        a, b = minhash.signatures([np.sort(x[:300]), np.sort(x[100:])])
        est.append((a == b).mean())
    assert abs(np.mean(est) - 0.5) < 0.02


# 4


def test_language_held_out_accuracy(spark):
    d = common.documents(spark, "/root/testdata/sf0.01")
    model = langid.train(d.filter(common.fold("doc_id") != 1))
    got = langid.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").filter(common.fold("doc_id") == 1)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_language_fit_knows_no_order(spark):
    d = common.documents(spark, "/root/testdata/sf0.001")
    one, two = langid.train(d.orderBy("doc_id")), langid.train(d.repartition(7).orderBy(F.desc("doc_id")))
    assert one["jobs"] == two["jobs"] and all(np.array_equal(a, b) for a, b in zip(one["w"], two["w"], strict=True))


def test_language_sample_is_bounded(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"), F.lit("en").alias("lang"))
    rows = rows.unionByName(spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("und ein Satz "), "id").alias("text"), F.lit("de").alias("lang")))
    model = langid.train(rows, per_language=50)
    assert set(model["langs"]) <= {"de", "en"} and "de" in model["langs"]


def test_language_edges(spark):
    rows = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "", None), (4, "the cat sat there", "en"), (None, "und so weiter und so fort", None)], "doc_id long, text string, lang string")
    one = langid.train(rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(rows, one).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4] == ("en", 1.0) and got[None][0] == "en"
    none = langid.train(rows.filter("doc_id = 3"))
    assert {r["lang_pred"] for r in langid.predict(rows, none).collect()} == {"und"}
    assert langid.predict(rows.limit(0), one).count() == 0


def test_every_language_is_learned(spark):
    rows = spark.range(201).select("id", F.concat(F.lit("word"), "id").alias("lang"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") * 7 + k) for k in range(5)]).alias("text")).withColumnRenamed("id", "doc_id")
    assert len(langid.train(rows, per_language=5)["langs"]) == 201
    with pytest.raises(ValueError, match="over 200 languages"):
        langid.train(rows, most_languages=200)


def test_signs_of_number_are_no_letters():
    assert not any(map(langid.has_letter, (None, "", "½ ² Ⅷ ① 12 _ !")))
    assert all(map(langid.has_letter, ("½a", "中", "ª")))


def test_machines_reach_the_optimum_of_a_plain_solver():
    rng = np.random.default_rng(4)
    for c in (10.0, 0.5):
        x = rng.normal(size=(60, 6)).astype(np.float32)
        y = np.where(x @ rng.normal(size=6) + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
        at = [np.arange(6)] * 60
        w = langid.svm(at, list(x), y, rounds=400, c=c)
        full = np.column_stack([x, np.ones(60)])
        loss = lambda v: 0.5 * v @ v + c * np.maximum(0, 1 - y * (full @ v)).sum()
        # projected gradient on the dual, with the step of its largest eigenvalue
        q = (full * y[:, None]) @ (full * y[:, None]).T
        a, step = np.zeros(60), 1 / np.linalg.eigvalsh(q)[-1]
        for _ in range(20000):
            a = np.clip(a + step * (1 - q @ a), 0, c)
        best = loss((a * y) @ full)
        assert loss(w[[*range(6), 1 << langid.BITS]].astype(float)) <= best * 1.01 + 1e-6


def test_votes_by_listing_all_machines():
    langs = ["de", "en", "nl", "fr", "es", "ru"]
    jobs = langid.machines(langs)
    assert len(jobs) == 3 + 3 + 1
    margins = np.random.default_rng(6).normal(size=(300, len(jobs)))
    margins[:40] = np.sign(margins[:40])  # ties of votes and of sums
    got, score = langid.decide(margins, {"langs": sorted(langs), "jobs": jobs})
    for m, lang, s in zip(margins, got, score, strict=True):
        fam = {j["name"]: x for j, x in zip(jobs, m, strict=True) if j["kind"] == "family"}
        best = [f for f in fam if fam[f] == max(fam.values())][0]
        votes, sums = collections.Counter(), collections.Counter()
        for j, x in zip(jobs, m, strict=True):
            if j["kind"] == "pair" and j["name"] == best:
                (a,), (b,) = j["yes"], j["no"]
                votes[a if x >= 0 else b] += 1
                sums[a] += x
                sums[b] -= x
        members = [x for x in sorted(langs) if langid.family(x) == best]
        assert (votes[lang], sums[lang]) == max((votes[x], sums[x]) for x in members) and 0 <= s <= 1


# 5


def test_base_rules(docs, rows):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, t in rows.items():
        w = t.encode().split()
        where = collections.defaultdict(list)
        for k in range(len(w) - 2):
            where[tuple(w[k : k + 3])].append(k)
        repeat = {k + j for ks in where.values() if len(ks) > 1 for k in ks for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(quality.SPACES)]
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(repeat), len(lines) - len(set(lines))), i
        assert r["word_chars"] == sum(len(x.decode()) for x in w) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))


def test_line_rules():
    r = quality.Rules()
    text = "A line of prose that ends well.\nhome | about | contact.\nAccept cookies to go on.\nno end here\n#### $$$$ %%%%.\nA line of prose that ends well."
    kept, repeats, _ = quality.lines_of(text, r)
    assert kept == ["A line of prose that ends well."] and repeats == 1


def test_line_rules_know_no_length():
    r, address = quality.Rules(), "https://a.example/" + "x" * 500
    for line in (f"home | about {address}.", f"Accept cookies at {address}.", "stem | " * 80 + "end.", f"{address} {address}.", "no end here " * 60):
        assert quality.lines_of(line, r)[0] == [], line
    for line in ("one two three. " * 40 + "and no more", "A line of prose that ends well. " * 30, f"See {address} for what was said of the a > b rule in the long report of that year, and more."):
        assert quality.lines_of(line, r)[0] == [line], line


CLEAN = (
    "The analog input works well.", "The dialog in the second act is long.", "You should read more books, said the teacher.", "He showed that 5 > 3 in every case.", "• First, whisk the eggs.", "> She wrote: I will come.",
    "And. Ornd. The end of it was near.", "Der Blogeintrag war lang.", "He said: no.", "→ See the second chapter for what became of them.", "La política de la ciudad cambió mucho ese año.",
)
JUNK = (
    "Home. About. Contact. Products. Careers. Sitemap.", "Datenschutz Impressum Kontakt. Alle Rechte vorbehalten.", "Log in.", "Read more.", "Home > Docs > Install.", "Home | About us | Contact.", "Please log in!", "Skip to content.",
    "Tous droits réservés.", "© 2024 Todos los derechos reservados.", "Accept all cookies.", "By using this you accept cookies and our privacy policy.", "Follow us! Share this!", "• Home • About • Press.",
)


def test_clean_lines_stay_and_junk_goes():
    for line in CLEAN:
        assert quality.lines_of(line, quality.Rules())[0] == [line], line
    for line in JUNK:
        assert quality.lines_of(line, quality.Rules())[0] == [], line


def test_line_rules_equal_their_sql(spark, tmp_path):
    """Each line a document of its own, its words repeated by no rule: whether anything is kept must agree."""
    import duckdb

    from sparkledger.llm import queries

    odd = ("|", "a | b", "• ", "x" * 30 + " " + "»" * 3, "log in log in log in.", "Ñandú. ¡Sí! No? Ya. É.", "1. 2. 3. 4.", "READ MORE", "read  more.", "ｌog in.", "a.b.c www.x.y www.z.")
    fill = " ".join(f"w{k}a" for k in range(60)) + "."
    texts = [f"{line}\n{fill}" for line in (*CLEAN, *JUNK, *odd)] + ["\n".join(CLEAN + JUNK)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    sql = queries.oracle_sql()["op5_quality_rules"].replace("SELECT doc_id, n_words, word_chars", "SELECT doc_id, kept_chars, n_words, word_chars", 1)
    want = {r[0]: r[1] for r in con.sql(sql).fetchall()}
    assert want == {i: quality.lines_of(t, quality.Rules())[2] for i, t in enumerate(texts)}


def test_many_distinct_words():
    codes = np.concatenate([np.arange(1 << 21), np.array([5, 6, 7])])
    assert quality.repeated_windows(codes, np.zeros(len(codes), np.int64), 1).tolist() == [6]


# 6


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"].split()
    partly = " ".join(mit[: int(len(mit) * 0.85)])
    half = " ".join(mit[: len(mit) // 2])
    rows = [(1, prose(500) + " Released under the MIT License. " + prose(300)), (2, prose(33) + " " + partly + " " + prose(50)), (3, prose(33) + " " + half), (4, None), (5, ""), (6, prose(100)), (7, licenses.TEMPLATES["apache-2.0-notice"].upper()), (7, licenses.TEMPLATES["apache-2.0-notice"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["shared"], r["of"]) for r in licenses.scan(docs).collect()}
    assert set(got) == {(1, "mit-notice"), (2, "mit"), (7, "apache-2.0-notice")}
    assert got[1, "mit-notice"] == (1, 1) and 0.75 <= got[2, "mit"][0] / got[2, "mit"][1] < 1
    plan = licenses.places(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.scan(docs.limit(0)).count() == 0


def test_other_notices_and_whole_texts(spark):
    names = ["cc-by-nc-4.0-notice", "mpl-2.0-notice", "agpl-3.0-notice", *license_texts.TEXTS]
    docs = spark.createDataFrame([(i, prose(80) + " " + licenses.TEMPLATES[k] + " " + prose(60)) for i, k in enumerate(names)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    assert got >= set(enumerate(names))


# 7


@given(st.lists(st.integers(0, 10**9), max_size=600))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values.sort()
    raw = token_store.EliasFano.build(np.array(values, np.uint64)).dump()
    back, end = token_store.EliasFano.load(b"xx" + raw, 2)
    assert end == len(raw) + 2
    assert back.select(np.arange(len(values))).tolist() == values


def test_token_store(spark, docs, rows):
    manifest = token_store.write(docs, common.new_path(spark, "ids"))
    got = {r["doc_id"]: r for r in token_store.read_digests(manifest, 7).collect()}
    at = 0
    for i in sorted(rows):
        ids = ids_of(rows[i])
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    twice = docs.filter("doc_id < 5").unionByName(docs.filter("doc_id < 5")).unionByName(docs.filter("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    found = token_store.read_digests(token_store.write(twice, common.new_path(spark, "ids"))).collect()
    assert len(found) == 13 and sum(r["doc_id"] is None for r in found) == 3
    assert token_store.read_digests(token_store.write(docs.limit(0), common.new_path(spark, "ids"))).count() == 0


# 8


def exact_cut(rows):
    raws = {i: t.encode() for i, t in rows.items()}
    seen = collections.Counter(x[k : k + 200] for x in raws.values() for k in range(len(x) - 199))
    out = {}
    for i, x in raws.items():
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out[i] = (len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(docs, rows):
    want = exact_cut(rows)
    for many in (2048, 3):  # the second: nearly all by windows
        suffix_dedup.MANY, before = many, suffix_dedup.MANY
        try:
            got = suffix_dedup.remove_repeats(docs.withColumn("n_bytes", F.lit("clash"))).collect()
        finally:
            suffix_dedup.MANY = before
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert sum(w[1] > 0 for w in want.values()) > 10


def test_long_texts_in_stretches(spark):
    before = suffix_dedup.STRETCH
    suffix_dedup.STRETCH = 1000
    try:
        part = prose(200)
        raws = [(prose(900) + part + prose(300)).encode(), part.encode()]
        found = [(i, at) for i, part_, at in suffix_dedup.stretches(raws)]
        assert len(found) > 5
        covered = np.zeros(len(raws[0]) - 199, int)
        for i, p, at in suffix_dedup.stretches(raws):
            if i == 0:
                b = np.frombuffer(b"".join(p), np.uint8)
                place, lo, hi, _ = suffix_dedup.anchors(b, suffix_dedup.Sums(b), np.array([len(b)]))
                assert ((place >= lo) & (place <= lo + 168) & (place >= hi)).all()
                for x, y in zip(lo, hi, strict=True):
                    covered[at + x : at + y + 1] += 1
        assert (covered >= 1).all()
    finally:
        suffix_dedup.STRETCH = before


@given(st.lists(st.binary(min_size=0, max_size=24).map(lambda x: bytes(c % 3 for c in x)), max_size=40), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_merged_transforms_give_order_and_common_prefixes(strings, shards):
    """Transforms of shards, merged by interleave refinement, against one sort of all strings."""
    columns = suffix_dedup.columns_of(strings, 24)
    parts = [suffix_dedup.transform(columns[k::shards]) for k in range(shards) if len(columns[k::shards])]
    if not parts:
        return
    t, rows = suffix_dedup.merged([p for p, _ in parts])
    place = np.concatenate([np.arange(len(columns))[k::shards][order] for k, (_, order) in enumerate(parts)])[rows]
    full = [x.ljust(24, b"\0") for x in strings]
    assert sorted(place.tolist()) == list(range(len(full))) and [full[i] for i in place] == sorted(full)
    lcp = [next((j for j in range(24) if x[j] != y[j]), 24) for x, y in zip(sorted(full)[1:], sorted(full)[:-1], strict=True)]
    assert suffix_dedup.common_prefixes(t).tolist() == [0, *lcp]


@given(st.data())
@settings(max_examples=40, deadline=None)
def test_repeated_heads_by_comparing_all_windows(data):
    """Surroundings of one anchor over two letters, cut at odd places, against all pairs of windows."""
    gram = bytes(range(32))
    letters = st.binary(min_size=168, max_size=168).map(lambda x: bytes(97 + (c % 53 == 0) for c in x))
    rows = []
    for k in range(data.draw(st.integers(1, 12))):
        left, right = data.draw(letters), data.draw(letters)
        head = data.draw(st.integers(0, 168))
        more = data.draw(st.integers(0, head))  # windows with heads from head - more to head
        rows.append((k, head, more, (left[168 - head :] + gram + right)[: more + 200]))
    shards = []
    for s in range(3):
        part = rows[s::3]
        if part:
            t = pa.table({"range": [0] * len(part), "shard": [s] * len(part), "gram": [7] * len(part), "around": [r[0] for r in part], "head": pa.array([r[1] for r in part], pa.int32()), "more": pa.array([r[2] for r in part], pa.int32()), "bytes": pa.array([r[3] for r in part], pa.binary())})
            shards += suffix_dedup.shard_transform(t).to_pylist()
    _, around, hit = suffix_dedup.repeated_heads(shards)
    seen = collections.Counter(raw[k : k + 200] for _, _, more, raw in rows for k in range(more + 1))
    for i, k in enumerate(around.tolist()):
        _, head, more, raw = rows[k]
        want = {head - j for j in range(more + 1) if seen[raw[j : j + 200]] > 1}
        assert set(np.flatnonzero(hit[i]).tolist()) == want


# 9


def test_warc(spark):
    big = "<p>é" + "x" * 200
    rows = [(1, "u1", big), (2, "u2\r\nX: y", big), (3, "u3", "small"), (4, "u4", "small"), (5, None, None), (6, "u6", ""), (7, "u7", "y" * 5000), (None, "n", big), (2, "u2", big)]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), common.new_path(spark, "warc"))
    got = warc.read(index, with_payload=True).collect()
    assert len(got) == len(rows)
    of = {(r["page_id"], r["url"]): r for r in got}
    assert of[1, "u1"]["record_type"] == "response" and of[1, "u1"]["payload"].decode() == big
    assert (of[2, "u2"]["record_type"], of[2, "u2"]["refers_to"], of[2, "u2"]["payload_bytes"]) == ("revisit", 1, len(big.encode()))
    assert of[None, "n"]["record_type"] == "response" and of[3, "u3"]["record_type"] == of[4, "u4"]["record_type"] == "response"
    assert of[5, ""]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    assert {r["page_id"] for r in warc.read(index.filter("page_id > 5"), gap=0).collect()} == {6, 7}
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"), common.new_path(spark, "warc"))).count() == 0


def test_warc_of_repeated_rows(spark):
    big, other = "<p>é" + "x" * 200, "y" * 150
    rows = [(1, "u", big)] * 3 + [(2, "v", big)] * 2 + [(1, "w", big), (3, "u", other), (None, None, other), (None, None, other), (4, None, None), (4, None, None)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, turn string")
    got = collections.Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(pages.repartition(4), common.new_path(spark, "warc"))).collect())
    assert got == {(1, "u", "response", None): 1, (1, "u", "revisit", 1): 2, (2, "v", "revisit", 1): 2, (1, "w", "revisit", 1): 1, (3, "u", "response", None): 1, (None, "", "response", None): 2, (4, "", "response", None): 2}


def test_warc_of_long_pages(spark):
    rows = [(1, "u", "long " * 2_000_000), (2, "v", "long " * 2_000_000), (3, "w", "long " * 2_000_000 + "!")]
    got = {r["page_id"]: r for r in warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), common.new_path(spark, "warc")), with_payload=True).collect()}
    assert [got[i]["record_type"] for i in (1, 2, 3)] == ["response", "revisit", "response"] and got[3]["payload"].decode() == rows[2][2]


# 10


def test_media_recall_and_precision(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("page_id < 120")
    pics = media.pictures(pages)
    got = {(q, r["page_id"]) for r in media.copies(pics, every=1).collect() for q in r["copy_of"]}
    want = {(a, b) for c in range(3, 120, 4) for a, b in ((c, c - 1), (c - 1, c))}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(got)


def test_corners_meet_as_by_brute_force():
    rng = np.random.default_rng(3)
    asked = np.zeros(3000, media.CORNER)
    asked["a"], asked["b"] = rng.integers(0, 1 << 64, (2, 3000), np.uint64)
    near = asked.copy()
    for row in near:
        for bit in rng.choice(128, rng.integers(0, 14), replace=False):
            row["a" if bit < 64 else "b"] ^= np.uint64(1 << int(bit % 64))
    d = np.bitwise_count(near["a"][:, None] ^ asked["a"]) + np.bitwise_count(near["b"][:, None] ^ asked["b"])
    for most in (5, 12, 13):
        assert set(zip(*(x.tolist() for x in media.meet(near, asked, media.tables(asked), most)), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(d <= most)), strict=True))


def test_corners_of_crowded_values_meet_in_small_steps():
    """Queries that share a value of one table: every pair is held against the other, few at a time."""
    import tracemalloc

    rng = np.random.default_rng(4)
    asked, near = np.zeros(3000, media.CORNER), np.zeros(1000, media.CORNER)
    for c in (asked, near):
        for w in "ab":
            c[w] = rng.integers(0, 1 << 63, len(c), dtype=np.uint64)
        c["a"] &= ~np.uint64((1 << 18) - 1)
    near["a"][:500], near["b"][:500] = asked["a"][:500] ^ np.uint64(1 << 40), asked["b"][:500] ^ np.uint64(6)
    index = media.tables(asked)
    tracemalloc.start()
    i, j = media.meet(near, asked, index, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    d = np.bitwise_count(near["a"][:, None] ^ asked["a"]).astype(int) + np.bitwise_count(near["b"][:, None] ^ asked["b"])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(d <= 40)), strict=True))


def test_corners_of_one_value_are_held_against_a_list_where_it_lies(monkeypatch):
    """Windows, whose content is copied, are for the few pairs of rare values. Lists of odd lengths, shorter and longer than a step, miss nothing."""
    windows, view = [], np.lib.stride_tricks.sliding_window_view
    monkeypatch.setattr(np.lib.stride_tricks, "sliding_window_view", lambda x, width: windows.append(width) or view(x, width))
    rng = np.random.default_rng(5)
    for queries, corners in ((3001, 900), (media.AT_ONCE + 3, 2), (9, 1001), (1, 1), (0, 5), (5, 0)):
        asked, near = np.zeros(queries, media.CORNER), np.zeros(corners, media.CORNER)
        for c in (asked, near):
            for w in "ab":
                c[w] = rng.integers(0, 1 << 63, len(c), dtype=np.uint64)
            c["a"] &= ~np.uint64((1 << 18) - 1)
        m = min(queries, corners)
        near["a"][:m], near["b"][:m] = asked["a"][:m] ^ np.uint64(1 << 40), asked["b"][:m] ^ np.uint64(6)
        windows.clear()
        i, j = media.meet(near, asked, media.tables(asked), 45)
        d = np.bitwise_count(near["a"][:, None] ^ asked["a"]).astype(int) + np.bitwise_count(near["b"][:, None] ^ asked["b"])
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == list(zip(*(x.tolist() for x in np.nonzero(d <= 45)), strict=True))
        assert max(windows, default=0) < 1000


def test_true_places_of_a_row_of_booleans():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 8, 9, 64, 1003):
        for share in (0, 0.02, 0.5, 1):
            mask = rng.random(n) < share
            assert (media._true(mask) == np.flatnonzero(mask)).all()


@pytest.mark.parametrize("h, w", [(96, 96), (23, 200), (60, 22), (24, 24), (21, 21), (20, 50), (9, 30)])
def test_corners_as_by_whole_pictures(monkeypatch, h, w):
    """The corners that a computation over whole pictures finds, ties among them, for much less of it."""
    rng = np.random.default_rng(7)
    kinds = [rng.integers(0, 256, (h, w)), np.tile(rng.integers(0, 256, (6, 6)), (h // 6 + 1, w // 6 + 1))[:h, :w], np.full((h, w), 9), *(media.warp(media.render(b"w%d" % k), 0, 2.2)[:h, :w] for k in range(3))]
    stack, edge, want = np.stack(kinds).astype(np.float32), media.RADIUS + 3, []
    gy, gx = np.zeros_like(stack), np.zeros_like(stack)
    gy[:, 1:-1], gx[:, :, 1:-1] = stack[:, 2:] - stack[:, :-2], stack[:, :, 2:] - stack[:, :, :-2]
    a, b, c = media.box(gy * gy), media.box(gx * gx), media.box(gx * gy)
    r = a * b - c * c - np.float32(0.05) * (a + b) ** 2
    for k in range(len(r)):
        found = []
        for y in range(edge, h - edge):
            for x in range(edge, w - edge):
                cross = [(y + d, x) for d in (-2, -1, 1, 2)] + [(y, x + d) for d in (-2, -1, 1, 2)]
                if r[k, y, x] > 1e4 and all(r[k, p, q] <= r[k, y, x] for p, q in cross if edge <= p < h - edge and edge <= q < w - edge):
                    found.append((-float(r[k, y, x]), y, x))
        want += [(k, y, x) for _, y, x in sorted(found)[:24]]
    seen, highest = [], np.maximum
    monkeypatch.setattr(np, "maximum", lambda *of, **named: seen.append(of[0].size) or highest(*of, **named))
    got = media.corners(stack, 24)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == want
    assert sum(seen) < 5 * stack.size


def test_media_blurred(spark):
    own = [media.render(b"%d" % i) for i in range(60)]
    rows = [(2 * i + k, 96, x.tobytes()) for i, p in enumerate(own) for k, x in enumerate((p, (media.box(p[None].astype(np.float32))[0] / 9).astype(np.uint8)))]
    got = {(q, r["page_id"]) for r in media.copies(spark.createDataFrame(rows, "page_id long, height int, pixels binary"), every=2).collect() for q in r["copy_of"]}
    want = {(2 * i, 2 * i + 1) for i in range(60)}
    assert len(want & got) >= 0.95 * len(want) and got <= want


def test_media_edits(spark):
    n, edits = 20, len(media.EDITS)
    own = [media.render(b"e%d" % i) for i in range(n)]
    pics = [(1000 * i, p) for i, p in enumerate(own)] + [(1000 * i + 1 + how, media.edited(p, how)) for i, p in enumerate(own) for how in range(edits)]
    rows = [(i, p.shape[0], p.tobytes()) for i, p in pics]
    got = {(q, r["page_id"]) for r in media.copies(spark.createDataFrame(rows, "page_id long, height int, pixels binary"), every=1000).collect() for q in r["copy_of"]}
    assert all(q // 1000 == c // 1000 for q, c in got)
    for how, name in enumerate(media.EDITS):
        assert sum((1000 * i, 1000 * i + 1 + how) in got for i in range(n)) >= 0.9 * n, name


def cropped(p, share, corner=False):
    n = int(len(p) * share)
    at = 0 if corner else (len(p) - n) // 2
    return np.ascontiguousarray(p[at : at + n, at : at + n])


FURTHER = {
    "size 0.6": lambda p: media.warp(p, 0, 0.6), "size 0.67": lambda p: media.warp(p, 0, 0.67), "size 1.5": lambda p: media.warp(p, 0, 1.5), "size 2": lambda p: media.warp(p, 0, 2),
    "two thirds": lambda p: cropped(p, 2 / 3), "two thirds, corner": lambda p: cropped(p, 2 / 3, True), "two thirds, turn 20": lambda p: cropped(media.warp(p, np.radians(20), 1), 2 / 3), "turn 30": lambda p: media.warp(p, np.radians(30), 1),
}


def smooth(k):
    """A picture of another kind than render()'s: soft hills, and disks and strokes on them."""
    rng = np.random.default_rng(k)
    y, x = np.mgrid[:96, :96].astype(np.float32)
    g = 110 + sum(40 * np.sin(a * x + b * y + c) for a, b, c in rng.uniform((-0.12, -0.12, 0), (0.12, 0.12, 6), (4, 3)))
    for _ in range(16):
        cy, cx, r, v = rng.uniform((0, 0, 3, 0), (96, 96, 12, 255))
        g = np.where((y - cy) ** 2 + (x - cx) ** 2 <= r * r, v, g)
        cy, cx, t, v = rng.uniform((0, 0, 0, 0), (96, 96, 3.1, 255))
        g = np.where((abs((y - cy) * np.cos(t) - (x - cx) * np.sin(t)) < 1.5) & (abs((y - cy) * np.sin(t) + (x - cx) * np.cos(t)) < 18), v, g)
    return np.clip(g + rng.normal(0, 3, g.shape), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("draw", [lambda i: media.render(b"f%d" % i), smooth])
def test_media_of_other_edits_and_kinds(spark, draw):
    """Edits that pictures() doesn't draw, on its pictures and on pictures that its tests of bits were not chosen on."""
    n = 20
    pics = [(1000 * i + k, p) for i in range(n) for k, p in enumerate([draw(i), *(f(draw(i)) for f in FURTHER.values())])]
    rows = [(i, p.shape[0], p.tobytes()) for i, p in pics]
    got = {(q, r["page_id"]) for r in media.copies(spark.createDataFrame(rows, "page_id long, height int, pixels binary"), every=1000).collect() for q in r["copy_of"]}
    assert all(q // 1000 == c // 1000 for q, c in got)
    found = {name: sum((1000 * i, 1000 * i + 1 + k) in got for i in range(n)) for k, name in enumerate(FURTHER)}
    print(found)
    assert all(x >= (0.8 if "thirds" in name else 0.9) * n for name, x in found.items()), found


def test_media_blocks_and_hostile_rows(spark):
    """Small blocks find what one finds; repeated and null ids, equal rows and columns with clashing names do no harm."""
    own = [media.render(b"b%d" % i) for i in range(9)]
    rows = [(i, 96, p.tobytes()) for i, p in enumerate(own)] + [(100 + i, 80, media.edited(p, 0).tobytes()) for i, p in enumerate(own)]
    rows += [rows[0], rows[0], (3, 96, own[4].tobytes()), (None, 96, own[5].tobytes()), (None, 80, rows[14][2]), (None, None, None), (55, 96, own[5].tobytes())]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, height int, pixels binary, of string, corners int")
    got = sorted(map(str, media.copies(pages, every=1).collect()))
    media.BLOCK, before = 2, media.BLOCK
    try:
        assert sorted(map(str, media.copies(pages, every=1).collect())) == got
    finally:
        media.BLOCK = before
    found = collections.defaultdict(list)
    for r in media.copies(pages, every=1).collect():
        found[r["page_id"]].append((r["class_id"], r["copy_of"]))
    assert len(got) == len(rows) and found[0] == [(0, [100])] * 3 and sorted(found[3]) == [(3, [103]), (3, [104])] and found[4] == [(3, [104])] and found[55] == [(5, [105])]
    assert sorted(found[None], key=str) == [(105, [5]), (5, [105]), (None, [])] and found[103] == [(103, [3])] and found[100] == [(100, [0])]


def test_pairs_of_pictures_as_by_comparing_all_corners():
    """The tables against all pairs of corners: every pair of pictures that all corner pairs within MOST bits confirm is found."""
    at_turn = media.turned(media.binary_tests())
    own = [media.render(b"t%d" % i) for i in range(26)]
    copies_ = [media.edited(p, i % len(media.EDITS)) for i, p in enumerate(own)]

    def corner(p):
        _, *cols = media.describe(p[None], at_turn)
        c = np.empty(len(cols[0]), media.CORNER)
        for name, x in zip(media.CORNER.names, cols, strict=True):
            c[name] = x.view(np.uint64) if name in "ab" else x
        return c

    a, b = [corner(p) for p in own], [corner(p) for p in copies_]
    want, got = set(), set()
    for i, x in enumerate(a):
        index = media.tables(x)
        for j, y in enumerate(b):
            d = np.bitwise_count(y["a"][:, None] ^ x["a"]) + np.bitwise_count(y["b"][:, None] ^ x["b"])
            r, q = np.nonzero(d <= media.MOST)
            want |= {(i, j)} if media.agree(x[q], y[r]) else set()
            r, q = media.meet(y, x, index, media.MOST)
            got |= {(i, j)} if media.agree(x[q], y[r]) else set()
    assert got <= want | {(i, i) for i in range(26)} and len(want & got) >= 0.95 * len(want)
    assert len({(i, i) for i in range(26)} & got) >= 24 and all(i == j for i, j in want)


def test_media_edges(spark):
    p = media.render(b"a").tobytes()
    rows = [(0, 96, p), (1, 96, p), (2, None, None), (3, 96, b""), (4, 7, b"1234567"), (5, 96, bytes(96 * 96))]
    got = {r["page_id"]: r for r in media.copies(spark.createDataFrame(rows, "page_id long, height int, pixels binary"), every=1).collect()}
    assert len(got) == 6 and got[1]["class_id"] == 0 and got[2]["class_id"] is None and all(r["n_copies"] == 0 for r in got.values())
    assert media.copies(spark.createDataFrame([], "page_id long, height int, pixels binary")).count() == 0


def test_licenses_are_told_apart(spark):
    """A notice within another, near-equal notices, two of them in one text, and a text that holds the short form only."""
    t = licenses.TEMPLATES
    short = t["agpl-3.0-notice"]
    rows = [(1, t["agpl-3.0"]), (2, t["gpl-3.0"]), (3, prose(60) + " " + short + " " + prose(60)), (4, t["agpl-3.0"] + " " + prose(400) + " " + t["gpl-3.0"]), (5, t["lgpl-3.0"]), (6, t["lgpl-2.1"]), (7, t["apache-2.0"]), (None, t["agpl-3.0"]), (8, t["cc-by-sa-4.0-notice"])]
    got = collections.defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].add((r["license"], r["shared"] == r["of"]))
    assert got == {1: {("agpl-3.0", True)}, 2: {("gpl-3.0", True)}, 3: {("agpl-3.0-notice", True)}, 4: {("agpl-3.0", True), ("gpl-3.0", True)}, 5: {("lgpl-3.0", True)}, 6: {("lgpl-2.1", True)}, 7: {("apache-2.0", True)}, None: {("agpl-3.0", True)}, 8: {("cc-by-sa-4.0-notice", True)}}


# all


def test_empty_and_null_tables(spark):
    for docs in (spark.createDataFrame([], DOCS), spark.createDataFrame([(None, None, None, None, None)] * 2, DOCS)):
        n = docs.count()
        assert minhash.near_duplicates(docs).count() == n
        assert quality.quality(docs).count() == n
        assert suffix_dedup.remove_repeats(docs).count() == n
        assert packing.pack(docs).count() == n
        assert sampling.encode(docs).count() == n
        assert licenses.scan(docs).count() == 0


CLASH = ("id", "of", "h", "w", "m", "t", "n", "sig", "key", "task", "place", "piece", "start", "length", "piece_ids", "decoded_crc32", "ids_crc32", "sequence_id", "offset", "n_shingles", "component_id", "kept", "lang_pred", "score", "draw", "share", "license", "shared", "n_tokens", "cleaned", "lost", "n_words", "n_removed", "kept_sha256", "gram", "range")


def hostile(spark):
    """Null and repeated ids, equal rows, null, empty, tied and very long texts."""
    a, b, notice = prose(120), prose(200), " Released under the MIT License. "
    rows = [(1, a, "en"), (1, a, "en"), (1, b, "de"), (None, a, "en"), (None, a, "en"), (None, None, None), (2, None, "en"), (3, "", None), (4, b + notice + a, "de"), (4, b + notice + a, "de"), (None, notice + a, "fr"), (5, " ".join(prose(400) for _ in range(60)) + notice + a, "en"), (6, "½ 12", "en")]
    return spark.createDataFrame([(i, t, x, "s", None) for i, t, x in rows], DOCS).repartition(3)


OPERATORS = {
    "sampling": lambda d: sampling.encode(d, digest=True),
    "packing": lambda d: packing.pack(d).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "near": minhash.near_duplicates,
    "language": lambda d: langid.predict(d, langid.train(d)),
    "quality": lambda d: quality.quality(d),
    "licenses": licenses.scan,
    "store": lambda d: token_store.read_digests(token_store.write(d, common.new_path(d.sparkSession, "ids"))),
    "repeats": lambda d: suffix_dedup.remove_repeats(d).select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hostile_rows_and_clashing_columns(spark, name):
    f, docs = OPERATORS[name], hostile(spark)
    want = f(docs)
    clash = docs.withColumns({c: F.lit("clash") for c in CLASH})
    got = f(clash)
    assert got.columns == want.columns
    rows = sorted(map(str, want.collect()))
    assert sorted(map(str, got.collect())) == rows
    n = {"packing": None, "licenses": 3}.get(name, docs.count())  # a piece, a license of an id, else a document
    assert len(rows) == n or n is None and len(rows) > docs.count()
    empty = f(clash.limit(0))
    assert empty.count() == 0 and empty.columns == want.columns


def test_ties_of_languages(spark):
    """The same text under two languages: either may be predicted, always the same, and nothing fails."""
    rows = spark.createDataFrame([(i, "one and the same text", x) for i, x in enumerate(["en", "de", "en", "de"])], "doc_id long, text string, lang string")
    got = {r["lang_pred"] for r in langid.predict(rows, langid.train(rows)).collect()}
    assert len(got) == 1 and got <= {"en", "de"} and got == {r["lang_pred"] for r in langid.predict(rows.repartition(3), langid.train(rows.orderBy(F.desc("doc_id")))).collect()}


def test_licenses_of_damaged_texts(spark):
    """Copies that lost one or two stretches: what is due by the exact rule, window by window, and what the bands retrieve."""
    rng, names = random.Random(11), ("gpl-3.0", "bsd-3-clause", "mit")
    step = lambda m: max(1, m // 4)
    shingle = lambda ws: [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    rows, due = [], set()
    for name in names:
        words, t = licenses.words_of(licenses.TEMPLATES[name]), set(shingle(licenses.words_of(licenses.TEMPLATES[name])))
        m = len(t)
        for _ in range(60):
            ws = list(words)
            for _ in range(rng.randint(1, 2)):
                at, n = rng.randrange(len(ws)), rng.randint(1, max(1, len(words) // 6))
                ws[at : at + n] = []
            text = prose(rng.randint(0, 40)) + " " + " ".join(ws) + " " + prose(rng.randint(5, 40))
            s = shingle(licenses.words_of(text))
            for a in range(0, len(s), step(m)):
                if t & set(s[a : a + m]) and 100 * len(t & set(s[max(0, a - m) : a + 2 * m])) >= 75 * m:
                    due.add((len(rows), name))
                    break
            rows.append((len(rows), text))
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {k: licenses.TEMPLATES[k] for k in names}).collect()}
    assert len(due) > 60 and found <= due and len(found) >= 0.99 * len(due)
