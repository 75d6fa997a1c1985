"""Each stage of the pipeline against a plain version of what it promises."""

import pathlib

import corpus_pipeline as p
from sparkledger.llm import common, quality, suffix_dedup

from tests.llm.test_ops import exact_components, exact_cut


def test_stages(spark):
    docs = common.documents(spark, "/root/testdata/sf0.001")
    seen, kept = {r["doc_id"]: r["text"] for r in docs.collect()}, []
    for name, stage in p.STAGES[:-1]:
        path = common.new_path(spark, "stage")
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == list(p.COLUMNS)
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality rules":
            judged = {i: quality.judge([t], quality.Rules()) for i, t in seen.items()}
            assert got == {i: j["cleaned"][0] for i, j in judged.items() if j["kept"][0]}
        elif name == "language ID":
            assert len(got) >= 0.99 * len(seen) and all(seen[i] == t for i, t in got.items())
        elif name == "MinHash near-dedup":
            root = exact_components(seen)
            assert got == {i: t for i, t in seen.items() if root[i][1] == i}
        else:
            want = exact_cut(seen)
            assert {i: len(t.encode()) for i, t in got.items()}.keys() == want.keys()
            assert all(len(t.encode()) <= want[i][0] - want[i][1] and len(t.encode()) >= want[i][0] - want[i][1] - 6 * (want[i][2] + 1) for i, t in got.items())
        seen = got
        kept.append(len(got))
    assert kept == sorted(kept, reverse=True)
    packed = p.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(seen)


def files(spark):
    return {x.name for x in pathlib.Path(common.shared_dir(spark).removeprefix("file:")).iterdir()}


def test_run(spark):
    """run() packs each kept document whole, leaves other queries' results and those of other runs alone, and keeps its rows only."""
    sf = "/root/testdata/sf0.001"
    other = suffix_dedup.remove_repeats(common.documents(spark, sf), with_text=False)
    before = files(spark)
    first = p.run(spark, sf)
    rows = first.toPandas()
    assert other.count() == common.documents(spark, sf).count()
    assert {x.rpartition("-")[0] for x in files(spark) - before} == {"stage-best_fit_packing"}
    assert not any(t.name.startswith("texts_") for t in spark.catalog.listTables())
    again = p.run(spark, sf)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect())) and first.count() == len(rows)
    part = rows.sort_values(["doc_id", "piece"])
    assert (part["start"] == part.groupby("doc_id")["length"].cumsum() - part["length"]).all()
    used = rows.sort_values("offset").groupby("sequence_id")["length"]
    assert (used.sum() <= 1024).all() and rows["doc_id"].nunique() > 100


DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_hostile_rows_through_all_stages(spark, tmp_path):
    """Nulls, repeated rows and ids, a long text and an extra column; then an empty table."""
    prose = [r["text"] for r in common.documents(spark, "/root/testdata/sf0.001").filter("length(text) > 600 AND lang = 'en'").orderBy("doc_id").limit(8).collect()]
    rows = [(i, t, "en", "s", len(t), "x") for i, t in enumerate(prose)]
    rows += [rows[0], (None, prose[1], None, None, None, None), (50, None, None, None, None, None), (51, "", "en", "s", 0, "x"), (1, prose[2], "en", "s", None, "x"), (52, " ".join(prose * 20), "en", "s", None, "x"), (None, None, None, None, None, None)]
    for k, n in enumerate((len(rows), 0)):
        docs = spark.createDataFrame(rows[:n], DOCS)
        for name, stage in p.STAGES:
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert (docs.count() > 5) == (n > 0)
        ids = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/{k}-MinHash near-dedup").collect() if r["doc_id"] is not None]
        assert len(ids) == len(set(ids)) and (n == 0 or 0 in ids and not {50, 51} & set(ids))


def test_near_dedup_deals_out_no_text_after_its_buckets(spark, tmp_path):
    """Only the ids that stay are dealt out to meet the texts."""
    rows = [(i, f"{'the same words in every text of a pair ' * 3}{i // 2} {i // 2 * 7} {i // 2 * 13}", "en", "web", 100) for i in range(40)] + [(None, "no id " * 20, "en", "web", 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "docs"))
    docs, before = spark.read.parquet(str(tmp_path / "docs")), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = p.near_dedup(spark, docs, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert sum("Exchange hashpartitioning(doc_id" in line for line in plan.split("\n")) == 2  # once for each branch of the union, of kept ids
        got = out.select("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r for r in got if r["doc_id"] is None] and len(got) == len({r["doc_id"] for r in got})
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("documents_by_id", "minhash_sets"))]
