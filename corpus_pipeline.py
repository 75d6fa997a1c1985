"""Documents to packed sequences: quality rules, language, near copies, repeated passages, packing.

Each stage works on all rows that the one before it kept, and is written as Parquet before the
next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.llm import common, langid, minhash, packing, quality, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.4


def _with_text(rows: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with another text and its length."""
    return rows.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines leave the texts; documents that lose too much, or fail the base rules, go."""
    judged = quality.quality(docs.select(*COLUMNS), keep=("doc_id", "lang", "source"))
    return _with_text(judged.filter("kept"), "cleaned")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`lang` becomes the predicted language; documents without one, or below LEAST_SCORE, go."""
    model = langid.train(docs.filter(common.fold("doc_id") != 1))
    found = langid.predict(docs.select(*COLUMNS), model, keep=COLUMNS)
    found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; rows without an id stay.

    Of rows that repeat an id one stays, the first in the order of all columns."""
    # the text is dealt out once: the operator and the join below read it where it lies
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with_id = common.bucketed(spark, docs.select(*COLUMNS).filter("doc_id IS NOT NULL").repartition(n, "doc_id"), "documents-by-id", "doc_id")
    kept = common.table(spark, minhash.near_duplicates(with_id).filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")), "kept-ids")
    stay = with_id.join(kept, "doc_id")
    single = stay.filter("n = 1").select(*COLUMNS)
    repeated = stay.filter("n > 1").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")
    return single.unionByName(repeated).unionByName(docs.select(*COLUMNS).filter("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 or more that occur elsewhere leave the texts."""
    return _with_text(suffix_dedup.remove_repeats(docs.select("doc_id", "text", "lang", "source")), "kept")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the byte windows and the tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from a table of their own, which is the caller's; all else that the run wrote is gone by then.

    A stage called by itself leaves what its result reads; common.owned() around it makes a list of that, for common.drop()."""
    docs, before = common.documents(spark, sf_dir), None
    for _, stage in STAGES:
        path = f"{common.shared_dir(spark)}/stage-{stage.__name__}-{common.uuid.uuid4().hex}"
        with common.owned(spark) as own:
            docs = common.table(spark, stage(spark, docs, sf_dir), stage.__name__, path)
        common.drop(spark, own)
        if before:
            common.delete(spark, before)
        before = path
    return docs
