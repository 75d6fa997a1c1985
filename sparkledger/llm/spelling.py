"""Spelling variants: words one edit apart, grouped under the far more frequent one.

Words of all texts are counted, and met by asymmetric chunks. Of a pair that one insertion, deletion or replacement
separates, the word that is not longer contributes two disjoint chunks, its left and right half; the other its
positional grams of those lengths. The edit falls into one half and leaves the other, which then stands in
the longer word at the same place (left half) or as much later as that word is longer (right half): a
shift of none or one. Grams at other places can meet no chunk and are not made. What meets is verified by edit distance.

A chunk that very many words share would make the square of them. Where over `MOST` pairs meet under one key,
the key is cut again: its words still differ in one open half, whose own two chunks go on in turn, and the key
becomes all but a quarter of the word, then all but an eighth, to all but one letter. Each pair stands under
one such key at every depth, so nothing is lost, and keys at the last depth hold a few words each.

Null and empty texts have no words. Rows without an id count their words as they stand (there is no id to damage
them by). Repeated rows count each; ties for a form go to the first word in code-point order; an empty table
gives an empty result; extra columns are left out; texts and words of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RUN = re.compile("[a-zÀ-ÿ]+")  # of texts whose A-Z are lower-cased
MOST = 256  # pairs under one key before it is cut
HELD = 200_000  # words that a task counts before it hands them on


@common.task()
def _words(batches, least: int, every: int):
    counts: Counter[str] = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            for run, n in Counter(RUN.findall(text.lower().decode(errors="replace"))).items():  # of bytes: A-Z only
                if len(run) < least:
                    continue
                if id is not None:
                    h = zlib.crc32(f"{id}:{run}".encode())
                    if h % every == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < least:
                            continue
                counts[run] += n
            if len(counts) >= HELD:
                yield flush()
    if counts:
        yield flush()


def counted(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31, text: str = "text", id: str = "doc_id") -> DataFrame:
    """word, n: the words of at least `least` letters and `often` occurrences, after the letters that the rows' hashes delete are gone."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    found = rows.mapInArrow(partial(_words, least=least, every=every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def sides(words: DataFrame) -> DataFrame:
    """word, n, short (length of the pair's shorter word), gap (how much longer the other is), long (whether this is the other).

    Words of one length meet each other: they stand once, on the side of the chunks."""
    k = F.length("word")
    kind = lambda short, gap, long: F.struct(short.alias("short"), F.lit(gap).alias("gap"), F.lit(long).alias("long"))
    return words.select("word", "n", F.explode(F.array(kind(k, 0, False), kind(k, 1, False), kind(k - 1, 1, True))).alias("x")).select("word", "n", "x.*")


def keyed(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Under the key of the open stretch [a, b) of the shorter word: what stands before, and what stands after."""
    at = b + F.when(F.col("long"), F.col("gap")).otherwise(0)  # of the longer word one letter more is open
    whole = F.concat(F.substring("word", F.lit(1), a), F.lit("\n"), F.substring(F.col("word"), at + 1, F.length("word")))
    return rows.withColumns({"a": a, "b": b, "key": whole})


def halves(rows: DataFrame) -> DataFrame:
    """The same rows with the left and with the right half of their stretch [a, b) left open."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    cut = F.explode(F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b").alias("b")))).alias("y")
    rows = rows.select("word", "n", "short", "gap", "long", cut).select("word", "n", "short", "gap", "long", F.col("y.a").alias("u"), F.col("y.b").alias("v"))
    return keyed(rows, F.col("u"), F.col("v")).drop("u", "v")


KEY = ("short", "gap", "a", "b", "key")


def near(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, other, m: the ordered pairs of words one edit apart, with their counts. words: word, n."""
    spark = words.sparkSession
    rows = halves(sides(words).withColumns({"a": F.lit(0), "b": F.col("short")}))
    found, path = None, common.new_path(spark, "near-words")
    while True:
        # hot keys: so many rows meet under them that a further cut pays, and there is still something to cut
        sums = rows.groupBy(*KEY).agg(F.count("*").alias("all"), F.count_if("long").alias("longer"))
        sums = sums.filter((F.col("all") > 1) & ((F.col("gap") == 0) | (F.col("longer") > 0) & (F.col("longer") < F.col("all"))))
        pairs = F.when(F.col("gap") == 0, F.col("all") * (F.col("all") - 1) / 2).otherwise(F.col("longer") * (F.col("all") - F.col("longer")))
        sums = common.table(spark, sums.select(*KEY, ((pairs > most) & (F.col("b") - F.col("a") > 1)).alias("hot")), "word-keys")
        own = common.table(spark, rows.join(sums, list(KEY)), "word-chunks")
        cool = own.filter("NOT hot")
        same, one = cool.filter("gap = 0"), cool.filter("gap = 1")
        side = lambda df, word, n: df.select(*KEY, F.col("word").alias(word), F.col("n").alias(n))
        met = side(same, "word", "n").join(side(same, "other", "m"), list(KEY)).filter("word < other")
        met = met.unionByName(side(one.filter("NOT long"), "word", "n").join(side(one.filter("long"), "other", "m"), list(KEY)))
        met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "m").write.mode("append").option("compression", "zstd").parquet(path)
        if sums.filter("hot").isEmpty():
            break
        rows = halves(own.filter("hot").drop("hot"))
    found = spark.read.schema("word string, n long, other string, m long").parquet(path).distinct()
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following the forms ends. forms: word, form; a form is always more frequent than its word, so no circle."""
    spark = forms.sparkSession
    ends = common.table(spark, forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:  # each step doubles the way
        up = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = common.table(spark, ends.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        ends = new.drop("moved")
        if new.filter("moved").isEmpty():
            return ends


@common.tidy("spelling")
def variants(docs: DataFrame, least: int = 7, often: int = 2, times: int = 10, every: int = 31, most: int = MOST, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A row per word: word, n, n_near, form (its near word of largest n, if that is at least `times` its own), form_n, root."""
    spark = docs.sparkSession
    words = common.table(spark, counted(docs, least, often, every, text, id), "words")
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    of = near(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("x"))
    of = words.join(of, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("x.m")).alias("m"), F.col("x.other").alias("other"))
    has = F.col("m") >= times * F.col("n")
    of = common.table(spark, of.select("word", "n", "n_near", F.when(has, F.col("other")).alias("form"), F.when(has, F.col("m")).alias("form_n")), "word-forms")
    ends = roots(of.filter("form IS NOT NULL").select("word", "form"))
    return of.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
