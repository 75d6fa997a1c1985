"""Near-duplicate documents by min-max hashing, links confirmed on full shingle sets.

Each of 64 hash functions gives two values, the least and the greatest over the set: 128 values
for 64 evaluations. Bands of four values (two functions) make 32 buckets a document; a pair at
similarity 0.75 shares none with probability 5e-6. Documents with equal sets are one class, and
only classes meet in buckets:

1. each member of a bucket is held against the bucket's smallest member;
2. links so found are joined to components;
3. in buckets where other members still lie in different components, these are compared block by block: the hashes that two
   sets share are counted for all pairs at once, as a product of matrices. Of sets too large to be sent whole the
   least hashes are (a fourth, and one, at least: of two similar sets these hold the least hash that they share).

So every pair that shares a bucket is either held against its sets, ruled out by what similar sets must have, or
already in one component; estimates decide nothing, and only the bands can lose a pair. No task emits the pairs of a large group of
copies: step 3 confirms sets of up to 1024 shingles where it stands, sends on pairs of larger ones that their least
hashes can't rule out, and gives only as many links as join the components of a block. The members of a bucket's largest component meet only the others, not each other: with o others
of n members, at most 2 * o * n / `BLOCK` rows beside n are dealt out. That is small next to n for copies, and grows
with the square of a bucket of sets that are all unlike.

Texts that are null or without words have no shingles: n_shingles 0, linked with nothing. Rows
without an id are linked with nothing and have component_id null and kept true. Rows that repeat an
id are the same document: all their sets count as linked. Extra columns are left out; an empty table
gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import sets

FUNCTIONS = 64
BAND = 4  # values
BANDS = 2 * FUNCTIONS // BAND
BLOCK = 512  # members of a bucket that meet in one task
_RNG = np.random.default_rng(20240501)
_TIMES = _RNG.integers(0, 1 << 63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(found: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set the least and greatest value under each function, side by side."""
    flat = np.concatenate(found)
    first = np.cumsum([0, *map(len, found[:-1])])
    out = np.empty((len(found), 2 * FUNCTIONS), np.uint32)
    for k, times in enumerate(_TIMES):
        with np.errstate(over="ignore"):
            v = ((flat * times) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * k] = np.minimum.reduceat(v, first)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, first)
    return out


@common.task()
def _rows(batches, words: int):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in common.slices(texts, 1_000_000):
            found = sets(texts[a:b], words)
            full = [s for s in found if len(s)]
            sig = iter(signatures(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array([len(s) for s in found], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
                pa.array([next(sig).astype("<u4").tobytes() if len(s) else None for s in found], pa.binary()),
            ], names=["id", "n", "of", "sig"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, on sorted distinct values."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


@common.task()
def _confirm(batches, percent: int):
    for batch in batches:
        a, b = ([np.frombuffer(x, "<u8") for x in batch.column(i).to_pylist()] for i in (2, 3))
        ok = pa.array([similar(x, y, percent) for x, y in zip(a, b, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)


@common.task()
def _set_bytes(batches, words: int):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in common.slices(texts, 1_000_000):
            found = sets(texts[a:b], words)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], names=["id", "set"])


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; full: id, set, in buckets by id: only the sets on the left are dealt out, with the pairs."""
    spark = full.sparkSession
    pairs = common.table(spark, pairs, "minhash-pairs")
    # a table, not a join, meets the pairs: Spark can then split a set that very many pairs ask for
    left = common.table(spark, full.join(pairs.select(F.col("a").alias("id")).distinct(), "id"), "minhash-left-sets")
    one = pairs.join(left.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(full.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(partial(_confirm, percent=percent), "a long, b long")


SKETCH = 1024  # least hashes of a set that go into step 3: all of most sets, and of others at least what prefix() asks for
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
HASHES = 4096  # columns of a product of blocks


def prefix(n, percent: int):
    """So many least hashes of a set of n: of two sets that are similar, those of each hold the least hash that both have."""
    return n - -(-percent * n // 100) + 1


def overlaps(heads: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """rows x cols: how many hashes two heads share. Exact: products of 0 and 1 add up below 2^24."""
    out = np.zeros((len(rows), len(cols)), np.float32)
    x, y = ((np.concatenate([heads[i] for i in of]), np.repeat(np.arange(len(of)), [len(heads[i]) for i in of])) for of in (rows, cols))
    both = np.intersect1d(x[0], y[0])
    found = []
    for h, of in (x, y):
        at = np.minimum(np.searchsorted(both, h), max(len(both) - 1, 0))
        ok = both[at] == h if len(both) else np.zeros(len(h), bool)
        order = np.argsort(at[ok], kind="stable")
        found.append((at[ok][order], of[ok][order]))
    if rows is cols:  # a hash of one set only is no one's but its own
        at, of = found[0]
        many = np.bincount(at, minlength=len(both)) > 1
        new = np.cumsum(many) - 1
        found = [(new[at[many[at]]], of[many[at]])] * 2
        both = both[many]
    for start in range(0, len(both), HASHES):
        parts = []
        for (at, of), n in zip(found, (len(rows), len(cols)), strict=True):
            lo, hi = np.searchsorted(at, (start, start + HASHES))
            m = np.zeros((n, min(HASHES, len(both) - start)), np.float32)
            m[of[lo:hi], at[lo:hi] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def may_be_similar(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int) -> bool:
    """Whether two sets of n and m hashes can be similar, by their heads a and b."""
    last = min(a[-1] if len(a) < n else ALL, b[-1] if len(b) < m else ALL)
    x, y = (h[: np.searchsorted(h, last, "right")] for h in (a, b))  # all of both sets up to there
    most = len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))
    return 100 * most >= percent * (n + m - most)


def _near(key: tuple, pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the components of one or two blocks of a bucket: as many as join them, not all. Pairs with a set beyond its head are given if they may be similar."""
    _, left, right = key
    heads, sizes = [np.frombuffer(x, "<u8") for x in pdf["head"]], pdf["n"].to_numpy()
    ids, block = pdf["id"].to_numpy(), pdf["block"].to_numpy()
    comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
    rows = np.flatnonzero(block == left)
    cols = rows if left == right else np.flatnonzero(block == right)
    both = overlaps(heads, rows, cols)
    n, m = sizes[rows][:, None], sizes[cols][None]
    ask = (both > 0) & (comp[rows][:, None] != comp[cols][None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    if left == right:
        ask = np.triu(ask, 1)
    whole = (n <= SKETCH) & (m <= SKETCH)
    sure = ask & whole & (100 * both >= percent * (n + m - both))
    found = [(ids[rows[i]], ids[cols[j]]) for i, j in zip(*np.nonzero(ask & ~whole), strict=True) if may_be_similar(heads[rows[i]], sizes[rows[i]], heads[cols[j]], sizes[cols[j]], percent)]
    for k in np.flatnonzero(sure.any(1)):
        i = rows[k]
        for j in cols[sure[k]]:
            if comp[j] != comp[i]:
                found.append((ids[i], ids[j]))
                comp[comp == comp[j]] = comp[i]
    pairs = sorted({(min(p), max(p)) for p in found})
    return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")


def meetings(rest: DataFrame) -> DataFrame:
    """Which members (bucket, id, comp) of a bucket meet in which task: left and right, the two blocks of the task, and the member's own block.

    Members outside the bucket's largest component lie in blocks 0, 1, ..., those inside in -1, -2, ...; every
    block outside meets every block."""
    counts = rest.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top")).select("bucket", F.col("top.comp").alias("top"), (F.col("size") - F.col("top.n")).alias("o"), F.col("top.n").alias("i"))
    n = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    placed = rest.join(sums.filter("o > 0").select("bucket", "top", n("o").alias("outer"), n("i").alias("inner")), "bucket")
    own, h = F.col("comp") == F.col("top"), F.xxhash64("id")
    placed = placed.withColumn("block", F.when(own, -1 - F.pmod(h, F.col("inner"))).otherwise(F.pmod(h, F.col("outer"))).cast("int"))
    other = F.when(own, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(-F.col("inner"), F.col("outer") - 1))
    placed = placed.withColumn("other", F.explode(other)).drop("top", "outer", "inner")
    # a block inside stands on the right; of two blocks outside the lesser on the left
    least, most = F.least("block", "other"), F.greatest("block", "other")
    return placed.withColumn("left", F.when(least < 0, most).otherwise(least)).withColumn("right", F.when(least < 0, least).otherwise(most)).drop("other")


def components(spark, links: DataFrame) -> DataFrame:
    """(id, root) of all linked ids, the root the smallest: alternating large and small stars."""
    links = common.table(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        new = common.table(spark, new, "links")
        a, b = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (links, new))
        links = new
        if a == b:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root"))


@common.tidy("near-duplicates")
def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = common.table(spark, docs.mapInArrow(partial(_rows, words=words), "id long, n long, of binary, sig binary"), "minhash-rows")
    classes = common.table(spark, rows.filter("id IS NOT NULL AND n > 0").groupBy("of").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("n").alias("n")), "minhash-classes")
    values = BAND * 4
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * values + 1, F.lit(values)))))
    member = classes.select(band.alias("bucket"), "id", "n")
    # a table, not an aggregate, meets the members: Spark can then split a bucket that very many share
    shared = common.table(spark, member.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("x"), F.count("*").alias("size")).filter("size > 1").select("bucket", F.col("x.id").alias("center"), F.col("x.n").alias("of"), "size"), "minhash-buckets")
    member = common.table(spark, member.join(shared, "bucket"), "minhash-members")
    alike = F.least("n", "of") * 100 >= F.greatest("n", "of") * percent  # others are not similar; their sets need not be sent
    stars = member.filter("id > center").filter(alike).select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()

    wanted = member.select("id").distinct()
    full = common.bucketed(spark, docs.join(wanted, "id").mapInArrow(partial(_set_bytes, words=words), "id long, set binary"), "minhash-sets", "id")
    # the classes that an id with several sets lies in are one: the id is linked with the smallest of each
    named = rows.filter("id IS NOT NULL AND n > 0").select("id", "of")
    several = named.join(named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "id")
    several = several.join(classes.select("of", F.col("id").alias("a")), "of").filter("a <> id").select("a", F.col("id").alias("b"))
    links = common.table(spark, confirmed(stars, full, percent).union(several), "minhash-links")
    comp = components(spark, links)

    placed = member.filter("size > 2").join(comp, "id", "left").select("bucket", "id", "center", F.coalesce("root", "id").alias("comp"))
    open_ = common.table(spark, meetings(placed.filter("id <> center").select("bucket", "id", "comp")), "minhash-open")
    held = F.greatest(F.lit(SKETCH), F.col("n") - F.ceil(F.col("n") * percent / 100) + 2)  # hashes: what prefix() asks for, and one
    head = full.withColumn("n", F.floor(F.octet_length("set") / 8)).select("id", F.substring("set", F.lit(1), (8 * held).cast("int")).alias("head"), "n")
    rest = open_.join(head, "id")
    maybe = rest.select("bucket", "left", "right", "id", "comp", "block", "head", "n").groupBy("bucket", "left", "right").applyInPandas(lambda key, pdf: _near(key, pdf, percent), "a long, b long")
    more = confirmed(maybe.distinct(), full, percent)
    links = common.table(spark, links.union(more), "minhash-links")
    comp = components(spark, links)

    roots = classes.select("of", "id").join(comp, "id", "left").select("of", F.coalesce("root", "id").alias("component"))
    out = rows.select("id", "n", "of").join(roots, "of", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
