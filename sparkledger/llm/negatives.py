"""Hard negatives by inner product, in the manner of LEMP: length buckets, sorted coordinate lists, feasible ranges.

The index: rows ordered by length (the root of their own inner product) and cut into buckets of at most `BUCKET`
rows, so that the rows of a bucket are about equally long. Each bucket is one row of a table: its ids, labels, integers,
and for each coordinate the list of its rows sorted by their direction's value there.

A search asks, for each of a block of anchors, for the best `k` rows whose score lies in given bounds. In a bucket, an
anchor q needs a cosine of at least t = (least score that still counts) / (|q| * greatest length). If t is over 1, the
bucket is passed over. Else the angle between q and a direction p is at most that of t, so that at each coordinate f
p_f lies between q_f * t - r (or -1, if q_f <= -t) and q_f * t + r (or 1, if q_f >= t), with
r = root of (1 - t^2)(1 - q_f^2). Of the `FOCUS` coordinates where the anchor's direction is largest, these
ranges are looked up in the sorted lists; the shortest gives the candidates, the others are intersected with
it, and what remains is verified by its exact score. Where the shortest range holds over half the bucket, lists prune
nothing, and the bucket's scores are computed at once. The least score that counts rises bucket by bucket, as better
rows are found. The longest buckets (`FIRST` of all) are searched in a job of their own: what they give is where all
other tasks begin.

Anchors come in blocks of bounded size (`ANCHORS` rows, `SENT` bytes), each broadcast, and each searched against all rows
in jobs of its own; positives first, whose scores bound those of the negatives. A task holds one bucket and the best rows
so far. The number of blocks grows with the rows, so the work grows with anchors times rows, as is asked.

Scores are exact: floor(256 * x) of components, as integers; the sums run in doubles, exact below 2^53, in 64-bit integers
where the lengths don't rule out more; beyond 2^62 an error is raised. Rows with a null id, label or vector, or with
any null or non-finite component take no part. A shorter vector counts as continued by zeros. Of rows that repeat an id
one takes part, the least by label and components. Anchors without positives, and positives without negatives, give no
rows. An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKET = 2048  # rows
FOCUS = 4  # coordinates
ANCHORS = 4096  # of a block
SENT = 16 << 20  # bytes of a block
TOGETHER = 256  # anchors that a task searches for at a time
FIRST = 1 / 16
EXACT = 2.0**53
MOST = 2.0**62
ENTRY = np.dtype([("id", "<i8"), ("label", "<i8")])


def usable(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", moved: int | None = 7, labels: int = 10) -> DataFrame:
    """id, label, v: rows that take part, with integer components as doubles. Of ids that `moved` divides the label is (label + 1) % labels."""
    rows = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
    if moved:
        rows = rows.withColumn("label", F.when(F.pmod("id", F.lit(moved)) == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")))
    twice = common.table(rows.sparkSession, rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated-vectors")
    one = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    rows = rows.join(twice, "id", "left_anti").unionByName(one)
    return rows.withColumn("v", _integers("v"))


def _integers(v: str) -> Column:
    """floor(256 * x), as doubles: FLOOR of a double is a long, which a large one would leave."""
    scaled = lambda x: x * F.lit(256.0)
    return F.transform(v, lambda x: F.when(F.abs(scaled(x)) < EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))


@common.task()
def _buckets(batches):
    """Rows (id, label, v) in order of length, as buckets of about equal lengths: n, dims, longest, entries, rows, order."""
    held: list[tuple] = []

    def flush():
        part, held[:] = held[:BUCKET], held[BUCKET:]
        dims = max(len(v) for _, _, v in part)
        m = np.zeros((len(part), dims))
        for i, (_, _, v) in enumerate(part):
            m[i, : len(v)] = v
        own = np.array([(a, b) for a, b, _ in part], ENTRY)
        order = np.argsort(directions(m), axis=0, kind="stable").T.astype("<u2")
        values = [len(part), dims, float(np.sqrt(squares(m).max(initial=0))), own.tobytes(), m.astype("<f8").tobytes(), order.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=["n", "dims", "longest", "entries", "rows", "lists"])

    for batch in batches:
        held += zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        while len(held) >= BUCKET:
            yield flush()
    if held:
        yield flush()


def squares(m: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", m, m)


def directions(m: np.ndarray) -> np.ndarray:
    long = np.sqrt(squares(m))
    return m / np.where(long > 0, long, 1)[:, None]


def index(rows: DataFrame) -> DataFrame:
    """The buckets of rows (id, label, v), longest first within each part."""
    common.ship(rows.sparkSession)
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumn("size", size)
    placed = rows.repartitionByRange(F.desc("size"), "id").sortWithinPartitions(F.desc("size"), "id").select("id", "label", "v")
    return common.table(rows.sparkSession, placed.mapInArrow(_buckets, "n long, dims long, longest double, entries binary, rows binary, lists binary"), "vector-buckets")


def scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit integers."""
    most = float(np.sqrt(squares(q).max(initial=0) * squares(m).max(initial=0)))
    if most < EXACT:  # so are all partial sums
        return (q @ m.T).astype(np.int64)
    if most >= MOST:
        raise ValueError("inner products beyond 2^62")
    return q.astype(np.int64) @ m.astype(np.int64).T


class Search:
    """The best k rows of each slot of each anchor: those of the same label or of others, with low <= score <= high."""

    def __init__(self, ids, labels, vectors, low, high, k: int, same: bool):
        self.ids, self.labels, self.q, self.k, self.same = ids, labels, vectors, k, same
        self.low, self.high = low.copy(), high  # anchors x slots, int64
        self.long, self.unit = np.sqrt(squares(vectors)), directions(vectors)
        self.focus = np.argsort(-abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # (anchor, slot): scores, ids

    def candidates(self, who: np.ndarray, need: np.ndarray, m: np.ndarray, lists: np.ndarray):
        """For each anchor the rows whose focus coordinates are feasible, None where that prunes too little."""
        d = directions(m)
        dims = min(d.shape[1], self.unit.shape[1])
        for a, t in zip(who, need, strict=True):
            if t <= 0:
                yield None
                continue
            ranges = []
            t = min(t * (1 - 1e-9), 1.0)  # roundings must not lose a row
            for f in self.focus[a]:
                if f >= dims:  # these rows are zero there
                    continue
                x = self.unit[a, f]
                r = np.sqrt((1 - t * t) * max(1 - x * x, 0)) + 1e-9
                column = d[lists[f], f]
                least, most = -1.1 if x <= -t else x * t - r, 1.1 if x >= t else x * t + r
                lo, hi = np.searchsorted(column, least, "left"), np.searchsorted(column, most, "right")
                ranges.append((hi - lo, lo, hi, f, least, most))
            if not ranges or min(ranges)[0] > len(m) / 2:
                yield None
                continue
            ranges.sort()
            _, lo, hi, f, _, _ = ranges[0]
            rows = lists[f][lo:hi].astype(np.int64)
            for _, _, _, g, least, most in ranges[1:]:
                rows = rows[(d[rows, g] >= least) & (d[rows, g] <= most)]
            yield rows

    def bucket(self, longest: float, entries: np.ndarray, m: np.ndarray, lists: np.ndarray) -> None:
        dims = max(m.shape[1], self.q.shape[1])
        wide = lambda x: np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if x.shape[1] < dims else x
        open_ = self.low <= self.high
        least = np.where(open_, self.low, np.iinfo(np.int64).max).min(1)
        reach = self.long * longest
        ok = open_.any(1) & (least <= reach * (1 + 1e-9) + 1)
        for start in range(0, len(self.ids), TOGETHER):
            who = np.flatnonzero(ok[start : start + TOGETHER]) + start
            if not len(who):
                continue
            need = np.divide(least[who], reach[who], out=np.zeros(len(who)), where=reach[who] > 0)
            found = list(self.candidates(who, need, m, lists))
            dense = np.array([c is None for c in found])
            if dense.any():
                self.take(who[dense], scores(wide(self.q[who[dense]]), wide(m)), entries)
            for a, c in zip(who[~dense], (c for c in found if c is not None), strict=True):
                if len(c):
                    self.take(np.array([a]), scores(wide(self.q[a : a + 1]), wide(m[c])), entries[c])

    def take(self, who: np.ndarray, s: np.ndarray, entries: np.ndarray) -> None:
        """Scores of anchors against rows: the best so far take in what belongs to them."""
        fits = (self.labels[who, None] == entries["label"][None]) == self.same
        fits &= self.ids[who, None] != entries["id"][None]
        for slot in range(self.low.shape[1]):
            i, j = np.nonzero(fits & (s >= self.low[who, slot][:, None]) & (s <= self.high[who, slot][:, None]))
            if not len(i):
                continue
            order = np.lexsort((entries["id"][j], -s[i, j], i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            for f, e in zip(first.tolist(), [*first[1:].tolist(), len(i)], strict=True):
                e = min(e, f + self.k)
                a = int(who[i[f]])
                new = s[i[f], j[f:e]], entries["id"][j[f:e]]
                old = self.best.get((a, slot))
                v, n = (np.concatenate(x) for x in zip(old, new, strict=True)) if old else new
                keep = np.lexsort((n, -v))[: self.k]
                self.best[a, slot] = v[keep], n[keep]
                if len(keep) == self.k:  # what is below the last counts no more; its equals may by their id
                    self.low[a, slot] = max(self.low[a, slot], v[keep][-1])


@common.task()
def _search(batches, block, k: int, same: bool):
    ids, labels, dims, vectors, low, high = block.value
    find = Search(ids, labels, np.frombuffer(vectors, "<f8").reshape(len(ids), dims), low, high, k, same)
    for batch in batches:
        for n, d, longest, entries, rows, lists in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            find.bucket(longest, np.frombuffer(entries, ENTRY), np.frombuffer(rows, "<f8").reshape(n, d), np.frombuffer(lists, "<u2").reshape(d, n))
    found = [(int(find.ids[a]), slot, int(i), int(s)) for (a, slot), (v, n) in find.best.items() for s, i in zip(v, n, strict=True)]
    for start in range(0, len(found), 100_000):
        part = found[start : start + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], pa.int64()) for i in range(4)], names=["anchor", "slot", "id", "score"])


FOUND = "anchor long, slot long, id long, score long"


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each slot of each anchor, with their rank. A slot has k rows of each task at most."""
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def best(buckets: DataFrame, longest: float, block: tuple, k: int, same: bool) -> DataFrame:
    """ranked() for one block of anchors, written as a table. buckets: the index; longest: where its first part ends."""
    spark = buckets.sparkSession
    *fixed, low, high = block
    low, place, before = low.copy(), {int(a): i for i, a in enumerate(fixed[0])}, None
    for part in (buckets.filter(F.col("longest") >= longest), buckets.filter(F.col("longest") < longest)):
        shared = spark.sparkContext.broadcast((*fixed, low, high))
        rows = part.select("n", "dims", "longest", "entries", "rows", "lists").mapInArrow(partial(_search, block=shared, k=k, same=same), FOUND)
        found = common.table(spark, ranked(rows.unionByName(before.drop("rank")) if before else rows, k), "anchors-best")
        shared.destroy()
        if before is None:  # what must be beaten from here on: a row for a slot at most
            for r in found.filter(F.col("rank") == k).collect():
                low[place[r["anchor"]], r["slot"]] = max(low[place[r["anchor"]], r["slot"]], r["score"])
        before = found
    return found


@common.tidy("hard-negatives")
def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, moved: int | None = 7, labels: int = 10, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: rows whose id `every` divides. Their positives: the first rows of their label. For each, the first rows of other
    labels whose score is between `least` and `most` per cent of the positive's."""
    spark = vectors.sparkSession
    rows = common.table(spark, usable(vectors, id, vector, label, moved, labels), "vectors")
    buckets = index(rows)
    sizes = buckets.agg(F.max("dims"), F.percentile_approx("longest", 1 - FIRST, 1000)).first()
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0)
    each = max(1, min(ANCHORS, SENT // (8 * max(1, sizes[0] or 1))))
    blocks = -(-asked.count() // each) or 1
    by_block, out = common.new_path(spark, "anchor-blocks"), common.new_path(spark, "negatives-found")
    asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition(blocks, "block").write.partitionBy("block").parquet(by_block)
    asked = spark.read.schema("id long, label long, v array<double>, block long").parquet(by_block)
    result = None
    for block in range(blocks):
        some = asked.filter(F.col("block") == block).select("id", "label", "v").orderBy("id").collect()  # about `each` anchors
        if some or result is None:
            result = _of_block(buckets, sizes[1] or 0.0, some, positives, negatives, least, most)
            result.write.mode("append").option("compression", "zstd").parquet(out)
    return spark.read.schema(result.schema).parquet(out)


def _of_block(buckets: DataFrame, longest: float, some: list, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    ids, labels = np.array([r["id"] for r in some], np.int64), np.array([r["label"] for r in some], np.int64)
    dims = max([1, *(len(r["v"]) for r in some)])
    m = np.zeros((len(some), dims))
    for i, r in enumerate(some):
        m[i, : len(r["v"])] = r["v"]
    data, bound = m.tobytes(), np.int64(MOST)
    one = np.full((len(some), 1), bound)
    own = best(buckets, longest, (ids, labels, dims, data, -one, one), positives, True).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    place = {int(a): i for i, a in enumerate(ids)}
    low, high = np.full((len(some), positives), bound), np.full((len(some), positives), -bound)  # a slot without a positive takes nothing
    for r in own.collect():  # `positives` rows an anchor at most
        a, slot, s = place[r["anchor"]], r["slot"], r["positive_score"]
        low[a, slot], high[a, slot] = -(-least * s // 100), most * s // 100
    found = best(buckets, longest, (ids, labels, dims, data, low, high), negatives, False)
    return found.join(own, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
