"""Near-duplicate documents by SimHash: fingerprints that differ in few bits, met by a self-join of binary tries.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles. Documents with one
fingerprint are one class; only classes are joined.

The join walks pairs of trie nodes, depth by depth, adds up the bits in which their paths differ, and drops a
pair as soon as these exceed what the depth allows. There are four tries, of the fingerprints turned left by 0, 16,
32 and 48 bits. Of two fingerprints within `most` bits one turn has, for each k, at most k * most / 4 of the differing
bits in its first k blocks of 16 (the cycle lemma); so each trie allows 0, most / 4, ... errors by depth, and the
four together find all pairs. As the first block allows no error (most is 3 or less), the walk begins with the pairs
(node, itself) of depth 16, and these are what Spark deals out. A node of over `LARGE` fingerprints is not one task: its
pair is replaced by the pairs of its descendants eight bits deeper that the budget allows, which Spark joins.

A task walks for 1, 2, ... bits in turn and leaves out pairs of nodes that lie in one component
already, so that thousands of close fingerprints are not compared with each other one by one; it gives
as many links as join the components of what it holds, not all.

Null texts and texts without words have fingerprint 0 and are linked like any other. Rows without an id have a
fingerprint, component_id null, and no links. Rows that repeat an id are the same document: all their
fingerprints count as linked. Extra columns are left out; an empty table gives an empty result; texts of any
length are read whole.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .minhash import components

BLOCK = 16  # bits
BLOCKS = 4
LARGE = 1 << 17  # fingerprints of a pair of nodes that one task walks
HELD = 1 << 18  # rows that a task gathers before it walks
STEP = 8  # bits by which Spark goes deeper
LEAF = 16  # pairs of fingerprints below which two nodes are compared outright
WIDE = 1 << 18  # pairs of nodes walked at a time


def hashes(text: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of each shingle, repeats included; of the whole sequence if it has fewer words."""
    found = text.lower().split()  # of bytes: A-Z, and the six kinds of white space
    if not found:
        return []
    joined, xxh = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return [xxh(joined, seed)]
    end = np.cumsum([len(w) + 1 for w in found])
    start = np.concatenate([[0], end[:-1]])
    return [xxh(joined[a:b], seed) for a, b in zip(start[: len(found) - words + 1].tolist(), (end[words - 1 :] - 1).tolist(), strict=True)]


def majority(found: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of hashes, as unsigned 64-bit integers."""
    out = np.zeros(len(found), "<u8")
    full = [i for i, x in enumerate(found) if x]
    if full:
        n = np.array([len(found[i]) for i in full])
        ones = np.zeros((len(full), 64), np.int64)
        for part in cut_lists(n):  # a long text may be cut
            rows, flat = part
            h = np.array([x for i, a, b in rows for x in found[full[i]][a:b]], "<u8") if flat else np.zeros(0, "<u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.cumsum([0, *(b - a for _, a, b in rows[:-1])])
            np.add.at(ones, [i for i, _, _ in rows], np.add.reduceat(bits, first, axis=0, dtype=np.int64))
        out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def cut_lists(n: np.ndarray, most: int = 1 << 17):
    """Cut lists of these lengths into runs of at most `most` entries: ([(list, from, to)], entries)."""
    rows, held = [], 0
    for i, k in enumerate(n.tolist()):
        at = 0
        while at < k:
            take = min(k - at, most - held)
            rows.append((i, at, at + take))
            at, held = at + take, held + take
            if held == most:
                yield rows, held
                rows, held = [], 0
    if rows:
        yield rows, held


@common.task()
def _fingerprints(batches, words: int, seed: int):
    for batch in batches:
        texts = batch.column(1)
        sizes = texts.fill_null(b"").to_pylist()
        for a, b in common.slices(sizes, 1_000_000):
            fp = majority([hashes(x, words, seed) for x in sizes[a:b]])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view("<i8"))], names=["id", "fp"])


# the walk


def allowed(depth: int, most: int) -> int:
    """Differing bits down to a depth, of the turn that spreads them so."""
    return most * -(-depth // BLOCK) // BLOCKS


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label[x]: the least index of x's component; the components that the links (i, j) join become one."""
    while True:
        a, b = label[i], label[j]
        go = a != b
        if not go.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[go], np.minimum(a, b)[go])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _members(a0, a1, b0, b1):
    """The index pairs of nodes a and b; of a node with itself, each once."""
    n, m = a1 - a0, b1 - b0
    size = n * m
    of = np.repeat(np.arange(len(n)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    i, j = a0[of] + k // m[of], b0[of] + k % m[of]
    ok = (a0[of] != b0[of]) | (i < j)
    return i[ok], j[ok]


def walk(keys: np.ndarray, nodes: tuple, depth: int, most: int, label: np.ndarray) -> np.ndarray:
    """Labels of the components after all pairs within `most` bits of these pairs of nodes are joined.

    keys: sorted within each node. nodes: first and end of a, first and end of b, differing bits so far."""
    ones = {}
    todo = [(depth, *nodes)]
    while todo:
        at, a0, a1, b0, b1, errors = todo.pop()
        if len(a0) > WIDE:
            half = len(a0) // 2
            todo += [(at, *(x[half:] for x in (a0, a1, b0, b1, errors))), (at, *(x[:half] for x in (a0, a1, b0, b1, errors)))]
            continue
        change = np.cumsum(np.concatenate([[False], label[1:] != label[:-1]]))
        one = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (label[a0] == label[b0])  # all of both in one component
        a0, a1, b0, b1, errors = (x[~one] for x in (a0, a1, b0, b1, errors))
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (at == 64)
        if small.any():
            i, j = _members(*(x[small] for x in (a0, a1, b0, b1)))
            near = np.bitwise_count(keys[i] ^ keys[j]) <= most
            label = join_labels(label, i[near], j[near])
            a0, a1, b0, b1, errors = (x[~small] for x in (a0, a1, b0, b1, errors))
        if not len(a0):
            continue
        if at not in ones:
            ones[at] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - at)) & np.uint64(1), dtype=np.int64)])
        c = ones[at]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])  # where the ones of a node begin
        self_ = a0 == b0
        parts = [(a0, am, b0, bm, errors), (am, a1, bm, b1, errors), (a0, am, bm, b1, errors + 1)]
        cross = tuple(x[~self_] for x in (am, a1, b0, bm, errors + 1))
        a0, a1, b0, b1, errors = (np.concatenate([*x]) for x in zip(*parts, cross, strict=True))
        ok = (a1 > a0) & (b1 > b0) & (errors <= allowed(at + 1, most))
        todo.append((at + 1, *(x[ok] for x in (a0, a1, b0, b1, errors))))
    return label


def links_of(turn, depth, pair, side, key, errors, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (turn, depth, pair, side, key), whole pairs of nodes: fingerprints a and b that lie in one component, as many as join them."""
    edge = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1])]))
    end = np.concatenate([edge[1:], [len(pair)]])
    right = edge + np.add.reduceat((side == 0).astype(np.int64), edge)
    alone = right == end  # a node with itself
    nodes = edge, np.where(alone, end, right), np.where(alone, edge, right), end, errors[edge].astype(np.int64)
    label = np.arange(len(key))
    for bits in range(1, most + 1) if most else (0,):
        for d in np.unique(depth[edge]):
            of = (depth[edge] == d) & (nodes[4] <= allowed(int(d), bits))
            label = walk(key, tuple(x[of] for x in nodes), int(d), bits, label)
    other = np.flatnonzero(label != np.arange(len(key)))
    back = (BLOCK * turn).astype(np.uint64)
    fp = np.where(back == 0, key, (key >> back) | (key << ((np.uint64(64) - back) & np.uint64(63))))
    a, b = fp[other], fp[label[other]]
    return a[a != b], b[a != b]


@common.task()
def _walks(batches, most: int):
    """Batches in the order that links_of() asks for; whole pairs of nodes are gathered up to about HELD rows."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table):
        turn, depth, p, q, errors, side, key = (c.to_numpy() for c in t.columns)
        new = np.concatenate([[True], (turn[1:] != turn[:-1]) | (depth[1:] != depth[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        a, b = links_of(turn, depth, np.cumsum(new), side, key.view("<u8"), errors, most)
        return pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            t = pa.Table.from_batches(held).combine_chunks()
            group = [t.column(i).to_numpy() for i in range(4)]
            last = np.flatnonzero(np.logical_or.reduce([g[1:] != g[:-1] for g in group]))
            if len(last):  # what may go on in the next batch stays
                yield flush(t.slice(0, int(last[-1]) + 1))
                held = t.slice(int(last[-1]) + 1).to_batches()
    if held:
        yield flush(pa.Table.from_batches(held).combine_chunks())


# what Spark deals out


def _turned(fp: str, turn) -> "F.Column":
    left = lambda k: F.shiftleft(fp, k).bitwiseOR(F.shiftrightunsigned(fp, 64 - k))
    return F.when(turn == 0, F.col(fp)).when(turn == 1, left(16)).when(turn == 2, left(32)).otherwise(left(48))


def node_pairs(member: DataFrame, most: int, large: int) -> DataFrame:
    """turn, depth, p, q, errors: the pairs of nodes whose walks find all links, each of at most `large` fingerprints (but for single nodes at the last depth)."""
    spark = member.sparkSession
    prefix = lambda depth: F.shiftrightunsigned("key", 64 - depth)
    depth, done = BLOCK, []
    nodes = member.groupBy("turn", prefix(depth).alias("p")).agg(F.count("*").alias("n")).filter("n > 1")
    pairs = common.table(spark, nodes.select("turn", F.lit(depth).alias("depth"), "p", F.col("p").alias("q"), F.lit(0).alias("errors"), "n"), "trie-pairs")
    while True:
        big = pairs.filter(F.col("n") > large)
        done.append(pairs.filter(F.col("n") <= large).drop("n"))
        if depth >= 64 - STEP or big.isEmpty():
            done.append(big.drop("n"))
            break
        depth += STEP
        held = big.select("turn", "p").union(big.select("turn", "q")).distinct()
        below = member.select("turn", prefix(depth - STEP).alias("p"), prefix(depth).alias("c")).join(held, ["turn", "p"]).groupBy("turn", "p", "c").agg(F.count("*").alias("k"))
        below = common.table(spark, below, "trie-nodes")
        left, right = below.withColumnsRenamed({"c": "cp", "k": "kp"}), below.withColumnsRenamed({"p": "q", "c": "cq", "k": "kq"})
        new = big.join(left, ["turn", "p"]).join(right, ["turn", "q"]).withColumn("errors", F.bit_count(F.col("cp").bitwiseXOR(F.col("cq"))))
        new = new.filter((F.col("errors") <= allowed(depth, most)) & ((F.col("p") != F.col("q")) | (F.col("cp") <= F.col("cq"))))
        n = F.when(F.col("cp") == F.col("cq"), F.col("kp")).otherwise(F.col("kp") + F.col("kq"))
        pairs = common.table(spark, new.select("turn", F.lit(depth).alias("depth"), F.col("cp").alias("p"), F.col("cq").alias("q"), "errors", n.alias("n")).filter("n > 1"), "trie-pairs")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def links(classes: DataFrame, most: int = 3, large: int = LARGE) -> DataFrame:
    """a, b: links that join the components of the distinct fingerprints (column fp)."""
    if not 0 <= most < BLOCKS:
        raise ValueError(f"between 0 and {BLOCKS - 1} bits")
    spark = classes.sparkSession
    turns = F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("turn")
    member = classes.select("fp", turns).select("turn", _turned("fp", F.col("turn")).alias("key"))
    pairs = common.table(spark, node_pairs(member, most, large), "trie-walks")
    depths = [r["depth"] for r in pairs.select("depth").distinct().collect()]
    rows = None
    for d in depths:
        here, own = pairs.filter(F.col("depth") == d), member.withColumn("node", F.shiftrightunsigned("key", 64 - d))
        for side, node in enumerate(("p", "q")):
            of = here if side == 0 else here.filter("p <> q")
            part = own.withColumnRenamed("node", node).join(of, ["turn", node]).select("turn", "depth", "p", "q", "errors", F.lit(side).alias("side"), "key")
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], "a long, b long")
    group = ("turn", "depth", "p", "q")
    rows = rows.repartition(*group).sortWithinPartitions(*group, "side", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))  # as unsigned
    return rows.mapInArrow(partial(_walks, most=most), "a long, b long")


@common.tidy("simhash")
def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, seed: int = 42, large: int = LARGE, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row: id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable over links of at most `most` bits)."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    rows = common.table(spark, docs.mapInArrow(partial(_fingerprints, words=words, seed=seed), "id long, fp long"), "simhash-rows")
    named = rows.filter("id IS NOT NULL")
    classes = common.table(spark, named.groupBy("fp").agg(F.min("id").alias("id")), "simhash-classes")
    several = named.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z")
    several = named.join(several.select("id", "a"), "id").filter("fp <> a").select("a", F.col("fp").alias("b"))
    comp = components(spark, links(classes, most, large).unionByName(several))
    of = classes.join(comp.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of = common.table(spark, of.select("fp", "root", "id"), "simhash-roots")
    least = of.groupBy("root").agg(F.min("id").alias("component"))
    of = of.select("fp", "root").join(least, "root").select("fp", "component")
    out = rows.join(of, "fp", "left")
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
