"""Exact removal of byte strings of 200 or more that occur elsewhere.

Every 200-byte window is named by an anchor, the least of its 32-byte grams by hash, so equal
windows have equal anchors at equal places. Only anchors whose gram occurs twice matter; all
text around others is left aside. For these:

1. occurrences whose whole surroundings (all windows that the anchor names) are equal by a 128-bit cryptographic
   digest of their bytes form a class; a class of two or more is repeated throughout;
2. surroundings of one gram that differ are compared in full. Each is two strings aligned at the anchor: the 200
   bytes from it on, and the 168 before it, read backwards. The texts are dealt into `SHARDS` shards; each shard's
   strings, range by range of grams, get their positional Burrows-Wheeler transforms, one task each, which are written out.
   Other tasks merge the transforms of all shards two by two by interleave refinement: column by column the
   interleave of two transforms is refined by a stable partition on the merged symbols, and no string is sorted
   anew. Inverting the merged transform gives the strings in order and so the common prefixes of neighbours; a threshold
   on them cuts the order into repeated intervals;
3. a window that starts h bytes before the anchor repeats if another row lies in its interval at 200 - h of the
   strings from the anchor on, and in its interval at h of those before it. No hash takes part in this.

Grams with more than `MANY` different surroundings (the edge of a passage that very many
documents share) are too many for one task: their windows are counted by a 128-bit cryptographic digest, spread evenly.

Texts are taken as UTF-8 bytes, nulls as empty; texts equal by SHA-256 are one class from the start. Texts
under 200 bytes lose nothing. Repeated rows each get the result of their text; a null id is an id
like others; extra columns are left out of the result; an empty table gives an empty result.
Texts of any length are read whole, in stretches that overlap by a window.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 200
GRAM = 32
MANY = 2048
SHARDS = 4
RANGE = 12_000  # surroundings compared in one task, about
STRETCH = (1 << 20) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = common.mix(np.arange(256, dtype=np.uint64), 21)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]), dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, STRETCH + 2), _powers(_INVERSE, STRETCH + 2)


class Sums:
    """Prefix sums of a rolling hash over one stretch of bytes."""

    def __init__(self, b: np.ndarray):
        with np.errstate(over="ignore"):
            self.s = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[b] * _UP[: len(b)], dtype=np.uint64)])

    def hash(self, start, end, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return common.mix((self.s[end] - self.s[start]) * _DOWN[start], seed)


def anchors(b: np.ndarray, sums: Sums, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of all windows that lie within one text: place, first and last window, gram hash.

    ends: where each text of the stretch ends."""
    n, w = len(b), WINDOW - GRAM + 1
    starts = np.arange(max(n - WINDOW + 1, 0))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    g = np.arange(n - GRAM + 1)
    h = sums.hash(g, g + GRAM, 31)
    order = (h & np.uint64(0xFFFFFFFFFFF00000)) | g.astype(np.uint64)
    pad = np.full(-(-len(order) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[: len(order)] = order
    rows = pad.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(after[starts], before[starts + w - 1])
    owner = (least & np.uint64(0xFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, starts, side="right")
    ok = starts + WINDOW <= ends[text]
    run = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(run[1:], len(starts)) - 1
    # windows across a text's end stand at the end of its run
    good = np.concatenate([[0], np.cumsum(ok)])
    many = good[last + 1] - good[run]
    keep = many > 0
    run, many = run[keep], many[keep]
    place = owner[run]
    return place, run, run + many - 1, h[place]


def stretches(raws: list[bytes]):
    """Runs of texts of at most STRETCH bytes together: (first, their bytes, offset in the first); a longer text alone, in overlapping parts."""
    a, held = 0, 0
    for i, r in enumerate(raws):
        if held + len(r) > STRETCH and i > a:
            yield a, raws[a:i], 0
            a, held = i, 0
        if len(r) > STRETCH:
            for at in range(0, len(r) - WINDOW + 1, STRETCH - WINDOW + 1):
                yield i, [r[at : at + STRETCH]], at
            a, held = i + 1, 0
        else:
            held += len(r)
    if a < len(raws):
        yield a, raws[a:], 0


@common.task()
def _anchors(batches):
    for batch in batches:
        raws = [t.encode() for t in batch.column(1).to_pylist()]
        for first, part, at in stretches(raws):
            b = np.frombuffer(b"".join(part), np.uint8)
            ends = np.cumsum([len(x) for x in part])
            sums = Sums(b)
            place, lo, hi, h = anchors(b, sums, ends)
            text = np.searchsorted(ends, place, side="right")
            begin = np.concatenate([[0], ends])[text]
            data, sizes = b.tobytes(), np.stack([place - lo, hi - lo], 1).astype("<i2").tobytes()
            around = [hashlib.blake2b(data[x : y + WINDOW] + sizes[4 * k : 4 * k + 4], digest_size=16).digest() for k, (x, y) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(first + text)), pa.array((place - begin + at).astype(np.int32)), pa.array((place - lo).astype(np.int16)), pa.array((hi - lo).astype(np.int16)),
                pa.array(h.view(np.int64)), pa.array(around, pa.binary()),
            ], names=["t", "place", "head", "more", "gram", "around"])


# --- positional Burrows-Wheeler transforms


def transform(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard's strings (rows of symbols): each column's symbols in the order of what follows that column, and the final order."""
    order = np.arange(len(columns))
    out = np.empty_like(columns.T)
    for j in range(columns.shape[1] - 1, -1, -1):
        out[j] = columns[order, j]
        order = order[np.argsort(out[j], kind="stable")]
    return out, order


def merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge two transforms: the merged one, and which of its final rows come from b.

    The interleave starts as all of a, then all of b; each column refines it by a stable partition
    on the merged symbols. The order of a's rows among themselves, and of b's, is never touched."""
    from_b = np.concatenate([np.zeros(a.shape[1], bool), np.ones(b.shape[1], bool)])
    out = np.empty((len(a), len(from_b)), a.dtype)
    for j in range(len(a) - 1, -1, -1):
        out[j, ~from_b], out[j, from_b] = a[j], b[j]
        from_b = from_b[np.argsort(out[j], kind="stable")]
    return out, from_b


def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms two by two: the merged one, and of its final rows where each stands in the parts' final orders, one after another."""
    ends = np.cumsum([p.shape[1] for p in parts])
    todo = [(p, np.arange(e - p.shape[1], e)) for p, e in zip(parts, ends, strict=True)]
    while len(todo) > 1:
        joined = []
        for (a, x), (b, y) in zip(todo[::2], todo[1::2], strict=False):
            t, from_b = merge(a, b)
            rows = np.empty(len(from_b), np.int64)
            rows[~from_b], rows[from_b] = x, y
            joined.append((t, rows))
        todo = joined + todo[len(todo) // 2 * 2 :]
    return todo[0]


def common_prefixes(t: np.ndarray) -> np.ndarray:
    """Of a transform's strings, in order, the bytes that each shares with the one before it; the transform is inverted column by column."""
    n = t.shape[1]
    at, shared, alike = np.arange(n), np.zeros(n, np.int64), np.arange(n) > 0
    for column in t:
        at = np.argsort(column, kind="stable")[at]
        symbols = column[at]
        differ = np.zeros(n, np.uint64)
        differ[1:] = symbols[1:] ^ symbols[:-1]
        zeros = np.full(n, 8)
        some = np.flatnonzero(differ)
        zeros[some] = (differ[some, None].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
        shared += np.where(alike, zeros, 0)
        alike &= differ == 0
    return shared


def intervals(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """The interval of each row: neighbours in the order with at least so many common bytes are in one."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < least)
    return out


def columns_of(raw: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of 64-bit symbols, first byte highest, zeros behind."""
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), ">u8").reshape(len(raw), width // 8).astype(np.uint64)


SIDE = WINDOW - GRAM
_SHARD = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("on", "on_order", "back", "back_order", "gram", "around", "head", "more")]])


def shard_transform(rows: pa.Table) -> pa.Table:
    """The transforms of one shard's strings in one range of grams, as one row."""
    raw, head = rows["bytes"].to_pylist(), rows["head"].to_pylist()
    on, on_order = transform(columns_of([x[h : h + WINDOW] for x, h in zip(raw, head, strict=True)], WINDOW))
    back, back_order = transform(columns_of([x[:h][::-1] for x, h in zip(raw, head, strict=True)], SIDE))
    kept = [rows[c].to_numpy().astype(k).tobytes() for c, k in (("gram", "<i8"), ("around", "<i8"), ("head", "<i4"), ("more", "<i4"))]
    value = [rows["range"][0].as_py(), rows["shard"][0].as_py(), len(raw), on.tobytes(), on_order.tobytes(), back.tobytes(), back_order.tobytes(), *kept]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(value, _SHARD.types, strict=True)], schema=_SHARD)


def repeated_heads(shards: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the shards of one range, the rows' gram and around, and rows x heads: whether the window that starts so many bytes before the anchor is repeated.

    A row has the windows with head - more <= h <= head."""
    gram, around, head, more = (np.concatenate([np.frombuffer(x[c], k) for x in shards]) for c, k in (("gram", "<i8"), ("around", "<i8"), ("head", "<i4"), ("more", "<i4")))
    first = np.cumsum([0, *[x["n"] for x in shards]])
    prefixes, orders = {}, {}
    for side in ("on", "back"):
        t, rows = merged([np.frombuffer(x[side], np.uint64).reshape(-1, x["n"]) for x in shards])
        orders[side] = np.concatenate([np.frombuffer(x[f"{side}_order"], np.int64) + a for x, a in zip(shards, first, strict=False)])[rows]
        prefixes[side] = common_prefixes(t)
    out = np.zeros((len(gram), SIDE + 1), bool)
    for h in range(SIDE + 1):
        live = np.flatnonzero((head >= h) & (head - more <= h))
        if len(live) < 2:
            continue
        key = intervals(orders["on"], prefixes["on"], WINDOW - h)[live] * (len(gram) + 1) + intervals(orders["back"], prefixes["back"], h)[live]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        out[live[by[1:][same]], h] = True
        out[live[by[:-1][same]], h] = True
    return gram, around, out


def _compare(shards: pa.Table) -> pa.Table:
    """Merge the shards of one range and say which heads of which surroundings repeat."""
    gram, around, hit = repeated_heads(sorted(shards.to_pylist(), key=lambda x: x["shard"]))
    some = np.flatnonzero(hit.any(1))
    return pa.table({"gram": pa.array(gram[some]), "around": pa.array(around[some]), "heads": pa.array([np.flatnonzero(x).astype(np.int32) for x in hit[some]], pa.list_(pa.int32()))})


@common.task()
def _surroundings(batches):
    """The bytes around the anchors that are asked for, from their texts."""
    for batch in batches:
        out = []
        for t, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = text.encode()
            for w in wanted:
                lo = w["place"] - w["head"]
                out.append((t, w["gram"], w["kind"], w["head"], w["more"], raw[lo : lo + w["more"] + WINDOW]))
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names=["t", "gram", "around", "head", "more", "bytes"])


@common.task()
def _windows(batches):
    """A row for each window of each surrounding: its hash and its head."""
    for batch in batches:
        for gram, around, head, more, raw in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
            n = more + 1
            w = [hashlib.blake2b(raw[k : k + WINDOW], digest_size=16).digest() for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(np.full(n, gram)), pa.array(np.full(n, around)), pa.array((head - np.arange(n)).astype(np.int32))], names=["w", "gram", "around", "h"])


def gone_bytes(sizes: np.ndarray, copies: np.ndarray, found: pa.ListArray) -> np.ndarray:
    """Of texts one after another, with one more place behind each, whether a byte goes. found: of each text, anchors with place, head, more and heads."""
    base = np.cumsum(sizes + 1) - sizes - 1
    offsets, x = found.offsets.to_numpy(), found.values.slice(found.offsets[0].as_py(), found.offsets[-1].as_py() - found.offsets[0].as_py())
    many = np.where(found.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    place, head, more = (x.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "head", "more"))
    start = np.repeat(base, many) + place  # of the anchors
    all_ = x.field("heads").is_null().to_numpy(zero_copy_only=False)
    heads = x.field("heads")
    per = np.where(all_, 0, np.diff(heads.offsets.to_numpy()))
    some = np.repeat(start, per) - heads.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    whole = np.flatnonzero((copies > 1) & (sizes >= WINDOW))
    lo = np.concatenate([start[all_] - head[all_], some, base[whole]])
    hi = np.concatenate([start[all_] - head[all_] + more[all_] + WINDOW, some + WINDOW, base[whole] + sizes[whole]])
    n = int((sizes + 1).sum())
    return np.cumsum(np.bincount(lo, minlength=n) - np.bincount(hi, minlength=n)) > 0


@common.task()
def _cut(batches, with_text: bool):
    types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in common.slices(texts, 4_000_000):
            raws = [t.encode() for t in texts[a:b]]
            sizes = np.array([len(x) for x in raws], np.int64)
            # fresh arrays: their offsets begin at 0
            gone = gone_bytes(sizes, batch.column(2).slice(a, b - a).to_numpy(), batch.column(3).take(pa.array(np.arange(a, b))))
            data, ends = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8), np.cumsum(sizes + 1)
            out = []
            for raw, lo, n in zip(raws, (ends - sizes - 1).tolist(), sizes.tolist(), strict=True):
                g = gone[lo : lo + n]
                removed = int(np.count_nonzero(g))
                kept = data[lo : lo + n][~g].tobytes() if removed else raw
                spans = int(np.count_nonzero(g[1:] > g[:-1])) + int(g[0]) if removed else 0
                out.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
            cols = [batch.column(0).slice(a, b - a), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), types[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(cols, names=["t", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """All columns of docs, then n_bytes, n_removed, n_spans, kept_sha256 and, unless left out, `kept`: the text without
    repeated bytes (a character cut in two goes whole). The new columns replace old ones of their names."""
    spark = docs.sparkSession
    common.ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    # one row per different text, in buckets by digest: the text is dealt out once, later joins read it where it lies
    name, path, left = f"texts_{uuid.uuid4().hex}", common.new_path(spark, "texts"), common.new_path(spark, "cut-texts")
    texts = docs.select(digest.alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("t").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    try:
        # buckets need a name in the catalogue; it goes as soon as what was cut is written
        with common.owned(spark) as own:
            texts.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "t").saveAsTable(name)
            cut = _cut_texts(spark.table(name), with_text)
            cut = common.table(spark, cut, "cut-texts", left)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        common.delete(spark, path)
    common.drop(spark, own)
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    # __t: no column of docs may stand in its way
    return docs.drop(*new).withColumn("__t", digest).join(cut.select(F.col("t").alias("__t"), *new), "__t").drop("__t")


def _cut_texts(texts: DataFrame, with_text: bool) -> DataFrame:
    """What is left of each text. texts: t, text, copies."""
    spark = texts.sparkSession
    long_texts = texts.filter(F.octet_length("text") >= WINDOW)

    found = common.table(spark, long_texts.select("t", "text").mapInArrow(_anchors, "t binary, place int, head short, more short, gram long, around binary"), "anchors")
    # a table, not an aggregate, meets the anchors: Spark can then split a gram that very many share
    twice = common.table(spark, found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "repeated-grams")
    found = common.table(spark, found.join(twice, "gram"), "repeated-anchors")
    classes = found.groupBy("gram", "around").agg(F.count("*").alias("members"), F.min(F.struct("t", "place", "head", "more")).alias("one"))
    classes = common.table(spark, classes.withColumn("kind", F.monotonically_increasing_id()), "surroundings")  # written: a kind keeps its number
    differ = common.table(spark, classes.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "differing-grams")
    wanted = common.table(spark, classes.join(differ, "gram").select("one.*", "gram", "kind", (F.col("kinds") > MANY).alias("many")), "wanted")

    def surroundings(rows: DataFrame) -> DataFrame:
        asked = rows.groupBy("t").agg(F.collect_list(F.struct("gram", "kind", "place", "head", "more")).alias("wanted"))
        return long_texts.join(asked, "t").select("t", "text", "wanted").mapInArrow(_surroundings, "t binary, gram long, around long, head int, more int, bytes binary")

    ranges = -(-wanted.filter("NOT many").count() // RANGE) or 1
    near = surroundings(wanted.filter("NOT many"))
    near = near.withColumn("range", F.pmod(F.xxhash64("gram"), F.lit(ranges))).withColumn("shard", F.pmod(F.xxhash64("t"), F.lit(SHARDS)))
    shards = near.drop("t").groupBy("range", "shard").applyInArrow(shard_transform, "range long, shard long, n long, on binary, on_order binary, back binary, back_order binary, gram binary, around binary, head binary, more binary")
    shards = common.table(spark, shards, "shard-transforms")
    compared = shards.groupBy("range").applyInArrow(_compare, "gram long, around long, heads array<int>")
    spread = common.table(spark, surroundings(wanted.filter("many")).mapInArrow(_windows, "w binary, gram long, around long, h int"), "windows")
    again = common.table(spark, spread.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w"), "repeated-windows")
    counted = spread.join(again, "w").groupBy("gram", "around").agg(F.collect_set("h").alias("heads"))
    partly = common.table(spark, compared.unionByName(counted), "repeated-heads").withColumnRenamed("around", "kind")

    whole = classes.filter("members > 1").select("gram", "around", F.lit(None).cast("array<int>").alias("heads"))
    single = classes.filter("members = 1").select("gram", "kind", "around").join(partly, ["gram", "kind"]).drop("kind")
    hit = found.join(whole.unionByName(single), ["gram", "around"]).groupBy("t").agg(F.collect_list(F.struct("place", "head", "more", "heads")).alias("found"))
    return texts.join(hit, "t", "left").select("t", "text", "copies", "found").mapInArrow(lambda b: _cut(b, with_text), "t binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
