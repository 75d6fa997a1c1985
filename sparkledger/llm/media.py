"""Cropped or edited copies of pictures by local descriptors.

Corners are found at several scales of each picture, at most `CORNERS` of each scale, the strongest; each gets an
orientation (the intensity centroid of its patch) and 128 binary tests turned by it. Descriptors meet in seven Hamming
tables of 18 or 20 bits, where the queries are listed under every value one bit off as well: two at distance 13 or less
meet in at least one table, as one of seven parts then differs in one bit at most. The stated queries
are held against all rows in blocks of about `BLOCK` pictures: for each block its corners are broadcast, the corners of
all pictures are read once where they lie, the pairs found are written, and the broadcast is given back, so neither
plans nor broadcasts grow with the data. The corners of a picture meet those of a block in one
place: pairs within `MOST` bits are counted there, and only pairs of pictures leave the task. A copy is
confirmed if one turn, zoom and shift carries at least `VOTES` corners of one picture to their
counterparts, and the orientations and scales of these corners differ by that turn and zoom.
All pairs within 13 bits are found, of those with 14 to `MOST` bits most: the tables guarantee no more. A picture whose
strongest corners a crop or an edit takes away may be missed: `CORNERS` bounds what is known of a picture. Scales stand 0.84 apart, so
that a copy of half to twice the size has corners within a tenth of the original's at several of them; of a crop to half a side about half
are found, and mirrored copies are not.

Pictures with equal pixels are one class: they are described and compared once a batch, and a page inherits what its
class found. Null or undecodable pictures have no corners and match nothing. Repeated ids are one
page each; a null id is a page without a class of its own, and never a query; extra columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIDE = 96
SCALES = (1.0, 0.84, 0.7, 0.59, 0.5)
CORNERS = (24, 18, 14, 12, 10)  # a scale
RADIUS = 7
MOST = 20
VOTES = 6
PLACES = 4  # that the corners of a copy stand in, at least
NEAR = 3  # pixels
TURN = 0.5  # radians that the orientation of a corner may be off
AT_ONCE = 1 << 16  # pairs of corners compared in one step
CROWD = 1 << 13  # pairs under one value of a table, from which they are compared by themselves
BLOCK = 2000  # query pictures at once
TOGETHER = 8192  # pictures held against them at once
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])
_TURNS = 72


def turned(tests: np.ndarray) -> np.ndarray:
    """The tests at each of the orientations: turns x tests x (y1, x1, y2, x2)."""
    out = []
    for t in range(_TURNS):
        c, s = np.cos(2 * np.pi * t / _TURNS), np.sin(2 * np.pi * t / _TURNS)
        y, x = tests[:, ::2], tests[:, 1::2]
        out.append(np.stack([np.rint(s * x + c * y), np.rint(c * x - s * y)], -1).reshape(len(tests), 4))
    return np.clip(np.array(out), -RADIUS - 2, RADIUS + 2).astype(np.int64)


@lru_cache(maxsize=2)
def binary_tests(drawn: int = 1500, pictures: int = 96, stable: float = 0.6) -> np.ndarray:
    """128 tests (y1, x1, y2, x2), chosen by a rule: of tests drawn at random those that split the corners of drawn pictures
    most evenly and change least when these are turned and resized, as unlike each other as 128 of them can be.
    They are dealt so that the bits of one table are least alike. Chance matches are what this keeps low."""
    rng = np.random.default_rng(3)
    tests = np.clip(np.rint(rng.normal(0, RADIUS * 0.5, (drawn, 4))), -RADIUS, RADIUS)
    tests = np.unique(tests[(tests[:, :2] != tests[:, 2:]).any(1)], axis=0)
    at_turn = turned(tests)
    pics = np.stack([render(b"sample %d" % i) for i in range(pictures)])
    i, y, x = corners(pics.astype(np.float32), CORNERS[0])
    bits = descriptor(pics.astype(np.float32), i, y, x, at_turn)[1]
    changed = []
    for turn, zoom in ((0.3, 1.0), (0.0, 0.87), (0.2, 1.15)):
        other = np.stack([warp(p, turn, zoom) for p in pics]).astype(np.float32)
        (h, w), c, s, dy, dx = other.shape[1:], np.cos(turn), np.sin(turn), y - (SIDE - 1) / 2, x - (SIDE - 1) / 2
        to_y, to_x = np.rint((c * dy - s * dx) * zoom + (h - 1) / 2).astype(int), np.rint((s * dy + c * dx) * zoom + (w - 1) / 2).astype(int)
        edge = RADIUS + 3
        ok = (to_y >= edge) & (to_y < h - edge) & (to_x >= edge) & (to_x < w - edge)
        changed.append((descriptor(other, i[ok], to_y[ok], to_x[ok], at_turn)[1] != bits[ok]).mean(0))
    alike = abs(np.corrcoef(bits.T.astype(np.float32)))
    order = np.argsort(abs(bits.mean(0) - 0.5) + stable * np.mean(changed, 0), kind="stable")
    for limit in np.arange(0.1, 1.2, 0.02):
        found: list[int] = []
        for k in order:
            if len(found) < 128 and (not found or alike[k, found].max() < limit):
                found.append(k)
        if len(found) == 128:
            break
    dealt: list[list[int]] = [[] for _ in PARTS]
    for k in found:
        free = [j for j, (_, n) in enumerate(PARTS) if len(dealt[j]) < n]
        dealt[min(free, key=lambda j: (max(alike[k, dealt[j]], default=0), len(dealt[j])))].append(k)
    return tests[np.concatenate(dealt).astype(int)]


def render(seed: bytes) -> np.ndarray:
    """A picture drawn from a digest: blocks of grey on a grain of its own."""
    rng = np.random.default_rng(np.frombuffer(hashlib.sha256(seed).digest(), np.uint32))
    n = 40
    grain = box(rng.integers(-60, 60, (1, SIDE, SIDE)).astype(np.float32))[0] / 3
    g = np.full((SIDE, SIDE), 90, np.float32)
    y, x = rng.integers(0, SIDE - 6, (2, n))
    h, w = rng.integers(5, 26, (2, n))
    v = rng.integers(0, 200, n)
    for top, left, end, right, grey in zip(y.tolist(), x.tolist(), (y + h).tolist(), (x + w).tolist(), v.tolist(), strict=True):
        g[top:end, left:right] = grey
    return np.clip(g + grain, 0, 255).astype(np.uint8)


def warp(p: np.ndarray, turn: float, zoom: float) -> np.ndarray:
    """A picture turned about its middle (radians; what lies outside repeats the edge) and resized."""
    h, w = p.shape
    n, m = round(h * zoom), round(w * zoom)
    y, x = ((np.arange(k, dtype=np.float32) - (k - 1) / 2) / zoom for k in (n, m))
    c, s = np.float32(np.cos(turn)), np.float32(np.sin(turn))
    sy, sx = (c * y[:, None] + s * x + (h - 1) / 2).clip(0, h - 1), (c * x - s * y[:, None] + (w - 1) / 2).clip(0, w - 1)
    y0, x0 = np.minimum(sy.astype(np.int32), h - 2), np.minimum(sx.astype(np.int32), w - 2)
    fy, fx = sy - y0, sx - x0
    p = p.astype(np.float32)
    out = (p[y0, x0] * (1 - fy) + p[y0 + 1, x0] * fy) * (1 - fx) + (p[y0, x0 + 1] * (1 - fy) + p[y0 + 1, x0 + 1] * fy) * fx
    return out.clip(0, 255).astype(np.uint8)


EDITS = ("crop", "lighter", "crop, lighter", "turn 10", "turn 20", "turn 45", "quarter turn", "resize 0.87", "resize 0.75", "resize 1.2", "noise", "blur", "turn, resize, lighter")


def edited(p: np.ndarray, how: int) -> np.ndarray:
    """A copy by one of EDITS; the noise follows from the picture."""
    if how in (0, 2):
        p = p[8:88, 12:92]
    if how in (3, 4, 5):
        p = warp(p, np.radians((10, 20, 45)[how - 3]), 1)
    if how == 6:
        p = np.ascontiguousarray(np.rot90(p))
    if how in (7, 8, 9):
        p = warp(p, 0, (0.87, 0.75, 1.2)[how - 7])
    if how == 10:
        p = np.clip(p + np.random.default_rng(zlib.crc32(p.tobytes())).normal(0, 8, p.shape), 0, 255).astype(np.uint8)
    if how == 11:
        f = np.pad(p.astype(np.float32), 1, "edge")
        p = (box(f[None])[0, 1:-1, 1:-1] / 9).astype(np.uint8)
    if how == 12:
        p = warp(p, np.radians(15), 0.9)
    if how in (1, 2, 12):
        p = np.clip(p.astype(np.float32) * 0.9 + 20, 0, 255).astype(np.uint8)
    return p


def shrink(stack: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return stack
    n, m = (int(s * scale) for s in stack.shape[1:])
    y, x = ((np.arange(k) + 0.5) / scale - 0.5 for k in (n, m))
    y0, x0 = np.clip(y.astype(int), 0, stack.shape[1] - 2), np.clip(x.astype(int), 0, stack.shape[2] - 2)
    fy, fx = (y - y0).astype(np.float32)[:, None], (x - x0).astype(np.float32)[None]
    for axis, at, f in ((1, y0, fy), (2, x0, fx)):
        here, after = ((slice(None),) * axis + (k,) for k in (at, at + 1))
        out, other = stack[here], stack[after]
        out *= 1 - f
        other *= f
        out += other
        stack = out
    return np.ascontiguousarray(stack)


def box(a: np.ndarray) -> np.ndarray:
    """Sums over squares of side 3, zero beyond the edge."""
    for axis in (1, 2):
        s, upto, after, first = np.empty_like(a), *((slice(None),) * axis + (x,) for x in (slice(None, -1), slice(1, None), slice(1)))
        s[first] = a[first]
        np.add(a[after], a[upto], out=s[after])
        s[upto] += a[after]
        a = s
    return a


def _sums(flat: np.ndarray, width: int) -> np.ndarray:
    """Sums over squares of side 3 of rows that lie one after another, from the first square's middle to the last's: as box()
    away from the edges, where squares run on into other rows."""
    for step in (width, 1):
        out = flat[step:-step] + flat[: -2 * step]
        out += flat[2 * step :]
        flat = out
    return flat


def _highest(flat: np.ndarray, step: int) -> np.ndarray:
    """The largest of five values this far apart, from the first one's middle to the last's."""
    two = np.maximum(flat[:-step], flat[step:])
    four = np.maximum(two[: -2 * step], two[2 * step :])
    return np.maximum(four[:-step], flat[4 * step :], out=four[:-step])


def corners(stack: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Picture, row and column of the strongest corners of each picture, away from the edge.

    Only what lies away from the edge is computed, with two pixels more at each side: rows one after another, so that a neighbour is a step in one row of numbers."""
    edge = RADIUS + 3
    part = np.ascontiguousarray(stack[:, edge - 2 : 2 - edge, edge - 2 : 2 - edge])
    n, h, w = part.shape
    if min(h, w) <= 4:
        return (np.zeros(0, np.int64),) * 3
    f = part.reshape(-1)
    gx, gy = f[w + 1 : 1 - w] - f[w - 1 : -1 - w], f[2 * w :] - f[: -2 * w]
    c = _sums(gx * gy, w)
    gx *= gx
    gy *= gy
    a, b = _sums(gy, w), _sums(gx, w)
    inner = slice(2 * w + 1, -2 * w - 1)
    r = np.zeros_like(part)
    both = a + b
    both *= both
    both *= np.float32(0.05)
    c *= c
    a *= b
    a -= c
    np.subtract(a, both, out=r.reshape(-1)[inner])
    r[:, :2], r[:, -2:], r[:, :, :2], r[:, :, -2:] = 0, 0, 0, 0
    r = r.reshape(-1)
    inner = r[2 * w : -2 * w]
    top = inner > 1e4
    top &= inner >= _highest(r, w)
    top &= inner >= _highest(r[2 * w - 2 : 2 - 2 * w], 1)
    at = np.flatnonzero(top) + 2 * w
    i = at // (h * w)
    order = np.lexsort((-r[at], i))
    at, i = at[order] % (h * w), i[order]
    ok = np.arange(len(i)) - np.searchsorted(i, np.arange(n))[i] < most
    return i[ok], at[ok] // w + edge - 2, at[ok] % w + edge - 2


def descriptor(img: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray, at_turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orientation and bits of the corners of a stack of pictures."""
    h, w = img.shape[1:]
    at = ((i * h + y) * w + x)[:, None]
    patch = img.reshape(-1)[at + (_DISC[:, 0] * w + _DISC[:, 1])].astype(np.float64)
    angle = np.arctan2((patch * _DISC[:, 0]).sum(1), (patch * _DISC[:, 1]).sum(1))
    turn = np.rint(angle / (2 * np.pi) * _TURNS).astype(int) % _TURNS
    at -= w + 1  # where sums begin
    soft = _sums(img.reshape(-1), w)
    sides = []
    for k in (0, 2):
        place = (at_turn[..., k] * w + at_turn[..., k + 1])[turn]
        place += at
        sides.append(soft[place])
    return angle, sides[0] < sides[1]


def describe(stack: np.ndarray, at_turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Picture, scale, row and column (at full size), orientation and two words of 64 bits of every corner."""
    out, full = [], stack.astype(np.float32)
    for s, (scale, most) in enumerate(zip(SCALES, CORNERS, strict=True)):
        img = shrink(full, scale)
        if min(img.shape[1:]) <= 2 * (RADIUS + 4):
            continue
        i, y, x = corners(img, most)
        if not len(i):
            continue
        angle, bits = descriptor(img, i, y, x, at_turn)
        words = np.packbits(bits, axis=1).view("<i8")
        out.append((i, np.full(len(i), s), np.rint(y / scale).astype(int), np.rint(x / scale).astype(int), angle, words[:, 0], words[:, 1]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 7


def _draw(batches):
    for batch in batches:
        ids, seeds, how = (batch.column(i).to_pylist() for i in range(3))
        pics = [render(bytes(s)) if s is not None else None for s in seeds]
        pics = [p if p is None or h is None else edited(p, h) for p, h in zip(pics, how, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if p is None else p.shape[0] for p in pics], pa.int32()), pa.array([None if p is None else p.tobytes() for p in pics], pa.binary())], names=["page_id", "height", "pixels"])


def pictures(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """A media column from a page table: page_id, height, pixels (grey, a byte each).

    A page's picture is drawn from its html; every fourth page shows an edited copy of the picture
    of the page before it instead (its own, if there is none)."""
    spark = pages.sparkSession
    common.ship(spark)
    own = pages.select(F.col(id).cast("long").alias("page_id"), F.unhex(F.md5(F.coalesce(F.col(html), F.lit("")).cast("binary"))).alias("seed"))
    before = own.groupBy((F.col("page_id") + 1).alias("page_id")).agg(F.min("seed").alias("other"))
    copy = (F.pmod(F.col("page_id"), F.lit(4)) == 3) & F.col("other").isNotNull()
    drawn = own.join(before, "page_id", "left").select("page_id", F.when(copy, F.col("other")).otherwise(F.col("seed")).alias("seed"), F.when(copy, F.pmod(F.floor(F.col("page_id") / 4), F.lit(len(EDITS))).cast("int")).alias("how"))
    drawn = drawn.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # small rows, much work
    return drawn.mapInArrow(_draw, "page_id long, height int, pixels binary")


CORNER = np.dtype([("scale", "u1"), ("y", "<i4"), ("x", "<i4"), ("angle", "<f4"), ("a", "<u8"), ("b", "<u8")])
#: Table by table the first bit and the number of bits, of 128.
PARTS = ((0, 18), (18, 18), (36, 18), (54, 20), (74, 18), (92, 18), (110, 18))


def _features(batches, tests: np.ndarray, at_once: int = 16):
    """A row per page: the digest of its picture, null if it has none, and its corners. Equal pictures of a batch are described once."""
    at_turn = turned(tests)
    for batch in batches:
        heights, pixels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        digest = [hashlib.md5(b"%d " % (h or 0) + p).digest() if p is not None else None for h, p in zip(heights, pixels, strict=True)]
        found: dict[bytes | None, bytes] = {}
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, (of, h, p) in enumerate(zip(digest, heights, pixels, strict=True)):
            if of not in found:
                found[of] = b""
                if p and h and h > 0 and len(p) % h == 0:
                    shapes.setdefault((h, len(p) // h), []).append(i)
        for (h, w), rows in shapes.items():
            for k in range(0, len(rows), at_once):
                part = rows[k : k + at_once]
                of, *cols = describe(np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w) for i in part]), at_turn)
                corner = np.empty(len(of), CORNER)
                for name, c in zip(CORNER.names, cols, strict=True):
                    corner[name] = c.view(np.uint64) if name in "ab" else c
                for j, i in enumerate(part):
                    found[digest[i]] = corner[of == j].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array([found[of] for of in digest], pa.binary())], names=["page_id", "of", "corners"])


def keys(c: np.ndarray) -> Iterator[np.ndarray]:
    """The value of each corner, table by table."""
    for first, n in PARTS:
        v = c["a"] >> np.uint64(first) if first < 64 else c["b"] >> np.uint64(first - 64)
        if first < 64 < first + n:
            v = v | (c["b"] << np.uint64(64 - first))
        yield (v & np.uint64((1 << n) - 1)).astype(np.int64)


def tables(c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table the corners in order of value, and their values."""
    out = []
    for key in keys(c):
        order = np.argsort(key, kind="stable")
        out.append((order, key[order]))
    return out


def _around(order: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value of n bits where its list starts, and the lists: corners of this value, then those one bit off, bit by bit."""
    new = np.flatnonzero(np.diff(key, prepend=-1))
    value, many = key[new], np.diff(new, append=len(key))
    rank = np.arange(len(key)) - np.repeat(new, many)
    flips = [0, *(1 << k for k in range(n))]
    start = np.concatenate([[0], np.bincount(np.concatenate([key ^ x for x in flips]), minlength=1 << n).cumsum()])
    free, listed = start[:-1].copy(), np.empty(start[-1], np.int32)
    for x in flips:
        listed[free[key ^ x] + rank] = order
        free[value ^ x] += many
    return start, listed


def _width(many: int) -> int:
    """Of the window in which a list of so many corners is compared: at most a quarter more."""
    step = 1 << max(0, many.bit_length() - 3)
    return -(-many // step) * step


def _true(mask: np.ndarray) -> np.ndarray:
    """Where a row of booleans, few of them true, is true: eight are looked at in one step."""
    whole = len(mask) // 8 * 8
    eight = np.flatnonzero(mask[:whole].view(np.uint64) != 0)
    at = np.flatnonzero(mask[:whole].reshape(-1, 8)[eight])
    return np.concatenate([eight[at >> 3] * 8 + (at & 7), np.flatnonzero(mask[whole:]) + whole])


def meet(c: np.ndarray, asked: np.ndarray, index: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Corners of c and of the queries within `most` bits: all of those within 13, each pair once.

    Of each table the queries are listed under all values one bit off, so that a corner has one list there. Where many pairs meet under
    one value, its corners are held against its list where that lies; the others are taken in order of
    the lengths of their lists: windows of one width over the lists hold what is compared, and nothing is made for a pair but the bits
    in which it differs. Lists of one table are held at a time."""
    met = [np.zeros(0, np.int64)]
    a, b, qa, qb = (x[w].copy() for x in (c, asked) for w in "ab")

    def near(i, xa, xb):
        """Corner by corner of i where it is within `most` bits of its row of the list, or of the one row there is."""
        shape = len(i), xa.shape[-1]
        x, bits, more, few = (room[: shape[0] * shape[1]].reshape(shape) for room in rooms)
        np.bitwise_count(np.bitwise_xor(xa, a[i, None], out=x), out=bits)
        np.bitwise_count(np.bitwise_xor(xb, b[i, None], out=x), out=more)
        bits += more
        return np.divmod(_true(np.less_equal(bits, most, out=few).reshape(-1)), shape[1])

    for key, (_, n), of in zip(keys(c), PARTS, index, strict=True):
        start, listed = _around(*of, n)
        many = np.diff(start)
        by = np.argsort((many[key] << n) + key)  # by the lengths of the lists, then by value
        key = key[by]
        by, key = (x[np.searchsorted(many[key], 1) :] for x in (by, key))
        if not len(by):
            continue
        first, count = start[key], many[key]
        la, lb = (np.concatenate([q[listed], np.zeros(_width(int(count[-1])), np.uint64)]) for q in (qa, qb))  # with room for the last windows
        rooms = [np.empty(max(AT_ONCE, _width(int(count[-1]))), t) for t in (np.uint64, np.uint8, np.uint8, bool)]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        corners_of = np.diff(new, append=len(key))
        crowded = corners_of * count[new] >= CROWD
        for lo, size in zip(new[crowded].tolist(), corners_of[crowded].tolist(), strict=True):
            at, width = int(first[lo]), int(count[lo])
            rows = max(1, AT_ONCE // width)
            for k in range(lo, lo + size, rows):
                i = by[k : min(lo + size, k + rows)]
                row, col = near(i, la[at : at + width], lb[at : at + width])
                met.append(i[row] * len(asked) + listed[at + col])
        alone = ~np.repeat(crowded, corners_of)
        by, first, count = by[alone], first[alone], count[alone]
        done = 0
        while done < len(by):
            width = _width(int(count[done]))
            stop = int(np.searchsorted(count, width, "right"))
            wa, wb = (np.lib.stride_tricks.sliding_window_view(x, width) for x in (la, lb))
            rows = max(1, AT_ONCE // width)
            for k in range(done, stop, rows):
                i, at = by[k : min(stop, k + rows)], first[k : min(stop, k + rows)]
                row, col = near(i, wa[at], wb[at])
                own = col < count[k + row]
                row, col = row[own], col[own]
                met.append(i[row] * len(asked) + listed[at[row] + col])
            done = stop
    pair = np.sort(np.concatenate(met))
    pair = pair[np.diff(pair, prepend=-1) > 0]
    return pair // max(len(asked), 1), pair % max(len(asked), 1)


def _close(s: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether turn and zoom are what a match says: within TURN, and one step of scale and a half."""
    r = s / own
    return (abs(np.angle(r)) <= TURN) & (abs(np.log(abs(r))) <= 1.5 * np.log(SCALES[0] / SCALES[1]))


def agree(q: np.ndarray, r: np.ndarray) -> bool:
    """Whether one similarity carries at least VOTES of the matched corners q to their counterparts r."""
    if min(len(np.unique(q)), len(np.unique(r))) < VOTES:
        return False
    a, b = (c["x"] + 1j * c["y"] for c in (q, r))
    own = (r["angle"] - q["angle"]).astype(np.float64)  # what each match says of the turn and the zoom
    level = np.log(SCALES[0] / SCALES[1]) * (r["scale"].astype(int) - q["scale"])
    own = np.exp(level + 1j * own)
    for i in range(len(a) - VOTES + 1):  # a copy's corners don't all lie beyond
        da, db = a - a[i], b - b[i]
        far = abs(da) > NEAR
        s = db[far] / da[far]
        s = s[(abs(s) > 0.25) & (abs(s) < 4)]
        s = s[_close(s, own[i])]
        fit = abs(s[:, None] * da - db) <= NEAR * np.maximum(1, abs(s))[:, None]
        fit &= _close(s[:, None], own[None])
        for row in fit[fit.sum(1) >= VOTES]:
            if min(len(np.unique(c[row])) for c in (q, r)) >= VOTES and min(len(np.unique(np.rint(x[row] / NEAR))) for x in (a, b)) >= PLACES:
                return True
    return False


def _met(batches, block):
    """The pairs (digest, query) of pictures of which one shows a copy of the other."""
    ids, digests, sizes, data = block.value
    asked, of = np.frombuffer(data, CORNER), np.repeat(np.arange(len(ids)), sizes)
    index = tables(asked)
    for batch in batches:
        pictures = list(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)).items())  # each once
        out = []
        for k in range(0, len(pictures), TOGETHER):
            part = [np.frombuffer(x, CORNER) for _, x in pictures[k : k + TOGETHER]]
            c, pic = np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])
            i, j = meet(c, asked, index, MOST)
            pair = pic[i] * len(ids) + of[j]
            order = np.argsort(pair, kind="stable")
            i, j, (pair, first, many) = i[order], j[order], np.unique(pair[order], return_index=True, return_counts=True)
            for p, f, m in zip(*(x[many >= VOTES].tolist() for x in (pair, first, many)), strict=True):
                q, own = p % len(ids), pictures[k + p // len(ids)][0]
                if digests[q] != own and agree(asked[j[f : f + m]], c[i[f : f + m]]):
                    out.append((own, ids[q]))
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], t) for n, t in ((0, pa.binary()), (1, pa.int64()))], names=["of", "q"])


@common.tidy("picture-copies")
def copies(media: DataFrame, every: int = 50) -> DataFrame:
    """A row per page: page_id, class_id (smallest page with equal pixels), copy_of (sorted class ids of the queries,
    pages whose id is divisible by `every`, of which it shows a cropped or edited copy), n_copies.

    media: page_id, height, pixels."""
    spark = media.sparkSession
    common.ship(spark)
    pages = common.table(spark, media.select("page_id", "height", "pixels").mapInArrow(partial(_features, tests=binary_tests()), "page_id long, of binary, corners binary"), "corners")
    known = pages.filter("of IS NOT NULL AND page_id IS NOT NULL")
    # tables, not aggregates, meet the pages: Spark can then split a picture that very many pages show
    classes = common.table(spark, known.groupBy("of").agg(F.min("page_id").alias("class")), "picture-classes")
    asked = known.filter(F.pmod("page_id", F.lit(every)) == 0).groupBy("of").agg(F.first("corners").alias("corners")).join(classes, "of")
    asked = common.table(spark, asked, "asked-pictures")
    blocks = -(-asked.count() // BLOCK) or 1
    by_block, found = common.new_path(spark, "asked-blocks"), common.new_path(spark, "picture-pairs")
    asked.withColumn("block", F.pmod(F.xxhash64("of"), F.lit(blocks))).repartition(blocks, "block").write.partitionBy("block").parquet(by_block)
    asked = spark.read.schema("of binary, corners binary, class long, block long").parquet(by_block)
    for block in range(blocks):
        rows = asked.filter(F.col("block") == block).collect()  # about BLOCK pictures
        value = [r["class"] for r in rows], [bytes(r["of"]) for r in rows], [len(r["corners"]) // CORNER.itemsize for r in rows], b"".join(bytes(r["corners"]) for r in rows)
        shared = spark.sparkContext.broadcast(value)
        pages.filter("length(corners) > 0").select("of", "corners").mapInArrow(partial(_met, block=shared), "of binary, q long").write.parquet(f"{found}/block={block}")
        shared.destroy()
    pairs = spark.read.schema("of binary, q long").parquet(*[f"{found}/block={b}" for b in range(blocks)])
    pairs = common.table(spark, pairs.groupBy("of").agg(F.array_sort(F.collect_set("q")).alias("copy_of")), "pictures-met")
    member = pages.select("page_id", "of").join(classes, "of", "left").join(pairs, "of", "left")
    none = F.coalesce("copy_of", F.array().cast("array<long>"))
    return member.select("page_id", F.col("class").alias("class_id"), none.alias("copy_of"), F.size(none).cast("long").alias("n_copies"))
