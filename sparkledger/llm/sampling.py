"""Sampled SentencePiece segmentation and lossless decoding.

A text's pieces form a lattice; forward filtering sums the weights of all ways to reach each
place, backward sampling then draws a segmentation in proportion to its weight. A piece of rank
r weighs (r + 1) ** -`sharpness`, a byte piece `byte_weight`. Draws come from a hash of the seed, the row key and the
number of the draw, so that a row's segmentation depends on neither batch nor partition.

No piece holds a space mark after another letter, so the lattice falls apart into words (a run
of spaces and what follows it up to the next space) whose tables are made once a batch.
Characters outside the vocabulary, and a literal space mark, are spelt by byte pieces: decoding
gives the text back byte for byte, white space included.

Null texts have null ids and decode to null; empty texts have no ids. Rows with equal keys and
texts get equal segmentations; a null key is a key of its own. Extra columns are left out; an
empty table gives an empty result. Long texts are sampled whole, in bounded runs of words.
"""

from __future__ import annotations

import gc
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: A word: spaces, then everything to the next space; line ends stand alone.
WORD = re.compile(r" *[^ \n]+|\n| +")


def model_file(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


LITERAL = 0x110000  # stands for a mark that the text itself holds


class Pieces:
    """The vocabulary as tables: a rolling hash of code points finds a piece, a bit table first."""

    def __init__(self, path: str | None, sharpness: float, byte_weight: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file(path))
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p in text.values()):
            raise ValueError("a piece spans the start of a word")
        self.longest = max(map(len, text.values()))
        self.raw = {i: p.replace(MARK, " ").encode() for i, p in text.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        ranked = sorted(plain, key=lambda i: -sp.get_score(i))
        hashes = np.array([self.hash(np.array([list(map(ord, text[i]))], np.uint64))[0] for i in ranked], np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        order = np.argsort(hashes)
        self.hashes, self.id = hashes[order], np.array(ranked, np.int64)[order]
        self.log_weight = -sharpness * np.log(np.arange(1, len(ranked) + 1))[order]
        self.log_byte = float(np.log(byte_weight))
        # two tables of places by different bits of the hash; the second for those that share a bucket
        self.first, self.second = np.zeros(1 << 22, np.int32), np.zeros(1 << 22, np.int32)
        place = np.arange(1, len(order) + 1, dtype=np.int32)
        self.first[self.bucket(self.hashes, 42)] = place
        rest = np.flatnonzero(self.first[self.bucket(self.hashes, 42)] != place)
        self.second[self.bucket(self.hashes[rest], 21)] = place[rest]
        if (self.second[self.bucket(self.hashes[rest], 21)] != place[rest]).any():
            raise ValueError("the tables are too small for this vocabulary")
        self.both = np.zeros(1 << 22, bool)
        self.both[self.bucket(self.hashes[rest], 42)] = True

    STEP, SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)  # a seed of 0 would hide a leading NUL

    @classmethod
    def hash(cls, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.full(len(rows), cls.SEED)
            for k in range(rows.shape[1]):
                h = (h ^ rows[:, k]) * cls.STEP
            return h

    @staticmethod
    def bucket(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << 22) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and where these stand in the tables."""
        bucket = self.bucket(h, 42)
        k = self.first[bucket]
        at = np.flatnonzero(k)
        k = k[at].astype(np.int64) - 1
        hit = self.hashes[k] == h[at]
        other = np.flatnonzero(~hit & self.both[bucket[at]])
        if len(other):
            o = self.second[self.bucket(h[at[other]], 21)].astype(np.int64) - 1
            ok = (o >= 0) & (self.hashes[o] == h[at[other]])
            k[other[ok]], hit[other[ok]] = o[ok], True
        return at[hit], k[hit]


class Lattice:
    """Forward filtering of distinct words, all at once.

    Word w has the nodes start[w] to start[w] + its length; node p ends the prefix of that many
    characters. Edges stand in the order of the nodes at which they end, each with the share of
    its node's weight that it and those before it hold."""

    def __init__(self, v: Pieces, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.length + 1) - self.length - 1
        n = int(self.length.sum())
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        code = np.where(code == ord(MARK), np.uint64(LITERAL), np.where(code == 0x20, np.uint64(ord(MARK)), code))
        place = np.arange(n) - np.repeat(np.cumsum(self.length) - self.length, self.length)  # of each character in its word
        room = np.repeat(self.length, self.length) - place
        slot = np.arange(n) + np.repeat(np.arange(len(words)), self.length)  # the node before each character
        h, live = np.full(n, v.SEED), np.arange(n)
        ends, backs, weights, pieces = [], [], [], []
        single = np.zeros(n, bool)
        for size in range(1, v.longest + 1):
            live = live[room[live] >= size]
            if not len(live):
                break
            with np.errstate(over="ignore"):
                h[live] = (h[live] ^ code[live + size - 1]) * v.STEP
            at, k = v.find(h[live])
            at = live[at]
            if size == 1:
                single[at] = True
            ends.append(slot[at] + size)
            backs.append(np.full(len(at), size))
            weights.append(v.log_weight[k])
            pieces.append(v.id[k])
        odd = np.flatnonzero(~single)
        if len(odd):
            size = 1 + (code[odd] >= 0x80) + (code[odd] >= 0x800) + (code[odd] >= 0x10000)
            size[code[odd] == LITERAL] = 3
            ends.append(slot[odd] + 1)
            backs.append(np.ones(len(odd), np.int64))
            weights.append(size * v.log_byte)
            pieces.append(-1 - code[odd].astype(np.int64))
        end, back = np.concatenate(ends), np.concatenate(backs)
        order = np.argsort(end, kind="stable")
        end, self.back = end[order], back[order]
        weight, self.piece = np.concatenate(weights)[order], np.concatenate(pieces)[order]
        self.edge = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=n + len(words)))])  # of each node, its first edge
        self.upto = self._filter(end, weight, place, slot)

    def _filter(self, end, weight, place, slot) -> np.ndarray:
        total = np.zeros(len(self.edge))
        depth = np.zeros(len(self.edge), np.int64)
        depth[slot + 1] = place + 1
        deep = depth[end]
        most_deep = int(deep.max(initial=0))
        turn = np.argsort(deep.astype(np.uint16) if most_deep < 1 << 16 else deep, kind="stable")  # shallow nodes first
        upto, bounds = np.empty(len(end)), np.cumsum(np.bincount(deep, minlength=most_deep + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            e = turn[a:b]
            x, node = total[end[e] - self.back[e]] + weight[e], end[e]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            many = np.diff(np.append(first, len(e)))
            most = np.maximum.reduceat(x, first)
            p = np.exp(x - np.repeat(most, many))
            run = np.cumsum(p)
            before = np.concatenate([[0.0], run])[first]
            s = run[first + many - 1] - before
            share = (run - np.repeat(before, many)) / np.repeat(s, many)
            share[first + many - 1] = 1.0
            upto[e] = share
            total[node[first]] = most + np.log(s)
        return upto


def uniform(key: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Draws in [0, 1) from the row's key and the number of the draw."""
    with np.errstate(over="ignore"):
        return (common.mix(key ^ common.mix(turn.astype(np.uint64), 1), 2) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def spell(v: Pieces, code: int) -> list[int]:
    return [v.bytes[b] for b in (MARK if code == LITERAL else chr(code)).encode()]


def sample(v: Pieces, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    """Backward sampling for all words of all texts at once; ids of each text."""
    split = [WORD.findall(t) for t in texts]
    flat = [w for ws in split for w in ws]
    if not flat:
        return [np.zeros(0, np.int32) for _ in texts]
    place_of = {w: i for i, w in enumerate(dict.fromkeys(flat))}  # pandas would take words that differ after a NUL as one
    number = np.fromiter(map(place_of.__getitem__, flat), np.int64, len(flat))
    lat = Lattice(v, list(place_of))
    counts = np.array([len(ws) for ws in split])
    size, begin = lat.length[number], lat.start[number]
    key, ends = np.repeat(keys, counts), np.cumsum(size)
    begins = ends - size
    bounds = np.concatenate([begins, ends[-1:]])[np.concatenate([[0], np.cumsum(counts)])]  # where texts begin, in characters
    turn = begins - np.repeat(bounds[:-1], counts)  # a draw is named by its place in the text
    place, live = size.copy(), np.arange(len(number))
    got_at, got_piece = [], []
    while len(live):
        e, u = lat.edge[begin[live] + place[live]], uniform(key[live], turn[live] + place[live])
        more = np.flatnonzero(lat.upto[e] <= u)
        while len(more):
            e[more] += 1
            more = more[lat.upto[e[more]] <= u[more]]
        got_at.append(begins[live] + place[live])
        got_piece.append(lat.piece[e])
        place[live] -= lat.back[e]
        live = live[place[live] > 0]
    at, found = np.concatenate(got_at), np.concatenate(got_piece)
    whole = np.zeros(int(ends[-1]) + 1, np.int64)  # a character ends one piece at most
    here = np.zeros(len(whole), bool)
    whole[at], here[at] = found, True
    at = np.flatnonzero(here)
    found = whole[at]
    if (found < 0).any():
        spelt = {int(k): spell(v, -int(k) - 1) for k in np.unique(found[found < 0])}
        neg = np.flatnonzero(found < 0)
        many = np.ones(len(found), np.int64)
        many[neg] = [len(spelt[int(k)]) for k in found[neg]]
        out = np.repeat(found, many)
        put = np.cumsum(many) - many
        for x, k in zip(put[neg].tolist(), found[neg].tolist(), strict=True):
            out[x : x + len(spelt[k])] = spelt[k]
        at, found = np.repeat(at, many), out
    cut = np.searchsorted(at, bounds, side="right")
    return [found[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def decode(v: Pieces, ids) -> str:
    return b"".join(map(v.raw.__getitem__, ids)).decode()


def pieces(path: str | None, sharpness: float, byte_weight: float) -> Pieces:
    """One a Python worker."""
    key = (path, sharpness, byte_weight)
    kept = common.CACHES.setdefault("pieces", {})
    if key not in kept:
        kept[key] = Pieces(*key)
    return kept[key]


@common.task("pieces")
def _encode(batches, path, sharpness: float, byte_weight: float, seed: int, digest: bool):
    gc.disable()  # words and tables hold no cycles
    v = pieces(path, sharpness, byte_weight)
    for batch in batches:
        texts, keys = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(np.int64).view(np.uint64)
        keys = common.mix(keys, seed)
        for a, b in common.slices(texts, 4_000_000):
            ids = sample(v, [t or "" for t in texts[a:b]], keys[a:b])
            null = [t is None for t in texts[a:b]]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()), mask=pa.array(null)
            )
            cols, names = [batch.column(0).slice(a, b - a), lists], ["id", "ids"]
            if digest:
                crc = [None if n else zlib.crc32(b"".join(map(v.raw.__getitem__, x.tolist()))) for n, x in zip(null, ids, strict=True)]
                cols, names = [*cols, pa.array(crc, pa.int64())], [*names, "crc"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    gc.enable()


def encode(docs: DataFrame, seed: int = 1, sharpness: float = 1.0, byte_weight: float = 1e-5, vocabulary: str | None = None, text: str = "text", id: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row per document: id and `piece_ids`, an array of int; with `digest` also `decoded_crc32`, of the bytes that the ids decode to."""
    common.ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(id).cast("string")).alias("key"))
    f = partial(_encode, path=vocabulary, sharpness=sharpness, byte_weight=byte_weight, seed=seed, digest=digest)
    return rows.mapInArrow(f, f"id {kind}, ids array<int>" + ", crc long" * digest).toDF(id, "piece_ids", *["decoded_crc32"] * digest)


@common.task("pieces")
def _decode(batches, path):
    v = pieces(path, 1.0, 1e-5)  # the weights play no part
    for batch in batches:
        texts = [None if x is None else decode(v, x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def decode_column(ids: DataFrame, column: str = "piece_ids", id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """One row per row: id and `text`."""
    common.ship(ids.sparkSession)
    kind = ids.schema[id].dataType.simpleString()
    return ids.select(id, column).mapInArrow(partial(_decode, path=vocabulary), f"id {kind}, text string").toDF(id, "text")
