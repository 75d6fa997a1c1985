"""Token ids on disk: one long id array per shard, document bounds in Elias-Fano form.

A shard file holds the ids of its documents back to back (16 or 32 bits each), then a footer:
the bounds (where each document starts, and the end) and the document ids, both as Elias-Fano
sequences with sampled select. Shards follow each other in document order; the manifest says
how many documents and ids stand before each.

Null texts count as empty; each document ends with the end id. Null ids come first. Repeated ids
are each a document, in the order of their texts' hashes; extra columns are not stored. An empty
table gives an empty manifest and no documents. A text of any length is encoded whole.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

MAGIC = b"EFTOKEN1"
SAMPLE = 256  # every so many set bits, select keeps a place


class EliasFano:
    """A sorted sequence of n integers from 0 to u: the low bits packed, the high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        k = max(0, (top // max(n, 1)).bit_length() - 1)
        low_bits = ((v[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if k else np.zeros((n, 0), np.uint8)
        ones = (v >> np.uint64(k)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1 if n else 0), np.uint8)
        high[ones] = 1
        return cls(n, k, np.packbits(low_bits.reshape(-1), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        i = np.asarray(i, np.int64)
        out = np.empty(len(i), np.int64)
        for block in np.unique(i // SAMPLE):
            at = np.flatnonzero(i // SAMPLE == block)
            start = int(self.samples[block])
            end = int(self.samples[block + 1]) if block + 1 < len(self.samples) else len(self.high) * 8
            bits = np.unpackbits(self.high[start // 8 : end // 8 + 1], bitorder="little")
            ones = np.flatnonzero(bits[start % 8 :]) + start
            k = i[at]
            out[at] = (ones[k - block * SAMPLE] - k) << self.low_bits
        if self.low_bits:
            bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
            out += (((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return out

    def dump(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        n, k, a, b, c = struct.unpack_from("<QBQQQ", raw, at)
        at += struct.calcsize("<QBQQQ")
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        samples = np.frombuffer(raw, "<u4", c, at + a + b)
        return cls(n, k, low, high, samples), at + a + b + 4 * c


class ShardWriter:
    """Ids go out as they come; bounds and document ids are kept till the end, 16 bytes a document."""

    def __init__(self, out, width: int):
        self.out, self.kind, self.bounds, self.ids, self.nulls = out, "<u2" if width == 2 else "<u4", [0], [], 0
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents whose ids stand one after another: the first from bounds[0], the last up to bounds[-1]."""
        self.out.write(ids.astype(self.kind, copy=False).data)
        self.bounds += (self.bounds[-1] + bounds[1:]).tolist()
        known = [x for x in doc_ids if x is not None]
        self.nulls += len(doc_ids) - len(known)
        self.ids += known

    def close(self) -> None:
        least = min(self.ids, default=0)
        tables = EliasFano.build(np.array(self.bounds)).dump() + EliasFano.build(np.array([x - least for x in self.ids], np.uint64)).dump()
        head = json.dumps({"kind": self.kind, "least": least, "nulls": self.nulls, "docs": len(self.bounds) - 1}).encode()
        self.out.write(head + tables + struct.pack("<QQ", len(head), len(tables)) + MAGIC)


class ShardReader:
    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        if tail[16:] != MAGIC:
            raise ValueError(f"{uri}: no token shard")
        n_head, n_tables = struct.unpack("<QQ", tail[:16])
        raw = self.file.read_at(n_head + n_tables, size - 24 - n_head - n_tables)
        self.head = json.loads(raw[:n_head])
        self.bounds, at = EliasFano.load(raw, n_head)
        self.ids, _ = EliasFano.load(raw, at)
        self.docs, self.width = self.head["docs"], int(self.head["kind"][-1])

    def doc_ids(self, i: np.ndarray) -> list[int | None]:
        i, nulls = np.asarray(i), self.head["nulls"]
        found = iter((self.ids.select(i[i >= nulls] - nulls) + self.head["least"]).tolist())
        return [None if k < nulls else next(found) for k in i]

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids from place first to place last of the shard."""
        raw = self.file.read_at((last - first) * self.width, len(MAGIC) + first * self.width)
        return np.frombuffer(raw, self.head["kind"])


@common.task("tokens")
def _write(batches, folder: str, path: str | None, width: int):
    shard = TaskContext.get().partitionId()
    uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
    fs, where = common.filesystem(uri)
    writer, out = None, None
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for a, b, ids, bounds in encoder(path).runs(batch.column(1)):
            if writer is None:
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(where, compression=None, buffer_size=1 << 20)
                writer = ShardWriter(out, width)
            writer.add(doc_ids[a:b], ids, bounds)
    if writer is not None:
        writer.close()
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "n_docs": [len(writer.bounds) - 1], "n_ids": [writer.bounds[-1]]}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Write the shards below `folder`, a URI, and return the manifest: shard, path, n_docs, n_ids, first_doc, first_id.

    Documents are dealt by ranges of id (and of a text hash, should one id have many rows)."""
    spark = docs.sparkSession
    common.ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if encoder(vocabulary).library.get_vocab_size() <= 1 << 16 else 4
    dealt = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h")
    shards = common.table(spark, dealt.select("id", "text").mapInArrow(partial(_write, folder=folder, path=vocabulary, width=width), "shard int, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard file
    return shards.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(a) for c, a in (("n_docs", "first_doc"), ("n_ids", "first_id"))])


@common.task()
def _read(batches, docs_at_once: int = 512):
    for pdf in batches:
        for path, first_id, lo, hi in zip(pdf["path"], pdf["first_id"], pdf["lo"], pdf["hi"], strict=True):
            shard = ShardReader(path)
            for a in range(lo, hi, docs_at_once):
                b = min(a + docs_at_once, hi)
                cut = shard.bounds.select(np.arange(a, b + 1))
                ids = shard.read(int(cut[0]), int(cut[-1])).astype("<u4")
                at = cut - cut[0]
                yield pd.DataFrame({
                    "doc_id": pd.array(shard.doc_ids(np.arange(a, b)), "Int64"), "start": first_id + cut[:-1], "n_tokens": np.diff(cut),
                    "ids_crc32": [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)],
                })


def read_digests(manifest: DataFrame, docs_a_task: int = 8192) -> DataFrame:
    """A row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    common.ship(spark)
    parts = manifest.select("path", "first_id", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(docs_a_task))).alias("lo"), "n_docs")
    parts = parts.select("path", "first_id", "lo", F.least(F.col("lo") + docs_a_task, "n_docs").alias("hi")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
