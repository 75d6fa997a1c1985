"""WARC archives with an index that is written first and read before any record.

Writing: every page becomes one record, a `response` or, if an equal payload of at least
`least` bytes has a smaller page id, a `revisit` that names it. Records are gzip members; the
index has a row per record: file, offset, length, url, digest. Reading: the selected index rows
are dealt by file and stretch, sorted by offset, and neighbouring ranges are fetched in one read.

Null html counts as empty, a null url as an empty string. Among repeated page ids with equal
payloads one row is the response (the first by url), the others revisit it; of rows that are equal in
all three columns one is the response as well. A page without an id
is written as a response and is never revisited. Extra columns are left out; an empty table
gives an empty index. Payloads of any length are written whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time
INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, length long"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def clean(value: str) -> str:
    """A header value without line ends."""
    return " ".join(value.split("\r")).replace("\n", " ")


def record(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record. A revisit has no payload; both carry the length of the full one."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode().rstrip("=")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha256:{b32}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says, its payload checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    b32 = h["WARC-Payload-Digest"].removeprefix("sha256:")
    digest = base64.b32decode(b32 + "=" * (-len(b32) % 8)).hex()
    kind = h["WARC-Type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
        raise ValueError(f"page {h['X-Page-Id']}: payload and digest differ")
    return {
        "page_id": int(h["X-Page-Id"]) if h.get("X-Page-Id") else None, "url": h["WARC-Target-URI"], "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "record_type": kind,
        "refers_to": int(h["X-Refers-To-Page-Id"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def _write(batches, folder: str, level: int, most: int):
    task, out, path, at, files = TaskContext.get().partitionId(), None, "", 0, 0
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if out is None or at > most:
                if out is not None:
                    out.close()
                path, at, files = f"{folder}/{task:06d}-{files:03d}-{uuid.uuid4().hex}.warc.gz", 0, files + 1
                fs, where = common.filesystem(path)
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(where, compression=None, buffer_size=1 << 20)
            payload = (r["html"] or "").encode()
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            raw = z.compress(record(r["page_id"], r["url"], payload, r["digest"], r["kind"], r["refers_to"])) + z.flush()
            out.write(raw)
            rows.append((r["page_id"], r["url"], len(payload), r["digest"], r["kind"], r["refers_to"], path, at, len(raw)))
            at += len(raw)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
    if out is not None:
        out.close()


def write(pages: DataFrame, folder: str, least: int = 100, level: int = 1, most: int = 1 << 30, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives below `folder`, a URI, and return the index, itself a table in the shared folder."""
    spark = pages.sparkSession
    common.ship(spark)
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # short columns alone say what a page is: the smallest (page id, url) of each large payload that occurs more than once
    short = rows.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    firsts = short.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    # a table, not an aggregate, meets the pages: Spark can then split a payload that very many share
    kinds = short.distinct().join(common.table(spark, firsts, "warc-firsts"), "digest")
    # the html is dealt out once, by page; equal rows are summed to one before it
    pages = rows.groupBy("page_id", "url", "digest").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    pages = pages.join(kinds, ["page_id", "url", "digest"], "left").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("n"))))
    again = F.col("first").isNotNull() & ((F.struct("page_id", "url") > F.col("first")) | (F.col("turn") > 1))
    marked = pages.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first.page_id")).alias("refers_to"))
    return common.table(spark, marked.mapInArrow(partial(_write, folder=folder, level=level, most=most), INDEX), "warc-index")


def _ranges(rows: list[tuple[int, int]], gap: int, most: int):
    """Runs of records close enough for one read: (first, last) places in `rows`, sorted by offset."""
    a = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] - sum(rows[i - 1]) > gap or sum(rows[i]) - rows[a][0] > most:
            yield a, i
            a = i


def _read(batches, gap: int, most: int, with_payload: bool):
    schema = pa.schema([(n, t) for n, t in zip(_SCHEMA.names[:6], _SCHEMA.types[:6], strict=True)] + ([("payload", pa.binary())] if with_payload else []))
    for batch in batches:
        path, offset, length = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        for i in range(1, len(path) + 1):
            if i < len(path) and path[i] == path[start]:
                continue
            fs, where = common.filesystem(path[start])
            rows = list(zip(offset[start:i], length[start:i], strict=True))
            with fs.open_input_file(where) as f:
                for a, b in _ranges(rows, gap, most):
                    base = rows[a][0]
                    raw = f.read_at(sum(rows[b - 1]) - base, base)
                    got = [parse(zlib.decompress(raw[o - base : o - base + n], 31)) for o, n in rows[a:b]]
                    yield pa.RecordBatch.from_arrays([pa.array([g[n] for g in got], t) for n, t in zip(schema.names, schema.types, strict=True)], schema=schema)
            start = i


def read(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """The records that the index rows name, read back from the archives.

    Rows are dealt by file and stretch of `most` bytes; ranges less than `gap` apart are one read."""
    spark = index.sparkSession
    common.ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("path", "offset", "length", F.floor(F.col("offset") / most).alias("stretch")).repartition(n, "path", "stretch").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    return dealt.mapInArrow(partial(_read, gap=gap, most=most, with_payload=with_payload), ", ".join(INDEX.split(", ")[:6]) + ", payload binary" * with_payload)
