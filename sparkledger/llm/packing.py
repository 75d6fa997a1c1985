"""Best-fit packing planned over the histogram of lengths.

Each document becomes one piece, or, if longer than the capacity, pieces of the capacity of
which the first may be shorter. The plan needs only how many pieces have each length, at most
`capacity` numbers: best-fit decreasing over counts fills runs of equal sequences at a time. A
piece then takes the planned slot that stands at its rank among the pieces of its length.
Ranks come from the rank within the writing task plus the counts of the tasks before it, so no
task sees all pieces of a common length.

Null texts count as empty and are one piece of the end id. Repeated rows are each packed; extra
columns are left out. An empty table gives no pieces. Texts of any length are encoded whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
BROADCAST_ROWS = 200_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of slots: length, first rank, number, first sequence, slots a sequence, offset of the first.

    Sequences with equal room are kept as runs of consecutive numbers; lengths go from long to short
    and fill the least room that holds them."""
    runs: dict[int, deque] = defaultdict(deque)
    rooms: list[int] = []
    out, fresh = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = runs[room].popleft()
                if not runs[room]:
                    rooms.pop(k)
            else:
                room, first, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # one sequence takes what is left
                out.append((length, rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                left, full = 0, full + 1
            put(room, first + full, n - full)
    return out


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n ids."""
    head = n % capacity or capacity
    return [(0, head), *((a, capacity) for a in range(head, n, capacity))]


@common.task("tokens")
def _pieces(batches, path: str | None, capacity: int):
    task = TaskContext.get().partitionId()
    met: dict[int, int] = defaultdict(int)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("place", pa.int64())])
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for first, last, ids, bounds in encoder(path).runs(batch.column(1)):
            rows, raw = [], ids.view(np.uint8).data
            for doc_id, x, y in zip(doc_ids[first:last], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for k, (a, n) in enumerate(pieces_of(y - x, capacity)):
                    rows.append((doc_id, k, a, n, zlib.crc32(raw[4 * (x + a) : 4 * (x + a + n)]), task, met[n]))
                    met[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def pack(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    common.ship(spark)
    found = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_pieces, path=vocabulary, capacity=capacity), PIECES)
    found = common.table(spark, found, "pieces")
    counts = common.table(spark, found.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    slots = spark.createDataFrame(runs, "length long, first_rank long, slots long, first_sequence long, each long, first_offset long")
    if len(runs) <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:  # a row per task and length: beyond some hundred tasks the pieces are dealt out instead
        ranked = F.broadcast(ranked)
    ranked = found.join(ranked, ["task", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    k = F.col("rank") - F.col("first_rank")
    placed = ranked.join(slots, "length").filter((F.col("rank") >= F.col("first_rank")) & (k < F.col("slots")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(k / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(k, F.col("each")) * F.col("length")).alias("offset"),
    )
