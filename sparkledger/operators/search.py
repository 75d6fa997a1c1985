"""Search over the log table: predicates, pages, counts, lookups."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: So many rows at most are put in order by one task.
TOP = 10_000


def _newest(time: str = "timestamp") -> list[Column]:
    return [F.desc_nulls_last(time), F.desc_nulls_last("id")]


def log_predicate(start: datetime | str | None = None, end: datetime | str | None = None, ip_address: str | None = None, operation: str | None = None, severity: str | None = None, ignore_case: bool = False, partitioned: bool = False) -> Column:
    """Both times inclusive; what is None, or an empty string, doesn't filter. `partitioned` adds the filter on event_date."""
    parts = [F.lit(True)]
    for value, test in ((start, Column.__ge__), (end, Column.__le__)):
        if value is not None:
            at = F.lit(value).cast("timestamp_ntz")
            parts.append(test(F.col("timestamp"), at))
            if partitioned:
                parts.append(test(F.col("event_date"), at.cast("date")))
    for name, value in (("ip_address", ip_address), ("operation", operation), ("severity", severity)):
        if value:
            c = F.collate(F.col(name), "UTF8_LCASE") if ignore_case else F.col(name)
            parts.append(c == value)
    return reduce(and_, parts)


def search(logs: DataFrame, **filters) -> DataFrame:
    return logs.filter(log_predicate(**filters))


def count(logs: DataFrame, **filters) -> DataFrame:
    return search(logs, **filters).agg(F.count("*").alias("total"))


def page(logs: DataFrame, number: int = 1, size: int = 20, **filters) -> DataFrame:
    """A page, newest first; equal times by id."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    return _slice(search(logs, **filters), (number - 1) * size, size)


def _after(column: str, value) -> tuple[Column, Column]:
    """Of one column in falling order, nulls last: what comes after the value, and what equals it."""
    c = F.col(column)
    if value is None:
        return F.lit(False), c.isNull()
    return c.isNull() | (c < value), c == value


def _past(time, id) -> Column:
    """Whether a row stands after those of this key."""
    later, same = _after("timestamp", None if time is None else F.lit(time).cast("timestamp_ntz"))
    next_, _ = _after("id", id)
    return F.coalesce(later | same & next_, F.lit(False))


def _at(time, id) -> Column:
    return F.col("timestamp").eqNullSafe(F.lit(time).cast("timestamp_ntz")) & F.col("id").eqNullSafe(F.lit(id))


def _places(found: DataFrame, *positions: int) -> list[tuple | None]:
    """For each position, from 1, the key (time, id) that stands there in the order of pages, how many rows of this key stand up to it, and
    how many there are; None beyond the end. Keys are dealt to ranges of the order, and only the range of a position is looked into."""
    with scratch.owned(found.sparkSession):
        keys = found.select("timestamp", "id").orderBy(*_newest()).withColumn("part", F.spark_partition_id())
        keys = scratch.table(found.sparkSession, keys, "page-keys")
        sizes, out = sorted(keys.groupBy("part").count().collect()), []
        for n in positions:
            for part, size in sizes:
                if n <= size:
                    rows = keys.filter(F.col("part") == part)
                    # as text: exact, and free of this process's time zone
                    key = tuple(rows.orderBy(*_newest()).offset(n - 1).select(F.col("timestamp").cast("string"), "id").first())
                    past, same = rows.agg(F.count_if(_past(*key)), F.count_if(_at(*key))).first()
                    out.append((key, n - (size - past - same), same))
                    break
                n -= size
            else:
                out.append(None)
        return out


def _slice(found: DataFrame, skip: int, size: int) -> DataFrame:
    """Rows skip + 1 to skip + size, newest first. Within the first TOP rows that is a top-k; else the keys at both ends are looked up, and what
    lies between them is filtered out and put in order by ranges: no task holds the whole page."""
    if skip + size <= TOP:
        return found.orderBy(*_newest()).offset(skip).limit(size)
    first, last = _places(found, skip, skip + size) if skip else (None, *_places(found, skip + size))
    if skip and first is None:
        return found.limit(0)
    if first and last and first[0] == last[0]:
        return found.filter(_at(*first[0])).limit(size)
    inside, cut = F.lit(True), []
    if first:
        inside = _past(*first[0])
        cut.append((first[0], first[2] - first[1]))
    if last:
        inside = inside & ~_past(*last[0])
        if last[1] < last[2]:
            inside = inside & ~_at(*last[0])
            cut.append((last[0], last[1]))
    out = found.filter(inside)
    for key, n in cut:  # of rows with one key a part
        if n:
            out = out.unionByName(found.filter(_at(*key)).limit(n))
    return out.orderBy(*_newest())


def keyset_page(logs: DataFrame, after: tuple | None = None, size: int = 20, **filters) -> DataFrame:
    """The page after the row (timestamp, id), either of which may be null: the same rows as by offset, at any depth for the price of a top-k;
    of a size beyond TOP, for that of a sort of keys.

    The order is that of page(), by time, then id, nulls last in both; rows that have both in common can't be told apart by it."""
    found = search(logs, **filters)
    return _slice(found if after is None else found.filter(_past(*after)), 0, size)


def envelope(logs: DataFrame, number: int = 1, size: int = 20, **filters) -> tuple[dict[str, int], DataFrame]:
    """Totals, and the page."""
    total = search(logs, **filters).count()
    rows = page(logs, 1, max(total, 1), **filters) if number == 1 and size > total else page(logs, number, size, **filters)
    return {"total": total, "page": number, "page_size": size, "pages": -(-total // size)}, rows


def by_id(rows: DataFrame, id: int) -> DataFrame:
    return rows.filter(F.col("id") == id)


_CAMEL = {"ip_address": "ipAddress", "operation_result": "operationResult", "source_file": "sourceFile", "created_at": "createdAt", "log_content": "logContent", "log_summary": "logSummary", "operation_type": "operationType", "risk_level": "riskLevel", "need_intervention": "needIntervention", "ai_suggestion": "aiSuggestion", "source_ip": "sourceIp", "model_used": "modelUsed", "analysis_time_ms": "analysisTimeMs"}


def camel_case(rows: DataFrame) -> DataFrame:
    """Column names as JSON consumers know them."""
    return rows.withColumnsRenamed(_CAMEL)


def failed(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("operation_result") == "FAIL")


def with_operations(logs: DataFrame, operations: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows whose operation is one of these, in any case."""
    return logs.filter(F.upper("operation").isin(*[o.upper() for o in operations]))
