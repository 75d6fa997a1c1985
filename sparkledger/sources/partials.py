"""Counts of the log table by hour, kept beside it: what every append adds is counted once and merged on read.

`_hours` below the table holds a row for each hour of each batch: total, abnormal, failed, and a sketch of the
addresses (HyperLogLog, 2^`LG_K` registers). Counts of hours or days are sums of these rows, different addresses of any range the union
of their sketches; neither reads the log. Where the counts can't be trusted (a batch is being appended, or died
half-way, or the folder was never made) readers count the log itself, and the next append makes them anew."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from .scratch import delete, exists, rename

LG_K = 12
HOURS = "hour timestamp_ntz, total long, abnormal long, failed long, ips binary"


def error_bound(lg_k: int = LG_K, deviations: float = 3) -> float:
    """The share by which an estimate is off, at so many deviations."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def of_rows(logs: DataFrame) -> DataFrame:
    """A row per hour."""
    return logs.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("total"), F.count_if(F.col("severity").isin(*stats.ABNORMAL)).alias("abnormal"), F.count_if(F.col("operation_result") == "FAIL").alias("failed"), F.hll_sketch_agg("ip_address", LG_K).alias("ips")
    )


def mark_path(table: str) -> str:
    return f"{table}/_largest_id"


def whole(spark: SparkSession, table: str) -> bool:
    """Whether the counts hold all rows of the table: no batch is open, and they were kept from the first on."""
    return exists(spark, f"{table}/_hours") and exists(spark, mark_path(table)) and spark.read.schema("id bigint").parquet(mark_path(table)).agg(F.max("id")).first()[0] is not None


def add(spark: SparkSession, table: str, after: int, days: tuple | None, all_: bool) -> None:
    """Count the rows with ids above `after`, which lie between two days; or, with all_, the whole table anew."""
    if all_:
        delete(spark, f"{table}/_hours")
    rows = spark.read.parquet(table)
    if not all_:
        if days is None or days[0] is None:
            return
        rows = rows.filter(F.col("event_date").between(F.lit(days[0]), F.lit(days[1])) & (F.col("id") > after))
    of_rows(rows).write.mode("append").parquet(f"{table}/_hours")


def compact(spark: SparkSession, table: str) -> None:
    """Leave one row for each hour, where every batch has left its own; for the one writer, between two appends.

    While the folders are swapped the mark is empty, so readers count the log itself; should the job die then, the next append makes the counts anew."""
    if not whole(spark, table):
        return
    kept, side = f"{table}/_hours", f"{table}/_hours_compact"
    top = spark.read.schema("id bigint").parquet(mark_path(table)).agg(F.max("id")).first()[0]
    delete(spark, side)
    hours(spark, table).repartitionByRange("hour").write.parquet(side)
    mark(spark, table, None)
    delete(spark, kept)
    rename(spark, side, kept)
    mark(spark, table, top)


def mark(spark: SparkSession, table: str, id: int | None) -> None:
    """Keep the largest id of a table; None while a batch or its counts are not whole."""
    spark.createDataFrame([(id,)], "id bigint").coalesce(1).write.mode("overwrite").parquet(mark_path(table))


def hours(spark: SparkSession, table: str) -> DataFrame:
    """A row per hour, over all batches."""
    if not whole(spark, table):
        return of_rows(spark.read.parquet(table))
    kept = spark.read.schema(HOURS).parquet(f"{table}/_hours")
    return kept.groupBy("hour").agg(F.sum("total").alias("total"), F.sum("abnormal").alias("abnormal"), F.sum("failed").alias("failed"), F.hll_union_agg("ips").alias("ips"))


def abnormal_rate_by_day(spark: SparkSession, table: str) -> DataFrame:
    """As stats.abnormal_rate_by_day(), from the counts."""
    days = hours(spark, table).groupBy(F.to_date("hour").alias("day")).agg(F.sum("total").alias("total"), F.sum("abnormal").alias("abnormal"))
    return stats.rated(days)


def day_stats(spark: SparkSession, table: str, day: str | None = None) -> DataFrame:
    d = F.lit(day).cast("date") if day else F.current_date()
    rows = hours(spark, table).filter(F.to_date("hour") == d)
    return rows.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("abnormal"), F.lit(0)).alias("abnormal"))


def _hour(t: datetime) -> datetime:
    return t.replace(minute=0, second=0, microsecond=0)


def unique_ips(spark: SparkSession, table: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """About how many different addresses between start and end, the end not included; see error_bound().

    Whole hours come from the sketches. Of a range that begins or ends within an hour the rows of that hour are read besides, and no others."""
    kept, parts = hours(spark, table).select("hour", "ips"), []
    first = start if start is None or start == _hour(start) else _hour(start) + timedelta(hours=1)
    last = end if end is None else _hour(end)
    if first is not None:
        kept = kept.filter(F.col("hour") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        kept = kept.filter(F.col("hour") < F.lit(last).cast("timestamp_ntz"))
    edges = []
    if start is not None and start != first:
        edges.append((start, min(first, end) if end else first))
    if end is not None and end != last and (start is None or start < last or not edges):
        edges.append((max(last, start) if start else last, end))
    for a, b in edges:
        parts.append(_sketch(spark, table, a, b))
    out = kept.select("ips")
    for p in parts:
        out = out.unionByName(p)
    return out.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("ips")), F.lit(0)).cast("long").alias("unique_ips"))


def _sketch(spark: SparkSession, table: str, a: datetime, b: datetime) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = spark.read.parquet(table).filter(_between(a, b) & (F.col("timestamp") >= at(a)) & (F.col("timestamp") < at(b)))
    return rows.agg(F.hll_sketch_agg("ip_address", LG_K).alias("ips")).filter("ips IS NOT NULL")


def _between(a: datetime, b: datetime) -> Column:
    return F.col("event_date").between(F.lit(a.date()), F.lit(b.date()))


def active_ips(spark: SparkSession, table: str, as_of: datetime, hours: int = 24) -> DataFrame:
    """About how many different addresses in the hours up to as_of, which is included."""
    tick = timedelta(microseconds=1)
    return unique_ips(spark, table, as_of - timedelta(hours=hours) + tick, as_of + tick)
