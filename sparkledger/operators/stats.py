"""Counts, rates and distributions of the log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITIES

ABNORMAL = ("ERROR", "CRITICAL")


def rate(part: Column, whole: Column, digits: int) -> Column:
    """Per cent, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, digits), F.lit(0.0))


def day_stats(logs: DataFrame, day: str | None = None) -> DataFrame:
    """total and abnormal of one day, today by default; a half-open range, so that it reaches the scan."""
    d = F.lit(day).cast("date") if day else F.current_date()
    rows = logs.filter((F.col("timestamp") >= d.cast("timestamp_ntz")) & (F.col("timestamp") < F.date_add(d, 1).cast("timestamp_ntz")))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("severity").isin(*ABNORMAL)).alias("abnormal"))


def health(percent: Column) -> Column:
    return F.when(percent > 10, "danger").when(percent > 3, "warn").otherwise("ok")


def abnormal_rate_by_day(logs: DataFrame) -> DataFrame:
    days = logs.filter("timestamp IS NOT NULL").groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("severity").isin(*ABNORMAL)).alias("abnormal"))
    return rated(days)


def rated(days: DataFrame) -> DataFrame:
    """Rows with total and abnormal, with their rate and what it means."""
    return days.withColumn("abnormal_rate", rate(F.col("abnormal"), F.col("total"), 1)).withColumn("health", health(F.col("abnormal_rate")))


def failure_rate(logs: DataFrame) -> DataFrame:
    n = logs.agg(F.count("*").alias("total_records"), F.count_if(F.col("operation_result") == "FAIL").alias("failed_records"))
    return n.withColumn("failure_rate", rate(F.col("failed_records"), F.col("total_records"), 2))


def unique_ips(logs: DataFrame, approximate: bool = False) -> DataFrame:
    return logs.agg((F.approx_count_distinct if approximate else F.count_distinct)("ip_address").alias("unique_ips"))


def active_ips(logs: DataFrame, as_of: str | None = None, hours: int = 24) -> DataFrame:
    """Different addresses in the hours up to `as_of`, now by default."""
    end = F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")
    return unique_ips(logs.filter((F.col("timestamp") > end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("timestamp") <= end)))


def distribution(logs: DataFrame, column: str) -> DataFrame:
    """Rows by value, null left out."""
    return logs.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def failed_operations(logs: DataFrame) -> DataFrame:
    return distribution(logs.filter(F.col("operation_result") == "FAIL"), "operation").orderBy(F.desc("n"), "operation")


def severities(logs: DataFrame, display: bool = False) -> DataFrame:
    """With `display`, the known levels only, most severe first."""
    found = distribution(logs, "severity")
    if not display:
        return found
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return found.filter(place > 0).orderBy(place)


def report_counts(logs: DataFrame) -> DataFrame:
    """All counts of a report in one pass: rows of (section, key, n, n_failed); key is null in the total row."""
    fail = F.col("operation_result") == "FAIL"
    pairs = logs.select(F.explode(F.array(
        F.struct(F.lit("total").alias("section"), F.lit(None).cast("string").alias("key"), fail.alias("failed")),
        F.struct(F.lit("severity").alias("section"), F.col("severity").alias("key"), fail.alias("failed")),
        F.struct(F.lit("operation").alias("section"), F.col("operation").alias("key"), fail.alias("failed")),
    )).alias("x")).select("x.*").filter("section = 'total' OR key IS NOT NULL")
    return pairs.groupBy("section", "key").agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"))
