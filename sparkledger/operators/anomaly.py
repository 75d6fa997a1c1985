"""Brute-force detection per address, and the report around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITIES
from ..sources import scratch
from . import search, stats


def tier(failures: Column, threshold: int) -> Column:
    """HIGH from three times the threshold, MEDIUM from twice, LOW from once."""
    return F.when(failures >= 3 * threshold, "HIGH").when(failures >= 2 * threshold, "MEDIUM").when(failures >= threshold, "LOW").otherwise("NORMAL")


def failures_per_ip(logs: DataFrame, operations: Sequence[str] | None = ("LOGIN",)) -> DataFrame:
    """Of failed rows with an address: failures, first and last time, users, operations (sorted)."""
    rows = search.failed(logs).filter("ip_address IS NOT NULL")
    if operations:
        rows = search.with_operations(rows, operations)
    return rows.groupBy("ip_address").agg(
        F.count("*").alias("failed_attempts"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count_distinct("username").alias("unique_users"), F.array_sort(F.collect_set("operation")).alias("operations_attempted"),
    )


def operations_in_order(logs: DataFrame) -> DataFrame:
    """Operations of each address by first time: two aggregations, no window over a busy address."""
    first = search.failed(logs).filter("ip_address IS NOT NULL AND operation IS NOT NULL").groupBy("ip_address", "operation").agg(F.min("timestamp").alias("at"))
    lists = first.groupBy("ip_address").agg(F.array_sort(F.collect_list(F.struct("at", "operation"))).alias("x"))
    return lists.select("ip_address", F.transform("x", lambda s: s["operation"]).alias("operations_attempted"))


def brute_force(logs: DataFrame, threshold: int = 5, operations: Sequence[str] | None = ("LOGIN",)) -> DataFrame:
    """Addresses with at least `threshold` failures, most failures first."""
    if threshold < 1:
        raise ValueError("the threshold starts at 1")
    found = failures_per_ip(logs, operations).filter(F.col("failed_attempts") >= threshold)
    return found.withColumn("is_suspicious", F.lit(True)).withColumn("risk_level", tier(F.col("failed_attempts"), threshold)).orderBy(F.desc("failed_attempts"), "ip_address")


def report_rows(logs: DataFrame, operations: Sequence[str] | None = ("LOGIN",)) -> DataFrame:
    """All that a report needs in one pass over the log: a row per (section, key), sections total, severity, operation and ip.

    n, n_failed; for failures among `operations` (all, if None) the columns of failures_per_ip().
    Rows are counted by what the sections ask of them before they are dealt to sections, so that neither the log nor the
    users of a busy address are multiplied: after the first step there is one row for each combination of values that occurs."""
    fail = F.coalesce(F.col("operation_result") == "FAIL", F.lit(False))
    asked = fail & F.coalesce(F.upper("operation").isin(*[o.upper() for o in operations]), F.lit(False)) if operations else fail
    asked = asked & F.col("ip_address").isNotNull()
    rows = logs.select("severity", "operation", "ip_address", fail.alias("fail"), asked.alias("asked"), F.when(asked, F.col("username")).alias("username"), F.when(asked, F.col("timestamp")).alias("at"))
    met = rows.groupBy("severity", "operation", "ip_address", "fail", "asked", "username").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    cell = lambda section, key: F.struct(F.lit(section).alias("section"), key.alias("key"))
    cells = F.array(cell("total", F.lit(None).cast("string")), *[cell(s, F.col(c)) for s, c in (("severity", "severity"), ("operation", "operation"), ("ip", "ip_address"))])
    met = met.withColumn("x", F.explode(cells)).filter("x.section = 'total' OR x.key IS NOT NULL")
    own = F.col("asked") & (F.col("x.section") == "ip")
    of = lambda c: F.when(own, F.col(c))
    # per user first: users of an address are counted as rows, not gathered
    users = met.groupBy("x.section", "x.key", of("username").alias("username"), own.alias("own")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("fail"), F.col("n")).otherwise(0)).alias("failed"), F.min(of("first")).alias("first"), F.max(of("last")).alias("last"), F.collect_set(of("operation")).alias("operations"),
    )
    of_own = lambda c: F.when(F.col("own"), F.col(c))
    return users.groupBy("section", "key").agg(
        F.sum("n").alias("n"), F.sum("failed").alias("n_failed"), F.coalesce(F.sum(of_own("n")), F.lit(0)).alias("failed_attempts"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        F.count(of_own("username")).alias("unique_users"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("operations")))).alias("operations_attempted"),
    )


def report(logs: DataFrame, threshold: int = 5) -> dict[str, DataFrame]:
    """summary (one row), suspicious, fail_operations, severities: all read from the rows of report_rows(), which are
    written once, by one pass over the log. The caller of scratch.owned() around this owns them; without one they stay."""
    if threshold < 1:
        raise ValueError("the threshold starts at 1")
    rows = scratch.table(logs.sparkSession, report_rows(logs), "report-rows")
    all_ = F.col("section") == "total"
    summary = rows.agg(
        F.coalesce(F.sum(F.when(all_, F.col("n"))), F.lit(0)).alias("total_records"), F.coalesce(F.sum(F.when(all_, F.col("n_failed"))), F.lit(0)).alias("failed_records"),
        F.count_if(F.col("section") == "ip").alias("unique_ips"), F.count_if((F.col("section") == "ip") & (F.col("failed_attempts") >= threshold)).alias("suspicious_ips"),
    )
    summary = summary.select("total_records", "failed_records", stats.rate(F.col("failed_records"), F.col("total_records"), 2).alias("failure_rate"), "unique_ips", "suspicious_ips")
    suspicious = rows.filter((F.col("section") == "ip") & (F.col("failed_attempts") >= threshold)).select(F.col("key").alias("ip_address"), *SUSPICIOUS)
    suspicious = suspicious.withColumn("is_suspicious", F.lit(True)).withColumn("risk_level", tier(F.col("failed_attempts"), threshold)).orderBy(F.desc("failed_attempts"), "ip_address")
    operations = rows.filter("section = 'operation' AND n_failed > 0").select(F.col("key").alias("operation"), F.col("n_failed").alias("n")).orderBy(F.desc("n"), "operation")
    levels = rows.filter("section = 'severity'").select(F.col("key").alias("severity"), "n")
    return {"rows": rows, "summary": summary, "suspicious": suspicious, "fail_operations": operations, "severities": levels}


SUSPICIOUS = ("failed_attempts", "first_seen", "last_seen", "unique_users", "operations_attempted")
#: Labels of the report.
TITLE, RULE = "          日志异常检测报告", "=" * 60
TOTAL, FAILED, IPS, SUSPECTS = "  总日志条数:         ", "  失败操作数:         ", "  独立 IP 数:         ", "  可疑 IP 数:         "
BY_OPERATION, BY_SEVERITY, LIST = "  失败操作分布:", "  严重程度分布:", "  可疑 IP 列表:"


def report_lines(sections: dict[str, DataFrame], threshold: int = 5) -> DataFrame:
    """The report as rows: part and place (in whose order the lines stand) and line. Made by Spark, however many addresses there are."""
    s, c = sections["summary"], F.col
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    share = F.when(c("total_records") > 0, F.format_string(" (%.2f%%)", "failure_rate")).otherwise("")
    head = [F.lit(RULE), F.lit(TITLE), F.lit(RULE), text(TOTAL, c("total_records")), text(FAILED, c("failed_records"), share), text(IPS, c("unique_ips")), text(SUSPECTS, c("suspicious_ips"), f" (阈值={threshold})"), F.lit("")]

    def numbered(part: int, lines: DataFrame, *order: Column) -> DataFrame:
        """Lines of one part, and what they are ordered by: two columns, k and name."""
        return lines.select(F.lit(part).alias("part"), F.struct(*order).alias("by"), "line")

    top = s.select(F.posexplode(F.array(*head)).alias("k", "line"))
    operations = sections["fail_operations"].select(text("    - ", c("operation"), ": ", c("n"), " 次").alias("line"), (-c("n")).alias("k"), c("operation").alias("name"))
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), c("severity"))
    levels = sections["severities"].filter(place > 0).select(text("    - ", c("severity"), ": ", c("n"), " 条").alias("line"), place.alias("k"))
    any_level = sections["severities"].limit(1)  # the heading stands over levels of any name
    suspects = sections["suspicious"].select(text("    [!] ", c("ip_address"), " — 失败 ", c("failed_attempts"), " 次 [", c("risk_level"), "]").alias("line"), (-c("failed_attempts")).alias("k"), c("ip_address").alias("name"))
    none = F.lit("").alias("name")
    lines = lambda df, *x: df.limit(1).select(F.posexplode(F.array(*map(F.lit, x))).alias("k", "line"))
    last = s.select(F.posexplode(F.array(F.lit(""), F.lit(RULE))).alias("k", "line"))
    parts = [
        numbered(0, top, c("k").cast("long").alias("k"), none), numbered(1, lines(operations, BY_OPERATION), c("k").cast("long").alias("k"), none), numbered(2, operations, c("k"), c("name")),
        numbered(3, lines(any_level, "", BY_SEVERITY), c("k").cast("long").alias("k"), none), numbered(4, levels, c("k").cast("long").alias("k"), none),
        numbered(5, lines(suspects, "", LIST), c("k").cast("long").alias("k"), none), numbered(6, suspects, c("k"), c("name")), numbered(7, last, c("k").cast("long").alias("k"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("part", F.col("by.k").alias("place"), F.col("by.name").alias("name"), "line")


ORDER = ("part", "place", "name")
