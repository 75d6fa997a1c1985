"""End-to-end jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..operators import anomaly, search, triage
from ..sources import readers, scratch, sinks


def log_report(spark: SparkSession, paths: list[str], out: str, threshold: int = 5, fmt: str = "auto", sql: bool = False, sections: bool = False, suspicious_csv: bool = True, address: str = extract.IPV4) -> dict[str, str]:
    """Parse, detect, report, export; returns where each output stands.

    The report is written whole, as text files in order below `report_text`: every failed operation and every suspicious
    address, however many. preview() gives its first lines as one text. The log is read once for all counts.
    `address`: see extract.ip_address()."""
    if threshold < 1:
        raise ValueError("the threshold starts at 1")
    written = {"report_text": f"{out}/report_text"}
    with scratch.owned(spark):
        logs = readers.read_logs(spark, paths, fmt, address=address)
        found = anomaly.report(logs, threshold)
        sinks.write_ordered_text(anomaly.report_lines(found, threshold), written["report_text"], anomaly.ORDER)
        if suspicious_csv:
            sinks.write_suspicious_csv(found["suspicious"], f"{out}/suspicious_ips")
            written["suspicious_ips"] = f"{out}/suspicious_ips"
        if sections:
            sinks.write_sections(report_sections(spark, found), f"{out}/report")
            written["report"] = f"{out}/report"
        if sql:
            sinks.write_sql(spark, readers.log_fields(logs), f"{out}/sql")
            written["sql"] = f"{out}/sql"
    return written


def preview(spark: SparkSession, path: str, lines: int = 100) -> str:
    """The first lines of a report that log_report() wrote, to show; the files have all."""
    with scratch.owned(spark):
        rows = readers.read_ordered_text(spark, path).filter(F.col("line_number") <= lines).collect()
    return "\n".join(r["value"] for r in sorted(rows, key=lambda r: r["line_number"]))


#: Headings of the report's sections.
METRICS = (("总日志条数", "total_records"), ("失败操作数", "failed_records"), ("独立 IP 数", "unique_ips"), ("可疑 IP 数", "suspicious_ips"))


def report_sections(spark: SparkSession, found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Summary, Suspicious_IPs, Fail_Distribution, Severity; a line of text where there is nothing."""
    pairs = [F.struct(F.lit(a).alias("指标"), F.col(b).cast("string").alias("值")) for a, b in METRICS]
    pairs.append(F.struct(F.lit("导出时间").alias("指标"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("值")))
    summary = found["summary"].select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    suspects, failed = found["summary"].first()["suspicious_ips"], not found["rows"].filter("section = 'operation' AND n_failed > 0").isEmpty()
    or_note = lambda df, note, some: df if some else spark.createDataFrame([(note,)], "`信息` string")
    operations = found["fail_operations"].select(F.col("operation").alias("操作类型"), F.col("n").alias("失败次数"))
    levels = found["severities"].select(F.col("severity").alias("严重程度"), F.col("n").alias("数量"))
    return {"Summary": summary, "Suspicious_IPs": or_note(found["suspicious"], "未发现可疑 IP", suspects), "Fail_Distribution": or_note(operations, "无失败操作", failed), "Severity": levels}


def load_and_search(spark: SparkSession, paths: list[str], table: str, number: int = 1, size: int = 20, address: str = extract.IPV4, **filters) -> tuple[dict[str, int], DataFrame]:
    """Parse, append to the log table, and look. `address`: see extract.ip_address()."""
    sinks.append_logs(spark, readers.log_fields(readers.read_logs(spark, paths, address=address)), table)
    return search.envelope(readers.read_table(spark, table), number, size, **filters)


def triage_suspicious(logs: DataFrame, replies: DataFrame | None, model: str, threshold: int = 5) -> DataFrame:
    """History rows for every log row of a suspicious address. logs: LOG_ENTRY columns.

    Texts that triage.admissible() refuses (blank, under 5 or over 5000 characters) are not judged, as the service refuses them."""
    suspects = anomaly.brute_force(logs, threshold).select("ip_address")
    rows = logs.join(suspects, "ip_address", "left_semi")
    text = F.concat_ws(" ", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "ip_address", F.concat(F.lit("User "), F.col("username")), "operation", "operation_result", "detail")
    rows = rows.select(F.col("id").alias("log_id"), "username", text.alias("log_content"), F.col("timestamp").alias("created_at"))
    judged, _ = triage.admissible(rows, "log_content")
    return triage.history(triage.resolve(judged, replies, model))
