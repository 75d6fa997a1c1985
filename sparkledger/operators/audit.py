"""The audit trail: who looked at, imported or exported what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target(action: Column, ip: Column, operation: Column, log_id: Column, count: Column) -> Column:
    """What an access was about; absent values read `null`."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    listed = F.concat(F.lit("ip="), text(ip), F.lit(", operation="), text(operation))
    return F.when(action.isin("VIEW_LOGS", "EXPORT_LOGS"), listed).when(action == "VIEW_DETAIL", F.concat(F.lit("logId="), text(log_id))).when(action == "UPLOAD_LOGS", F.concat(F.lit("count="), text(count)))


def client_address(forwarded: Column, peer: Column) -> Column:
    """The first forwarded address, else the peer's."""
    return F.when(F.trim(forwarded) != "", F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))).otherwise(peer)


def records(accesses: DataFrame) -> DataFrame:
    """Audit rows of accesses: id, user, action, ip, operation, log_id, count, forwarded, peer, ok, at."""
    c = F.col
    return accesses.select(
        "id", F.coalesce(c("user"), F.lit("anonymous")).alias("operator"), "action", target(c("action"), c("ip"), c("operation"), c("log_id"), c("count")).alias("target"),
        client_address(c("forwarded"), c("peer")).alias("ip_address"), F.when(c("ok"), "SUCCESS").otherwise("FAILED").alias("status"), c("at").alias("created_at"),
    )


def by_operator(rows: DataFrame, operator: str) -> DataFrame:
    return rows.filter(F.col("operator") == operator).orderBy(F.desc("created_at"), F.desc("id"))
