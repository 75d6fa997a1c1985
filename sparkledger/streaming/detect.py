"""Extensions: brute force within sliding windows, in batch and on streams."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import extract
from ..operators import anomaly, search


def _micros(spark: SparkSession, length: str) -> int:
    """Of a duration as windows take it, such as "10 minutes"."""
    return spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {length}) AS n").first()["n"]


def sliding_brute_force(logs: DataFrame, threshold: int = 5, length: str = "10 minutes", slide: str = "1 minute", operations=("LOGIN",)) -> DataFrame:
    """Windows in which an address fails at least `threshold` times.

    Failures are counted by panes first, stretches of which every window holds whole ones, and only these counts are dealt to
    the windows that overlap: a failure is one row of the first count, however many windows it lies in."""
    spark = logs.sparkSession
    pane = gcd(_micros(spark, length), _micros(spark, slide))
    rows = search.with_operations(search.failed(logs), operations).filter("ip_address IS NOT NULL AND timestamp IS NOT NULL")
    panes = rows.groupBy(F.window("timestamp", f"{pane} microseconds").alias("p"), "ip_address").agg(F.count("*").alias("n"))
    counts = panes.groupBy(F.window(F.window_time("p"), length, slide).alias("w"), "ip_address").agg(F.sum("n").alias("failed_attempts"))
    found = counts.filter(F.col("failed_attempts") >= threshold)
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "ip_address", "failed_attempts", anomaly.tier(F.col("failed_attempts"), threshold).alias("risk_level"))


def stream_detect(spark: SparkSession, folder: str, out: str, checkpoint: str, threshold: int = 5, length: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes", year: int = 1970, address: str = extract.IPV4) -> StreamingQuery:
    """Read what lies in a folder of text logs, and what came since the last call; append windows that are over. `address`: see extract.ip_address()."""
    lines = spark.readStream.text(folder).select(F.make_valid_utf8("value").alias("value"))
    # watermarks take timestamps with a zone only
    logs = extract.parse_lines(lines, "value", year, address).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    found = sliding_brute_force(logs, threshold, length, slide)
    return found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
