"""Alerts the moment that an address crosses the threshold, once for each stretch of attack, in batch and on streams.

Time is cut into panes, of which each window of `length`, one starting every `slide`, holds whole ones. An episode of an address is
a longest run of successive windows that hold at least `threshold` failures each."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import extract
from ..operators import anomaly, search
from .detect import _micros, sliding_brute_force

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ALERT = "ip_address string, window_start timestamp, window_end timestamp, failed_attempts long"


def episodes(logs: DataFrame, threshold: int = 5, length: str = "10 minutes", slide: str = "1 minute", operations=("LOGIN",)) -> DataFrame:
    """ip_address, window_start, window_end and failed_attempts of the first window of each episode, its risk_level, and last_end.

    Only windows over the threshold are put in order, of an address at most as many as there are slides in the time that the log spans."""
    found = sliding_brute_force(logs, threshold, length, slide, operations)
    by, step = Window.partitionBy("ip_address").orderBy("window_start"), F.expr(f"INTERVAL {slide}")
    new = F.coalesce(F.lag("window_start").over(by) + step < F.col("window_start"), F.lit(True))
    found = found.withColumn("episode", F.sum(new.cast("int")).over(by))
    first = F.min(F.struct("window_start", "window_end", "failed_attempts", "risk_level")).alias("x")
    return found.groupBy("ip_address", "episode").agg(first, F.max("window_end").alias("last_end")).select("ip_address", "x.*", "last_end")


def _processor(threshold: int, length: int, slide: int):
    """The state of one address: how many failures in which pane, and of which windows an alert was raised. Lengths are in microseconds.

    What lies more than two lengths behind the watermark can change nothing any more and goes; when nothing is left, a timer
    removes the address. All is defined within, so that tasks need no other module."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    pane = gcd(length, slide)

    def crossings(counts: dict[int, int], raised: set[int], since: int):
        """First windows (start, failures) of episodes of which no window was raised before; all windows at or over the threshold are raised then."""
        sums: dict[int, int] = {}
        for at, n in counts.items():
            start = at - at % slide
            while start > at - length:
                sums[start] = sums.get(start, 0) + n
                start -= slide
        over = sorted(s for s, n in sums.items() if n >= threshold and s >= since)
        out, k = [], 0
        while k < len(over):
            end = k
            while end + 1 < len(over) and over[end + 1] == over[end] + slide:
                end += 1
            run = over[k : end + 1]
            if not raised & {run[0] - slide, *run}:
                out.append((run[0], sums[run[0]]))
            raised.update(run)
            k = end + 1
        return out

    class Alerts(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("panes", "at array<bigint>, n array<bigint>, raised array<bigint>, timer bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            at, n, raised, timer = self.state.get() if self.state.exists() else ([], [], [], None)
            counts, raised = dict(zip(at, n)), set(raised)
            for pdf in rows:
                micros = pdf["timestamp"].astype("datetime64[us]").astype("int64")
                for p, k in (micros - micros % pane).value_counts().items():
                    counts[int(p)] = counts.get(int(p), 0) + int(k)
            old = timerValues.getCurrentWatermarkInMs() * 1000 - 2 * length
            counts = {p: k for p, k in counts.items() if p >= old}
            found = crossings(counts, raised, old)
            raised = {s for s in raised if s >= old - slide}
            last = (max(counts) + 2 * length + pane) // 1000 + 1 if counts else None
            if timer != last:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if last is not None:
                    self.handle.registerTimer(last)
            if counts:
                self.state.update((list(counts), list(counts.values()), sorted(raised), last))
            elif self.state.exists():
                self.state.clear()
            time = lambda x: pd.to_datetime(x, unit="us")
            if found:
                yield pd.DataFrame({"ip_address": [key[0]] * len(found), "window_start": [time(s) for s, _ in found], "window_end": [time(s + length) for s, _ in found], "failed_attempts": [n for _, n in found]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.state.clear()
            return iter(())

        def close(self):
            pass

    return Alerts(), crossings


def alerts(logs: DataFrame, threshold: int = 5, length: str = "10 minutes", slide: str = "1 minute", operations=("LOGIN",)) -> DataFrame:
    """Of a stream with a watermark on `timestamp`: a row as soon as a batch shows an episode that none was raised for.

    failed_attempts: of the first window, as known then. Late rows within the watermark count; where they join two episodes
    both were raised already."""
    spark = logs.sparkSession
    rows = search.with_operations(search.failed(logs), operations).filter("ip_address IS NOT NULL AND timestamp IS NOT NULL").select("ip_address", "timestamp")
    processor, _ = _processor(threshold, _micros(spark, length), _micros(spark, slide))
    found = rows.groupBy("ip_address").transformWithStateInPandas(processor, ALERT, "Append", "EventTime")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "ip_address", "failed_attempts", anomaly.tier(F.col("failed_attempts"), threshold).alias("risk_level"))


def stream_alerts(spark: SparkSession, folder: str, out: str, checkpoint: str, threshold: int = 5, length: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes", year: int = 1970, files: int | None = None, address: str = extract.IPV4) -> StreamingQuery:
    """Read what lies in a folder of text logs, and what came since the last call, `files` at a time if given; append alerts. State is kept by RocksDB. `address`: see extract.ip_address()."""
    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    lines = reader.text(folder).select(F.make_valid_utf8("value").alias("value"))
    logs = extract.parse_lines(lines, "value", year, address).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)  # a query keeps the settings that it starts under
    try:
        return alerts(logs, threshold, length, slide).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)
