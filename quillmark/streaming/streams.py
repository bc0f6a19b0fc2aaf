"""Sessions, day windows, deduplication and day-partitioned sinks for Structured Streaming and batch alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, started, n): runs of events with less than a gap between neighbours."""
    s = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("started"), "n")


def kst_days(events: DataFrame, ts: str, *keys: str) -> DataFrame:
    """Counts by Korean day: midnight there is 15:00 UTC."""
    w = events.groupBy(F.window(ts, "1 day", "1 day", "15 hours").alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.to_date(F.from_utc_timestamp("w.start", "Asia/Seoul")).alias("day"), *keys, "n")


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of a key; state is dropped once the watermark has passed it."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def on_time(events: DataFrame, ts: str, now, days: int = 540) -> DataFrame:
    """Rows no older than so many days."""
    return events.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def write_days(events: DataFrame, path: str, checkpoint: str, day: str = "day", batch: str = "batch") -> StreamingQuery:
    """Runs through what has arrived; files are partitioned by day and batch id.

    A repeated batch replaces its own partitions alone, so that no row is written twice and no other batch's rows go.
    """

    def put(rows: DataFrame, batch_id: int) -> None:
        rows = rows.withColumn(batch, F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, batch).parquet(path)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
