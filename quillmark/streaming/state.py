"""Source states that expire inside of a stream: demotions that end after thirty days without a reading.

``SourceState`` is a processor for ``transformWithStateInPandas``: for each source it keeps the counts of its readings, the
day of the last one, and the status last said, in the state store (RocksDB) and so in the checkpoint. A row goes out
whenever a source's status changes. A demoted source sets a timer in event time for the day its demotion ends; a further
reading moves it, and when it fires the source is watched again. So a demotion also ends where no row of the source ever
comes again, which a recomputation only sees when it is run.

Results after all readings up to a watermark equal ``operators.tabs.source_status`` for the watermark's day. State is one
small row a source. A stream that is stopped goes on from its checkpoint with the same states and timers.

Edge cases: readings without a source are dropped; a null keep counts as not kept, a null sharpness isn't averaged; of
readings of one batch all count, in any order; readings that are not after the watermark are dropped, as their source's
demotion may have ended already.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
# Bounds of the status of a source.
DEMOTED_FROM, DEMOTED_BELOW, DEMOTED_SHARPNESS = 8, 0.2, 4.5
TRUSTED_FROM, TRUSTED_RATE = 6, 0.6
STATES = "source string, status string, seen long, kept long, last timestamp, ended boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and typed state need this store; a stream keeps the store it was started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def status_of(seen: int, kept: int, sharp: float, rated: int, fresh: bool) -> str:
    rate = kept / seen
    if seen >= DEMOTED_FROM and rate < DEMOTED_BELOW and rated and sharp / rated < DEMOTED_SHARPNESS and fresh:
        return "demoted"
    return "trusted" if seen >= TRUSTED_FROM and rate >= TRUSTED_RATE else "watch"


class SourceState(StatefulProcessor):
    """Readings of a source -> a row for each change of its status."""

    def __init__(self, forget: int = 30):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "seen long, kept long, sharp double, rated long, last long, status string, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  named by the base class
        seen, kept, sharp, rated, last, status, timer = self.counts.get() if self.counts.exists() else (0, 0, 0.0, 0, 0, "", 0)
        for part in rows:
            keep, points = part["keep"].fillna(False).astype(bool), part["sharpness"].dropna()
            seen, kept, sharp, rated = seen + len(part), kept + int(keep.sum()), sharp + float(points.sum()), rated + len(points)
            last = max(last, int(part["at"].max()) // DAY_MS * DAY_MS)
        end = last + self.forget * DAY_MS
        said = status_of(seen, kept, sharp, rated, end > timerValues.getCurrentWatermarkInMs())
        if timer:
            self.handle.deleteTimer(timer)
        timer = end if said == "demoted" else 0
        if timer:
            self.handle.registerTimer(timer)
        self.counts.update((seen, kept, sharp, rated, last, said, timer))
        if said != status:
            yield self._row(key[0], said, seen, kept, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, kept, sharp, rated, last, _, _ = self.counts.get()
        said = status_of(seen, kept, sharp, rated, False)
        self.counts.update((seen, kept, sharp, rated, last, said, 0))
        yield self._row(key[0], said, seen, kept, last, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(source: str, status: str, seen: int, kept: int, last: int, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"source": [source], "status": [status], "seen": [seen], "kept": [kept], "last": [pd.Timestamp(last, unit="ms")], "ended": [ended]})


def source_changes(readings: DataFrame, forget: int = 30, late: str = "1 day") -> DataFrame:
    """A stream of readings (source, ts, keep, sharpness) -> changes of status, those by expiry too."""
    rows = readings.where("source IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("source", "ts", F.col("keep").cast("boolean").alias("keep"), F.col("sharpness").cast("double").alias("sharpness"), F.unix_millis("ts").alias("at"))
    return rows.groupBy("source").transformWithStateInPandas(SourceState(forget), STATES, "Update", "EventTime")


def follow_sources(readings: DataFrame, path: str, checkpoint: str, forget: int = 30, late: str = "1 day") -> StreamingQuery:
    """Runs through what has arrived; changes are appended under the batch they came in, a repeated batch replaces its own."""
    use_rocksdb(readings.sparkSession)

    def put(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    out = source_changes(readings, forget, late).writeStream.foreachBatch(put).outputMode("update")
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """Each source's last change: within a batch an end comes before a new status of later readings."""
    rows = spark.read.schema(STATES + ", batch long").parquet(path)
    order = F.struct("batch", "last", F.col("ended").cast("int"))
    return rows.groupBy("source").agg(F.max_by(F.struct("status", "seen", "kept", "last", "ended"), order).alias("v")).select("source", "v.*")
