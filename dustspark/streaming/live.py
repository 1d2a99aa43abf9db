"""Stream forms of the daily roll-up, of de-duplication and of the running site state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from dustspark import constants as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watch_hours(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Hourly observations arriving as Parquet files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def unique_hours(hours: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each (site, hour) once, however often it is delivered within the lateness."""
    return hours.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["site_id", "ts"])


def daily_stream(hours: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Daily roll-up of an hourly stream; a day is emitted once the watermark has passed its end."""
    marked = hours if hours.isStreaming and _has_watermark(hours) else hours.withWatermark("ts", lateness)
    return marked.groupBy("site_id", F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("hours"), F.avg("pm10").alias("pm10_ugm3"), F.avg("dust_ugm3").alias("dust_ugm3"),
        F.avg("aod").alias("aod"), (F.sum(F.coalesce("ghi_wm2", F.lit(0.0))) / 1000.0).alias("irradiation_kwh_m2"),
        F.max("temp_c").alias("tair_max_c")).select(
        "site_id", F.to_date("w.start").alias("date"), "hours", "pm10_ugm3", "dust_ugm3", "aod",
        "irradiation_kwh_m2", "tair_max_c")


def _has_watermark(df: DataFrame) -> bool:
    return "spark.watermarkDelayMs" in df.schema["ts"].metadata


def split_late(batch: DataFrame, batch_id: int, folder: str, lateness: str, closes: Column, kept: list[str]) -> None:
    """One micro-batch into two sinks: rows whose ``closes`` (the event time after which they count no more) the watermark has passed go to ``late``.

    The watermark is the latest ``ts`` of all batches before, less the lateness, as a stream's own. Each batch's
    latest ``ts`` is kept beside the sinks, and a batch's folders are overwritten, so a batch that is run again after a
    failure leaves the same rows, once.
    """
    spark = batch.sparkSession
    clock = f"{folder}/clock"
    spark.createDataFrame([], "batch long, latest timestamp").write.mode("ignore").parquet(f"{clock}/batch=-1")
    seen = spark.read.schema("latest timestamp, batch long").parquet(clock).where(F.col("batch") < batch_id).agg(F.max("latest").alias("m")).first()["m"]
    passed = F.lit(None).cast("timestamp") if seen is None else F.lit(seen) - F.expr(f"INTERVAL {lateness}")
    late = F.coalesce(closes <= passed, F.lit(False))
    rows = batch.persist()
    try:
        rows.where(~late).select(*kept).write.mode("overwrite").parquet(f"{folder}/ontime/batch={batch_id}")
        rows.where(late).select(*kept, passed.alias("watermark")).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        rows.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{clock}/batch={batch_id}")
    finally:
        rows.unpersist()


def divert_late(stream: DataFrame, folder: str, checkpoint: str, lateness: str, closes: Column) -> None:
    """Runs what is there of a stream (one file a batch if it was opened so) through ``split_late``."""
    kept = list(stream.columns)
    query = stream.writeStream.foreachBatch(lambda rows, n: split_late(rows, n, folder, lateness, closes, kept)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def day_end(ts: Column) -> Column:
    return F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")


_WAITING = "day long, dust_factor double, precip_mm double, pm10_max double, threshold double"


class SiteState(StatefulProcessor):
    """Per site the exposure and rows since rain, and a list of days that wait for the watermark.

    The earliest waiting day has an event-time timer at its own time. When the watermark has passed it, all days before the
    watermark leave the list in the order of their dates, whatever the order of their arrival, and the next day sets the
    timer: the list is read once a batch, not once a day. A day delivered again while it waits replaces the first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("site", "exposure double, since_rain int")
        self._waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = {w[0]: w for w in self._waiting.get()}
        timed = min(waiting, default=None)
        for part in rows:
            for ts, *values in zip(part["ts"], *[part[c].astype(float) for c in ("dust_factor", "precip_mm", "pm10_max", "threshold")], strict=True):
                at = int(pd.Timestamp(ts).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(ts).tzinfo is None else int(pd.Timestamp(ts).timestamp() * 1000)
                waiting[at] = (at, *map(float, values))
        first = min(waiting, default=None)
        if first is not None and (timed is None or first < timed):
            self._handle.registerTimer(first)
        self._waiting.put(list(waiting.values()))
        yield pd.DataFrame({"site_id": [], "day": [], "exposure": [], "days_since_rain": [], "storm_alert": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        due, rest = [], []
        for w in self._waiting.get():
            (due if w[0] <= passed else rest).append(w)
        exposure, since = self._state.get() if self._state.exists() else (0.0, C.DAYS_SINCE_CAP)
        out = []
        for day, dust_factor, precip_mm, pm10_max, threshold in sorted(due):
            exposure = min(C.MAX_EXPOSURE, exposure + dust_factor)
            if precip_mm >= C.RAIN_WASHOFF_MM:
                exposure *= C.RAIN_WASHOFF_KEEP
            since = 0 if precip_mm >= 1.0 else min(since + 1, C.DAYS_SINCE_CAP)
            out.append((key[0], day, exposure, since, bool(pm10_max >= threshold)))
        if due:
            if rest:
                self._waiting.put(rest)
                self._handle.registerTimer(min(w[0] for w in rest))
            else:
                self._waiting.clear()
            self._state.update((float(exposure), int(since)))
        yield pd.DataFrame(out, columns=["site_id", "day", "exposure", "days_since_rain", "storm_alert"])

    def close(self) -> None:
        pass


def site_state_stream(days: DataFrame, lateness: str = "3 days") -> DataFrame:
    """Running exposure (never cleaned), days since rain and storm alert of each site; a day comes out once the watermark reaches it.

    ``days`` streams (site_id, ts, dust_factor, precip_mm, pm10_max, threshold), ``ts`` the day as a timestamp. Days that are later than the
    lateness are dropped; ``divert_late`` in front keeps them. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    site = days.schema["site_id"].dataType.simpleString()
    released = days.withWatermark("ts", lateness).groupBy("site_id").transformWithStateInPandas(
        SiteState(), f"site_id {site}, day long, exposure double, days_since_rain int, storm_alert boolean", "Append", "EventTime")
    return released.select("site_id", F.to_date(F.timestamp_millis("day")).alias("date"), "exposure", "days_since_rain", "storm_alert")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything which is there, write Parquet, stop. The checkpoint lets a restart go on."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
