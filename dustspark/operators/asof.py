"""Imagery availability, source probes and fetch windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_available(requests: DataFrame, available: DataFrame, days_back: int = 20,
                     months_back: int = 24) -> DataFrame:
    """Newest imagery day at or before each request, within the tolerance of the layer's kind.

    ``requests`` has ``layer``, ``kind`` (daily or monthly) and ``date``; ``available`` has ``layer`` and
    ``date``. Each available day is spread over the request days it can serve, so the as-of join is an
    equality join on (layer, day) against at most one row per layer and day. Monthly layers look at first
    days of months only.
    """
    days = available.select("layer", "date").distinct()
    daily = days.select("layer", F.lit("daily").alias("kind"), F.col("date").alias("_avail"), F.explode(
        F.sequence("date", F.date_add("date", days_back), F.expr("interval 1 day"))).alias("_slot"))
    monthly = days.filter(F.dayofmonth("date") == 1).select(
        "layer", F.lit("monthly").alias("kind"), F.col("date").alias("_avail"), F.explode(
            F.sequence("date", F.add_months("date", months_back), F.expr("interval 1 month"))).alias("_slot"))
    lookup = daily.unionByName(monthly).groupBy("layer", "kind", "_slot").agg(
        F.max("_avail").alias("effective_date"))
    slot = F.when(F.col("kind") == "monthly", F.trunc("date", "month")).otherwise(F.col("date"))
    return requests.withColumn("_slot", slot).join(lookup, ["layer", "kind", "_slot"], "left").drop("_slot")


def feasible_date(kind: Column, today: Column, latency_days: int = 3) -> Column:
    """Latest date worth asking for: first of the month for monthly layers, else a few days ago."""
    return F.when(kind == "monthly", F.trunc(today, "month")).otherwise(F.date_sub(today, latency_days))


def fetch_windows(ranges: DataFrame, step: int) -> DataFrame:
    """Consecutive closed windows of ``step`` days over each row's [start, end], the last one clipped."""
    starts = F.sequence("start", "end", F.expr(f"interval {int(step)} day"))
    return ranges.filter(F.col("start") <= F.col("end")).withColumn("window_start", F.explode(starts)).withColumn(
        "window_end", F.least(F.date_add("window_start", step - 1), F.col("end")))


def source_health(registry: DataFrame, probes: DataFrame) -> DataFrame:
    """Registry with its newest probe; sources which need a key are ``gated``.

    ``probes`` has ``source_id``, ``checked`` (orderable, unique per source), ``http`` and ``bytes``.
    """
    newest = probes.groupBy("source_id").agg(F.max(F.struct("checked", "http", "bytes")).alias("_p"))
    status = (F.when(F.col("access") != "open", "gated")
              .when(F.col("_p").isNull() | F.col("_p.http").isNull(), "unreachable")
              .when(F.col("_p.http") == 200, "live").when(F.col("_p.http") == 204, "no_data")
              .otherwise("error"))
    is_open = F.col("access") == "open"
    return registry.join(newest, "source_id", "left").select(
        *registry.columns, status.alias("status"),
        F.when(is_open, F.col("_p.http")).alias("http"), F.when(is_open, F.col("_p.bytes")).alias("bytes"))


def health_summary(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if(F.col("status") == "live").alias("open_live"),
                      F.count_if(F.col("access") == "open").alias("open_total"),
                      F.count_if(F.col("status") == "gated").alias("gated"))
