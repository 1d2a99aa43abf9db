"""Adapters which read the driver tables under the logical schemas of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark.session import spread

VAL_START = "2000-01-01"
TEST_START = "2001-01-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """One row per site: id, name, climate, region, position, capacity."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    climate = (F.when(nation % 4 == 0, "west").when(nation % 4 == 1, "east")
               .when(nation % 4 == 2, "inland").otherwise("highland"))
    region = (F.when(nation % 6 == 0, "west").when(nation % 6 == 1, "east").when(nation % 6 == 2, "central")
              .when(nation % 6 == 3, "north").when(nation % 6 == 4, "northwest").otherwise("southwest_highland"))
    return table(spark, folder, "supplier").select(
        key.alias("site_id"), F.col("s_name").alias("name"), climate.alias("climate"), region.alias("region"),
        (16.0 + (key * 37 % 165) / 10.0).alias("lat"), (34.0 + (key * 53 % 220) / 10.0).alias("lon"),
        (1000.0 * (1 + key % 50)).alias("capacity_kwp"))


def daily(spark: SparkSession, folder: str, with_nulls: bool = False) -> DataFrame:
    """One row per site and day. ``with_nulls`` blanks PM10 on some days."""
    li = table(spark, folder, "lineitem")
    q, site = F.col("l_quantity"), F.col("l_suppkey")
    rain = F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.07), q / 4).otherwise(0.0)
    days = li.groupBy(site.alias("site_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.max(q * q).alias("_q2"), F.avg(q).alias("_q"), F.max(q).alias("_qmax"),
        F.max("l_tax").alias("_tax"), F.max("l_discount").alias("_disc"), F.sum(rain).alias("precip_mm"),
        F.max(F.col("l_partkey") % 20).alias("_p20"), F.max(F.col("l_orderkey") % 28).alias("_o28"),
        F.max(F.col("l_partkey") % 70).alias("_p70"),
    ).select(
        "site_id", "date",
        (F.col("_q2") * 0.05 * (4 + F.col("site_id") % 9)).alias("pm10_max"),
        (F.col("_q") * (2 + F.col("site_id") % 5)).alias("pm10_mean"),
        (F.col("_qmax") * 6).alias("dust_max"), (F.col("_q") * 4).alias("dust_mean"),
        (F.col("_tax") * 10).alias("aod_mean"),
        (3 + F.col("_disc") * 150).alias("gust_max_ms"), (2 + F.col("_disc") * 120).alias("wind_max_ms"),
        "precip_mm", (8.0 + F.col("_p20")).alias("ghi_mj_m2"), (15.0 + F.col("_o28")).alias("tmean_c"),
        (10.0 + F.col("_p70")).alias("rh_mean_pct"))
    if with_nulls:
        blank = (F.col("site_id") * 7 + F.dayofyear("date")) % 50 == 0
        days = days.withColumn("pm10_max", F.when(~blank, F.col("pm10_max"))) \
                   .withColumn("pm10_mean", F.when(~blank, F.col("pm10_mean")))
    return days


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """One row per site and hour; about four of five values of each measure are null."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, folder, "events").groupBy(
        F.col("user_id").alias("site_id"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(
        F.avg(F.when(kind == "view", value)).alias("pm10"),
        F.avg(F.when(kind == "click", value)).alias("dust_ugm3"),
        F.avg(F.when(kind == "purchase", value / 100)).alias("aod"),
        F.avg(F.when(kind == "signup", value * 8)).alias("ghi_wm2"),
        F.avg(F.when(kind == "error", value / 4)).alias("temp_c"))


def rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The daily table under the names of the serving roll-up."""
    return daily(spark, folder).select(
        "site_id", "date", (F.col("ghi_mj_m2") / 3.6).alias("irradiation_kwh_m2"),
        F.col("tmean_c").alias("tair_max_c"),
        F.lit(None).cast("double").alias("tcell_max_c"), F.lit(None).cast("double").alias("peak_ghi_wm2"),
        "rh_mean_pct", "wind_max_ms", "gust_max_ms", "precip_mm",
        F.col("pm10_mean").alias("pm10_ugm3"), F.col("dust_mean").alias("dust_ugm3"),
        (F.col("aod_mean")).alias("aod"))


def stations(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("station_id"), F.col("c_name").alias("name"),
        (16.0 + (key * 37 % 165) / 10.0).alias("lat"), (34.0 + (key * 53 % 220) / 10.0).alias("lon"),
        F.col("c_acctbal").alias("elev_m"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents")).select("doc_id", "text", "source", "lang")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages")).select("page_id", "url", "html")


def calls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("call_id"), F.col("event_type").alias("name"), F.col("props").alias("args"))


def chat(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
