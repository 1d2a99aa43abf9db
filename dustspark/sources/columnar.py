"""Columnar payloads (a struct of parallel arrays) as rows, and the merging of overlapping pulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Payload name -> column of the hourly table
WEATHER_HOURLY = {
    "temperature_2m": "temp_c", "relative_humidity_2m": "rh_pct", "dew_point_2m": "dewpoint_c",
    "wind_speed_10m": "wind_ms", "wind_gusts_10m": "gust_ms", "wind_direction_10m": "wind_dir",
    "precipitation": "precip_mm", "shortwave_radiation": "ghi_wm2", "direct_normal_irradiance": "dni_wm2",
    "diffuse_radiation": "dhi_wm2", "cloud_cover": "cloud_pct",
}
AIR_HOURLY = {"pm10": "pm10", "pm2_5": "pm2_5", "dust": "dust_ugm3", "aerosol_optical_depth": "aod"}
# Payload name -> column of the daily table
WEATHER_DAILY = {
    "shortwave_radiation_sum": "ghi_mj_m2", "temperature_2m_max": "tmax_c", "temperature_2m_min": "tmin_c",
    "temperature_2m_mean": "tmean_c", "relative_humidity_2m_mean": "rh_mean_pct",
    "wind_speed_10m_max": "wind_max_ms", "wind_gusts_10m_max": "gust_max_ms", "precipitation_sum": "precip_mm",
    "wind_direction_10m_dominant": "wind_dir_deg",
}


def payload_schema(block: str, names: list[str], keys: str = "site_id string") -> str:
    arrays = ", ".join(f"`{n}`: array<double>" for n in names)
    return f"{keys}, {block} struct<time: array<string>, {arrays}>"


def read_payloads(spark: SparkSession, path: str, block: str, names: list[str],
                  keys: str = "site_id string") -> DataFrame:
    """JSON files, one payload per file, under a declared schema."""
    return spark.read.schema(payload_schema(block, names, keys)).json(path, multiLine=True)


def unpack(payloads: DataFrame, block: str, rename: dict[str, str], time: str = "time") -> DataFrame:
    """One row per time step. Arrays shorter than ``time`` (or absent) give nulls.

    All other columns of the payload row are kept.
    """
    inside = payloads.schema[block].dataType.fieldNames()
    others = [c for c in payloads.columns if c != block]
    arrays = [F.col(f"{block}.{time}").alias("_t")]
    arrays += [F.coalesce(F.col(f"{block}.`{n}`"), F.array().cast("array<double>")).alias(n)
               for n in rename if n in inside]
    rows = payloads.select(*others, F.inline_outer(F.arrays_zip(*arrays)))
    return rows.filter(F.col("_t").isNotNull()).select(
        *others, F.col("_t").alias(time),
        *[(F.col(n) if n in inside else F.lit(None).cast("double")).alias(c) for n, c in rename.items()])


def hourly_rows(weather: DataFrame, air: DataFrame) -> DataFrame:
    """Hourly observations: the weather feed with the air feed joined on site and time (not on position)."""
    w = unpack(weather, "hourly", WEATHER_HOURLY)
    a = unpack(air, "hourly", AIR_HOURLY)
    out = w.join(a, ["site_id", "time"], "left").withColumn("aq_measured", F.col("dust_ugm3").isNotNull())
    return out.withColumn("ts", F.to_timestamp("time")).drop("time")


def daily_rows(weather: DataFrame) -> DataFrame:
    return unpack(weather, "daily", WEATHER_DAILY).withColumn("date", F.to_date("time")).drop("time")


def merge_chunks(*parts: DataFrame) -> DataFrame:
    """Concatenate chunked pulls; a variable missing from a chunk becomes null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def latest_chunk_wins(rows: DataFrame, keys: list[str], chunk_start: str) -> DataFrame:
    """Overlapping windows: keep the row of the latest chunk per key, as a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    order: list[Column] = [F.col(chunk_start)] + [F.col(c) for c in rest if c != chunk_start]
    names = [chunk_start] + [c for c in rest if c != chunk_start]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*[c.alias(n) for c, n in zip(order, names)])).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
