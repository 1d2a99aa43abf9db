"""Declared schemas of the logical tables, and the scan-side normalisation to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustspark.functions.cleaning import num

SITES = "site_id string, name string, region string, climate string, lat double, lon double, capacity_kwp double"
HOURLY = ("site_id string, ts timestamp, temp_c double, rh_pct double, dewpoint_c double, wind_ms double, gust_ms double, "
          "wind_dir double, precip_mm double, ghi_wm2 double, dni_wm2 double, dhi_wm2 double, cloud_pct double, pm10 double, "
          "pm2_5 double, dust_ugm3 double, aod double, aq_measured boolean")
DAILY = ("site_id string, date date, lat double, lon double, elevation_m double, ghi_mj_m2 double, tmax_c double, tmin_c double, "
         "tmean_c double, rh_mean_pct double, wind_max_ms double, gust_max_ms double, precip_mm double, wind_dir_deg double, "
         "pm10_max double, pm10_mean double, dust_max double, dust_mean double, aod_max double, aod_mean double, pm25_mean double")
TRAINING = ("site_id string, region string, source string, aq_source string, date date, lat double, lon double, elevation_m double, "
            "tmax_c double, tmin_c double, tmean_c double, rh_mean_pct double, wind_max_kmh double, gust_max_kmh double, "
            "precip_mm double, radiation_mj_m2 double, et0_mm double, pm10_mean_ugm3 double, pm10_max_ugm3 double, "
            "pm2_5_mean_ugm3 double, dust_mean_ugm3 double, dust_max_ugm3 double, aod_mean double, aod_max double, aq_hours_valid int")
ROLLUP = ("site_id string, date date, irradiation_kwh_m2 double, tair_max_c double, tair_mean_c double, tcell_max_c double, "
          "rh_mean_pct double, wind_max_ms double, gust_max_ms double, precip_mm double, pm10_ugm3 double, dust_ugm3 double, "
          "aod double, peak_ghi_wm2 double")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The declared columns in order. Missing ones are null; numbers which are blank, unparsable, NaN or
    infinite become null, so there is one representation of a missing value after the scan."""
    out = []
    for field in T.StructType.fromDDL(schema).fields:
        if field.name not in df.columns:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.DoubleType):
            value = num(field.name)
        else:
            value = F.col(field.name).try_cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)
