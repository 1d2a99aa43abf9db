"""Value cleaning and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark.functions import cleaning as CL
from dustspark.functions import scoring as SG
from dustspark.functions.geo import in_box
from dustspark.operators import daily as D
from dustspark.operators import profile as PR
from dustspark.plans.catalog.base import pick, query, rounded, sql
from dustspark.plans.catalog.scans import _DIRTY, dirty_lines
from dustspark.sources import fixtures as X
from dustspark.sources import text as TX


@query("p1_numeric_sanitiser", "P1", f"""SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, CASE WHEN isfinite(TRY_CAST({_DIRTY} AS DOUBLE)) THEN TRY_CAST({_DIRTY} AS DOUBLE) ELSE -1 END AS value FROM lineitem""")
def numeric_sanitiser(spark: SparkSession, d: str) -> DataFrame:
    return dirty_lines(spark, d).select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), CL.num("raw", -1.0).alias("value"))


@query("p2_column_defaults", "P2", sql("hourly", """SELECT site_id, strftime(ts, '%Y-%m-%d %H') AS hour, round(coalesce(temp_c, 3.0::DOUBLE),4) AS wind_max_ms,
      round(coalesce(pm10,0),4) AS pm10_max, round(coalesce(dust_ugm3,0),4) AS dust_max FROM hourly"""))
def column_defaults(spark: SparkSession, d: str) -> DataFrame:
    h = X.hourly(spark, d).select("site_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.col("temp_c").alias("wind_max_ms"),
                                  F.col("pm10").alias("pm10_max"), F.col("dust_ugm3").alias("dust_max"))
    return rounded(h.na.fill({"wind_max_ms": 3.0, "pm10_max": 0.0, "dust_max": 0.0}))


_TEMPS = """SELECT site_id, CAST(ts AS DATE) AS date, max(temp_c) AS tmax_c, CASE WHEN site_id % 9 = 0 THEN 'NaN'::DOUBLE ELSE min(temp_c) END AS tmin_c FROM hourly GROUP BY 1, 2"""


@query("p3_complete_spine", "P3 P10", sql("hourly", f"""SELECT site_id, date, round(tmax_c,6) AS tmax_c, round(tmin_c,6) AS tmin_c, round(0.5::DOUBLE*(tmax_c+tmin_c),6) AS tmean_c
    FROM ({_TEMPS}) WHERE tmax_c IS NOT NULL AND isfinite(tmin_c)"""))
def complete_spine(spark: SparkSession, d: str) -> DataFrame:
    days = X.hourly(spark, d).groupBy("site_id", F.to_date("ts").alias("date")).agg(F.max("temp_c").alias("tmax_c"), F.min("temp_c").alias("tmin_c"))
    days = days.withColumn("tmin_c", F.when(F.col("site_id") % 9 == 0, float("nan")).otherwise(F.col("tmin_c")))
    return rounded(D.complete_spine(days), 6)


@query("p4_usable_rows", "P4 P5 J2", sql("daily_n hourly", """, air AS (SELECT site_id, date, CASE WHEN dayofmonth(date) % 2 = 0 THEN dust_max END AS dust_max, dust_mean, pm10_max, pm10_mean,
      aod_mean AS aod_max, CASE WHEN dayofmonth(date) % 3 = 0 THEN aod_mean/2 END AS aod_mean FROM daily_n)
    SELECT site_id, date, round(ghi_mj_m2,4) AS ghi_mj_m2, round(a.pm10_max,4) AS pm10_max, round(coalesce(a.dust_max, 0.45::DOUBLE*a.pm10_max),4) AS dust_max,
      round(CASE WHEN a.dust_max IS NULL THEN 0.3::DOUBLE*a.pm10_mean ELSE a.dust_mean END,4) AS dust_mean, round(coalesce(a.aod_mean, a.aod_max),4) AS aod_mean
    FROM daily d JOIN air a USING (site_id, date) WHERE a.pm10_max IS NOT NULL AND d.date >= DATE '1997-01-01'""").replace("\n, air", ", air"))
def usable_rows(spark: SparkSession, d: str) -> DataFrame:
    weather = X.daily(spark, d).filter(F.col("date") >= F.lit("1997-01-01").cast("date")).select("site_id", "date", "ghi_mj_m2")
    n = X.daily(spark, d, with_nulls=True)
    day = F.dayofmonth("date")
    air = n.select("site_id", "date", "pm10_max", "pm10_mean", F.when(day % 2 == 0, F.col("dust_max")).alias("dust_max"), "dust_mean",
                   F.col("aod_mean").alias("aod_max"), F.when(day % 3 == 0, F.col("aod_mean") / 2).alias("aod_mean"))
    out = D.proxy_fallback(D.assemble_inner(weather, air))
    return pick(out, "site_id", "date", "ghi_mj_m2", "pm10_max", "dust_max", "dust_mean", "aod_mean")


@query("p6_all_finite_rows", "P6", sql("hourly", """SELECT site_id, strftime(ts, '%Y-%m-%d %H') AS hour, round(pm10,4) AS pm10, round(dust_ugm3,4) AS dust_ugm3 FROM hourly
    WHERE pm10 IS NOT NULL AND dust_ugm3 IS NOT NULL AND site_id % 11 <> 0"""))
def all_finite(spark: SparkSession, d: str) -> DataFrame:
    h = X.hourly(spark, d).select("site_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "pm10",
                                  F.when(F.col("site_id") % 11 == 0, float("inf")).otherwise(F.col("dust_ugm3")).alias("dust_ugm3"))
    clean = h.withColumns({c: CL.finite(F.col(c)) for c in ("pm10", "dust_ugm3")})
    return rounded(clean.dropna(how="any"))


@query("p7_alias_columns", "P7", sql("hourly", """SELECT site_id, strftime(ts, '%Y-%m-%d %H') AS hour, round(coalesce(pm10, dust_ugm3),4) AS pm10_mean_ugm3, round(temp_c,4) AS tmean_c, round(aod,4) AS aod_mean FROM hourly"""))
def alias_columns(spark: SparkSession, d: str) -> DataFrame:
    h = X.hourly(spark, d).select("site_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.col("pm10").alias(" PM10 "),
                                  F.col("dust_ugm3").alias("pm10_mean"), F.col("temp_c").alias("Temperature_2m"), F.col("aod").alias("aerosol_optical_depth"))
    return rounded(TX.canonical_names(h))


@query("p8_default_imputation", "P8", sql("daily_n hourly", """, med AS (SELECT median(pm10_mean) AS m1, min(pm10_mean) AS lo1, max(pm10_mean) AS hi1, median(dust_mean) AS m2, min(dust_mean) AS lo2, max(dust_mean) AS hi2 FROM daily_n WHERE date < DATE '1996-01-01')
    SELECT site_id, date, round(pm,4) AS pm10_mean, round(dust_mean,4) AS dust_mean, ((CASE WHEN pm < lo1-1e-9 OR pm > hi1+1e-9 THEN 1 ELSE 0 END)+(CASE WHEN dust_mean < lo2-1e-9 OR dust_mean > hi2+1e-9 THEN 1 ELSE 0 END))/2.0::DOUBLE AS out_of_range
    FROM (SELECT site_id, date, coalesce(pm10_mean, m1) AS pm, dust_mean, lo1, hi1, lo2, hi2 FROM daily_n, med WHERE date >= DATE '1996-01-01')""").replace("\n, med", ", med"))
def default_imputation(spark: SparkSession, d: str) -> DataFrame:
    n = X.daily(spark, d, with_nulls=True).select("site_id", "date", "pm10_mean", "dust_mean")
    early = F.col("date") < F.lit("1996-01-01").cast("date")
    cols = ["pm10_mean", "dust_mean"]
    bounds = PR.imputation_bounds(PR.feature_ranges(n.filter(early), cols), cols)
    return rounded(PR.impute_with_range_check(n.filter(~early), cols, bounds))


@query("p9_rolling_fill", "P9", sql("daily_n", """SELECT site_id, date, round(coalesce(pm10_mean, pm10_mean),4) AS pm10_mean_ugm3_7d_mean, round(CASE WHEN dayofmonth(date) > 15 THEN coalesce(aod_mean/2, aod_mean) ELSE aod_mean END,4) AS aod_mean_7d_mean,
      round(precip_mm,4) AS precip_mm_30d_sum FROM daily_n"""))
def rolling_fill(spark: SparkSession, d: str) -> DataFrame:
    n = X.daily(spark, d, with_nulls=True).select(
        "site_id", "date", F.col("pm10_mean").alias("pm10_mean_ugm3"), "aod_mean", "precip_mm",
        F.when(F.dayofmonth("date") > 15, F.col("aod_mean") / 2).alias("aod_mean_7d_mean"))
    return pick(TX.fill_rolling(n), "site_id", "date", "pm10_mean_ugm3_7d_mean", "aod_mean_7d_mean", "precip_mm_30d_sum")


@query("p11_bounding_box", "P11", sql("stations", "SELECT station_id, round(lat,4) AS lat, round(lon,4) AS lon FROM stations WHERE lat BETWEEN 16 AND 32.5 AND lon BETWEEN 34 AND 50"))
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    box = {"south": 16.0, "north": 32.5, "west": 34.0, "east": 50.0}
    return pick(X.stations(spark, d).filter(in_box(F.col("lat"), F.col("lon"), box)), "station_id", "lat", "lon")


@query("p12_keyword_filter", "P12", "SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%ent%' OR lower(text) LIKE '%ish%'")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return TX.keyword_filter(X.documents(spark, d), "text", ["ENT", "ish"]).select("doc_id", "lang")


@query("p14_unit_conversions", "P14", sql("daily sites", """SELECT site_id, date, round(ghi_mj_m2/3.6::DOUBLE,6) AS ghi_kwh, round(ghi_mj_m2*30/1000,6) AS wh_kwh, round(wind_max_ms*3.6::DOUBLE/3.6::DOUBLE,6) AS wind_ms,
      round(capacity_kwp/1000,6) AS mwp FROM daily JOIN sites USING (site_id)"""))
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    j = X.daily(spark, d).join(X.sites(spark, d).select("site_id", "capacity_kwp"), "site_id")
    return pick(j, "site_id", "date", CL.mj_to_kwh(F.col("ghi_mj_m2")).alias("ghi_kwh"), CL.wh_to_kwh(F.col("ghi_mj_m2") * 30).alias("wh_kwh"),
                CL.kmh_to_ms(CL.ms_to_kmh(F.col("wind_max_ms"))).alias("wind_ms"), CL.kwp_to_mwp(F.col("capacity_kwp")).alias("mwp"), digits=6)


@query("p15_prediction_clamps", "P15", sql("daily", """SELECT site_id, date, round(least(greatest(ghi_mj_m2-14,0),12),4) AS yield_kwh, round(least(greatest(pm10_max/10-5,0),65),4) AS soiling_pct,
      round(least(greatest(pm10_max/4-20,0),100),4) AS batch_loss_pct FROM daily"""))
def prediction_clamps(spark: SparkSession, d: str) -> DataFrame:
    return pick(X.daily(spark, d), "site_id", "date", SG.clamp_yield(F.col("ghi_mj_m2") - 14).alias("yield_kwh"),
                SG.clamp_soiling(F.col("pm10_max") / 10 - 5).alias("soiling_pct"), SG.clamp_batch_loss(F.col("pm10_max") / 4 - 20).alias("batch_loss_pct"))
