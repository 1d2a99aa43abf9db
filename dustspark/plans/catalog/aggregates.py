"""Roll-ups, percentiles, profiles and threshold studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.operators import daily as D
from dustspark.operators import features as FE
from dustspark.operators import profile as PR
from dustspark.operators import ranks as R
from dustspark.plans import reports as RP
from dustspark.plans.catalog.base import SQL_FEATURES, pick, query, rounded, sql
from dustspark.session import scratch, written
from dustspark.sources import fixtures as X
from dustspark.sources import sinks as K

_SERVING = """SELECT site_id, CAST(ts AS DATE) AS date, round(sum(coalesce(ghi_wm2,0))/1000,8) AS irradiation_kwh_m2, round(max(temp_c),8) AS tair_max_c,
      round({mean},8) AS tair_mean_c, round(max(temp_c+coalesce(ghi_wm2,0)*0.028::DOUBLE),8) AS tcell_max_c, round(avg(pm10),8) AS pm10_ugm3, round(avg(dust_ugm3),8) AS dust_ugm3,
      round(avg(aod),8) AS aod, round(max(coalesce(ghi_wm2,0)),8) AS peak_ghi_wm2 FROM hourly GROUP BY 1, 2"""
_SERVED = ("site_id", "date", "irradiation_kwh_m2", "tair_max_c", "tair_mean_c", "tcell_max_c", "pm10_ugm3",
           "dust_ugm3", "aod", "peak_ghi_wm2")


@query("a1_rollup_serving", "A1", sql("hourly", _SERVING.format(mean="avg(temp_c)")))
def rollup_serving(spark: SparkSession, d: str) -> DataFrame:
    return pick(D.rollup_serving(X.hourly(spark, d)), *_SERVED, digits=8)


@query("a1_rollup_null_as_zero", "A1", sql("hourly", _SERVING.format(mean="sum(coalesce(temp_c,0))/count(*)")))
def rollup_reference(spark: SparkSession, d: str) -> DataFrame:
    return pick(D.rollup_serving(X.hourly(spark, d), mode="reference"), *_SERVED, digits=8)


@query("a2_rollup_training", "A2", sql("hourly", """SELECT site_id, CAST(ts AS DATE) AS date, round(max(pm10),6) AS pm10_max, round(avg(pm10),6) AS pm10_mean, round(max(dust_ugm3),6) AS dust_ugm3_max, round(avg(dust_ugm3),6) AS dust_ugm3_mean,
      round(max(aod),6) AS aod_max, round(avg(aod),6) AS aod_mean, CAST((CASE WHEN count(pm10)>0 THEN 1 ELSE 0 END)+(CASE WHEN count(dust_ugm3)>0 THEN 1 ELSE 0 END)+(CASE WHEN count(aod)>0 THEN 1 ELSE 0 END) AS INTEGER) AS aq_hours
    FROM hourly GROUP BY 1, 2 HAVING greatest(count(pm10),count(dust_ugm3),count(aod)) > 0"""))
def rollup_training(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.rollup_training(X.hourly(spark, d), ["pm10", "dust_ugm3", "aod"]), 6)


@query("a3_rollup_harvest", "A3", sql("hourly", """SELECT site_id, CAST(ts AS DATE) AS date, round(max(pm10),6) AS pm10_max, round(avg(pm10),6) AS pm10_mean, count(pm10) AS pm10_n,
      round(max(aod),6) AS aod_max, round(avg(aod),6) AS aod_mean, count(aod) AS aod_n FROM hourly GROUP BY 1, 2 HAVING count(pm10)+count(aod) > 0"""))
def rollup_harvest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.rollup_stats(X.hourly(spark, d), ["pm10", "aod"]), 6)


@query("a3_local_day_rollup", "A3", sql("hourly", """SELECT site_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS date, round(max(pm10),6) AS pm10_max, round(avg(pm10),6) AS pm10_mean, count(pm10) AS pm10_n FROM hourly GROUP BY 1, 2 HAVING count(pm10) > 0"""))
def local_day(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.rollup_stats(X.hourly(spark, d), ["pm10"], tz="Asia/Riyadh"), 6)


@query("a4_storm_thresholds", "A4", sql("daily_n", """SELECT site_id, round(coalesce(greatest(3.0::DOUBLE*CASE WHEN nt > 0 THEN mt ELSE ma END, 300), 300),4) AS threshold FROM (SELECT site_id,
      count(*) FILTER (date < DATE '1996-06-01') AS nt, list_sort(list(pm10_max) FILTER (date < DATE '1996-06-01' AND pm10_max IS NOT NULL))[count(pm10_max) FILTER (date < DATE '1996-06-01') // 2 + 1] AS mt,
      list_sort(list(pm10_max) FILTER (pm10_max IS NOT NULL))[count(pm10_max) // 2 + 1] AS ma FROM daily_n GROUP BY 1)"""))
def storm_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FE.storm_thresholds(X.daily(spark, d, with_nulls=True), "1996-06-01"))


_PCTS = [10, 50, 75, 90, 95, 97, 98, 99, 99.5, 99.9]
_PCT_SQL = "(SELECT unnest([10,50,75,90,95,97,98,99,99.5,99.9])::DOUBLE AS percent)"


@query("a5_global_percentiles", "A5", sql("daily_n", f""", v AS (SELECT list_sort(list(pm10_max) FILTER (pm10_max IS NOT NULL)) AS l FROM daily_n)
    SELECT percent, round(l[least(CAST(floor(len(l)*percent/100) AS BIGINT), len(l)-1)+1],4) AS value FROM v, {_PCT_SQL}"""))
def global_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.nearest_rank(X.daily(spark, d, with_nulls=True).select("pm10_max"), "pm10_max", _PCTS))


@query("a5_column_percentiles", "A5", sql("daily", f""", u AS (UNPIVOT (SELECT pm10_max, dust_mean, precip_mm, rh_mean_pct FROM daily) ON COLUMNS(*) INTO NAME feature VALUE value),
    v AS (SELECT feature, list_sort(list(value)) AS l FROM u GROUP BY 1) SELECT feature, percent, round(l[least(CAST(floor(len(l)*percent/100) AS BIGINT), len(l)-1)+1],4) AS value FROM v, {_PCT_SQL}"""))
def column_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = PR.unpivot(X.daily(spark, d), ["pm10_max", "dust_mean", "precip_mm", "rh_mean_pct"])
    return rounded(R.nearest_rank(rows, "value", _PCTS, by="feature"))


@query("a6_exceedance_rates", "A6", sql("daily_n", """SELECT cut::DOUBLE AS cut, count(*) FILTER (pm10_max >= cut) AS days, round(100.0::DOUBLE*count(*) FILTER (pm10_max >= cut)/count(pm10_max),4) AS pct
    FROM daily_n, (SELECT unnest([200,300,400,500,700,1000]) AS cut) GROUP BY cut"""))
def exceedance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PR.exceedance(X.daily(spark, d, with_nulls=True), "pm10_max"))


@query("a7_site_exceedance", "A7", sql("daily_n", "SELECT site_id, count(pm10_max) AS days, count(*) FILTER (pm10_max >= 500) AS events, round(100.0::DOUBLE*count(*) FILTER (pm10_max >= 500)/count(pm10_max),4) AS pct FROM daily_n GROUP BY 1"))
def site_exceedance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PR.site_exceedance(X.daily(spark, d, with_nulls=True), "pm10_max", 500.0))


_REL = """, r AS (SELECT site_id, median(pm10_max) AS median, list_sort(list(pm10_max) FILTER (pm10_max IS NOT NULL)) AS l FROM daily_n GROUP BY 1),
    s AS (SELECT site_id, median, l[CAST(floor(len(l)*0.9::DOUBLE) AS BIGINT)+1] AS p90, l[CAST(floor(len(l)*0.99::DOUBLE) AS BIGINT)+1] AS p99, greatest(3*median,300) AS threshold, CAST(len(l) AS INTEGER) AS days,
      CAST(len(list_filter(l, lambda v: v >= greatest(3*median,300))) AS INTEGER) AS events FROM r) """


@query("a7_relative_storms", "A7", sql("daily_n", _REL.lstrip() + "SELECT site_id, round(median,4) AS median, round(p90,4) AS p90, round(p99,4) AS p99, round(threshold,4) AS threshold, days, events, round(100.0::DOUBLE*events/days,4) AS pct FROM s"))
def relative_storms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PR.relative_storms(X.daily(spark, d, with_nulls=True)))


@query("a7_storm_rate_summary", "A7", sql("daily_n", _REL.lstrip() + """SELECT CAST(sum(events) AS BIGINT) AS events, CAST(sum(days) AS BIGINT) AS days, round(100.0::DOUBLE*sum(events)/sum(days),4) AS pct,
      round(min(100.0::DOUBLE*events/days),4) AS min_pct, round(max(100.0::DOUBLE*events/days),4) AS max_pct, count(*) FILTER (events=0) AS sites_without_events FROM s"""))
def storm_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PR.storm_rate_summary(PR.relative_storms(X.daily(spark, d, with_nulls=True))))


@query("a8_monthly_events", "A8", sql("daily", "SELECT CAST(month(date) AS INTEGER) AS month, count(*) AS events FROM daily WHERE pm10_max >= 500 GROUP BY 1"))
def monthly_events(spark: SparkSession, d: str) -> DataFrame:
    return PR.monthly_events(X.daily(spark, d), F.col("pm10_max") >= 500)


@query("a8_monthly_relative_events", "A8", sql("daily_n", _REL.lstrip() + "SELECT CAST(month(date) AS INTEGER) AS month, count(*) AS events FROM daily_n JOIN s USING (site_id) WHERE pm10_max >= threshold GROUP BY 1"))
def monthly_relative(spark: SparkSession, d: str) -> DataFrame:
    n = X.daily(spark, d, with_nulls=True)
    cuts = PR.relative_storms(n).select("site_id", "threshold")
    return PR.monthly_events(n.join(cuts, "site_id"), F.col("pm10_max") >= F.col("threshold"))


_COLS = ["pm10_max", "pm10_mean", "dust_max", "ghi_mj_m2", "gust_max_ms", "precip_mm"]


@query("a9_column_profile", "A9", sql("daily_n", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, round(min({c}),4) AS min_value, round(avg({c}),4) AS mean_value, round(max({c}),4) AS max_value, round(100.0::DOUBLE*count({c})/count(*),3) AS non_null_pct FROM daily_n" for c in _COLS)))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PR.column_profile(X.daily(spark, d, with_nulls=True), _COLS))


@query("a9_key_profile", "A9", sql("daily", "SELECT count(*) AS n_rows, count(DISTINCT (site_id, date)) AS distinct_keys, count(*)-count(DISTINCT (site_id, date)) AS duplicate_rows FROM daily"))
def key_profile(spark: SparkSession, d: str) -> DataFrame:
    return PR.key_profile(X.daily(spark, d), ["site_id", "date"])


_SITE_PROFILE = """SELECT site_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(pm10_max) AS pm10_days, count(*) FILTER (pm10_max >= 200) AS storm_pm10,
      count(*) FILTER (coalesce(pm10_max,0) >= 200 OR coalesce(dust_max,0) >= 100) AS storm_pm10_or_dust FROM daily_n GROUP BY 1"""


@query("a10_site_profile", "A10", sql("daily_n", _SITE_PROFILE))
def site_profile(spark: SparkSession, d: str) -> DataFrame:
    return PR.site_profile(X.daily(spark, d, with_nulls=True))


@query("q8_harvest_report", "Q8 A9 K2", sql("daily_n", """SELECT n_rows, distinct_keys, n_rows-distinct_keys AS duplicate_rows, storm_pm10, storm_pm10_or_dust, pm10_pct FROM (SELECT count(*) AS n_rows, count(DISTINCT (site_id, date)) AS distinct_keys,
      count(*) FILTER (pm10_max >= 200) AS storm_pm10, count(*) FILTER (coalesce(pm10_max,0) >= 200 OR coalesce(dust_max,0) >= 100) AS storm_pm10_or_dust, round(100.0::DOUBLE*count(pm10_max)/count(*),3) AS pm10_pct FROM daily_n)"""))
def harvest_report(spark: SparkSession, d: str) -> DataFrame:
    made = RP.harvest_report(X.daily(spark, d, with_nulls=True), _COLS)
    folder = scratch(spark)
    K.write_report(made, folder)
    report = K.read_report(spark, folder, made)
    return report.select("n_rows", "distinct_keys", "duplicate_rows", "storm_pm10", "storm_pm10_or_dust",
                         F.filter("columns", lambda c: c["column_name"] == "pm10_max")[0]["non_null_pct"].alias("pm10_pct"))


@query("a12_complete_rows", "A12", sql("daily_n", "SELECT count(*) AS n_rows, count(*) FILTER (pm10_max IS NOT NULL AND pm10_mean IS NOT NULL AND dust_max IS NOT NULL) AS complete_rows FROM daily_n"))
def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    return PR.complete_rows(X.daily(spark, d, with_nulls=True), ["pm10_max", "pm10_mean", "dust_max"])


def _train(spark: SparkSession, d: str) -> DataFrame:
    """All features of the training rows; six decimals, so that the order of a sum does not make two values of one."""
    s = FE.make_samples(X.daily(spark, d), X.VAL_START).filter(F.col("date") < F.lit(X.VAL_START).cast("date"))
    return rounded(s.select(*C.FEATURES), 6)


@query("a20_feature_ranges", "A20", sql("samples", f""", u AS (UNPIVOT (SELECT {SQL_FEATURES} FROM samples WHERE date < DATE '2000-01-01') ON COLUMNS(*) INTO NAME feature VALUE value)
    SELECT feature, round(median(value),4) AS median_value, round(min(value),4) AS min_value, round(max(value),4) AS max_value, round(avg(value),4) AS mean_value, round(stddev_pop(value),4) AS std_value FROM u GROUP BY 1"""))
def feature_ranges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PR.feature_ranges(_train(spark, d), C.FEATURES))


_EDGES = """, u AS (UNPIVOT (SELECT {features} FROM samples WHERE date < DATE '2000-01-01') ON COLUMNS(*) INTO NAME feature VALUE value),
    e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {p}))) AS edges FROM u GROUP BY 1) """.replace(
    "{p}", "[" + ",".join(f"{i / 32}" for i in range(1, 32)) + "]").replace("{features}", SQL_FEATURES)


@query("a21_bin_edges", "A21", sql("samples", _EDGES.lstrip() + "SELECT feature, CAST(i AS INTEGER) AS i, round(edges[i+1],6) AS edge FROM (SELECT feature, edges, unnest(range(len(edges))) AS i FROM e)"))
def bin_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = PR.bin_edges(_train(spark, d), C.FEATURES)
    return rounded(edges.select("feature", F.posexplode("edges").alias("i", "edge")), 6)


@query("a21_bin_counts", "A21", sql("samples", _EDGES.lstrip() + "SELECT feature, CAST(len(list_filter(edges, lambda x: x < value)) AS INTEGER) AS bin, count(*) AS n FROM u JOIN e USING (feature) GROUP BY 1, 2"))
def bin_counts(spark: SparkSession, d: str) -> DataFrame:
    n = written(_train(spark, d))  # the edges and the bins both read it
    return PR.bin_values(n, C.FEATURES, PR.bin_edges(n, C.FEATURES)).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("a24_fact_counts", "A24", "SELECT count(*) AS facts, count(*) FILTER (quality=1) AS verified, count(*) FILTER (coalesce(quality,0)<>1) AS unverified FROM documents LEFT JOIN labels USING (doc_id)")
def fact_counts(spark: SparkSession, d: str) -> DataFrame:
    from dustspark.sources.text import fact_counts as count
    docs = X.documents(spark, d).join(X.table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("verified")), "doc_id", "left")
    return count(docs)


@query("u3_distinct_counts", "U3", sql("daily", "SELECT count(DISTINCT date) AS dates, count(DISTINCT site_id) AS sites FROM daily"))
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    n = X.daily(spark, d)
    return n.select("date").distinct().agg(F.count(F.lit(1)).alias("dates")).join(
        F.broadcast(n.select("site_id").distinct().agg(F.count(F.lit(1)).alias("sites"))))


@query("u4_duplicate_day_keys", "U4", "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    li = X.table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"))
    return PR.duplicate_keys(li, ["l_suppkey", "day"])
